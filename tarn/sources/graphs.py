"""Graphs: triple tables, relational tables seen as a graph, unions; and data sets of them.

A graph answers basic graph patterns with a relation, and gives its triples. TriplesGraph holds a DataFrame
(s, p, o_k, o_v, o_dt, o_lang). MappedGraph compiles the patterns on one subject to one scan of its table, with native
columns and keys; only unknown predicates look at its triples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.terms import DATATYPE_OF, E, XSD, boxed, constant, equal, lexical, same_iri, to_term
from tarn.operators.lineage import cut
from tarn.operators.relation import Relation, Var, join, union, unit

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
TRIPLES = "s string, p string, o_k string, o_v string, o_dt string, o_lang string"
COLUMNS = ["s", "p", "o_k", "o_v", "o_dt", "o_lang"]


def subject_term(c: Column) -> Column:
    """The boxed term of a subject: an IRI, or _: and a label."""
    e = F.lit("")
    return F.when(c.startswith("_:"), boxed("b", F.substring(c, 3, 1 << 30), e, e)).when(c.isNotNull(), boxed("i", c, e, e))


def matched(df: DataFrame, parts: list[tuple[tuple, E, bool]]) -> Relation:
    """Rows of df where each (pattern term, value, definite) agrees; variables get the values, and repeats must be equal."""
    vars_, cols, conditions = {}, {}, []
    for term, e, definite in parts:
        if term[0] == "var":
            if term[1] in cols:
                conditions.append(equal(cols[term[1]], e).col)
            else:
                cols[term[1]] = e
                vars_[term[1]] = Var(e.kind, e.prefix, e.lang, True)
                if not definite:
                    conditions.append(e.col.isNotNull())
        else:
            c = constant(term)
            conditions.append(same_iri(e, c) if e.kind in ("iri", "key") and c.kind == "iri" else equal(e, c).col)
    if conditions:
        df = df.where(reduce(lambda a, b: a & b, conditions))
    return Relation(df.select(*[e.col.alias(n) for n, e in cols.items()]) if cols else df.select(F.lit(1).alias("__matched")), vars_)


class Graph:
    """What the compiler needs of a graph."""

    spark: SparkSession

    def triples(self) -> DataFrame:
        raise NotImplementedError

    def bgp(self, patterns: list[tuple], wanted: set[str] | None = None) -> Relation:
        """wanted: the variables that the query uses outside these patterns; None: any."""
        return joined([self.pattern(p) for p in ordered(patterns, self.cardinality)]) if patterns else unit(self.spark)

    def pattern(self, p: tuple) -> Relation:
        s, pred, o = p
        df = self.triples()
        if s[0] == "iri":
            df = df.where(F.col("s") == s[1])
        if pred[0] == "iri":
            df = df.where(F.col("p") == pred[1])
        if o[0] in ("iri", "lit"):
            df = df.where(F.col("o_v") == o[1]) if o[0] == "iri" or o[2] == XSD + "string" else df
        obj = E("term", boxed(F.col("o_k"), F.col("o_v"), F.col("o_dt"), F.col("o_lang")))
        return matched(df, [(s, E("term", subject_term(F.col("s"))), True), (pred, E("iri", F.col("p")), True), (o, obj, True)])

    def nodes(self, among: DataFrame | None = None) -> DataFrame:
        """The subjects and objects as distinct terms (x): all, or those among distinct terms (x)."""
        t = self.triples()
        both = t.select(subject_term(F.col("s")).alias("x")).unionByName(t.select(boxed(F.col("o_k"), F.col("o_v"), F.col("o_dt"), F.col("o_lang")).alias("x")))
        return (both if among is None else both.join(among, "x", "left_semi")).distinct()

    def drop(self) -> None:
        """Called when a data set removes the graph for good."""

    def cardinality(self, p: tuple) -> float:
        """A guess at how many triples match, for the order of joins: the more is known, the fewer."""
        return sum(w for t, w in zip(p, (4, 1, 3), strict=True) if t[0] == "var")


def joined(rels: list[Relation]) -> Relation:
    return reduce(join, rels)


def ordered(patterns: list[tuple], cardinality: Callable[[tuple], float]) -> list[tuple]:
    """Patterns so that each shares a variable with an earlier one where it can, the smallest first."""
    left, out, known = list(patterns), [], set()
    while left:
        near = [p for p in left if not known or known & {t[1] for t in p if t[0] == "var"}] or left
        p = min(near, key=cardinality)
        left.remove(p)
        out.append(p)
        known |= {t[1] for t in p if t[0] == "var"}
    return out


class TriplesGraph(Graph):
    """A graph of a DataFrame of triples; updates replace the DataFrame, snapshot by snapshot."""

    def __init__(self, df: DataFrame):
        self.spark, self.df = df.sparkSession, df.select(*COLUMNS)
        self.counts: dict[str, int] | None = None

    def triples(self) -> DataFrame:
        return self.df

    def snapshot(self, df: DataFrame) -> DataFrame:
        """df computed once, to be swapped in; the graph stays as it is."""
        return cut(df.select(*COLUMNS))

    def swap(self, df: DataFrame) -> None:
        self.df, self.counts = df, None

    def insert(self, triples: DataFrame) -> None:
        self.swap(self.snapshot(self.df.unionByName(triples.select(*COLUMNS)).distinct()))

    def delete(self, triples: DataFrame) -> None:
        self.swap(self.snapshot(self.df.join(triples.select(*COLUMNS).distinct(), COLUMNS, "left_anti")))

    def clear(self) -> None:
        self.swap(self.spark.createDataFrame([], TRIPLES))

    def analyze(self) -> None:
        """Counts triples by predicate, for the order of joins (10,000 predicates at most are kept)."""
        self.counts = {r[0]: r[1] for r in self.df.groupBy("p").count().orderBy(F.desc("count")).limit(10_000).collect()}

    def cardinality(self, p: tuple) -> float:
        if self.counts is None:
            return super().cardinality(p)
        n = self.counts.get(p[1][1], 0) if p[1][0] == "iri" else sum(self.counts.values())
        return n * (1e-3 if p[0][0] != "var" else 1) * (1e-2 if p[2][0] != "var" else 1)


class UnionGraph(Graph):
    """The distinct triples of several graphs."""

    def __init__(self, graphs: list[Graph]):
        self.graphs, self.spark = graphs, graphs[0].spark

    def triples(self) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [g.triples() for g in self.graphs]).distinct()

    def nodes(self, among: DataFrame | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, [g.nodes(among) for g in self.graphs]).distinct()


@dataclass
class TableMap:
    """A table as triples: prefix + key is a row's subject; columns and references (to another prefix) its properties.

    key None: rows have no key; the subject is a hash of all columns and a number among equal rows, and only made if
    a query needs it.
    """

    name: str
    prefix: str
    key: str | None
    columns: dict[str, str] = field(default_factory=dict)  # predicate IRI -> column
    references: dict[str, tuple[str, str]] = field(default_factory=dict)  # predicate IRI -> (column, prefix)
    type_iri: str | None = None


KINDS = {"string": "str", "double": "dbl", "float": "dbl", "boolean": "bool", "timestamp_ntz": "dt", "timestamp": "dt", "date": "str"}

#: So many keys or hashes at most are sent to all executors, to be looked for in a column.
MOST_BROADCAST_KEYS = 100_000


def row_hash(df: DataFrame) -> Column:
    return F.hex(F.xxhash64(*df.columns))


class MappedGraph(Graph):
    def __init__(self, spark: SparkSession, maps: list[TableMap], read: Callable[[str], DataFrame]):
        self.spark, self.maps, self.source, self.tables = spark, maps, read, {}
        self.by_predicate = {p: m for m in maps for p in (*m.columns, *m.references)}
        self.by_type = {m.type_iri: m for m in maps if m.type_iri}

    def read(self, name: str) -> DataFrame:
        return self.table(name)[0]

    def table(self, name: str) -> tuple[DataFrame, dict[str, str]]:
        """A table and the types of its columns; the source is asked once."""
        if name not in self.tables:
            df = self.source(name)
            self.tables[name] = df, dict(df.dtypes)
        return self.tables[name]

    def column(self, m: TableMap, name: str, kind: str) -> Column:
        """A column, cast where it isn't of that type already."""
        return F.col(name) if self.table(m.name)[1][name] == kind else F.col(name).cast(kind)

    def value(self, m: TableMap, predicate: str) -> E:
        if predicate in m.references:
            c, prefix = m.references[predicate]
            return E("key", self.column(m, c, "bigint"), prefix)
        c = m.columns[predicate]
        t = self.table(m.name)[1][c]
        kind = KINDS.get(t, "dbl" if t.startswith("decimal") else "int")
        return E(kind, self.column(m, c, {"int": "bigint", "dbl": "double", "dt": "timestamp_ntz", "bool": "boolean"}.get(kind, "string")))

    def subject(self, m: TableMap, df: DataFrame) -> tuple[DataFrame, E]:
        if m.key:
            return df, E("key", self.column(m, m.key, "bigint"), m.prefix)
        same = F.row_number().over(Window.partitionBy(*df.columns).orderBy(F.lit(1)))
        df = df.withColumn("__id", F.concat(row_hash(df), F.lit("-"), same.cast("string")))
        return df, E("iri", F.concat(F.lit(m.prefix), F.col("__id")))

    def bgp(self, patterns: list[tuple], wanted: set[str] | None = None) -> Relation:
        """Stars: patterns on one subject and table are one scan; stars are joined on native keys."""
        stars: dict[tuple, list[tuple]] = {}
        rels, every = [], [t for p in patterns for t in p]
        for p in patterns:
            s, pred, o = p
            m = self.by_predicate.get(pred[1]) if pred[0] == "iri" else None
            if pred == ("iri", RDF_TYPE) and o[0] == "iri":
                m = self.by_type.get(o[1])
                if m is None:
                    rels.append(self.pattern(p))
                    continue
            if m is None:
                rels.append(self.pattern(p))
            else:
                stars.setdefault((s, m.name), []).append(p)
        by_name = {m.name: m for m in self.maps}
        for (s, name), star in stars.items():
            # a subject that nothing else names need not be made
            with_subject = s[0] != "var" or wanted is None or s[1] in wanted or sum(t == s for t in every) > len(star)
            rels.append(self.star(by_name[name], s, star, with_subject))
        return joined(connected(rels)) if rels else unit(self.spark)

    def star(self, m: TableMap, s: tuple, star: list[tuple], with_subject: bool) -> Relation:
        df = self.read(m.name)
        parts = [(o, self.value(m, pred[1]), False) for _, pred, o in star if pred[1] != RDF_TYPE]
        if with_subject:
            df, e = self.subject(m, df)
            parts.insert(0, (s, e, True))
        return matched(df, parts)

    def nodes(self, among: DataFrame | None = None) -> DataFrame:
        """Given terms are counted by prefix, type and datatype first; only columns that may hold them are read, natively."""
        if among is None:
            return super().nodes()
        x, e = F.col("x"), F.lit("")
        prefixes = sorted({m.prefix for m in self.maps} | {p for m in self.maps for _, p in m.references.values()})
        tests = {p: (x["k"] == "i") & x["v"].startswith(p) for p in prefixes} | {t: (x["k"] == "i") & (x["v"] == t) for t in self.by_type}
        literal = (x["k"] == "l") & (x["lang"] == "")
        tests |= {("l", k): literal & (x["dt"] == DATATYPE_OF[k]) for k in sorted({*KINDS.values(), "int"})}
        counts = dict(zip(tests, among.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(tests.values())]).first(), strict=True))
        found = [among.where("false")]
        for p in filter(counts.get, prefixes):
            found += self.keys_among(p, among.where(tests[p]), counts[p])
        for t in filter(counts.get, self.by_type):
            found += [self.read(m.name).limit(1).select(boxed("i", F.lit(t), e, e).alias("x")) for m in self.maps if m.type_iri == t]
        kinds = {k for k in {*KINDS.values(), "int"} if counts["l", k]}
        for m in self.maps if kinds else ():
            for v in (self.value(m, c) for c in m.columns):
                if v.kind in kinds:
                    texts = self.read(m.name).select(lexical(v).alias("v")).join(among.where(tests["l", v.kind]).select(x["v"].alias("v")), "v", "left_semi")
                    found.append(texts.distinct().select(boxed("l", F.col("v"), F.lit(DATATYPE_OF[v.kind]), e).alias("x")))
        return reduce(DataFrame.unionByName, found).distinct()

    def keys_among(self, prefix: str, iris: DataFrame, count: int) -> list[DataFrame]:
        """Which of the IRIs of a prefix, as terms (x), are subjects or references."""
        e, text = F.lit(""), F.substring(F.col("x")["v"], len(prefix) + 1, 1 << 30)
        small = F.broadcast if count <= MOST_BROADCAST_KEYS else lambda df: df
        keys = small(iris.select(text.alias("__text"), text.try_cast("bigint").alias("__key")).where("__text = string(__key)").select("__key"))
        found = []
        for m in self.maps:
            columns = [(self.read(m.name), self.value(m, p).col) for p, (_, to) in m.references.items() if to == prefix]
            if m.prefix == prefix and m.key:
                columns.append((self.subject_rows(m), self.column(m, m.key, "bigint")))
            for df, c in columns:
                met = df.select(c.alias("__key")).join(keys, "__key", "left_semi").distinct()
                found.append(met.select(boxed("i", F.concat(F.lit(prefix), F.col("__key").cast("string")), e, e).alias("x")))
            if m.prefix == prefix and not m.key:
                # equal rows have equal hashes, so rows of other hashes don't change the numbers among equal ones
                df = self.subject_rows(m)
                hashes = small(iris.select(F.substring_index(text, "-", 1).alias("__hash")).distinct())
                df, s = self.subject(m, df.join(hashes, row_hash(df) == F.col("__hash"), "left_semi"))
                found.append(df.select(to_term(s).col.alias("x")).join(iris, "x", "left_semi"))
        return found

    def subject_rows(self, m: TableMap) -> DataFrame:
        """The rows that are subjects of triples: all of a table with a type, else those with a value."""
        df = self.read(m.name)
        if m.type_iri:
            return df
        return df.where(reduce(Column.__or__, [self.value(m, p).col.isNotNull() for p in (*m.columns, *m.references)], F.lit(False)))

    def triples(self) -> DataFrame:
        """All tables as triples, a scan of each."""
        return reduce(lambda a, b: a.unionByName(b), [self.table_triples(m) for m in self.maps])

    def table_triples(self, m: TableMap, predicates: set[str] | None = None) -> DataFrame:
        df, s = self.subject(m, self.read(m.name))
        out = []
        for p in (*m.columns, *m.references):
            if predicates is None or p in predicates:
                t = to_term(self.value(m, p)).col
                out.append(F.struct(F.lit(p).alias("p"), t["k"].alias("o_k"), t["v"].alias("o_v"), t["dt"].alias("o_dt"), t["lang"].alias("o_lang")))
        if m.type_iri and (predicates is None or RDF_TYPE in predicates):
            e = F.lit("")
            out.append(F.struct(F.lit(RDF_TYPE).alias("p"), F.lit("i").alias("o_k"), F.lit(m.type_iri).alias("o_v"), e.alias("o_dt"), e.alias("o_lang")))
        return df.select(lexical(s).alias("s"), F.inline(F.array(*out))).where("o_v is not null")

    def pattern(self, p: tuple) -> Relation:
        """A pattern with an unknown predicate: only tables that its subject's prefix and predicate allow are looked at."""
        s, pred, o = p
        maps = [m for m in self.maps if s[0] != "iri" or s[1].startswith(m.prefix)]
        if pred[0] == "iri":
            maps = [m for m in maps if pred[1] == RDF_TYPE or pred[1] in m.columns or pred[1] in m.references]
        if not maps:
            return matched(self.spark.createDataFrame([], TRIPLES), [(t, E("term", subject_term(F.col("s"))), True) for t in p if t[0] == "var"])
        found = []
        for m in maps:
            df = self.table_triples(m, {pred[1]} if pred[0] == "iri" else None)
            if s[0] == "iri" and m.key:  # the key's filter reaches the scan
                key = s[1][len(m.prefix) :]
                if not key.lstrip("-").isdigit():
                    continue
                df = MappedGraph(self.spark, [m], lambda n, k=m.key, v=int(key): self.read(n).where(F.col(k) == v)).table_triples(m, {pred[1]} if pred[0] == "iri" else None)
            found.append(df)
        if not found:
            found = [self.spark.createDataFrame([], TRIPLES)]
        return TriplesGraph(reduce(lambda a, b: a.unionByName(b), found)).pattern(p)


def connected(rels: list[Relation]) -> list[Relation]:
    """Relations so that each shares a variable with an earlier one where it can, the ones of most filters first."""
    left, out, known = list(rels), [], set()
    while left:
        r = next((r for r in left if known & set(r.vars)), left[0])
        left.remove(r)
        out.append(r)
        known |= set(r.vars)
    return out


class Dataset:
    """A default graph and named ones; factory(iri) makes a named graph when one is asked for that isn't there.

    default_is_named: GRAPH ?g also visits the default graph, under default_iri.
    """

    def __init__(self, default: Graph, named: dict[str, Graph] | None = None, default_iri: str = "urn:default", factory: Callable[[str], Graph] | None = None, default_is_named: bool = False):
        self.default, self.named, self.default_iri, self.factory, self.default_is_named = default, dict(named or {}), default_iri, factory, default_is_named

    @property
    def spark(self) -> SparkSession:
        return self.default.spark

    def get(self, iri: str) -> Graph:
        if iri == self.default_iri:
            return self.default
        if iri not in self.named:
            if not self.factory:
                raise KeyError(f"unknown graph {iri}")
            self.named[iri] = self.factory(iri)
        return self.named[iri]

    def has(self, iri: str) -> bool:
        return iri in self.named

    def add(self, iri: str, graph: Graph) -> None:
        self.named[iri] = graph

    def delete(self, iri: str) -> None:
        del self.named[iri]

    def union_graph(self, iris: list[str], with_default: bool = False) -> Graph:
        graphs = [*([self.default] if with_default else []), *(self.get(i) for i in iris)]
        return graphs[0] if len(graphs) == 1 else UnionGraph(graphs)

    def all_graphs(self) -> dict[str, Graph]:
        return ({self.default_iri: self.default} if self.default_is_named else {}) | self.named


def empty_graph(spark: SparkSession) -> TriplesGraph:
    return TriplesGraph(spark.createDataFrame([], TRIPLES))


__all__ = ["Dataset", "Graph", "MappedGraph", "TableMap", "TriplesGraph", "UnionGraph", "empty_graph", "union"]
