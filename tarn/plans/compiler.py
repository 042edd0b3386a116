"""From the syntax tree to DataFrames, bottom-up. The optimizer of the session does the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from tarn.functions import aggregates
from tarn.functions.scalar import CASTS, EXTENSIONS, UnsupportedOperation, evaluated, strsplit
from tarn.functions.terms import E, boxed, constant, ebv, lexical, n3, null, order_keys, to_term
from tarn.operators import search
from tarn.operators.cache import BGPCache
from tarn.operators.lineage import cut
from tarn.operators.paths import closure
from tarn.operators.relation import Relation, Var, distinct, join, left_join, marked, minus, semi, union, unit
from tarn.plans.parser import Query
from tarn.sources.graphs import COLUMNS, TRIPLES, Dataset, Graph, matched

#: Local names of the extension functions, aggregates, full-text predicates and hints stand behind these namespaces.
NAMESPACES = {"functions": "urn:tarn:functions#", "aggregates": "urn:tarn:aggregates#", "search": "urn:tarn:search#", "hint": "urn:tarn:hint#"}
HINTS = {"HashJoin": "shuffle_hash", "SymmetricHashJoin": "shuffle_hash", "SortedMergeJoin": "merge", "NestedLoopJoin": "shuffle_replicate_nl", "Broadcast": "broadcast"}


@dataclass
class Options:
    """compat: REPLACE takes the first match only. functions: IRI -> function of typed columns, or (E, array) generators."""

    compat: bool = False
    namespaces: dict[str, str] = field(default_factory=lambda: dict(NAMESPACES))
    functions: dict[str, Callable[[list[E]], object]] = field(default_factory=dict)
    rules: list[Callable[[list], list]] = field(default_factory=list)  # each takes and gives a group
    elements: dict[str, Callable] = field(default_factory=dict)  # own compilers of group elements, by their first item
    services: dict[str, Graph] = field(default_factory=dict)
    cache: BGPCache | None = None


@dataclass(frozen=True)
class Context:
    """Which graphs the patterns look at."""

    graph: Graph
    named: tuple[str, ...] | None = None  # FROM NAMED; None: all
    key: str = ""  # names the graph in the cache
    wanted: frozenset | None = None
    limited: bool = False


def variables(x: object) -> set[str]:
    """All variables named in a piece of the tree."""
    if isinstance(x, Query):
        return variables([x.items, x.where, x.group_by, x.having, x.order_by, x.template, x.describe]) | {i for i in x.items if isinstance(i, str)}
    if isinstance(x, tuple) and len(x) == 2 and x[0] == "var" and isinstance(x[1], str):
        return {x[1]}
    if isinstance(x, tuple | list):
        if isinstance(x, tuple) and x and x[0] == "values":
            return set(x[1])
        extra = {x[2]} if isinstance(x, tuple) and len(x) == 3 and x[0] == "bind" else set()
        return extra.union(*(variables(i) for i in x)) if x else extra
    return set()


class Compiler:
    def __init__(self, dataset: Dataset, options: Options | None = None):
        self.dataset, self.options, self.spark = dataset, options or Options(), dataset.spark
        self.fresh = 0

    def name(self, what: str) -> str:
        self.fresh += 1
        return f"__{what}{self.fresh}"

    # queries
    def context(self, q: Query) -> Context:
        graph, key = self.dataset.default, self.dataset.default_iri
        if q.default_graphs:
            graph, key = self.dataset.union_graph(q.default_graphs), "+".join(q.default_graphs)
        named = tuple(q.named_graphs) if q.named_graphs or q.default_graphs else None
        return Context(graph, named, key)

    def solutions(self, q: Query, ctx: Context | None = None) -> Relation:
        """The relation of a query's solutions: projected, in order and cut for SELECT."""
        ctx = ctx or self.context(q)
        if q.form == "select" and q.items:
            wanted = variables([q.items, q.group_by, q.having, q.order_by]) | {i if isinstance(i, str) else i[1] for i in q.items}
            ctx = replace(ctx, wanted=frozenset(wanted))
        ctx = replace(ctx, limited=q.limit is not None or q.offset > 0)
        rel = self.group(q.where, ctx)
        items = list(q.items) or [n for n in rel.vars if not n.startswith("__")]
        aggs: list[tuple[str, tuple]] = []
        pull = lambda e: self.pulled(e, aggs)
        pulled_items = [(pull(i[0]), i[1]) if isinstance(i, tuple) else i for i in items]
        having = [pull(e) for e in q.having]
        order = [(pull(e), d) for e, d in q.order_by]
        if q.group_by or aggs:
            rel = self.grouped(rel, q.group_by, aggs, ctx)
        for e in having:
            rel, e = self.with_exists(rel, e, ctx)
            rel = rel.where(ebv(self.expr(e, rel)))
        for i in pulled_items:
            if isinstance(i, tuple):
                rel = self.bound(rel, i[0], i[1], ctx)
        names = [i if isinstance(i, str) else i[1] for i in items]
        if q.form != "select":
            return self.sliced(self.sorted(rel, order), q)
        if not q.distinct:
            rel = self.sorted(rel, order)
        for n in names:
            if n not in rel.vars:
                rel = rel.extend(n, null())
        rel = rel.keep(list(dict.fromkeys(names)))
        if q.distinct:
            rel = self.sorted(distinct(rel), order)
        return self.sliced(rel, q)

    def sorted(self, rel: Relation, order: list) -> Relation:
        keys = []
        for e, descending in order:
            for c in order_keys(self.expr(e, rel)):
                keys.append(c.desc_nulls_last() if descending else c.asc_nulls_first())
        return Relation(rel.df.orderBy(*keys), rel.vars) if keys else rel

    def sliced(self, rel: Relation, q: Query) -> Relation:
        df = rel.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Relation(df, rel.vars)

    def pulled(self, e: object, aggs: list) -> object:
        """e with its aggregates replaced by variables; they are added to aggs."""
        if isinstance(e, tuple):
            if e and (e[0] == "agg" or (e[0] == "call" and e[1].startswith(self.options.namespaces["aggregates"]))):
                for n, a in aggs:
                    if a == e:
                        return ("var", n)
                aggs.append((self.name("agg"), e))
                return ("var", aggs[-1][0])
            if e and e[0] == "exists":
                return e
            return tuple(self.pulled(x, aggs) for x in e)
        return [self.pulled(x, aggs) for x in e] if isinstance(e, list) else e

    def grouped(self, rel: Relation, by: list, aggs: list, ctx: Context) -> Relation:
        names = []
        for e, name in by:
            if name is None and e[0] == "var":
                names.append(e[1])
                if e[1] not in rel.vars:
                    rel = rel.extend(e[1], null())
            else:
                names.append(name or self.name("key"))
                rel = self.bound(rel, e, names[-1], ctx)
        cols, vars_ = [], {n: rel.vars[n] for n in names}
        for n, a in aggs:
            if a[0] == "agg":
                _, f, arg, dist, sep = a
                row = F.struct(*[F.col(f"`{v}`") for v in rel.vars if not v.startswith("__")]) if arg == "*" and dist and rel.vars else F.lit(1)
                x = aggregates.aggregate(f, None if arg == "*" else self.expr(arg, rel), dist, sep, row)
            else:
                local = a[1][len(self.options.namespaces["aggregates"]) :].lower()
                if local not in aggregates.EXTENSIONS:
                    raise UnsupportedOperation(f"unknown aggregate: {a[1]}")
                x = E("dbl", aggregates.EXTENSIONS[local](*[self.expr(y, rel) for y in a[2]]))
            cols.append(x.col.alias(n))
            vars_[n] = Var(x.kind, x.prefix, x.lang, definite=a[0] == "agg" and a[1] in ("COUNT", "SUM", "GROUP_CONCAT"))
        keys = [F.col(f"`{n}`") for n in names]
        if not cols:
            return Relation(rel.df.select(*keys).distinct(), vars_)
        return Relation(rel.df.groupBy(*keys).agg(*cols), vars_)

    # forms
    def select(self, q: Query, native: bool = True) -> DataFrame:
        rel = self.solutions(q)
        return rel.df.select(*[(self.native(rel.e(n)) if native else n3(rel.e(n))).alias(n) for n in rel.vars])

    @staticmethod
    def native(e: E):
        if e.kind in ("key",):
            return lexical(e)
        return n3(e) if e.kind == "term" else e.col

    def ask(self, q: Query) -> DataFrame:
        rel = self.solutions(replace(q, limit=1))
        return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))

    def construct(self, q: Query, dedupe: bool = True) -> DataFrame:
        return self.instantiated(q.template, self.solutions(q), dedupe)

    def instantiated(self, template: list, rel: Relation, dedupe: bool = True) -> DataFrame:
        """The triples of a template for each solution; those with an unbound part or a literal subject are left out."""
        out = None
        label = F.monotonically_increasing_id().cast("string")
        df = rel.df.withColumn("__solution", label) if any(t[0] == "bnode" for p in template for t in p) else rel.df
        for p in template:
            s, pred, o = (self.template_term(t, rel) for t in p)
            d = df.select(F.when(s["k"] == "b", F.concat(F.lit("_:"), s["v"])).when(s["k"] == "i", s["v"]).alias("s"), F.when(pred["k"] == "i", pred["v"]).alias("p"), o["k"].alias("o_k"), o["v"].alias("o_v"), o["dt"].alias("o_dt"), o["lang"].alias("o_lang"))
            out = d if out is None else out.unionByName(d)
        if out is None:
            return self.spark.createDataFrame([], TRIPLES)
        out = out.where("s is not null and p is not null and o_v is not null")
        return out.distinct() if dedupe else out

    def template_term(self, t: tuple, rel: Relation):
        if t[0] == "var":
            return to_term(rel.e(t[1]) if t[1] in rel.vars else null()).col
        if t[0] == "bnode":
            return boxed("b", F.concat(F.lit(t[1] + "_"), F.col("__solution")), F.lit(""), F.lit(""))
        return to_term(constant(t)).col

    def describe(self, q: Query) -> DataFrame:
        """All triples whose subject is described."""
        ctx = self.context(q)
        rel = self.solutions(q, ctx) if q.where else None
        terms = q.describe or [("var", n) for n in (rel.vars if rel else ())]
        parts = [rel.df.select(to_term(rel.e(t[1])).col.alias("t")) for t in terms if t[0] == "var" and rel and t[1] in rel.vars]
        any_of = ("var", "__p"), ("var", "__o")
        known = [self.instantiated([(t, *any_of)], ctx.graph.bgp([(t, *any_of)], None)) for t in terms if t[0] == "iri"]
        out = reduce(DataFrame.unionByName, known).distinct() if known else self.spark.createDataFrame([], TRIPLES)
        if not parts:
            return out
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        subjects = df.select(F.when(F.col("t")["k"] == "i", F.col("t")["v"]).when(F.col("t")["k"] == "b", F.concat(F.lit("_:"), F.col("t")["v"])).alias("s")).where("s is not null").distinct()
        found = ctx.graph.triples().join(subjects, "s", "left_semi").select(*COLUMNS)
        return (found.unionByName(out) if known else found).distinct()

    # groups
    def group(self, elements: list, ctx: Context) -> Relation:
        rel, late = self.open_group(elements, ctx)
        for e in late:
            rel, e = self.with_exists(rel, e, ctx)
            rel = rel.where(ebv(self.expr(e, rel)))
        marks = [n for n in rel.vars if n.startswith("__ex")]
        return Relation(rel.df.drop(*marks), {n: v for n, v in rel.vars.items() if n not in marks}) if marks else rel

    def open_group(self, elements: list, ctx: Context, defer: bool = False) -> tuple[Relation, list]:
        """The relation of a group, and with defer those filters that name variables from outside it."""
        for rule in self.options.rules:
            elements = rule(elements)
        filters = [x[1] for x in elements if x[0] == "filter"]
        rest = [x for x in elements if x[0] != "filter"]
        rel = unit(self.spark)
        for k, x in enumerate(rest):
            inner = ctx
            if ctx.wanted is not None:
                inner = replace(ctx, wanted=ctx.wanted | variables([filters, rest[:k], rest[k + 1 :]]))
            rel = self.element(rel, x, inner)
        late = []
        for e in filters:
            if e[0] == "exists":
                b, outer = self.open_group(e[1], replace(ctx, wanted=None), defer=True)
                rel = semi(rel, b, e[2], self.condition(outer, ctx) if outer else None)
            elif defer and variables(e) - set(rel.vars):
                late.append(e)
            else:
                rel, e2 = self.with_exists(rel, e, ctx)
                rel = rel.where(ebv(self.expr(e2, rel)))
        return rel, late

    def condition(self, filters: list, ctx: Context):
        def run(both: Relation):
            c = F.lit(True)
            for e in filters:
                c = c & ebv(self.expr(e, both))
            return c

        return run

    def with_exists(self, rel: Relation, e: object, ctx: Context) -> tuple[Relation, object]:
        """e with each EXISTS inside it replaced by a column of rel that says whether it holds."""
        if isinstance(e, tuple) and e and e[0] == "exists":
            b, outer = self.open_group(e[1], replace(ctx, wanted=None), defer=True)
            n = self.name("ex")
            rel = marked(rel, b, n, self.condition(outer, ctx) if outer else None)
            return rel, ("column", n) if e[2] else ("op", "!", [("column", n)])
        if isinstance(e, tuple | list):
            parts = []
            for x in e:
                rel, x = self.with_exists(rel, x, ctx)
                parts.append(x)
            return rel, type(e)(parts)
        return rel, e

    def element(self, rel: Relation, x: tuple, ctx: Context) -> Relation:
        kind = x[0]
        if kind in self.options.elements:
            return self.options.elements[kind](self, rel, x, ctx)
        if kind == "triples":
            return self.triples(rel, x[1], ctx)
        if kind == "group":
            return join(rel, self.group(x[1], ctx))
        if kind == "optional":
            b, outer = self.open_group(x[1], ctx, defer=True)
            return left_join(rel, b, self.condition(outer, ctx) if outer else None)
        if kind == "union":
            sides = [self.group(g, ctx) for g in x[1]]
            out = sides[0]
            for s in sides[1:]:
                out = union(out, s)
            return join(rel, out)
        if kind == "minus":
            return minus(rel, self.group(x[1], replace(ctx, wanted=None)))
        if kind == "bind":
            rel, e = self.with_exists(rel, x[1], ctx)
            return self.bound(rel, e, x[2], ctx)
        if kind == "values":
            return join(rel, self.values(x[1], x[2]), "broadcast")
        if kind == "select":
            return join(rel, self.solutions(x[1], replace(ctx, wanted=None)))
        if kind == "graph":
            return join(rel, self.in_graph(x[1], x[2], ctx))
        if kind == "service":
            return join(rel, self.service(x[1], x[2], x[3], ctx))
        raise UnsupportedOperation(f"unknown element {kind}")

    def in_graph(self, term: tuple, group: list, ctx: Context) -> Relation:
        if term[0] == "iri":
            return self.group(group, replace(ctx, graph=self.dataset.get(term[1]), key=term[1]))
        graphs = self.dataset.all_graphs() if ctx.named is None else {i: self.dataset.get(i) for i in ctx.named}
        out = None
        for iri, g in graphs.items():
            one = self.group(group, replace(ctx, graph=g, key=iri))
            g_var = Relation(self.spark.range(1).select(F.lit(iri).alias(term[1])), {term[1]: Var("iri")})
            one = join(one, g_var)
            out = one if out is None else union(out, one)
        if out is None:
            return Relation(self.spark.range(0).select(F.lit("").alias(term[1])), {term[1]: Var("iri")})
        return out

    def service(self, term: tuple, group: list, silent: bool, ctx: Context) -> Relation:
        try:
            if term[0] != "iri":
                raise UnsupportedOperation("SERVICE needs an IRI")
            graph = self.options.services.get(term[1]) or self.dataset.get(term[1])
            rel = self.group(group, replace(ctx, graph=graph, key=term[1], named=None))
            if silent:
                rel.df = cut(rel.df)  # what any of its partitions raises must show here
            return rel
        except (KeyError, ValueError, OSError, PySparkException, Py4JJavaError):
            if not silent:
                raise
            return unit(self.spark)

    def values(self, names: list[str], rows: list) -> Relation:
        vars_, cols, types = {}, [], []
        native = {"int": "bigint", "dbl": "double", "bool": "boolean"}
        for k, n in enumerate(names):
            terms = [r[k] for r in rows if r[k] is not None]
            kinds = {constant(t).kind for t in terms}
            kind = kinds.pop() if len(kinds) == 1 else "term"
            if kind not in ("iri", "str", "int", "dbl", "bool"):
                kind = "term"
            vars_[n] = Var(kind, definite=all(r[k] is not None for r in rows))
            types.append(f"`{n}` " + (native.get(kind, "string") if kind != "term" else "struct<k:string,v:string,dt:string,lang:string>"))
            cols.append(kind)

        def value(t, kind):
            if t is None:
                return None
            if kind == "term":
                return {"iri": ("i", t[1], "", ""), "bnode": ("b", t[1], "", "")}.get(t[0]) or ("l", t[1], t[2], t[3])
            return {"int": int, "dbl": float, "bool": lambda v: v in ("true", "1")}.get(kind, str)(t[1])

        df = self.spark.createDataFrame([tuple(value(t, c) for t, c in zip(r, cols, strict=True)) for r in rows], ", ".join(types))
        return Relation(df, vars_)

    def bound(self, rel: Relation, e: tuple, name: str, ctx: Context) -> Relation:
        """BIND: a generator gives a solution for each part; an error leaves the variable unbound."""
        if e[0] == "call":
            local = e[1].removeprefix(self.options.namespaces["functions"])
            if e[1] not in self.options.functions and local.lower() == "strsplit" and local != e[1]:
                one, parts = strsplit([self.expr(a, rel) for a in e[2]])
                return Relation(rel.df.withColumn(name, F.explode(parts)), rel.vars | {name: Var(one.kind)})
            if e[1] in self.options.functions:
                got = self.options.functions[e[1]]([self.expr(a, rel) for a in e[2]])
                if isinstance(got, tuple):
                    return Relation(rel.df.withColumn(name, F.explode(got[1])), rel.vars | {name: Var(got[0].kind, got[0].prefix, got[0].lang)})
                return rel.extend(name, got)
        return rel.extend(name, self.expr(e, rel))

    # patterns
    def triples(self, rel: Relation, patterns: list, ctx: Context) -> Relation:
        hide = lambda t: ("var", f"__hidden_{t[1]}") if t[0] == "bnode" else t
        patterns = [tuple(hide(t) if t[0] == "bnode" else t for t in p) for p in patterns]
        hint = None
        ns = self.options.namespaces
        if any(p[1][0] == "iri" and p[1][1].startswith(ns["hint"]) for p in patterns):
            for p in patterns:
                if p[1][0] == "iri" and p[1][1].startswith(ns["hint"]) and p[2][1] == "true":
                    hint = HINTS.get(p[1][1][len(ns["hint"]) :], hint)
            patterns = [p for p in patterns if not (p[1][0] == "iri" and p[1][1].startswith(ns["hint"])) and not (p[0][0] == "iri" and p[0][1].startswith(ns["hint"]))]
        plain = [p for p in patterns if p[1][0] in ("iri", "var")]
        magic = [p for p in plain if p[1][0] == "iri" and p[1][1].startswith(ns["search"])]
        plain = [p for p in plain if p not in magic]
        paths = [p for p in patterns if p[1][0] not in ("iri", "var")]
        outside = None if ctx.wanted is None else set(ctx.wanted) | variables([paths, magic]) | set(rel.vars)
        found = search.evaluated(self, plain, magic, ns["search"], ctx, outside) if magic else self.bgp(plain, ctx, outside)
        out = join(rel, found, hint)
        for s, path, o in paths:
            out = join(out, self.path(s, path, o, ctx, out), hint)
        hidden = [n for n in out.vars if n.startswith("__hidden_")]
        return out.keep([n for n in out.vars if n not in hidden]) if hidden and len(hidden) < len(out.vars) else out

    def bgp(self, patterns: list, ctx: Context, outside: set[str] | None) -> Relation:
        if not patterns:
            return unit(self.spark)
        if self.options.cache is None:
            return ctx.graph.bgp(patterns, outside)
        return self.options.cache.evaluated(patterns, ctx.key, lambda ps: ctx.graph.bgp(ps, None), fill=not ctx.limited)

    def path(self, s: tuple, path: tuple, o: tuple, ctx: Context, given: Relation | None = None) -> Relation:
        """given: what the path will be joined with; its values of an end seed closures."""
        kind = path[0]
        if kind == "iri":
            return ctx.graph.bgp([(s, path, o)], None)
        if kind == "inv":
            return self.path(o, path[1], s, ctx, given)
        if kind == "seq":
            rel, here, hidden = unit(self.spark), s, []
            for k, p in enumerate(path[1]):
                there = o if k == len(path[1]) - 1 else ("var", self.name("step"))
                rel = join(rel, self.path(here, p, there, ctx, rel if k else given))
                if there is not o:
                    hidden.append(there[1])
                here = there
            rest = [n for n in rel.vars if n not in hidden]
            return rel.keep(rest) if rest else Relation(rel.df.select(F.lit(1).alias("__path")), {})
        if kind == "alt":
            rels = [self.path(s, p, o, ctx, given) for p in path[1]]
            out = rels[0]
            for r in rels[1:]:
                out = union(out, r)
            return out
        if kind == "neg":
            forward, backward = [i for i, inv in path[1] if not inv], [i for i, inv in path[1] if inv]
            sides = []
            for names, a, b in ((forward, s, o), (backward, o, s)):
                if names:
                    p = ("var", self.name("pred"))
                    r = ctx.graph.bgp([(a, p, b)], None)
                    r = r.where(~lexical(r.e(p[1])).isin(names))
                    rest = [n for n in r.vars if n != p[1]]
                    sides.append(r.keep(rest) if rest else Relation(r.df.select(F.lit(1).alias("__path")), {}))
            return sides[0] if len(sides) == 1 else union(*sides)
        return self.closed(s, kind, path[1], o, ctx, given)

    def closed(self, s: tuple, kind: str, inner: tuple, o: tuple, ctx: Context, given: Relation | None = None) -> Relation:
        """p+, p* and p?: distinct pairs, from the end that is known, or that given binds in each solution."""
        x, y = ("var", self.name("x")), ("var", self.name("y"))
        r = self.path(x, inner, y, ctx)
        pairs = r.df.select(to_term(r.e(x[1])).col.alias("x"), to_term(r.e(y[1])).col.alias("y"))
        fixed = lambda t: None if t[0] == "var" else to_term(constant(t)).col
        seeds: dict[str, DataFrame] = {}
        if s[0] == o[0] == "var" and given is not None:
            known = [(end, t[1]) for end, t in (("starts", s), ("ends", o)) if t[1] in given.vars and given.vars[t[1]].definite]
            seeds = {end: given.df.select(to_term(given.e(n)).col.alias("x")) for end, n in known[:1]}
        pairs = closure(pairs, kind, fixed(s), fixed(o), ctx.graph.nodes, **seeds)
        return matched(pairs, [(s, E("term", F.col("x")), True), (o, E("term", F.col("y")), True)])

    # expressions
    def expr(self, e: tuple, rel: Relation) -> E:
        kind = e[0]
        if kind == "var":
            return rel.e(e[1]) if e[1] in rel.vars else null()
        if kind == "column":
            return E("bool", F.col(e[1]))
        if kind in ("iri", "lit", "bnode"):
            return constant(e)
        if kind == "op":
            return evaluated(e[1], [self.expr(a, rel) for a in e[2]], self.options.compat)
        if kind == "call":
            args = [self.expr(a, rel) for a in e[2]]
            if e[1] in self.options.functions:
                return self.options.functions[e[1]](args)
            if e[1] in CASTS:
                return CASTS[e[1]](args)
            local = e[1].removeprefix(self.options.namespaces["functions"])
            if local != e[1] and local.lower() in EXTENSIONS:
                return EXTENSIONS[local.lower()](args)
            raise UnsupportedOperation(f"unknown function: {e[1]}")
        raise UnsupportedOperation(f"unsupported expression: {kind}")


__all__ = ["Compiler", "Context", "Options"]
