"""RDF files as triple tables, read by executors: N-Triples line by line, Turtle document by document."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.plans.parser import Parser, SparqlSyntaxError
from tarn.functions.terms import LANG_STRING, XSD
from tarn.sources.graphs import COLUMNS, TRIPLES

#: subject, predicate, IRI or label, quoted text, language, datatype
_LINE = r'^\s*(<[^>]*>|_:\S+)\s*<([^>]*)>\s*(?:<([^>]*)>|(_:\S+?)|"((?:[^"\\]|\\.)*)"(?:@([a-zA-Z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'


def unescaped(c: Column) -> Column:
    """Escapes of N-Triples are those of JSON, but for \\U and eight digits, which stay."""
    j = F.from_json(F.concat(F.lit('["'), F.replace(F.replace(c, F.lit("\\U"), F.lit("\\\\U")), F.lit("\\'"), F.lit("'")), F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"})
    return F.when(c.contains("\\"), F.get(j, F.lit(0))).otherwise(c)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Triples of a DataFrame with the column value: a line of N-Triples each. Blank lines and comments give none; other lines that aren't triples are an error."""
    part = lambda k: F.regexp_extract("value", _LINE, k)
    d = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    d = d.withColumn("ok", F.when(F.col("value").rlike(_LINE), True).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.substring("value", 1, 80))).cast("boolean")))
    s = F.when(part(1).startswith("<"), F.substring(part(1), F.lit(2), F.length(part(1)) - 2)).otherwise(part(1))
    literal = (part(3) == "") & (part(4) == "")
    kind = F.when(part(3) != "", "i").when(part(4) != "", "b").otherwise("l")
    value = F.when(part(3) != "", part(3)).when(part(4) != "", F.substring(part(4), 3, 1 << 30)).otherwise(unescaped(part(5)))
    dt = F.when(~literal, "").when(part(6) != "", LANG_STRING).when(part(7) != "", part(7)).otherwise(XSD + "string")
    return d.where("ok").select(s.alias("s"), part(2).alias("p"), kind.alias("o_k"), value.alias("o_v"), dt.alias("o_dt"), F.lower(part(6)).alias("o_lang"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parsed_lines(spark.read.text(path))


class TurtleParser(Parser):
    def document(self) -> list[tuple]:
        out: list = []
        while self.peek()[0] != "end":
            kind, v = self.peek()
            if kind == "lang" and v.lower() in ("@prefix", "@base"):
                self.next()
                if v.lower() == "@base":
                    self.base = self.next()[1][1:-1]
                else:
                    name = self.next()[1]
                    self.prefixes[name[:-1]] = self.resolve(*self.next())
                self.need(".")
            elif self.is_word("PREFIX", "BASE"):
                self.prologue()
            elif not self.op("."):
                self.triples_block(out, paths=False)
        return out


def row(t: tuple) -> tuple:
    s, p, o = t
    if p[0] != "iri" or s[0] not in ("iri", "bnode"):
        raise SparqlSyntaxError(f"not a triple: {t}")
    head = ("_:" + s[1] if s[0] == "bnode" else s[1], p[1])
    return (*head, "l", o[1], o[2], o[3]) if o[0] == "lit" else (*head, "i" if o[0] == "iri" else "b", o[1], "", "")


def scoped(t: tuple, scope: str) -> tuple:
    s, p, kind, value, *rest = t
    return (f"_:b{scope}-{s[2:]}" if s.startswith("_:") else s, p, kind, f"b{scope}-{value}" if kind == "b" else value, *rest)


def turtle_triples(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(sorted({row(t) for t in TurtleParser(text).document()}), TRIPLES)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """A file, or a folder of them. A document is one unit that a task holds, so large data should come in many files.

    Labels of blank nodes are a document's own: a hash of the file's name goes before them. A malformed document is an
    error of the job that reads it.
    """

    def run(batches):
        for b in batches:
            for text, scope in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                rows = sorted({scoped(row(t), scope) for t in TurtleParser(text).document()})
                columns = zip(*rows, strict=True) if rows else ((),) * len(COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], COLUMNS)

    files = spark.read.text(path, wholetext=True).select("value", F.lower(F.hex(F.xxhash64("_metadata.file_path"))).alias("scope"))
    return files.mapInArrow(run, TRIPLES).distinct()


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """.nt, .ttl, or a Parquet table of triples."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end in ("nt", "ntriples"):
        return read_ntriples(spark, path).distinct()
    if end in ("ttl", "turtle"):
        return read_turtle(spark, path)
    return spark.read.parquet(path).select(*COLUMNS)


def write_ntriples(triples: DataFrame, path: str) -> None:
    """Triples as lines of N-Triples, a file for each partition."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    s = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(iri(F.col("s")))
    tail = F.when(F.col("o_lang") != "", F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_dt") == XSD + "string", F.lit("")).otherwise(F.concat(F.lit("^^"), iri(F.col("o_dt"))))
    o = F.when(F.col("o_k") == "i", iri(F.col("o_v"))).when(F.col("o_k") == "b", F.concat(F.lit("_:"), F.col("o_v"))).otherwise(F.concat(F.lit('"'), esc(F.col("o_v")), F.lit('"'), tail))
    triples.select(F.concat_ws(" ", s, iri(F.col("p")), o, F.lit(".")).alias("value")).write.text(path)
