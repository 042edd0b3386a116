"""RDF terms on Spark columns.

A value of one known kind is a native column (whole numbers, doubles, strings, times, keys of IRI templates), so
comparisons and joins stay native. Only values of mixed kinds are boxed: struct<k,v,dt,lang> with k i, b or l.
Errors and unbound values are null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
TERM_TYPE = "struct<k:string,v:string,dt:string,lang:string>"
INTEGERS = [XSD + x for x in ("integer", "byte", "short", "int", "long", "unsignedByte", "unsignedShort", "unsignedInt", "unsignedLong", "positiveInteger", "nonPositiveInteger", "negativeInteger", "nonNegativeInteger")]
NUMERIC = [*INTEGERS, XSD + "float", XSD + "double", XSD + "decimal", XSD + "number"]
DATATYPE_OF = {"str": XSD + "string", "int": XSD + "integer", "dbl": XSD + "double", "bool": XSD + "boolean", "dt": XSD + "dateTime", "lang": LANG_STRING}
IRIS = ("iri", "key")


@dataclass(frozen=True)
class E:
    """A typed column. prefix: of a key's IRI template; lang: of all values of kind lang; const: a constant's term."""

    kind: str
    col: Column
    prefix: str = ""
    lang: str = ""
    const: tuple | None = None

    def with_col(self, col: Column) -> E:
        return replace(self, col=col, const=None)


def null() -> E:
    return E("null", F.lit(None).cast("string"))


def string(c: Column) -> E:
    return E("str", c)


def constant(term: tuple) -> E:
    """The value of a parsed term that isn't a variable."""
    if term[0] == "iri":
        return E("iri", F.lit(term[1]), const=term)
    if term[0] == "bnode":
        return E("bnode", F.lit(term[1]), const=term)
    _, v, dt, lang = term
    if dt in INTEGERS and re.fullmatch(r"[+-]?\d{1,18}", v):
        return E("int", F.lit(int(v)).cast("bigint"), const=term)
    if dt in NUMERIC and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v):
        return E("dbl", F.lit(float(v)), const=term)
    if dt == XSD + "boolean" and v in ("true", "false", "1", "0"):
        return E("bool", F.lit(v in ("true", "1")), const=term)
    if dt == XSD + "string":
        return E("str", F.lit(v), const=term)
    if dt == LANG_STRING:
        return E("lang", F.lit(v), lang=lang, const=term)
    return E("term", boxed("l", F.lit(v), F.lit(dt), F.lit(lang)), const=term)


def boxed(k: str | Column, v: Column, dt: Column, lang: Column) -> Column:
    return F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), v.alias("v"), dt.alias("dt"), lang.alias("lang"))


def double_text(c: Column) -> Column:
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def time_text(c: Column) -> Column:
    part = F.date_format(c, "SSSSSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == "000000", "").otherwise(F.concat(F.lit("."), F.regexp_replace(part, "0+$", ""))), F.lit("Z"))


def lexical(e: E) -> Column:
    """The text of a value: of an IRI the IRI, of a literal its lexical form."""
    if e.kind == "key":
        return F.concat(F.lit(e.prefix), e.col.cast("string"))
    if e.kind == "term":
        return e.col["v"]
    if e.kind == "dbl":
        return double_text(e.col)
    if e.kind == "dt":
        return time_text(e.col)
    return e.col.cast("string")


def box(e: E) -> Column:
    if e.kind == "term":
        return e.col
    if e.kind == "null":
        return F.lit(None).cast(TERM_TYPE)
    k = "i" if e.kind in IRIS else "b" if e.kind == "bnode" else "l"
    s = boxed(k, lexical(e), F.lit(DATATYPE_OF.get(e.kind, "")), F.lit(e.lang))
    return F.when(e.col.isNotNull(), s)


def to_term(e: E) -> E:
    return E("term", box(e))


def iri_text(e: E) -> Column:
    return lexical(e)


def literal_text(e: E) -> Column:
    """The lexical form of a literal; null for other terms."""
    if e.kind == "term":
        return F.when(e.col["k"] == "l", e.col["v"])
    return F.lit(None).cast("string") if e.kind in (*IRIS, "bnode", "null") else lexical(e)


def is_num(e: E) -> Column:
    if e.kind == "term":
        return (e.col["k"] == "l") & e.col["dt"].isin(NUMERIC)
    return F.lit(e.kind in ("int", "dbl"))


def num(e: E) -> Column:
    """A number (bigint or double); null for what isn't one."""
    if e.kind in ("int", "dbl"):
        return e.col
    if e.kind == "term":
        return F.when(is_num(e), e.col["v"].try_cast("double"))
    return F.lit(None).cast("double")


def time_of_text(c: Column) -> Column:
    return F.to_utc_timestamp(c.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def constant_time(v: str) -> datetime | None:
    try:
        t = datetime.fromisoformat(re.sub(r"([+-]\d\d)(\d\d)$", r"\1:\2", v))
    except ValueError:
        return None
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def time(e: E) -> Column:
    if e.kind == "dt":
        return e.col
    if e.const and e.const[0] == "lit" and e.const[2] == XSD + "dateTime" and (t := constant_time(e.const[1])):
        return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    if e.kind == "term":
        return F.when(e.col["dt"] == XSD + "dateTime", time_of_text(e.col["v"]))
    return F.lit(None).cast("timestamp_ntz")


def may_be_time(e: E) -> bool:
    return e.kind == "dt" or bool(e.const and e.const[0] == "lit" and e.const[2] == XSD + "dateTime")


def ebv(e: E) -> Column:
    """Effective boolean value; null is an error."""
    if e.kind == "bool":
        return e.col
    if e.kind in ("int", "dbl"):
        return (e.col != 0) & ~F.isnan(e.col.cast("double"))
    if e.kind in ("str", "lang"):
        return F.length(e.col) > 0
    if e.kind == "term":
        c, n = e.col, num(e)
        b = F.when(c["dt"] == XSD + "boolean", c["v"].isin("true", "1"))
        s = F.when(c["dt"].isin(XSD + "string", LANG_STRING), F.length(c["v"]) > 0)
        return F.when(c["k"] == "l", F.coalesce(b, (n != 0) & ~F.isnan(n), s))
    return F.lit(None).cast("boolean")


def equal(a: E, b: E) -> E:
    """SPARQL =: numbers and times by value; other terms if they are the same. Different kinds are unequal."""
    if "null" in (a.kind, b.kind):
        return E("bool", F.lit(None).cast("boolean"))
    if {a.kind, b.kind} <= {"int", "dbl"}:
        return E("bool", a.col == b.col)
    if may_be_time(a) and may_be_time(b):
        return E("bool", time(a) == time(b))
    if a.kind in IRIS and b.kind in IRIS:
        return E("bool", same_iri(a, b))
    if a.kind == b.kind and a.kind in ("str", "bool", "bnode", "dt") or (a.kind == b.kind == "lang" and a.lang == b.lang):
        return E("bool", a.col == b.col)
    if "term" not in (a.kind, b.kind):
        return E("bool", F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)))
    x, y = box(a), box(b)
    by_value = F.coalesce(num(a) == num(b), time(a) == time(b))
    return E("bool", F.when(x.isNotNull() & y.isNotNull(), F.coalesce(by_value, x == y)))


def same_iri(a: E, b: E) -> Column:
    """Equality of IRIs; on keys where a template allows it, so that filters reach the scan."""
    if a.kind == "key" and b.kind == "key":
        if a.prefix == b.prefix:
            return a.col == b.col
        return lexical(a) == lexical(b) if a.prefix.startswith(b.prefix) or b.prefix.startswith(a.prefix) else F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    for x, y in ((a, b), (b, a)):
        if x.kind == "key" and y.const:
            v = y.const[1]
            if not v.startswith(x.prefix):
                return F.when(x.col.isNotNull(), F.lit(False))
            key = v[len(x.prefix) :]
            return x.col == (F.lit(int(key)) if re.fullmatch(r"0|-?[1-9]\d{0,17}", key) else F.lit(None))
    return lexical(a) == lexical(b)


def same_term(a: E, b: E) -> E:
    if {a.kind, b.kind} <= {"int", "dbl"} and a.kind != b.kind:
        return E("bool", F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)))
    if "term" in (a.kind, b.kind):
        x, y = box(a), box(b)
        return E("bool", F.when(x.isNotNull() & y.isNotNull(), x == y))
    return equal(a, b)


def compared(a: E, b: E, op: str) -> E:
    do = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if {a.kind, b.kind} <= {"int", "dbl"}:
        return E("bool", do(a.col, b.col))
    if may_be_time(a) and may_be_time(b):
        return E("bool", do(time(a), time(b)))
    if a.kind == b.kind and a.kind in ("str", "bool", "dt") or (a.kind == b.kind == "lang"):
        return E("bool", do(a.col, b.col))
    if "term" not in (a.kind, b.kind):
        return E("bool", F.lit(None).cast("boolean"))
    text = lambda e: F.when(box(e)["dt"].isin(XSD + "string", LANG_STRING, XSD + "boolean"), box(e)["v"])
    same = F.when(box(a)["dt"] == box(b)["dt"], do(text(a), text(b)))
    return E("bool", F.coalesce(do(num(a), num(b)), do(time(a), time(b)), same))


def joint(es: list[E]) -> tuple[str, str, str]:
    """(kind, prefix, lang) that holds all of es without loss."""
    es = [e for e in es if e.kind != "null"]
    if not es:
        return "null", "", ""
    kinds = {(e.kind, e.prefix, e.lang) for e in es}
    if len(kinds) == 1:
        return next(iter(kinds))
    if all(e.kind in IRIS for e in es):
        return "iri", "", ""
    return "term", "", ""


def widened(e: E, kind: str, prefix: str = "", lang: str = "") -> E:
    if (e.kind, e.prefix, e.lang) == (kind, prefix, lang):
        return e
    if e.kind == "null":
        native = {"int": "bigint", "dbl": "double", "bool": "boolean", "dt": "timestamp_ntz", "term": TERM_TYPE, "key": "bigint"}
        return E(kind, F.lit(None).cast(native.get(kind, "string")), prefix, lang)
    if kind == "iri":
        return E("iri", F.when(e.col.isNotNull(), lexical(e)))
    if kind == "dbl":
        return E("dbl", num(e).cast("double"))
    return to_term(e)


def n3(e: E) -> Column:
    """N3 text of a term: IRIs bare, _:label, quoted literals with language or datatype (xsd:string has none)."""
    c = box(e)
    quoted = F.concat(F.lit('"'), c["v"], F.lit('"'))
    tail = F.when(c["lang"] != "", F.concat(F.lit("@"), c["lang"])).when(c["dt"].isin("", XSD + "string"), F.lit("")).otherwise(F.concat(F.lit("^^"), c["dt"]))
    return F.when(c["k"] == "i", c["v"]).when(c["k"] == "b", F.concat(F.lit("_:"), c["v"])).when(c["k"] == "l", F.concat(quoted, tail))


def of_n3(c: Column) -> Column:
    """The boxed term of such a text."""
    body = F.regexp_extract(c, r'(?s)^"(.*)"(?:@[a-zA-Z0-9-]+|\^\^[^"]+)?$', 1)
    lang = F.regexp_extract(c, r'(?s)^".*"@([a-zA-Z0-9-]+)$', 1)
    dt = F.regexp_extract(c, r'(?s)^".*"\^\^([^"]+)$', 1)
    dt = F.when(lang != "", F.lit(LANG_STRING)).when(dt == "", F.lit(XSD + "string")).otherwise(dt)
    e = F.lit("")
    return F.when(c.startswith('"'), boxed("l", body, dt, lang)).when(c.startswith("_:"), boxed("b", F.substring(c, 3, 1 << 30), e, e)).when(c.isNotNull(), boxed("i", c, e, e))


def order_keys(e: E) -> list[Column]:
    """Columns that sort as SPARQL asks: unbound, blank nodes, IRIs, literals; numbers and times by value."""
    if e.kind in ("int", "dbl", "str", "bool", "dt", "iri", "lang", "bnode"):
        return [e.col]
    if e.kind == "key":
        return [lexical(e)]
    if e.kind == "null":
        return [F.lit(0)]
    c = e.col
    rank = F.when(c.isNull(), 0).when(c["k"] == "b", 1).when(c["k"] == "i", 2).when(is_num(e), 3).when(c["dt"] == XSD + "dateTime", 4).otherwise(5)
    return [rank, num(e), time(e), c["v"]]
