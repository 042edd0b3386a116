"""SPARQL operators and functions as column expressions. Each takes and gives typed columns; an error is null."""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tarn.functions.terms import IRIS, LANG_STRING, XSD, E, box, boxed, compared, ebv, equal, is_num, joint, lexical, literal_text, null, num, same_term, string, widened

Function = Callable[[list[E]], E]


class UnsupportedOperation(ValueError):
    pass


def boolean(c: Column) -> E:
    return E("bool", c)


def whole(c: Column) -> E:
    return E("int", c.cast("bigint"))


def double(c: Column) -> E:
    return E("dbl", c.cast("double"))


def arithmetic(op: str) -> Function:
    def run(args: list[E]) -> E:
        a, b = args
        if op == "+" and a.kind in ("str", "lang") and b.kind in ("str", "lang"):
            return a.with_col(F.concat(a.col, b.col))
        x, y = num(a), num(b)
        if op == "/":
            return double(F.try_divide(x.cast("double"), y.cast("double")))
        do = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
        if a.kind == b.kind == "int":
            return whole(do(x, y))
        return double(do(x.cast("double"), y.cast("double")))

    return run


def numeric(f: Callable[[Column], Column]) -> Function:
    def run(args: list[E]) -> E:
        a = args[0]
        return whole(f(a.col)) if a.kind == "int" else double(f(num(a).cast("double")))

    return run


def to_whole(f: Callable[[Column], Column]) -> Function:
    """A rounding of doubles; whole numbers, and doubles from 2**53 on, which have no fraction, stay as they are."""

    def run(args: list[E]) -> E:
        a = args[0]
        if a.kind == "int":
            return whole(a.col)
        x = num(a).cast("double")
        return double(F.when(F.abs(x) < 2.0**53, f(x).cast("double")).otherwise(x))

    return run


def like(e: E, c: Column) -> E:
    """A string with the language or datatype of e."""
    if e.kind in ("str", "lang"):
        return e.with_col(c)
    if e.kind == "term":
        return E("term", F.when(e.col["k"] == "l", boxed("l", c, e.col["dt"], e.col["lang"])))
    return string(c)


def on_text(f: Callable[..., Column]) -> Function:
    return lambda args: like(args[0], f(literal_text(args[0]), *[literal_text(a) for a in args[1:]]))


def test(f: Callable[..., Column]) -> Function:
    return lambda args: boolean(f(*[literal_text(a) for a in args]))


def kind_test(kinds: tuple[str, ...], k: str) -> Function:
    def run(args: list[E]) -> E:
        a = args[0]
        if a.kind == "term":
            return boolean(a.col["k"] == k)
        return boolean(F.when(a.col.isNotNull(), F.lit(a.kind in kinds)))

    return run


def coalesce(args: list[E]) -> E:
    t = joint(args)
    return E(t[0], F.coalesce(*[widened(a, *t).col for a in args]), *t[1:])


def if_(args: list[E]) -> E:
    c, (t) = ebv(args[0]), joint(args[1:])
    a, b = (widened(x, *t).col for x in args[1:])
    return E(t[0], F.when(c, a).when(~c, b), *t[1:])


def in_(args: list[E], negative: bool = False) -> E:
    found = F.lit(False)
    for x in args[1:]:
        found = found | equal(args[0], x).col
    return boolean(~found if negative else found)


def lang(args: list[E]) -> E:
    a = args[0]
    if a.kind == "lang":
        return string(F.when(a.col.isNotNull(), F.lower(F.lit(a.lang))))
    return string(F.when(a.col.isNotNull(), F.lower(a.col["lang"]) if a.kind == "term" else F.lit("")))


def datatype(args: list[E]) -> E:
    """The datatype as an IRI; for what isn't a literal the empty string."""
    a = args[0]
    c = box(a)
    e = F.lit("")
    return E("term", F.when(c["k"] == "l", boxed("i", c["dt"], e, e)).when(c.isNotNull(), boxed("l", e, F.lit(XSD + "string"), e)))


def strdt(args: list[E]) -> E:
    dt = lexical(args[1])
    return E("term", F.when(dt.isNotNull(), boxed("l", literal_text(args[0]), dt, F.lit(""))))


def strlang(args: list[E]) -> E:
    return E("term", boxed("l", literal_text(args[0]), F.lit(LANG_STRING), F.lower(literal_text(args[1]))))


def langmatches(args: list[E]) -> E:
    t, r = (F.lower(literal_text(a)) for a in args)
    return boolean(F.when(r == "*", t != "").otherwise((t == r) | t.startswith(F.concat(r, F.lit("-")))))


def fixed_text(e: E) -> str | None:
    return e.const[1] if e.const and e.const[0] == "lit" else None


def java_pattern(text: str):
    """The JVM's compiled pattern; None where it is malformed."""
    try:
        return SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(text)
    except (Py4JJavaError, PySparkException):
        return None


def pattern_of(args: list[E], at: int = 3) -> tuple[Column, str | None]:
    """The pattern, args[1], with its flags, args[at]: a column (null where it can't be one) and, if both are constant, its text."""
    flags = args[at] if len(args) > at else E("str", F.lit(""), const=("lit", "", XSD + "string", ""))
    p, f = fixed_text(args[1]), fixed_text(flags)
    if p is not None and f is not None:
        if set(f) - set("imsxqg"):
            return F.lit(None).cast("string"), None
        inline = "".join(c for c in "imsx" if c in f)
        text = (f"(?{inline})" if inline else "") + (f"\\Q{p}\\E" if "q" in f else p)
        return (F.lit(text), text) if java_pattern(text) else (F.lit(None).cast("string"), None)
    of, marks = literal_text(args[1]), literal_text(flags)
    of = F.when(marks.contains("q"), F.concat(F.lit("\\Q"), of, F.lit("\\E"))).otherwise(of)
    inline = F.regexp_replace(marks, "[qg]", "")
    return F.when(marks.rlike("^[imsxqg]*$"), F.when(inline == "", of).otherwise(F.concat(F.lit("(?"), inline, F.lit(")"), of))), None


def regex(args: list[E]) -> E:
    """A malformed constant pattern or flag is an error; a malformed one of a row's own stops the query, as the engine can't catch it."""
    return boolean(F.regexp_like(literal_text(args[0]), pattern_of(args, 2)[0]))


def replacement_of(text: str, groups: int) -> str | None:
    """The JVM's form of a replacement: references to groups that aren't there are empty; None where it is malformed."""
    out, rest = "", text
    while rest:
        if m := re.match(r"\$(\d+)", rest):
            digits = m[1]
            while len(digits) > 1 and int(digits) > groups:
                digits = digits[:-1]
            out += f"${digits}" if int(digits) <= groups else ""
            rest = rest[1 + len(digits) :]
        elif m := re.match(r"\\[\\$]|[^\\$]+", rest):
            out += m[0]
            rest = rest[len(m[0]) :]
        else:
            return None
    return out


def replace(args: list[E], first_only: bool = False) -> E:
    v, r = literal_text(args[0]), literal_text(args[2])
    p, text = pattern_of(args)
    if text is not None and fixed_text(args[2]) is not None:
        fixed = replacement_of(fixed_text(args[2]), java_pattern(text).matcher("").groupCount())
        if fixed is None:
            return like(args[0], F.lit(None).cast("string"))
        r = F.lit(fixed)
    every = F.regexp_replace(v, p, r)
    if not first_only:
        return like(args[0], every)
    m, at = F.regexp_substr(v, p), F.regexp_instr(v, p)
    first = F.when(m.isNull() & v.isNotNull(), v).otherwise(F.overlay(v, F.regexp_replace(m, p, r), at, F.length(m)))
    flags = literal_text(args[3]) if len(args) > 3 else F.lit("")
    return like(args[0], F.when(flags.contains("g"), every).otherwise(first))


def before(args: list[E]) -> E:
    v, s = (literal_text(a) for a in args)
    at = F.position(s, v)
    return like(args[0], F.when(at > 0, F.substr(v, F.lit(1), at - 1)).when(at == 0, F.lit("")))


def after(args: list[E]) -> E:
    v, s = (literal_text(a) for a in args)
    at = F.position(s, v)
    return like(args[0], F.when(at > 0, F.substr(v, at + F.length(s))).when(at == 0, F.lit("")))


def substr(args: list[E]) -> E:
    """Signs at places p with start <= p < start + length, both rounded; places before the first use up length."""
    v, start = literal_text(args[0]), F.floor(num(args[1]).cast("double") + 0.5)
    first = F.greatest(start, F.lit(1)).cast("int")
    if len(args) == 2:
        return like(args[0], F.when(start.isNotNull(), F.substr(v, first)))
    end = start + F.floor(num(args[2]).cast("double") + 0.5)
    size = F.least(F.greatest(end - first, F.lit(0)), F.lit(1 << 30)).cast("int")
    return like(args[0], F.when(start.isNotNull() & end.isNotNull(), F.substr(v, first, size)))


def encode(args: list[E]) -> E:
    c = F.url_encode(literal_text(args[0]))
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return string(c)


def concat(args: list[E]) -> E:
    out = F.concat(*[literal_text(a) for a in args]) if args else F.lit("")
    langs = {a.lang for a in args}
    return args[0].with_col(out) if args and all(a.kind == "lang" for a in args) and len(langs) == 1 else string(out)


def moment(field: str) -> Function:
    """A field of a time, on the value's own offset: from its text where it is boxed."""
    at = {"year": (1, 4), "month": (6, 2), "day": (9, 2), "hour": (12, 2), "minute": (15, 2), "second": (18, 2)}[field]

    def run(args: list[E]) -> E:
        a = args[0]
        if a.kind == "dt":
            return whole(getattr(F, {"day": "dayofmonth"}.get(field, field))(a.col))
        if a.kind == "term":
            return whole(F.when(a.col["dt"] == XSD + "dateTime", F.substring(a.col["v"], *at).try_cast("bigint")))
        return whole(F.lit(None))

    return run


def offset(args: list[E]) -> tuple[Column, Column]:
    v = lexical(args[0])
    return v, F.regexp_extract(v, r"(Z|[+-]\d\d:?\d\d)$", 1)


def tz(args: list[E]) -> E:
    """Hours of the offset as text, without leading zeros; '' without one."""
    v, o = offset(args)
    hours = F.regexp_extract(o, r"^([+-]\d\d)", 1).try_cast("int").cast("string")
    return string(F.when(v.isNotNull(), F.when(o == "", F.lit("")).when(o == "Z", F.lit("0")).otherwise(hours)))


def timezone(args: list[E]) -> E:
    """The offset as an xsd:dayTimeDuration; an error without one."""
    _, o = offset(args)
    h, m = F.regexp_extract(o, r"(\d\d):?\d\d", 1).try_cast("int"), F.regexp_extract(o, r"\d\d:?(\d\d)", 1).try_cast("int")
    text = F.concat(F.when(o.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.lit("PT"), h.cast("string"), F.lit("H"), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(F.lit("")))
    text = F.when(o.isin("Z", "+00:00", "+0000"), F.lit("PT0S")).when(o != "", text)
    return E("term", F.when(text.isNotNull(), boxed("l", text, F.lit(XSD + "dayTimeDuration"), F.lit(""))))


def make_iri(args: list[E]) -> E:
    a = args[0]
    return a if a.kind in IRIS else E("iri", lexical(a))


def bnode(args: list[E]) -> E:
    return E("bnode", literal_text(args[0]) if args else F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))


#: The lexical form of xsd:dateTime, with offsets of hours and minutes with or without a colon.
DATE_TIME = r"^\d{4}-\d\d-\d\dT([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]\d\d:?\d\d)?$"


def cast(to: str) -> Function:
    def run(args: list[E]) -> E:
        a = args[0]
        if to == "string":
            return string(lexical(a))
        if a.kind == "bool" and to in ("int", "dbl"):
            return E(to, a.col.cast({"int": "bigint", "dbl": "double"}[to]))
        if to == "int":
            return whole(F.when(is_num(a), num(a).try_cast("bigint")).otherwise(F.trim(literal_text(a)).try_cast("bigint")))
        if to == "dbl":
            return double(F.coalesce(num(a).cast("double"), F.trim(literal_text(a)).try_cast("double")))
        if to == "bool":
            t = literal_text(a)
            return boolean(F.when(is_num(a), num(a) != 0).when(t.isin("true", "1"), F.lit(True)).when(t.isin("false", "0"), F.lit(False)))
        t = F.trim(lexical(a) if a.kind == "dt" else literal_text(a))
        real = t.rlike(DATE_TIME) & F.substring(t, 1, 10).try_cast("date").isNotNull()
        return E("term", F.when(real, boxed("l", t, F.lit(XSD + "dateTime"), F.lit(""))))

    return run


def rounded(c: Column) -> Column:
    return F.floor(c + 0.5)


FUNCTIONS: dict[str, Function] = {
    "coalesce": coalesce,
    "if": if_,
    "+": arithmetic("+"),
    "-": arithmetic("-"),
    "*": arithmetic("*"),
    "/": arithmetic("/"),
    "neg": numeric(lambda c: -c),
    "pos": numeric(lambda c: c),
    "=": lambda a: equal(*a),
    "!=": lambda a: boolean(~equal(*a).col),
    "<": lambda a: compared(*a, "<"),
    "<=": lambda a: compared(*a, "<="),
    ">": lambda a: compared(*a, ">"),
    ">=": lambda a: compared(*a, ">="),
    "!": lambda a: boolean(~ebv(a[0])),
    "&&": lambda a: boolean(ebv(a[0]) & ebv(a[1])),
    "||": lambda a: boolean(ebv(a[0]) | ebv(a[1])),
    "bound": lambda a: boolean(a[0].col.isNotNull()),
    "sameterm": lambda a: same_term(*a),
    "in": in_,
    "notin": lambda a: in_(a, True),
    "isiri": kind_test(IRIS, "i"),
    "isuri": kind_test(IRIS, "i"),
    "isblank": kind_test(("bnode",), "b"),
    "isliteral": kind_test(("str", "lang", "int", "dbl", "bool", "dt"), "l"),
    "isnumeric": lambda a: boolean(F.when(a[0].col.isNotNull(), is_num(a[0]))),
    "str": lambda a: string(lexical(a[0])),
    "lang": lang,
    "datatype": datatype,
    "iri": make_iri,
    "uri": make_iri,
    "bnode": bnode,
    "strdt": strdt,
    "strlang": strlang,
    "uuid": lambda a: E("iri", F.concat(F.lit("urn:uuid:"), F.uuid())),
    "struuid": lambda a: string(F.uuid()),
    "strlen": lambda a: whole(F.length(literal_text(a[0]))),
    "substr": substr,
    "ucase": on_text(F.upper),
    "lcase": on_text(F.lower),
    "strstarts": test(lambda a, b: a.startswith(b)),
    "strends": test(lambda a, b: a.endswith(b)),
    "contains": test(lambda a, b: a.contains(b)),
    "strbefore": before,
    "strafter": after,
    "encode_for_uri": encode,
    "concat": concat,
    "langmatches": langmatches,
    "regex": regex,
    "replace": replace,
    "abs": numeric(F.abs),
    "round": to_whole(rounded),
    "ceil": to_whole(F.ceil),
    "floor": to_whole(F.floor),
    "rand": lambda a: double(F.rand()),
    "now": lambda a: E("dt", F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")),
    "year": moment("year"),
    "month": moment("month"),
    "day": moment("day"),
    "hours": moment("hour"),
    "minutes": moment("minute"),
    "seconds": moment("second"),
    "tz": tz,
    "timezone": timezone,
    "md5": lambda a: string(F.md5(literal_text(a[0]).cast("binary"))),
    "sha1": lambda a: string(F.sha1(literal_text(a[0]).cast("binary"))),
    "sha256": lambda a: string(F.sha2(literal_text(a[0]).cast("binary"), 256)),
    "sha384": lambda a: string(F.sha2(literal_text(a[0]).cast("binary"), 384)),
    "sha512": lambda a: string(F.sha2(literal_text(a[0]).cast("binary"), 512)),
}

CASTS: dict[str, Function] = {
    **{XSD + t: cast("int") for t in ("integer", "int", "long", "short", "byte")},
    **{XSD + t: cast("dbl") for t in ("double", "float", "decimal")},
    XSD + "string": cast("string"),
    XSD + "boolean": cast("bool"),
    XSD + "dateTime": cast("dateTime"),
}


def on_number(f: Callable[[Column], Column]) -> Function:
    return lambda a: double(f(num(a[0]).cast("double")))


#: Extension functions, by the local name behind the functions namespace. All give doubles.
EXTENSIONS: dict[str, Function] = {
    "cosh": on_number(F.cosh),
    "sinh": on_number(F.sinh),
    "tanh": on_number(F.tanh),
    "coth": on_number(lambda x: F.try_divide(F.exp(2 * x) + 1, F.exp(2 * x) - 1)),
    "sech": on_number(lambda x: 2 * F.exp(x) / (F.exp(2 * x) + 1)),
    "csch": on_number(lambda x: F.try_divide(2 * F.exp(x), F.exp(2 * x) - 1)),
    "todegrees": on_number(F.degrees),
    "toradians": on_number(F.radians),
}


def strsplit(args: list[E]) -> tuple[E, Column]:
    """A generator: the parts of a string, one solution each."""
    sep = literal_text(args[1])
    parts = F.split(literal_text(args[0]), F.concat(F.lit("\\Q"), sep, F.lit("\\E")))
    return string(F.lit("")), parts


def evaluated(name: str, args: list[E], compat: bool = False) -> E:
    if name == "replace" and compat:
        return replace(args, first_only=True)
    if name not in FUNCTIONS:
        raise UnsupportedOperation(f"there is no function or operator {name}")
    if any(a.kind == "null" for a in args) and name not in ("coalesce", "bound", "&&", "||", "if", "in", "notin"):
        return boolean(F.lit(None).cast("boolean")) if name in ("=", "!=", "<", ">", "<=", ">=", "regex", "contains", "strstarts", "strends") else null()
    return FUNCTIONS[name](args)

