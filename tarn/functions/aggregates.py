"""SPARQL aggregates as Spark aggregates. Extension aggregates are called by IRI, on variables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.terms import E, box, equal, lexical, num, string


def aggregate(name: str, arg: E | None, distinct: bool, separator: str, row: Column | None = None) -> E:
    """One of the standard aggregates; arg None: of whole solutions, row tells different ones apart."""
    if name == "COUNT":
        if arg is None:
            return E("int", F.count_distinct(row) if distinct else F.count(F.lit(1)))
        return E("int", F.count_distinct(arg.col) if distinct else F.count(arg.col))
    if name in ("SUM", "AVG"):
        n = num(arg)
        if name == "SUM":
            kind = "int" if arg.kind == "int" else "dbl"
            total = F.sum_distinct(n) if distinct else F.sum(n)
            return E(kind, F.coalesce(total, F.lit(0).cast("bigint" if kind == "int" else "double")))
        mean = F.try_divide(F.sum_distinct(n), F.count_distinct(n)) if distinct else F.avg(n.cast("double"))
        return E("dbl", F.when(F.count(arg.col) == 0, F.lit(0.0)).otherwise(mean))  # of no values 0, of none that is a number an error
    if name in ("MIN", "MAX"):
        f = F.min if name == "MIN" else F.max
        if arg.kind == "term":  # numbers by value; else by text
            pick = F.min_by if name == "MIN" else F.max_by
            n = num(arg)
            return E("term", F.coalesce(pick(F.when(n.isNotNull(), arg.col), n), pick(arg.col, arg.col["v"])))
        return E(arg.kind, f(arg.col), arg.prefix, arg.lang)
    if name == "SAMPLE":
        return E(arg.kind, F.any_value(arg.col, True), arg.prefix, arg.lang)
    if name == "GROUP_CONCAT":  # in order of the text, so the result doesn't depend on the order of rows
        t = lexical(arg)
        return string(F.coalesce(F.array_join(F.array_sort(F.collect_set(t) if distinct else F.collect_list(t)), separator), F.lit("")))
    raise ValueError(name)


def _squares(a: E, b: E) -> Column:
    d = num(a).cast("double") - num(b).cast("double")
    return F.avg(d * d)


def _hits(a: E, b: E) -> Column:
    return F.size(F.array_intersect(F.collect_set(box(a)), F.collect_set(box(b)))).cast("double")


def _precision(a: E, b: E) -> Column:
    return F.try_divide(_hits(a, b), F.count(b.col).cast("double"))


def _recall(a: E, b: E) -> Column:
    return F.try_divide(_hits(a, b), F.count(a.col).cast("double"))


def _f1(a: E, b: E) -> Column:
    p, r = _precision(a, b), _recall(a, b)
    return F.try_divide(2 * p * r, p + r)


def _gmean(a: E) -> Column:
    return F.pow(F.product(F.coalesce(num(a).cast("double"), F.when(a.col.isNotNull(), F.lit(1.0)))), F.lit(1.0) / F.count(a.col))


#: By the local name behind the aggregates namespace, in lower case. All give doubles.
EXTENSIONS: dict[str, Callable[..., Column]] = {
    "accuracy": lambda a, b: F.avg(F.when(F.coalesce(equal(a, b).col, F.lit(False)), 1.0).otherwise(0.0)),
    "gmean": _gmean,
    "mse": _squares,
    "rmse": lambda a, b: F.sqrt(_squares(a, b)),
    "precision": _precision,
    "recall": _recall,
    "f1": _f1,
}
