"""Relations of solution mappings, and their algebra: joins, optional parts, unions, differences.

A relation is a DataFrame with a column for each variable and what is known of it: its kind and whether each row
binds it. Joins of all kinds on variables that both sides always bind are plain equalities; a side that may leave one
unbound is split into the rows that bind it and those that don't, so all parts stay hash or merge joins.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.terms import E, joint, lexical, widened


@dataclass(frozen=True)
class Var:
    kind: str
    prefix: str = ""
    lang: str = ""
    definite: bool = True


@dataclass
class Relation:
    df: DataFrame
    vars: dict[str, Var]

    def e(self, name: str, suffix: str = "") -> E:
        v = self.vars[name]
        return E(v.kind, F.col(f"`{name}{suffix}`"), v.prefix, v.lang)

    def where(self, c: Column) -> Relation:
        return Relation(self.df.where(c), self.vars)

    def extend(self, name: str, e: E, definite: bool = False) -> Relation:
        return Relation(self.df.withColumn(name, e.col), self.vars | {name: Var(e.kind, e.prefix, e.lang, definite)})

    def keep(self, names: list[str]) -> Relation:
        return Relation(self.df.select(*quoted(names)), {n: self.vars[n] for n in names})

    def as_kind(self, name: str, kind: str, prefix: str = "", lang: str = "") -> Relation:
        v = self.vars[name]
        if (v.kind, v.prefix, v.lang) == (kind, prefix, lang):
            return self
        e = widened(self.e(name), kind, prefix, lang)
        return Relation(self.df.withColumn(name, e.col), self.vars | {name: Var(kind, prefix, lang, v.definite)})


def quoted(names: Iterable[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def unit(spark: SparkSession) -> Relation:
    """One solution that binds nothing."""
    return Relation(spark.range(1).select(F.lit(1).alias("__unit")), {})


def is_unit(r: Relation) -> bool:
    return not r.vars and r.df.columns == ["__unit"]


def alike(a: Relation, b: Relation, names: list[str]) -> tuple[Relation, Relation]:
    """Both sides with the named variables of one kind."""
    for n in names:
        t = joint([a.e(n), b.e(n)])
        if t[0] == "null":
            t = ("str", "", "")
        a, b = a.as_kind(n, *t), b.as_kind(n, *t)
    return a, b


def renamed(b: Relation, names: list[str]) -> DataFrame:
    """b's DataFrame with __r behind the named columns and without helper columns."""
    return b.df.selectExpr(*[f"`{n}` AS `{n}__r`" if n in names else f"`{n}`" for n in b.vars])


def shared(a: Relation, b: Relation) -> list[str]:
    return [n for n in a.vars if n in b.vars]


def parted(r: Relation, name: str) -> tuple[Relation, Relation]:
    """The rows of r that bind a variable, and the others, without it."""
    c = F.col(f"`{name}`")
    bound = Relation(r.df.where(c.isNotNull()), r.vars | {name: replace(r.vars[name], definite=True)})
    rest = [m for m in r.vars if m != name]
    free = Relation(r.df.where(c.isNull()), r.vars)
    return bound, free.keep(rest) if rest else Relation(free.df.select(F.lit(1).alias("__free")), {})


def open_name(a: Relation, b: Relation) -> str | None:
    """A variable of both that some row of a may leave unbound."""
    return next((n for n in a.vars if n in b.vars and not a.vars[n].definite), None)


def join(a: Relation, b: Relation, hint: str | None = None) -> Relation:
    """Compatible solutions of both, merged."""
    if is_unit(a):
        return b
    if is_unit(b):
        return a
    if n := open_name(a, b):
        return union(*(join(x, b, hint) for x in parted(a, n)))
    if n := open_name(b, a):
        return union(*(join(a, x, hint) for x in parted(b, n)))
    names = shared(a, b)
    a, b = alike(a, b, names)
    right = renamed(b, names)
    if hint:
        right = right.hint(hint)
    if not names:
        df = a.df.crossJoin(right) if b.vars else a.df.crossJoin(b.df.select(F.lit(1).alias("__one")))
    else:
        df = a.df.join(right, equalities(names), "inner")
    vars_ = a.vars | {n: v for n, v in b.vars.items() if n not in a.vars}
    return Relation(df.select(*quoted(vars_)) if vars_ else df, vars_)


def equalities(names: list[str]) -> Column:
    """Equality of the named columns of both sides, which rows of both bind."""
    return F.expr(" AND ".join(f"`{n}` = `{n}__r`" for n in names) or "true")


def left_join(a: Relation, b: Relation, condition=None) -> Relation:
    """OPTIONAL: condition(relation of both) goes into the join.

    Where b may leave a shared variable unbound, its parts are joined one by one and the rows that match none are added.
    """
    if n := open_name(a, b):
        return union(*(left_join(x, b, condition) for x in parted(a, n)))
    if open_name(b, a):
        found = join(a, b)
        if condition is not None:
            found = found.where(F.coalesce(condition(found), F.lit(False)))
        return union(found, semi(a, b, False, condition))
    names = shared(a, b)
    a, b = alike(a, b, names)
    if not a.vars:
        a = Relation(a.df.select(F.lit(1).alias("__unit")), {})
    right = renamed(b, names)
    on = equalities(names)
    both = a.vars | {n: replace(v, definite=False) for n, v in b.vars.items() if n not in a.vars}
    if condition is not None:
        on = on & F.coalesce(condition(Relation(a.df, both)), F.lit(False))
    df = a.df.join(right, on, "left")
    return Relation(df.select(*quoted(both)), both)


def union(a: Relation, b: Relation) -> Relation:
    """All solutions of both; a variable that one side lacks is unbound there."""
    names = [*a.vars, *[n for n in b.vars if n not in a.vars]]
    kinds = {}
    for n in names:
        es = [r.e(n) for r in (a, b) if n in r.vars]
        kinds[n] = joint(es) if joint(es)[0] != "null" else ("str", "", "")
    sides = []
    for r in (a, b):
        cols = [widened(r.e(n) if n in r.vars else E("null", F.lit(None).cast("string")), *kinds[n]).col.alias(n) for n in names]
        sides.append(r.df.select(*cols) if cols else r.df.select(F.lit(1).alias("__unit")))
    vars_ = {n: Var(*kinds[n], definite=all(n in r.vars and r.vars[n].definite for r in (a, b))) for n in names}
    return Relation(sides[0].unionByName(sides[1]), vars_)


def minus(a: Relation, b: Relation) -> Relation:
    """Solutions of a without those compatible with one of b that shares a bound variable."""
    if n := open_name(a, b):
        return union(*(minus(x, b) for x in parted(a, n)))
    if n := open_name(b, a):
        bound, free = parted(b, n)
        return minus(minus(a, bound), free)
    names = shared(a, b)
    if not names:
        return a
    a, b = alike(a, b, names)
    return Relation(a.df.join(renamed(b.keep(names), names), equalities(names), "left_anti"), a.vars)


def semi(a: Relation, b: Relation, positive: bool, condition=None) -> Relation:
    """Solutions of a that some (or no) solution of b is compatible with; condition(relation of both) must hold too."""
    if n := open_name(a, b):
        return union(*(semi(x, b, positive, condition) for x in parted(a, n)))
    if n := open_name(b, a):
        bound, free = parted(b, n)
        rest = semi(semi(a, bound, False, condition), free, positive, condition)
        return union(semi(a, bound, True, condition), rest) if positive else rest
    names = shared(a, b)
    a, b = alike(a, b, names)
    both = a.vars | {n: v for n, v in b.vars.items() if n not in a.vars}
    right = renamed(b, names) if b.vars else b.df.select(F.lit(1).alias("__one")).limit(1)
    on = equalities(names)
    if condition is not None:
        on = on & F.coalesce(condition(Relation(a.df, both)), F.lit(False))
    return Relation(a.df.join(right, on, "left_semi" if positive else "left_anti"), a.vars)


def marked(a: Relation, b: Relation, name: str, condition=None) -> Relation:
    """a with a boolean variable: whether some solution of b is compatible. Rows of a stay single."""
    if condition is None and not open_name(a, b) and not open_name(b, a):
        names = shared(a, b)
        a, b = alike(a, b, names)
        keys = b.keep(names).df.distinct() if names else b.df.select(F.lit(1).alias("__one")).limit(1)
        right = keys.selectExpr(*[f"`{n}` AS `{n}__r`" for n in names], f"true AS `{name}`")
        df = a.df.join(right, equalities(names), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
        return Relation(df.select(*quoted(a.vars), name), a.vars | {name: Var("bool")})
    yes, no = (semi(a, b, holds, condition).extend(name, E("bool", F.lit(holds)), definite=True) for holds in (True, False))
    return union(yes, no)


def distinct(a: Relation) -> Relation:
    return Relation(a.df.distinct(), a.vars)


__all__ = ["Relation", "Var", "alike", "distinct", "equalities", "join", "left_join", "lexical", "marked", "minus", "semi", "union", "unit"]
