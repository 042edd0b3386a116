"""Full-text search by magic predicates.

A search target is a variable of a pattern. Its N3 text is split at spaces; a keyword's score is the share of words
that contain it, and a solution's relevance the mean over keywords, rounded to three digits. Only positive scores
within the bounds stay. Ranks count from 0 by falling relevance among the matches for each solution of the other
patterns; equal relevances are ordered by subject, predicate and object.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tarn.functions.terms import E, n3
from tarn.operators.lineage import global_rank
from tarn.operators.relation import Relation, Var, join


@dataclass
class Search:
    keywords: list[str]
    all_terms: bool = False
    low: float | None = None
    high: float | None = None
    first: int | None = None
    last: int | None = None
    relevance: str | None = None
    rank: str | None = None


def number(o: tuple, whole: bool) -> float:
    try:
        v = int(o[1]) if whole else float(o[1])
    except (ValueError, TypeError):
        raise ValueError(f"not a number: {o[1]!r}") from None
    if whole and v < 0:
        raise ValueError("a rank can't be negative")
    return v


def read(magic: list[tuple], namespace: str) -> Search:
    s = Search([])
    for _, p, o in magic:
        what = p[1][len(namespace) :]
        if what == "search":
            if o[0] != "lit":
                raise ValueError("keywords must be a literal")
            s.keywords = o[1].split(" ")
        elif what == "matchAllTerms":
            s.all_terms = o[1] in ("true", "1")
        elif what == "minRelevance":
            s.low = number(o, False)
        elif what == "maxRelevance":
            s.high = number(o, False)
        elif what == "minRank":
            s.first = int(number(o, True))
        elif what == "maxRank":
            s.last = int(number(o, True))
        elif what in ("relevance", "rank"):
            if o[0] != "var":
                raise ValueError(f"{what} must bind a variable")
            setattr(s, what, o[1])
    if s.low is not None and s.high is not None and s.low > s.high:
        raise ValueError("minRelevance is over maxRelevance")
    if s.first is not None and s.last is not None and s.first > s.last:
        raise ValueError("minRank is over maxRank")
    return s


def containing(keyword: str):
    return lambda w: w.contains(keyword)


def score(text: Column, s: Search) -> Column:
    words = F.split(text, " ")
    total, every = F.lit(0.0), F.lit(True)
    for k in s.keywords:
        hits = F.size(F.filter(words, containing(k)))
        total, every = total + hits / F.size(words), every & (hits > 0)
    mean = F.round(total / len(s.keywords), 3)
    return F.when(every, mean).otherwise(0.0) if s.all_terms else mean


def evaluated(compiler, plain: list[tuple], magic: list[tuple], namespace: str, ctx, outside) -> Relation:
    targets = list(dict.fromkeys(p[0][1] for p in magic if p[0][0] == "var"))
    if len(targets) != len({p[0] for p in magic}):
        raise ValueError("the subject of a search must be a variable")
    searched = {v: next((p for p in plain if ("var", v) in (p[0], p[2])), None) for v in targets}
    if None in searched.values():
        raise ValueError("a searched variable is in no pattern")
    rest = [p for p in plain if p not in searched.values()]
    rel = compiler.bgp(rest, ctx, None)
    for v, pattern in searched.items():
        s = read([p for p in magic if p[0] == ("var", v)], namespace)
        if rest:
            rel = Relation(rel.df.withColumn("__input", F.monotonically_increasing_id()), rel.vars)
        found = joined_keeping(rel, ctx.graph.bgp([pattern], None), "__input" if rest else None)
        df = found.df.withColumn("__score", score(n3(found.e(v)), s)).where("__score > 0")
        if s.low is not None:
            df = df.where(F.col("__score") >= s.low)
        if s.high is not None:
            df = df.where(F.col("__score") <= s.high)
        if s.rank or s.first is not None or s.last is not None:
            order = [F.desc("__score"), *[n3(found.e(t[1])).asc() for t in pattern if t[0] == "var"]]
            if rest:
                df = df.withColumn("__rank", (F.row_number().over(Window.partitionBy("__input").orderBy(*order)) - 1).cast("bigint"))
            else:
                if s.last is not None:
                    df = df.orderBy(*order).limit(s.last + 1)
                keyed = df.select("*", *[c.alias(f"__o{k}") for k, c in enumerate([-F.col("__score"), *[n3(found.e(t[1])) for t in pattern if t[0] == "var"]])])
                df = global_rank(keyed, [F.col(f"__o{k}") for k in range(len(order))], "__rank")
            if s.first is not None:
                df = df.where(F.col("__rank") >= s.first)
            if s.last is not None:
                df = df.where(F.col("__rank") <= s.last)
        rel = Relation(df, found.vars)
        for name, e in ((s.relevance, E("dbl", F.col("__score"))), (s.rank, E("int", F.col("__rank") if "__rank" in df.columns else F.lit(0)))):
            if name:
                rel = rel.extend(name, e, definite=True)
        rel = rel.keep(list(rel.vars))
    return rel


def joined_keeping(a: Relation, b: Relation, column: str | None) -> Relation:
    """join(a, b) that carries a helper column of a along."""
    if column is None:
        return join(a, b)
    out = join(Relation(a.df, a.vars | {column: Var("int")}), b)
    return Relation(out.df, {n: v for n, v in out.vars.items() if n != column})
