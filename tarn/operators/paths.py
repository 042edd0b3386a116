"""Closures of property paths, by semi-naive rounds until no new pair is found."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.lineage import cut


def closure(
    pairs: DataFrame,
    kind: str,
    start: Column | None,
    end: Column | None,
    nodes: Callable[[DataFrame | None], DataFrame],
    starts: DataFrame | None = None,
    ends: DataFrame | None = None,
) -> DataFrame:
    """Distinct pairs (x, y) of plus, star or opt over the step's pairs.

    A known start or end, or starts or ends (x), seed the search, so only what they reach is visited; an end alone
    walks backwards. Each round is stored once. star and opt add each node, or the known end itself, paired with itself;
    nodes(terms) gives those of the terms (x) that are nodes, nodes(None) all.
    """
    pairs = pairs.distinct()
    seeds = starts if starts is not None else ends
    if seeds is not None:
        seeds = cut(seeds.distinct())
    if kind == "opt":
        out = pairs
        if start is not None:
            out = out.where(F.col("x") == start)
        if end is not None:
            out = out.where(F.col("y") == end)
        if seeds is not None:
            out = seeded(out, seeds) if starts is not None else turned(seeded(turned(out), seeds))
        return out.unionByName(same(pairs, start, end, nodes, seeds)).distinct()
    backwards = start is None and starts is None and (end is not None or ends is not None)
    steps = cut(turned(pairs) if backwards else pairs)
    seed = end if backwards else start
    new = steps
    if seed is not None:
        new = steps.where(F.col("x") == seed)
    elif seeds is not None:
        new = seeded(steps, seeds)
    onward = steps.select(F.col("x").alias("via"), "y")
    rounds = [cut(new)]
    while not rounds[-1].isEmpty():
        far = rounds[-1].select("x", F.col("y").alias("via")).join(onward, "via").select("x", "y").distinct()
        rounds.append(cut(far.join(reduce(DataFrame.unionByName, rounds), ["x", "y"], "left_anti")))
    seen = reduce(DataFrame.unionByName, rounds[:-1] or rounds)
    if backwards:
        seen = turned(seen)
    elif end is not None:
        seen = seen.where(F.col("y") == end)
    if kind == "plus":
        return seen
    return seen.unionByName(same(pairs, start, end, nodes, seeds)).distinct()


def seeded(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    return pairs.join(seeds, "x", "left_semi")


def turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))


def same(pairs: DataFrame, start: Column | None, end: Column | None, nodes: Callable[[DataFrame | None], DataFrame], seeds: DataFrame | None) -> DataFrame:
    """The pairs of a node with itself, of the seeds if there are any."""
    if start is not None and end is not None:
        return pairs.sparkSession.range(1).select(start.alias("x"), end.alias("y")).where("x = y")
    if start is not None or end is not None:
        one = start if start is not None else end
        return pairs.sparkSession.range(1).select(one.alias("x"), one.alias("y"))
    return nodes(seeds).select("x", F.col("x").alias("y"))
