"""Mixing sources to target weights by Pfair scheduling.

Block j (from 1) of a source of weight w is released at (j - 1) / w, rounded down to a slot, and due at j / w, rounded
up; of the released blocks the one due first goes first. So after every slot each source has had its weight's share to
less than a block. Weights are exact: whole numbers of any size in proportion to those given. When a source has no block
left, the others share the slots by the same weights: time runs on by the slots that they have had.

A source's rows are cut into blocks of equal size, so many for all sources that the driver can schedule them; larger
tables have larger blocks, as a share of the mix they stay the same. All rows find their places by a join.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import from_driver, ranked

#: Times are kept in whole numbers with so many bits behind the point; they only order blocks.
_POINT = 96
#: Schedules of up to so many rows are broadcast, others joined.
BROADCAST_ROWS = 250_000


def whole_weights(weights: dict) -> dict:
    """Whole numbers in exactly the proportions of the weights (all over 0)."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be over 0")
    scale = 1
    for w in exact.values():
        scale = scale * w.denominator // _common(scale, w.denominator)
    return {s: int(w * scale) for s, w in exact.items()}


def _common(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def schedule(blocks: dict, weights: dict) -> list[tuple]:
    """(source, block) in the order of the mix, blocks from 0: earliest deadline first among the released.

    With C the blocks that the sources with blocks left have had, and W their weights' sum, time is C / W; block j of a
    source of weight a is released once (j - 1) / a < (C + 1) / W and due at j / a. A block costs two heap operations.
    """
    parts = whole_weights({s: weights[s] for s, n in blocks.items() if n})
    names = sorted(parts, key=str)
    had, whole, all_had = dict.fromkeys(names, 0), sum(parts.values()), 0
    out: list[tuple] = []
    coming = [(0, k) for k in range(len(names))]  # release, source; a sorted list is a heap
    released: list[tuple] = []  # deadline, source
    while coming or released:
        while coming and had[s := names[coming[0][1]]] * whole < (all_had + 1) * parts[s]:
            _, k = heappop(coming)
            heappush(released, (((had[s] + 1) << _POINT) // parts[s], k))
        _, k = heappop(released)
        s = names[k]
        out.append((s, had[s]))
        had[s] += 1
        all_had += 1
        if had[s] < blocks[s]:
            heappush(coming, ((had[s] << _POINT) // parts[s], k))
        else:
            whole -= parts[s]
            all_had -= had[s]
    return out


def target_weights(counts: dict, power: float) -> dict:
    return {s: n**power for s, n in counts.items()}


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, blocks: int = 20_000, block_rows: int | None = None) -> DataFrame:
    """docs with source_key, block, slot and position: every row once, in the order of the mix.

    weights (over 0) are by source (a null source is ''); without them a source's target is its row count to the given
    power. A source missing from weights has the smallest weight given. A source's rows are ordered by a hash of doc_id and
    text, and make blocks of block_rows, by default as many rows as make about `blocks` blocks of all; a source's last may
    be shorter. `slot` numbers blocks in the order of the mix, `position` rows, without gaps. Columns that clash with the
    new ones are replaced. An empty table gives no rows. The driver holds a count for each source and a row for each block:
    at most `blocks` and the number of sources together.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("source_key", "block", "slot", "position", "order__")]
    d = docs.select(*own, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"))
    d = d.withColumn("order__", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))) if "text" in own else F.xxhash64("doc_id"))
    d = ranked(d, ["source_key"], ["order__"], "mix").drop("order__")
    counts = {r[0]: r[1] for r in d.groupBy("source_key").count().collect()}
    if weights is not None:
        least = min(weights.values(), default=1.0)
        weights = {s: weights.get(s, least) for s in counts}
    each = block_rows or max(1, -(-sum(counts.values()) // blocks))
    order = schedule({s: -(-n // each) for s, n in counts.items()}, weights or target_weights(counts, power))
    rows, at = [], 0
    for slot, (s, b) in enumerate(order):
        rows.append((s, b, slot, at))
        at += min(each, counts[s] - b * each)
    places = from_driver(spark, rows, "source_key string, block bigint, slot bigint, at__ bigint", "schedule")
    places = F.broadcast(places) if len(rows) <= BROADCAST_ROWS else places
    d = d.withColumn("block", F.floor(F.col("rank__") / each)).join(places, ["source_key", "block"])
    return d.withColumn("position", F.col("at__") + F.col("rank__") % each).select(*own, "source_key", "block", "slot", "position")


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """docs with its own columns alone, dealt and sorted so that files written from it follow the mix."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed(docs, **options).repartitionByRange(parts, "position").sortWithinPartitions("position").select(*docs.columns)
