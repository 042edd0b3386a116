"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised; rows are sorted by the place of their cell on a Hilbert curve, and the
order is cut into runs. Rows of a run are close in every dimension, so files made of runs have narrow ranges of all
of them. All steps are DataFrame operations; a cell's place is an expression of its coordinates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import let, ranked, redealt

#: Bits of each dimension's levels: source, language and size.
BITS, DIMENSIONS = 10, 3
#: Levels of an octave of sizes: the largest text that a row can hold, 2**31 bytes, is below 2**BITS.
PER_OCTAVE = 32
#: Tables of levels up to so many rows are broadcast, others joined.
BROADCAST_ROWS = 100_000


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place on the Hilbert curve of a point with coordinates of so many bits (Skilling's transform, as published)."""
    x = list(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | v >> b & 1
    return out


def hilbert(coordinates: list[Column], bits: int) -> Column:
    """hilbert_index() of bigint columns, which may be named many times."""
    n = len(coordinates)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def turned(x, i, low, high):  # one step of the transform: bit `high` of x[i], and the bits below it
        first, other = F.get(x, 0), F.get(x, i)
        swap = first.bitwiseXOR(other).bitwiseAND(low)
        rest = [F.get(x, k) for k in range(n)]
        flipped = F.array(first.bitwiseXOR(low), *rest[1:])
        swapped = F.array(first.bitwiseXOR(swap), *[v.bitwiseXOR(swap) if k + 1 == i else v for k, v in enumerate(rest[1:])])
        return F.when(other.bitwiseAND(high) != 0, flipped).otherwise(swapped)

    def level(x, b):  # all dimensions at bit b
        high = F.call_function("shiftleft", one, b)
        return reduce(lambda v, i: let(v, lambda y: turned(y, i, high - 1, high)), range(n), x)

    def gray(x):
        return F.array(*[reduce(lambda a, k: a.bitwiseXOR(F.get(x, k)), range(1, i + 1), F.get(x, 0)) for i in range(n)])

    def unflipped(x):
        down = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1))
        last = F.get(x, n - 1)
        mask = lambda b: F.call_function("shiftleft", one, b)
        flip = F.aggregate(down, zero, lambda t, b: F.when(last.bitwiseAND(mask(b)) != 0, t.bitwiseXOR(mask(b) - 1)).otherwise(t))
        return let(flip, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    def woven(x):
        bit = lambda v, b: F.call_function("shiftright", v, b).bitwiseAND(one)
        down = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
        return F.aggregate(down, zero, lambda out, b: F.aggregate(x, out, lambda o, v: F.shiftleft(o, 1).bitwiseOR(bit(v, b))))

    start = F.array(*[c.cast("bigint") for c in coordinates])
    steps = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), start, level)
    return let(let(let(steps, gray), unflipped), woven)


def levels(d: DataFrame, column: str) -> DataFrame:
    """(value__, level__) of each value of a column: its rank among the values, null first, spread over all levels."""
    values = ranked(d.select(F.col(column).alias("value__")).distinct().withColumn("all__", F.lit(0)), ["all__"], ["value__"], "levels")
    return values.select("value__", F.floor(F.col("rank__") * (1 << BITS) / F.col("total__")).cast("bigint").alias("level__"))


def with_level(d: DataFrame, column: str) -> DataFrame:
    """d with the level of a column's value in place of it."""
    found = levels(d, column).withColumnRenamed("level__", "of__")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return d.join(found, F.col(column).eqNullSafe(F.col("value__"))).drop("value__", column).withColumnRenamed("of__", column)


def size_level(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double")) * PER_OCTAVE).cast("bigint")


def sharded(docs: DataFrame, shards: int = 40, with_text: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs (doc_id, text, lang, source).

    The law is `rows`: shards are runs of the curve's order whose row counts differ by one at most. The dimensions are
    the ranks of source and language and the logarithm of the size, in 1/32 of an octave. Equal texts are neighbours in
    the order, at the first of their cells on the curve; then doc_id decides, nulls first, and rows that agree in all are
    ordered as they are read. A null text has size 16; null sources or languages are levels of their own. with_text adds
    text, lang and source. An empty table gives no rows; with fewer rows than shards the last shards are empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = ["text", "lang", "source"] if with_text else []
    d = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("same__"),
        F.col("source").cast("string").alias("source__"),
        F.col("lang").cast("string").alias("lang__"),
        *more,
    )
    d = with_level(with_level(d, "source__"), "lang__")
    d = d.withColumn("place__", hilbert([F.col("source__"), F.col("lang__"), size_level(F.col("size"))], BITS)).drop("source__", "lang__")
    text_key = ["same__", "size", "text_crc32"]
    copies = d.groupBy(*text_key).agg(F.min("place__").alias("first__"), F.max("place__").alias("last__")).where("first__ < last__").drop("last__")
    d = d.join(redealt(copies, *text_key), text_key, "left").withColumn("place__", F.coalesce("first__", "place__")).drop("first__").withColumn("all__", F.lit(0))
    d = ranked(d, ["all__"], ["place__", *text_key, "doc_id"], "shards")
    each, extra = F.floor(F.col("total__") / shards), F.col("total__") % shards
    long_ = extra * (each + 1)
    behind = extra + F.floor((F.col("rank__") - long_) / F.greatest(each, F.lit(1)))
    shard = F.when(F.col("rank__") < long_, F.floor(F.col("rank__") / (each + 1))).otherwise(behind).cast("int")
    start = F.least(F.col("shard"), extra) + F.col("shard") * each
    out = d.withColumn("shard", shard).withColumn("slot", (F.col("rank__") - start).cast("bigint"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *more)


def write_shards(docs: DataFrame, path: str, shards: int = 40, files: int = 4) -> None:
    """Writes docs as Parquet, a folder for each shard (shard=0 ...), of about so many files each in slot order."""
    d = sharded(docs, shards, with_text=True)
    d.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
