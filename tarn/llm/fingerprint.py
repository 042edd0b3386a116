"""Order MinHash fingerprints of texts.

Tokens make 2-mers, whose occurrences are numbered, so equal ones differ. Hashes of numbered 2-mers fall into BUCKETS by
their first bits; of each bucket the TUPLE smallest are selected, put back in text order, and hashed together. Such a
signature changes with order as well as content, and so follows edit distance. The published method takes the smallest
of each of many independent orders; here one order is dealt into buckets, which costs one hash a k-mer instead of
BUCKETS. So a text with few k-mers leaves buckets empty, and likeness counts filled ones only. All steps are DataFrame
operations on arrays of whole numbers, kept in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import WORD_BREAK, let, ranked, written

BUCKETS, TUPLE = 64, 2
#: Bits of a position in a packed number. An array of 2**28 numbers is more than Spark's rows can hold.
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1
#: Longer words are cut: behind vowels, digits and signs beyond ASCII, at the latest after six signs.
LONGEST_WORD = 12
CUT = r"\S{0,5}?[aeiouAEIOU0-9[^\x00-\x7F]]|\S{1,6}"


def tokens(text: Column) -> Column:
    """Words, and pieces of those over LONGEST_WORD, so texts without white space have tokens too. A change moves the cuts near it alone."""
    long_ = lambda x: F.length(x) > LONGEST_WORD
    cut = lambda x: F.when(long_(x), F.regexp_extract_all(x, F.lit(CUT), F.lit(0))).otherwise(F.array(x))
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    return let(words, lambda w: F.when(F.exists(w, long_), F.flatten(F.transform(w, cut))).otherwise(w))


def _packed(value: Column, place: Column) -> Column:
    """The upper bits of value and a place, in one bigint that sorts by value first."""
    return value.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place.cast("bigint"))


def _high(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACE))


def _bucket(x: Column) -> Column:
    return F.shiftright(x, 64 - (BUCKETS - 1).bit_length())


def _unlike(x: Column, y: Column) -> Column:
    return F.coalesce(x != y, F.lit(True))


def _kmers(t: Column) -> Column:
    """A packed number for each token and the one behind it, sorted: equal 2-mers are neighbours, in text order."""
    return F.sort_array(F.transform(t, lambda x, i: _packed(F.xxhash64(x, F.get(t, i + 1)), i)))


def _numbers(k: Column) -> Column:
    """The number of each 2-mer of k among its equals."""
    starts = F.filter(F.transform(k, lambda x, i: F.when(_unlike(_high(x), _high(F.get(k, i - 1))), i)), lambda x: x.isNotNull())
    until = lambda s, x, j: F.coalesce(F.get(s, j + 1), F.size(k)) - x - 1
    return let(starts, lambda s: F.flatten(F.transform(s, lambda x, j: F.sequence(F.lit(0), until(s, x, j)))))


def _numbered(k: Column) -> Column:
    """Packed numbers of the numbered 2-mers, sorted: those of a bucket are neighbours."""
    return let(_numbers(k), lambda o: F.sort_array(F.transform(k, lambda x, i: _packed(F.xxhash64(_high(x), F.get(o, i)), _place(x)))))


def _chosen(v: Column) -> Column:
    """The first TUPLE of each bucket."""
    return F.filter(v, lambda x, i: _unlike(_bucket(x), _bucket(F.get(v, i - TUPLE))))


def _signed(v: Column) -> Column:
    """(b, h) of each bucket with an entry: its number and the hash of its chosen values in text order."""

    def one(x, i):
        y = F.get(v, i + 1)
        in_order = F.when(_place(x) <= _place(y), F.xxhash64(_high(x), _high(y))).otherwise(F.xxhash64(_high(y), _high(x)))
        pair = F.when(_bucket(x) == _bucket(y), in_order).otherwise(F.xxhash64(_high(x)))
        digits = F.lpad(F.hex(F.greatest(F.lit(1).cast("bigint"), pair.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
        return F.when(_unlike(_bucket(x), _bucket(F.get(v, i - 1))), F.struct(_bucket(x).cast("int").alias("b"), digits.alias("h")))

    return F.filter(F.transform(v, one), lambda x: x.isNotNull())


def _joined(e: Column) -> Column:
    gap = lambda x, j: F.repeat(F.lit("0" * 8), x["b"] - F.coalesce(F.get(e, j - 1)["b"], F.lit(-BUCKETS // 2 - 1)) - 1)
    return F.rpad(F.array_join(F.transform(e, lambda x, j: F.concat(gap(x, j), x["h"])), ""), 8 * BUCKETS, "0")


def fingerprint(text: Column) -> Column:
    """BUCKETS groups of eight hexadecimal digits, 00000000 for an empty bucket; '' for an empty text."""
    full = let(tokens(text), lambda t: let(_kmers(t), lambda k: let(_numbered(k), lambda v: let(_chosen(v), lambda c: let(_signed(c), _joined)))))
    return F.when(F.length(text) == 0, F.lit("")).otherwise(full)


def likeness(a: str, b: str) -> Column:
    """0 to 1: the root (of degree TUPLE) of the share of equal buckets among those that either text fills; 1 if both are empty."""
    parts = lambda c: F.regexp_extract_all(F.col(c), F.lit(".{8}"), F.lit(0))
    pairs = F.arrays_zip(parts(a).alias("p"), parts(b).alias("q"))
    none = "0" * 8
    filled = F.size(F.filter(pairs, lambda x: (x["p"] != none) | (x["q"] != none)))
    same = F.size(F.filter(pairs, lambda x: (x["p"] == x["q"]) & (x["p"] != none)))
    empty = lambda c: F.length(c) == 0
    share = F.when(filled == 0, F.lit(1.0)).otherwise(same / filled)  # two texts of white space alone
    ratio = F.when(empty(a) & empty(b), F.lit(1.0)).when(empty(a) | empty(b), F.lit(0.0)).otherwise(share)
    return F.pow(ratio, F.lit(1.0 / TUPLE))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of docs (doc_id, text); a null text counts as empty."""
    return docs.select("doc_id", fingerprint(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("fingerprint"))


def edit_sensitivity(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document's: by ascending doc_id (nulls first, then by a hash of the text), after the last the first. Rows that
    agree in doc_id and text are one document, and are repeated in the result. A single document is its own next. Null
    texts count as empty; an empty table gives no rows; other columns are ignored.

    Only numbers are sorted and ranked; of the texts, halves and beginnings meet by rank, each dealt once.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text__"))
    d = d.withColumn("h__", F.xxhash64("text__"))
    ids = d.groupBy("doc_id", "h__").agg(F.count("*").alias("copies__"), F.first(F.length("text__")).alias("n_chars")).withColumn("all__", F.lit(0))
    ids = ranked(ids, ["all__"], ["doc_id", "h__"], "order").withColumnRenamed("rank__", "rank").withColumnRenamed("total__", "total").drop("all__")
    before = ids.select(((F.col("rank") + 1) % F.col("total")).alias("rank"), F.col("n_chars").alias("n_before"), F.col("rank").alias("rank_before"))
    ids = written(ids.join(before, "rank"), "neighbours").drop("total").withColumnsRenamed({"doc_id": "id__", "h__": "g__"})
    d = d.join(ids, F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("h__") == F.col("g__"))).drop("id__", "g__", "h__")
    d = d.withColumn("f__", fingerprint(F.col("text__")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    start = lambda n: F.substring("text__", F.lit(1), n.cast("int"))
    own = F.struct(
        F.col("rank").alias("key"),
        F.col("doc_id"),
        F.col("n_chars"),
        F.col("copies__"),
        F.unhex("f__").alias("fingerprint"),
        start(F.col("n_chars") - half).alias("kept"),
        none("string").alias("next"),
        none("binary").alias("next_fingerprint"),
    )
    following = F.struct(
        F.col("rank_before").alias("key"),
        none("bigint").alias("doc_id"),
        none("int").alias("n_chars"),
        none("bigint").alias("copies__"),
        none("binary").alias("fingerprint"),
        none("string").alias("kept"),
        start(F.floor(F.col("n_before") / 2)).alias("next"),
        F.unhex("f__").alias("next_fingerprint"),
    )
    sides = d.select(F.inline(F.array(own, following))).repartition(parts, "key")
    d = sides.groupBy("key").agg(*[F.max(c).alias(c) for c in sides.columns if c != "key"])
    d = d.withColumn("edited", F.concat("kept", "next")).drop("kept", "next")
    d = d.withColumn("fingerprint", F.hex("fingerprint")).withColumn("next_fingerprint", F.hex("next_fingerprint"))
    d = d.withColumn("edited_fingerprint", fingerprint(F.col("edited"))).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    d = d.withColumn("near_edited", likeness("fingerprint", "edited_fingerprint")).withColumn("near_next", likeness("fingerprint", "next_fingerprint"))
    d = d.withColumn("copy__", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies__"))))
    return d.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
