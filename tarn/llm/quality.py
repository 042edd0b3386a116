"""Quality rules: counts of plain defects, and a hashed n-gram log-likelihood ratio.

Tokens are runs of letters and digits, or of other signs. One- and two-token n-grams are hashed to buckets; the
trusted texts' multinomial over buckets, smoothed by the corpus's, is compared with the corpus's. A text is kept if
the sum of its n-grams' log ratios, over their number, reaches a threshold. Log ratios are whole millionths, so sums
don't depend on their order. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import WORD_BREAK, let, written

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
BUCKETS = 1 << 16
MICRO = 1_000_000


def text_of() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def bucket(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")


def grams(text: Column) -> Column:
    """The buckets of a text's n-grams in one array: those of its tokens, and BUCKETS more for those of its pairs of tokens."""

    def of(t):
        pair = lambda i: F.lit(BUCKETS) + bucket(F.get(t, i - 1), F.get(t, i))
        pairs = F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(1), F.size(t) - 1), pair)).otherwise(F.array().cast("array<int>"))
        return F.concat(F.transform(t, lambda x: bucket(x)), pairs)

    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), of)


def trusted_ids(labels: DataFrame, rows: int) -> DataFrame:
    """doc_ids that labels call good (quality 1, and never 0): at most rows, the first by a hash (the documented bound)."""
    y = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("q")).where("doc_id is not null and q is not null")
    return y.groupBy("doc_id").agg(F.min("q").alias("q")).where("q = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.lit(1).alias("good__"))


def log_ratios(docs: DataFrame, labels: DataFrame, trusted_rows: int = 50_000, prior: float = 1000.0) -> DataFrame:
    """(kind, bucket, ratio) for the buckets that occur, a written table of 2 * BUCKETS rows at most.

    Corpus counts are over all of docs; the trusted ones over at most trusted_rows labelled documents. ratio is
    ln((trusted + prior * corpus share) / (all trusted + prior) / corpus share) in millionths; 0 with no trusted text.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text__"))
    d = d.join(F.broadcast(trusted_ids(labels, trusted_rows)), "doc_id", "left")  # at most trusted_rows ids
    g = d.select("good__", F.explode(grams(F.col("text__"))).alias("gram"))
    # both kinds under one key: BUCKETS groups fit the generated code's hash map
    pair, good = F.col("gram") >= BUCKETS, F.col("good__").isNotNull()
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    n = g.groupBy(F.col("gram").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(count(~pair, "n1"), count(pair, "n2"), count(~pair & good, "good1"), count(pair & good, "good2"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n{k}").alias("n"), F.col(f"good{k}").alias("good")) for k in (1, 2)])
    n = n.select("bucket", F.inline(kinds)).where("n > 0")
    n = written(n, "ngram-counts")
    all_ = n.groupBy("kind").agg(F.sum("n").alias("n_all"), F.sum("good").alias("good_all"))
    share = F.col("n") / F.col("n_all")
    ratio = F.log((F.col("good") + prior * share) / (F.col("good_all") + prior) / share)
    micro = F.round(F.when(F.col("good_all") > 0, ratio).otherwise(0.0) * MICRO).cast("bigint")
    return written(n.join(F.broadcast(all_), "kind").select("kind", "bucket", micro.alias("ratio")), "ngram-ratios")


def ratio_array(ratios: DataFrame) -> Column:
    """log_ratios() as one array of 2 * BUCKETS numbers that every task holds; 0 where a bucket doesn't occur."""
    gram = (F.col("kind") - 1) * BUCKETS + F.col("bucket")
    every = ratios.sparkSession.range(2 * BUCKETS).select(F.col("id").cast("int").alias("gram"), F.lit(0).cast("bigint").alias("ratio"))
    dense = ratios.select(gram.cast("int").alias("gram"), "ratio").unionByName(every).groupBy("gram").agg(F.sum("ratio").alias("ratio"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("gram", "ratio"))), lambda x: x["ratio"])).scalar()


def repeated_words(w: Column) -> Column:
    """How many of the words w are in three-word windows that occur again. Only texts with such a window are sorted."""
    of_words = lambda h: F.transform(F.slice(h, F.lit(1), F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    windows = let(F.transform(w, lambda x: F.xxhash64(x)), of_words)

    def again(h):  # places of such windows, ascending
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        like = lambda s, x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        twice = let(by_hash, lambda s: F.filter(s, lambda x, k: like(s, x, k - 1) | like(s, x, k + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p):  # each window covers its words up to the next one's
        new = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    count = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(again(h), covered)).otherwise(0))
    return F.when(F.size(w) < 4, 0).otherwise(count).cast("bigint")


def base_counts(text: Column) -> Column:
    """n_words, word_chars, n_repeat_words, n_symbols and n_dup_lines of a text, as a struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(F.array_remove(F.split(text, WORD_BREAK), ""), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return let(
        of_words,
        lambda x: F.struct(
            x["n_words"].alias("n_words"),
            F.length(F.regexp_replace(text, WORD_BREAK, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("bigint").alias("n_dup_lines"),
            x["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def quality(docs: DataFrame, labels: DataFrame, threshold: float = -0.25, **options) -> DataFrame:
    """doc_id, the five base counts, n_ngrams, ratio_sum, base_failed and kept of every row of docs (doc_id, text).

    base_failed: under 50 words, or over half of them in three-word windows found again. kept: not base_failed, and
    ratio_sum >= threshold * n_ngrams (in millionths). A null text counts as empty; an empty one fails the base. Rows are
    judged one by one, where they are read, so repeated rows and null doc_ids stay; an empty table gives no rows, other
    columns are ignored.
    """
    ratios = ratio_array(log_ratios(docs, labels, **options))
    summed = lambda r: lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda a, x: a + F.get(r, x))
    of_grams = lambda r: let(grams(text_of()), lambda g: F.struct(F.size(g).cast("bigint").alias("n"), summed(r)(g).alias("sum")))
    d = docs.select("doc_id", "text", ratios.alias("r__"))  # named once below, so the plan has it inline and not in each row
    d = d.select(F.col("doc_id").cast("bigint").alias("doc_id"), base_counts(text_of()).alias("c__"), let(F.col("r__"), of_grams).alias("g__"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.col("ratio_sum") >= F.lit(round(threshold * MICRO)) * F.col("n_ngrams")
    d = d.select("doc_id", "c__.*", F.col("g__.n").alias("n_ngrams"), F.col("g__.sum").alias("ratio_sum"))
    return d.select("*", failed.alias("base_failed"), (~failed & fine).alias("kept"))
