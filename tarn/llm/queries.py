"""The queries opN_<name> of the corpus operators: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import chat, fingerprint, linededup, mixing, neardup, packing, quality, sharding, toxicity, warc
from tarn.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through seekable bundles and back."""
    return warc.bundle_and_read(table(spark, sf_dir, "pages")).drop("payload")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in components of near duplicates."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized whole, in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings in its texts, formatted in windows and read back."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.windows(c.unionByName(more)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned from the labelled ones that aren't held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the blocks that they share with earlier ones."""
    return linededup.without_shared_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.edit_sensitivity(table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mix of all sources, by counts to the power 0.7."""
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source")).drop("source")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every document; the trusted texts are those labelled good."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards along a Hilbert curve."""
    return sharding.sharded(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_near_duplicates, op3_pack, op4_chat, op5_toxicity, op6_line_dedup, op7_order_minhash, op8_mix, op9_quality, op10_hilbert)}

#: DuckDB's SHA-1 is hexadecimal; base 32 takes its 160 bits in 32 groups of five.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT hex, max(page_id) AS first, count(*) AS n FROM p GROUP BY hex)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(list_sum(list_transform(range(5), lambda j:
      ((strpos('0123456789abcdef', substr(p.hex, CAST((5 * i + j) // 4 + 1 AS BIGINT), 1)) - 1) >> CAST(3 - (5 * i + j) % 4 AS BIGINT)) % 2 * (1 << CAST(4 - j AS BIGINT)))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN p.page_id IS NOT DISTINCT FROM g.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS NOT DISTINCT FROM g.first THEN NULL ELSE g.first END AS refers_to, p_url.url AS url
FROM p JOIN g USING (hex) JOIN pages p_url ON p_url.page_id = p.page_id
"""

OP2_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 75 * (nx.n + ny.n - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op2_near_duplicates": OP2_SQL}
