"""The corpus pipeline: toxicity, line deduplication, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents. Empty tables give empty results in all stages; further columns
of documents stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import linededup, mixing, neardup, packing, toxicity
from tarn.llm.common import forget, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model is learned from the labelled rows that aren't held out.

    Null and empty texts, null doc_ids and repeated rows are judged as they are, row by row; a tie at 0.5 goes.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks go from later documents; a document of which nothing is left goes as a whole.

    Of a tie in doc_id the text of the larger hash is the later one; repeated rows are one document. Rows with a null
    doc_id stay as they are; a null text becomes empty and stays, as does one that was empty before.
    """
    d = linededup.without_shared_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return d.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays, once.

    Of a tie in doc_id the text of the least hash stays. Null or empty texts are linked with nothing; rows with a null
    doc_id all stay.
    """
    return neardup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, dealt into files and sorted there in the order of the mix.

    A null source is a source of its own. Ties, also repeated rows, keep the order in which they are read.
    """
    return mixing.in_mixed_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces placed in sequences of 2048 tokens, filled in the order in which the mix was written.

    A null text counts as empty, which is one piece of id 0. Rows with a null doc_id and repeated rows are packed too.
    """
    order = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    return packing.pack_documents(docs, order=order)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Stages learn models and tokenize: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents. A stage's table goes once the next one's is written; the last reads the mix."""
    docs, own = table(spark, sf_dir, "documents"), False
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if own:
            forget(before)
        own = True
    return STAGES[-1][1](spark, docs, sf_dir)
