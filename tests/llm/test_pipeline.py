"""The pipeline's stages on a small folder of tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import mixing, queries
from tarn.llm.common import written

CLEAN = "sentence number {0} tells of the quiet river {0} and the boat {0} that went down it {0} days ago with nobody on board"
PASSAGE = "this very passage of more than fifty words stands in two documents " + " ".join(f"w{k}" for k in range(50))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = [(i, "\n".join(CLEAN.format(f"{i}x{k}") for k in range(4)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, f"you worthless moron {i}, get lost, clown, " + CLEAN.format(i), "en", "s0") for i in range(60)]
    rows += [(200, rows[5][1], "en", "s1"), (201, rows[6][1] + "\none more line", "de", "s2")]
    rows += [(210, f"own words first\n{PASSAGE}\nend of one", "en", "s1"), (211, f"quite another start here\n{PASSAGE}\nanother end of it", "en", "s1")]
    long = " ".join(f"l{k}" for k in range(300))
    rows += [(220, long, "en", None), (221, long.replace("l150", "changed"), "en", None), (230, "", "en", "s0"), (None, "no id", None, None)]
    docs = [(i, t, lang, s, len(t)) for i, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 160)) for i, *_ in rows if i is not None], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), docs


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = written(out, name)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    all_ids = {i for i, *_ in rows}
    assert set(kept["toxicity"]) == all_ids - set(range(100, 160))
    assert set(kept["line_dedup"]) == set(kept["toxicity"]) - {200}  # nothing was left of the copy
    assert kept["line_dedup"][201] == "one more line" and PASSAGE not in kept["line_dedup"][211] and PASSAGE in kept["line_dedup"][210]
    assert set(kept["near_dedup"]) == set(kept["line_dedup"]) - {221}
    assert kept["mix"] == kept["near_dedup"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == set(kept["mix"])
    run = corpus_pipeline.run(spark, path).collect()
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, run)) == sorted(map(key, packed))
    order = [r.doc_id for r in spark.read.parquet(docs.inputFiles()[0].rsplit("/", 1)[0]).selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index i").orderBy("f", "i").collect()]
    assert len(order) == len(kept["mix"])
    mixed = sorted(mixing.mixed(spark.createDataFrame(rows, docs.schema).where(F.col("doc_id").isin(order) | F.col("doc_id").isNull())).collect(), key=lambda r: r.position)
    sources = {r[0]: r[3] or "" for r in rows}
    assert Counter(sources[i] for i in order) == Counter(r.source_key for r in mixed)
    lead = [sources[i] for i in order[:12]]  # the smallest sources aren't left for the end
    assert set(lead) == {r.source_key for r in mixed[:12]}


def test_stages_on_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for table in ("documents", "labels"):
        spark.read.parquet(f"{path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mix", "pack"]
