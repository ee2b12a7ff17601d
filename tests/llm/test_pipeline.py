"""The pipeline's stages one by one, each on what its predecessor kept."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from quillon.llm.decontaminate import find_contamination
from quillon.llm.near_dedup import near_duplicates

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        seen[name] = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad, good = (ids(labels.where(f"quality = {q}")) for q in (0, 1))
    assert len(ids(seen["line_dedup"]) & bad) <= len(bad) // 20 and len(good - ids(seen["line_dedup"])) <= len(good) // 50
    lines = seen["near_dedup"]
    assert ids(lines) == ids(seen["line_dedup"])
    assert lines.where("n_chars <> char_length(text)").count() == seen["line_dedup"].where("n_chars <> char_length(text)").count()
    kept = ids(seen["decontamination"])
    assert kept == ids(near_duplicates(lines, words=5).where("kept"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(seen["mixing"]) == ids(find_contamination(seen["decontamination"], bench).where("n_hit = 0"))
    assert docs.count() == seen["mixing"].count() and docs.agg(F.sum("taken")).first()[0] > 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_awkward_rows_and_names(spark):
    """Nulls, repeats and extra columns named like the operators' own come through; a table need not have n_chars."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").drop("n_chars")
    odd = spark.createDataFrame([(900, None, None, None), (901, "", "en", "s"), (None, "x y", "en", "s"), (3, "again", None, None)], docs.select("doc_id", "text", "lang", "source").schema)
    names = ["score", "n_lines", "n_deleted", "n_words", "n_hit", "items", "spans", "in", "row", "runs", "kept", "as_it_was", "component_id", "odd.name"]
    docs = docs.select("doc_id", "text", "lang", "source").unionByName(odd).unionByName(docs.where("doc_id = 5").select("doc_id", "text", "lang", "source"))
    for c in names:
        docs = docs.withColumn(c, F.lit("own"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == "own" for r in rows for c in names), name
        if name != "quality":
            assert {900, 901, None} <= {r["doc_id"] for r in rows}, name
    assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count()
