"""The registered queries and the pipeline, on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowsieve.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cols = ", ".join(sorted(got.columns))
    expected = con.execute(f"SELECT {cols} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(expected)


COLUMNS = {
    "op1": ["doc_id", "fingerprint", "component_id"],
    "op2": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op4": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5": ["doc_id", "held_out", "lang_pred", "score"],
    "op7": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op8": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9": ["doc_id", "held_out", "score", "predicted"],
    "op10": ["query_id", "rank", "vec_id", "score"],
    "op11": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op12": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op13": ["item_id", "rank", "doc_id", "score"],
}


def test_contracts_name_all_operators():
    names = queries.queries()
    assert sorted(int(n.split("_")[0][2:]) for n in names) == list(range(1, 14))


@pytest.mark.parametrize("op", COLUMNS)
def test_contract_columns(spark, op):
    (name,) = [n for n in queries.queries() if n.split("_")[0] == op]
    df = queries.queries()[name](spark, SF)
    assert df.columns == COLUMNS[op]
    if op not in ("op10", "op13"):
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert sorted(r[0] for r in df.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(10_000, "1234 5678 !?", None, "src0", 12), (10_001, None, "en", None, 0)], docs.schema
    )
    docs = docs.union(extra).union(docs.where("doc_id = 7").withColumn("doc_id", F.lit(10_002).cast("bigint")))
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == list(corpus_pipeline.COLUMNS) and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name == "language":
            assert {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in docs.select("doc_id").collect()} == {10_000, 10_001}
        if name == "lines":
            assert docs.count() == before.count() and docs.where("n_chars <> length(text)").count() == 0
        if name == "near_duplicates":
            texts = before.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1")
            assert docs.groupBy("text").count().where("count > 1").count() == 0
            assert docs.join(before, ["doc_id", "text"], "left_anti").count() == 0 and texts.count() > 0
        if name == "mixture":
            assert {r[0] for r in before.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
        if name == "tokens":
            joined = docs.join(before.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).distinct(), "doc_id")
            assert joined.where("h <> decoded_sha256").count() == 0 and joined.where("n_tokens <> size(ids)").count() == 0
    assert sizes[-1] > 0.5 * sizes[0]
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == docs.columns and whole.count() > 0
