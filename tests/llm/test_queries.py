"""The registered queries: their columns, their SQL, and the pipeline against the stages one by one."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    1: "doc_id start n_tokens ids_crc32", 2: "page_id payload_bytes payload_digest record_type refers_to", 3: "page_id url text n_chars",
    4: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 5: "doc_id", 6: "doc_id piece start length ids_crc32 sequence_id offset",
    7: "doc_id fingerprint component_id", 8: "page_id host path rule verdict", 9: "doc_id n_words n_hit n_items items_sha256 contaminated",
    10: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
}


def test_all_ten_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("k", range(1, 11))
def test_query_columns_and_sql(spark, k):
    import duckdb
    from millrace.llm import queries

    name = next(n for n in queries.queries() if n.startswith(f"op{k}_"))
    df = queries.queries()[name](spark, SF)
    assert set(COLUMNS[k].split()) <= set(df.columns)
    rows = df.collect()
    assert rows
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        got = con.execute(sql)
        cols = [d[0] for d in got.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(map(repr, got.fetchall())) == sorted(repr(tuple(r[c] for c in cols)) for r in rows)


def test_pipeline_keeps_what_the_stages_keep(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.collect()} == kept
    assert all(stage(spark, docs.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import random

    import corpus_pipeline
    from pyspark.sql import functions as F

    r = random.Random(6)

    def prose(n):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))

    one, two = prose(90), prose(80)
    item = prose(20)
    rows = [(1, one), (1, one), (2, one), (None, one), (None, None), (3, None), (4, ""), (5, two), (6, f"{prose(60)} {item}"), (7, prose(20_000)), (None, prose(70)), (8, two + " end")]
    df = spark.createDataFrame([(d, t, None if d == 5 else "s") for d, t in rows], "doc_id long, text string, source string")
    df = df.withColumns({"_row": F.lit(1), "quality": F.lit("mine"), "removed": F.lit(2)}).select("*", F.lit("other").alias("TEXT"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    kept = docs.select("doc_id").collect()
    assert sorted(str(x["doc_id"]) for x in kept) == ["1", "1", "5", "7", "None", "None"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.filter("doc_id = 7").agg(F.max("piece")).first()[0] > 5
