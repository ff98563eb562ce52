import os
import threading

import duckdb
from pyspark.sql import functions as F

from textmill.operators import evidence, records, sampling
from textmill.plans import registry

SCHEMA = "id string, question string, candidate_answer string, context string"


def test_passage_is_cut_to_the_budget(spark):
    d = spark.createDataFrame([("1", "who is it", "a man", "one two three four five six"), ("2", "who", "he", None)], SCHEMA)
    got = {r["id"]: r for r in records.formatted(records.record_parts(d, 14), "F3").collect()}
    assert got["1"]["text_a"] == "one two three" and got["1"]["text_b"] == "who is it a man"
    assert got["2"]["text_a"] == "who he" and got["2"]["text_b"] == ""


def test_tokens_have_separators(spark):
    d = records.record_parts(spark.createDataFrame([("1", "q", "a", "p")], SCHEMA))
    assert records.token_list(d).first()["tokens"] == ["p", "<SEP>", "q", "<SEP>", "a"]
    assert records.token_list(d, "F1").first()["tokens"] == ["q", "<SEP>", "a"]


def test_features(spark):
    d = spark.createDataFrame([("1", "কোথায়?", "ঢাকা।", "রাজধানী ঢাকা শহর"), ("2", "কোথায়?", "ঢাকা", ""), ("3", "q", ".", "a b .")], SCHEMA)
    got = {r["id"]: r for r in records.features(d).collect()}
    assert (got["1"]["exact_in_passage"], got["1"]["edit_passage"]) == (1.0, 0.0)
    assert [got["2"][k] for k in ("has_context", "exact_in_passage", "edit_passage", "token_overlap", "lm_passage")] == [0.0, 0.0, 1.0, 0.0, 0.0]
    assert got["3"]["token_overlap"] == 0.0
    rules = {r["id"]: (r["exact"], r["fuzzy"]) for r in records.rule_predictions(records.features(d)).collect()}
    assert rules["1"] == (1, 1) and rules["2"] == (0, 0)


def test_years(spark):
    d = spark.createDataFrame([("তিনি ১৩০৬ বঙ্গাব্দে (১৮৯৯) জন্মগ্রহণ করেন",), ("founded in 1921",), ("no year",)], "s string")
    got = [tuple(r) for r in d.select(evidence.birth_year(F.col("s")), evidence.establishment_year(F.col("s"))).collect()]
    assert got == [("1899", None), (None, "1921"), (None, None)]


def test_prompts_come_in_both_orders(spark):
    d = spark.createDataFrame([("1", "q", "a", "p")], SCHEMA)
    got = evidence.judge_prompts(d, "id", "question", "candidate_answer", "context").collect()
    assert len(got) == 2 and got[0]["prompt_hash"] != got[1]["prompt_hash"]


def test_references_in_bank_order(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, x array<string>").coalesce(1)
    first = frame([("a", ["B c", None, "d"]), ("b", None), ("a", ["D", "e", "bC"]), (None, ["n"])])
    second = frame([("a", ["f", "E "]), ("c", [])])
    df = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "a", "b", "c", "d", None])], "id int, k string")
    for limit, want in ((12, ["B c", "d", "e", "f"]), (None, ["B c", "d", "e", "f"]), (3, ["B c", "d", "e"])):
        got = {r["id"]: r["references"] for r in evidence.references(df, [first, second], "k", "x", limit).collect()}
        assert got == {0: want, 1: want, 2: [], 3: [], 4: [], 5: []}


def test_reference_answers_of_a_key_with_very_many(spark, tmp_path):
    n = 30_000
    parts = spark.range(2 * n).select(F.col("id").alias("p_partkey"), F.lit("LARGE").alias("p_type"), F.concat(F.lit("Brand#"), F.col("id") % n).alias("p_brand"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    got = registry.QUERIES["reference_answers"](spark, str(tmp_path)).collect()
    late.cancel()
    assert [tuple(r) for r in got] == [("LARGE", n)]


def test_sheet_batches_beyond_four_digits(spark, tmp_path):
    n = 10_050
    doc = spark.range(n).withColumnRenamed("id", "doc_id")
    doc.select("doc_id", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(9).alias("n_chars")).coalesce(1).write.parquet(f"{tmp_path}/documents")
    doc.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).coalesce(1).write.parquet(f"{tmp_path}/labels")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        os.rename(f"{tmp_path}/{t}", f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cols = ["doc_id", "position", "batch", "item_id", "blind"]
    got = [tuple(r) for r in registry.QUERIES["sheet_batches"](spark, str(tmp_path)).select(cols).collect()]
    assert sorted(got) == sorted(con.execute(f"select {', '.join(cols)} from ({registry.ORACLE_SQL['sheet_batches']})").fetchall()) and len(got) == n
    ids = sampling.batches(spark.createDataFrame([(r[1],) for r in got], "position int"), size=100).select("item_id").distinct()
    assert ids.count() == n
