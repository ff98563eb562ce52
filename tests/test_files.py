import json

import pytest
from pyspark.sql import functions as F

from textmill.sources import files


def test_split_leaves_out_excluded(spark, tmp_path):
    rows = [{"id": "a_1", "excluded": False, "label": 1}, {"id": "a_2", "excluded": True, "label": 0}]
    (tmp_path / "dev.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    assert [r["id"] for r in files.read_split(spark, str(tmp_path), "dev").collect()] == ["a_1"]
    (tmp_path / "train.jsonl").write_text(json.dumps({"id": "b_1"}) + "\n")
    with pytest.raises(Exception, match="excluded"):
        files.read_split(spark, str(tmp_path), "train").collect()


def test_raw_numbers_lines(spark, tmp_path):
    (tmp_path / "math_qa.jsonl").write_text('{"context":"[NULL]","prompt_bn":"q","response_bn":"r","label":1}\n\n{"context":"c","prompt_bn":"q2","response_bn":"r2","label":0}\n')
    got = files.read_raw(spark, str(tmp_path)).orderBy("source_line").collect()
    assert [(r["source_line"], r["subject"], r["label"]) for r in got] == [(1, "math", 1), (3, "math", 0)]


def test_sheet_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "a_FINAL.csv").write_text('﻿item_id,your_label\nx_1,"correct, yes"\n', encoding="utf-8")
    r = files.read_sheet(spark, str(tmp_path / "a_FINAL.csv")).first()
    assert (r["item_id"], r["your_label"]) == ("x_1", "correct, yes")


def test_json_lines_are_sorted(spark, tmp_path):
    d = spark.createDataFrame([("p", 0, "w"), ("p", 1, "c")], "pair_id string, label int, answer string")
    files.write_json(d, str(tmp_path / "out"), ["pair_id", F.desc("label")])
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ['{"answer":"c","label":1,"pair_id":"p"}', '{"answer":"w","label":0,"pair_id":"p"}']


def test_cache_keeps_the_latest(spark, tmp_path):
    c = files.Cache(spark, str(tmp_path / "cache"))
    assert c.read().count() == 0
    c.put(spark.createDataFrame([("a", "1")], "k string, value string"))
    c.put(spark.createDataFrame([("a", "2"), ("b", "3")], "k string, value string"))
    assert {r["k"]: r["value"] for r in c.read().collect()} == {"a": "2", "b": "3"}
    c.compact()
    assert c.read().count() == 2


def test_words_and_empty_tables(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# head\nনা\n\nএক\n", encoding="utf-8")
    assert files.read_words(spark, str(tmp_path / "w.txt")) == sorted(["না", "এক"])
    with pytest.raises(ValueError, match="no rows"):
        files.write_table(spark.createDataFrame([], "a int"), str(tmp_path / "t"))
