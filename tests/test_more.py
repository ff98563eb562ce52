"""Sources, sinks, streams, models and small operators that have no registered query."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from textmill.functions import similarity, text
from textmill.operators import lookup, models, records, sampling
from textmill.sources import files
from textmill.streaming import variants


def test_json_of_a_file_and_a_folder(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"id": name, "label": 1}) + "\n")
    assert files.read_json(spark, str(tmp_path / "a.jsonl")).count() == 1
    assert {r["id"] for r in files.read_json(spark, str(tmp_path)).collect()} == {"a", "b"}
    (tmp_path / "c.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        files.read_json(spark, str(tmp_path / "c.jsonl")).collect()


def test_subject_of_a_file(spark):
    d = spark.createDataFrame([("/x/math_qa.jsonl",), ("history.json.gz",)], "f string")
    assert [r[0] for r in d.select(files.subject_of(F.col("f"))).collect()] == ["math", "history"]


def test_splits_are_joined(spark, tmp_path):
    for s, n in (("train", 3), ("dev", 2)):
        (tmp_path / f"{s}.jsonl").write_text("".join(json.dumps({"id": f"{s}_{i}", "excluded": i == 0}) + "\n" for i in range(n)))
    got = files.read_splits(spark, str(tmp_path)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 2, "dev": 1}


def test_bank_has_its_columns_and_keys(spark, tmp_path):
    path = str(tmp_path / "bank")
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, other string").write.parquet(path)
    assert files.read_bank(spark, path, "k", ["k", "v"]).columns == ["k", "v"]
    with pytest.raises(ValueError, match="no columns"):
        files.read_bank(spark, path, "k", ["k", "missing"])
    spark.createDataFrame([("a", 3, "z")], "k string, v int, other string").write.mode("append").parquet(path)
    with pytest.raises(Exception, match="duplicate key"):
        files.read_bank(spark, path, "k", ["k", "v"]).collect()


def test_verified_file_is_the_one_with_the_digest(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).write_bytes(name.encode())
    paths = [str(tmp_path / "one"), str(tmp_path / "two")]
    assert files.read_verified(spark, paths, hashlib.sha256(b"two").hexdigest()) == paths[1]
    with pytest.raises(FileNotFoundError):
        files.read_verified(spark, paths, "0" * 64)


def test_json_map_zipped_or_not(spark, tmp_path):
    body = json.dumps({"Dhaka": {"year": 1608}, "Khulna": {"year": 1882}}).encode()
    (tmp_path / "m.json").write_bytes(body)
    (tmp_path / "m.json.gz").write_bytes(gzip.compress(body))
    for name in ("m.json", "m.json.gz"):
        got = files.read_json_map(spark, str(tmp_path / name), "struct<year:int>").collect()
        assert {r["key"]: r["value"]["year"] for r in got} == {"Dhaka": 1608, "Khulna": 1882}


def test_idioms_and_antonyms(spark, tmp_path):
    path = str(tmp_path / "idioms")
    spark.createDataFrame([("a", ["b", "a"], "m"), ("c", None, "n")], "idiom string, alternatives array<string>, meaning string").write.parquet(path)
    assert sorted((r["term"], r["meaning"]) for r in files.read_idioms(spark, path).collect()) == [("a", "m"), ("b", "m"), ("c", "n")]
    p = spark.createDataFrame([("up", "down", 0.95), ("in", "out", 0.5), ("hot", "unknown", 0.99)], "word string, antonym string, ocr_confidence double")
    known = spark.createDataFrame([("up",), ("down",), ("in",), ("out",), ("hot",)], "word string")
    assert {tuple(r) for r in files.antonyms(p, known).collect()} == {("up", "down"), ("down", "up")}


def test_log_rows_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    run = lambda *ids: spark.createDataFrame([(i, "d", "m", "F2", "V1", "42", "", "", "", "dev", 0.5, None, "has-context+hard 0.61; seconds 12") for i in ids], files.LOG)
    files.append_runs(spark, run("r1"), path)
    files.append_runs(spark, run("r1", "r2"), path)
    log = files.read_log(spark, path)
    assert sorted((r["run_id"], r["hard"], r["seconds"]) for r in log.collect()) == [("r1", 0.61, 12.0), ("r2", 0.61, 12.0)]
    assert files.next_attempt(log, "r1") == "r1_attempt2" and files.next_attempt(log, "r9") == "r9"


def test_sheets_by_batch(spark, tmp_path):
    d = spark.createDataFrame([(i, i // 2 + 1, "=a, \"b\"") for i in range(5)], "id int, batch int, cell string")
    files.write_sheets(d, str(tmp_path / "sheets"))
    assert sorted(p.name for p in (tmp_path / "sheets").iterdir() if p.is_dir()) == ["batch=1", "batch=2", "batch=3"]
    assert files.read_sheet(spark, str(tmp_path / "sheets" / "batch=1")).select("cell").first()[0] == "=a, \"b\""


def _stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def _drain(out, spark, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.table(name)


def test_stream_keeps_the_first_of_a_key(spark, tmp_path):
    s = _stream(spark, str(tmp_path / "a"), [("x", 1), ("x", 2), ("y", 3)], "k string, n int").withColumn("t", F.timestamp_seconds("n"))
    assert sorted(r["k"] for r in _drain(variants.dedupe(s, ["k"], "t"), spark, "first_of_key").collect()) == ["x", "y"]


def test_stream_counts_and_scores_by_window(spark, tmp_path):
    rows = [(0, 1, 1), (10, 1, 0), (20, 0, 0), (400, 0, 1)]
    s = _stream(spark, str(tmp_path / "b"), rows, "n int, truth int, pred int").withColumn("t", F.timestamp_seconds("n"))
    got = _drain(variants.windowed_counts(s, "t", ["truth"], "pred"), spark, "counts_by_window", "complete").collect()
    assert sorted((r["window"].start.minute, r["truth"], r["n"], r["total"]) for r in got) == [(0, 0, 1, 0), (0, 1, 2, 1), (5, 0, 1, 1)]
    got = _drain(variants.windowed_scores(s, "t", "truth", "pred", "5 minutes"), spark, "scores_by_window", "complete").collect()
    assert sorted((r["n"], round(r["accuracy"], 4)) for r in got) == [(1, 0.0), (3, 0.6667)]


def test_stream_into_a_cache(spark, tmp_path):
    cache = files.Cache(spark, str(tmp_path / "cache"))
    s = _stream(spark, str(tmp_path / "c"), [("a", "1"), ("b", "2")], "k string, value string")
    variants.upsert(s, cache, str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(60)
    assert {r["k"]: r["value"] for r in cache.read().collect()} == {"a": "1", "b": "2"}


def test_similarities(spark):
    d = spark.createDataFrame([("The Cat sat", "the cat  sat!"), ("abc", "xyz"), ("one two three four", "zero one two three")], "a string, b string")
    got = [tuple(r) for r in d.select(similarity.text_similarity(F.col("a"), F.col("b")), similarity.partial_ratio("a", "b"), similarity.verbatim_run_length(F.col("a"), F.col("b")), similarity.context_support(F.col("a"), F.col("b"))).collect()]
    assert got[0][0] == 1.0 and got[0][3] and got[1][0] == 0.0 and not got[1][3]
    assert [r[2] for r in got] == [0, 0, 3]  # words as they stand: case and marks count
    whole = spark.createDataFrame([("abc", "xxabcxx")], "a string, b string").select(similarity.partial_ratio("a", "b"), similarity.partial_ratio("b", "a"), similarity.partial_ratio("a", "a")).first()
    assert whole[0] == whole[1] == whole[2] and got[1][1] < whole[0]


def test_deletions_and_repeated_keys(spark):
    d = spark.createDataFrame([("abc",), ("",)], "w string")
    assert [sorted(r[0]) for r in d.select(lookup.deletions(F.col("w"))).collect()] == [["ab", "abc", "ac", "bc"], [""]]
    b = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert [tuple(r) for r in lookup.unique_key(b, "k").collect()] == [("a", 2)]


def test_items_in_texts_by_a_run_of_words(spark):
    items = ["one two three four five six", "two words", "x  y z u v w", ""]
    texts = ["pre-one two three four five sixth", "one two three four five", "has two wordsmiths", "x y z u v w", "a x  y z u v w b", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    i = spark.createDataFrame([(x,) for x in items], "item string")
    got = {r["id"] for r in lookup.containing(d, i, "id", "text", "item").collect()}
    assert got == {k for k, t in enumerate(texts) if t and any(x and x in t for x in items)} == {0, 2, 4}


def test_typed_record_and_shuffled_words(spark):
    r = records.make_record(spark, "q?", "a", " ")
    assert r.first()["condition"] == "no_context" and records.make_record(spark, "q", "a", "p").first()["condition"] == "has_context"
    d = spark.createDataFrame([("1", ["a", "b", "c", "d"])], "id string, tokens array<string>")
    one, two = (records.invariant_to_order(d, "tokens", "id", s).first()["tokens"] for s in (1, 2))
    assert sorted(one) == ["a", "b", "c", "d"] and one == records.invariant_to_order(d, "tokens", "id", 1).first()["tokens"] and (one != two or one != ["a", "b", "c", "d"])


def test_subjects_stay_under_their_share(spark):
    d = spark.createDataFrame([(i, "a" if i < 70 else "b" if i < 90 else "c") for i in range(100)], "id int, s string")
    n = {r["s"]: r["count"] for r in sampling.capped(d, "s", "id", 0.4).groupBy("s").count().collect()}
    assert max(n.values()) <= 0.4 * sum(n.values()) + 1 and n["c"] == 10


def test_models_on_numbers_vectors_and_variants(spark, tmp_path):
    rows = [(i, float(i % 2 * 5 + i % 3), 1.0 * (i % 5), ["good", "fine", "nice"] if i % 2 else ["bad", "poor", "sad"], "good fine nice day" if i % 2 else "bad poor sad day", i % 2) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, x double, y double, tokens array<string>, text string, label int").cache()
    numeric = models.numeric_model(["x", "y"]).fit(d)
    assert models.predicted(numeric, d).where("pred = label").count() == 60
    models.save(numeric, str(tmp_path / "m"))
    assert models.predicted(models.load(str(tmp_path / "m")), d).where("pred = label").count() == 60
    words = models.vector_model().fit(d)
    votes = models.ensemble({"numeric": numeric, "vectors": words, "again": numeric}, d, "id").collect()
    assert all(r["correct"] == r["id"] % 2 for r in votes)
    table = models.ablation(d, d, "text", {"V0": {}, "V1": {"normalize": False}})
    assert {r["variant"]: r["accuracy"] for r in table.collect()} == {"V0": 1.0, "V1": 1.0}


def test_ngram_terms(spark):
    d = spark.createDataFrame([(["ab", "c"],)], "tokens array<string>")
    terms = models.ngram_features(d, "tokens").first()["terms"]
    assert {"ab", "c", "ab c"} <= set(terms) and any("b" in x and len(x) == 3 for x in terms)
    assert d.select(text.word_ngrams(F.col("tokens"), 3)).first()[0] == []


def test_exit_codes(spark, tmp_path, capsys):
    from textmill import cli

    def write(name, labels):
        rows = [{"id": f"a_{name}_{i}".replace(name, str(len(name))) + f"{i}", "pair_id": f"{name}{i // 2}", "label": x, "hallucination_type": "none" if x else "entity", "condition": "has_context" if i % 5 < 3 else "no_context", "context": "a passage" if i % 5 < 3 else "", "question": "q", "candidate_answer": "passage", "difficulty": "easy", "excluded": False} for i, x in enumerate(labels)]
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))

    write("train", [1, 0] * 10)
    write("dev", [1, 0] * 5)
    write("test", [1, 0] * 5)
    path = str(tmp_path)
    assert cli.main(["gate", path], spark) == 0
    assert cli.main(["evaluate", path, "--split", "test"], spark) == 1 and "refused" in capsys.readouterr().out
    assert cli.main(["evaluate", path, "--split", "test", "--final"], spark) == 0
    write("dev", [1] * 30)
    assert cli.main(["gate", path], spark) == 1


def test_coefficients_and_what_is_missing(spark):
    d = spark.createDataFrame([(float(i % 2), float(i % 3), 0.0, i % 2) for i in range(30)], "x double, y double, z double, label int")
    top = models.top_coefficients(models.numeric_model(["x", "y", "z"]).fit(d), ["x", "y", "z"], 2)
    assert [n for n, _ in top] == ["x", "y"] and top[0][1] > 0
    assert models.missing(["a"], ["b", "a"]) == ["b"] and models.confidence_scale("bow_svm") == "margin" and models.confidence_scale("tfidf_nb") == "probability"
