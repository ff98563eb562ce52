import math
import random
import threading
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from textmill.operators import annotate, lm, lookup, metrics, pairs, sampling, vectorize, verify, wordproblems
from textmill.plans import cases


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_f1_by_hand(spark):
    d = frame(spark, [(1, 1), (1, 1), (0, 1), (0, 1)], "t int, p int")
    r = metrics.evaluate(d, "t", "p").first()
    assert round(r["macro_f1"], 3) == 0.333 and r["accuracy"] == 0.5 and r["collapsed"]
    d = frame(spark, [(0, 0), (0, 0), (0, 1), (1, 1)], "t int, p int")
    x = d.agg(*(c.alias(k) for k, c in metrics.precision_recall_f1("t", "p", 0).items())).first()
    assert (x["precision"], round(x["recall"], 3), round(x["f1"], 3)) == (1.0, 0.667, 0.8)


@pytest.mark.parametrize(("scores", "want"), [([1.0, 2.0, 3.0, 4.0], 1.0), ([4.0, 3.0, 2.0, 1.0], 0.0), ([1.0] * 4, 0.5)])
def test_auc(spark, scores, want):
    d = frame(spark, list(zip([0, 0, 1, 1], scores, strict=True)), "t int, s double")
    assert metrics.auc(d, "t", "s").first()["auc"] == want


def test_auc_of_one_class_is_null(spark):
    assert metrics.auc(frame(spark, [(1, 0.5)], "t int, s double"), "t", "s").first()["auc"] is None


def test_mcnemar():
    assert metrics.mcnemar_p(0, 0) == 1.0
    assert metrics.mcnemar_p(10, 0) < 0.01
    assert metrics.mcnemar_p(5, 5) == 1.0


def test_threshold_is_the_first_best(spark):
    d = frame(spark, [(1, 0.9), (1, 0.8), (0, 0.3), (0, 0.2)], "t int, s double")
    r = metrics.tune_threshold(d, "t", "s").first()
    assert r["macro_f1"] == 1.0 and r["threshold"] == 0.31
    low = frame(spark, [(1, 0.1), (0, 0.6)], "t int, s double")
    assert metrics.tune_threshold(low, "t", "s", keep_low=True).first()["threshold"] == 0.1


def test_kappa(spark):
    d = frame(spark, [(1, 1), (1, 1), (0, 0), (0, 1)], "a int, b int")
    assert round(metrics.kappa(d, "a", "b").first()["kappa"], 3) == 0.5
    assert metrics.kappa(frame(spark, [(1, 1), (1, 1)], "a int, b int"), "a", "b").first()["kappa"] == 1.0


def test_bootstrap_of_perfect_predictions_is_a_point(spark):
    d = frame(spark, [(i // 2, i % 2, i % 2) for i in range(40)], "pair int, t int, p int")
    r = metrics.bootstrap(d, "t", "p", "pair", 50).first()
    assert r["low"] == r["high"] == 1.0


def test_consensus_counts_abstentions(spark):
    v = frame(spark, [(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, None), (2, 2, None)], "item int, judge int, vote string")
    r = {x["item"]: x for x in annotate.consensus(v, "item", "judge", "vote", 0.667).collect()}
    assert r[1]["value"] == "a" and not r[1]["accepted"] and r[2]["value"] is None and not r[2]["accepted"]
    assert annotate.consensus(v, "item", "judge", "vote", 2 / 3).where("item = 1").first()["accepted"]


def test_replies(spark):
    d = frame(spark, [('x {"verdict": "WRONG", "confidence": 7}',), ("it is correct",), ("??",), ('{"verdict": "correct", "confidence": "high"}',)], "r string")
    got = [tuple(x["p"]) for x in d.select(annotate.parse_reply(F.col("r"), "verdict", ["correct", "wrong"]).alias("p")).collect()]
    assert got == [("wrong", 1.0), ("correct", 0.4), (None, 0.0), ("correct", 0.5)]


def test_settle(spark):
    v = frame(spark, [("r1", 0, "numeric", "has_context"), ("r1", 0, "numeric", "has_context"), ("r2", 0, "entity", "no_context"), ("r3", 1, None, "no_context"), ("r4", 0, "entity", "has_context"), ("r4", 0, "numeric", "has_context")], "record string, label int, type string, condition string")
    r = {x["record"]: (x["type"], x["source"]) for x in annotate.settle(v, "record", "label", "type", "condition").collect()}
    assert r["r1"] == ("numeric", "double_annotated") and r["r2"][0] is None and r["r3"] == (None, "humans say correct") and r["r4"] == (None, "different types")


def test_pairs(spark):
    d = frame(spark, [("a", 1), ("a", 0), ("b", 1), ("c", 1), ("c", 1), ("d", 0), ("d", 1), ("d", 1)], "pair_id string, label int")
    assert {r[0] for r in pairs.genuine_pairs(d).select("pair_id").collect()} == {"a"}
    assert {r[0] for r in pairs.drop_contradictions(d, ["pair_id"]).select("pair_id").collect()} == {"b", "c"}


def test_keep_first_and_last(spark):
    d = frame(spark, [("k", 2, "b"), ("k", 1, "a"), (None, 3, "c")], "k string, n int, v string")
    assert sorted((r["v"] for r in pairs.keep_first(d, ["k"], ["n"]).collect())) == ["a", "c"]
    assert sorted((r["v"] for r in pairs.keep_last(d, ["k"], ["n"]).collect())) == ["b", "c"]


def test_split_is_whole_and_proportional(spark):
    d = frame(spark, [(i // 2, i, "xy"[i // 2 % 2]) for i in range(400)], "pair int, id int, s string")
    out = sampling.stratified_split(d, "pair", ["s"])
    assert pairs.leakage(out, "pair").count() == 0
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 280, "dev": 60, "test": 60}


def test_subject_cap_settles():
    kept = sampling.subject_cap({"a": 900, "b": 50, "c": 50, "d": 50}, 0.4)
    assert kept["b"] == 50 and kept["a"] <= 0.4 * (sum(kept.values())) + 1


def test_char_lm_sums_to_one(spark):
    train = frame(spark, [("abcab",), ("bca",)], "text string")
    counts, alphabet = lm.char_lm(train, "text", 2)
    v = alphabet.first()["alphabet"]
    for h in "abc":
        rows = [r for r in counts.collect() if r["history"] == h]
        total = rows[0]["total"] if rows else 0
        assert math.isclose(sum((r["n"] + 0.1) / (total + 0.1 * v) for r in rows) + (v - len(rows)) * 0.1 / (total + 0.1 * v), 1.0)
    s = lm.char_lm_score((counts, alphabet), frame(spark, [(1, "abc"), (2, "")], "id int, text string"), "id", "text", 2)
    got = {r["id"]: r["log_prob"] for r in s.collect()}
    assert got[2] == 0.0 and got[1] < 0


def test_passage_score():
    assert lm.passage_score("", "abc") == 0.0
    assert lm.passage_score("abc", "abcabc") > lm.passage_score("zzz", "abcabc")


def test_coverage_and_vectors(spark):
    train = frame(spark, [(["ক", "খ"],)], "tokens array<string>")
    dev = frame(spark, [(["ক", "অজানা"],)], "tokens array<string>")
    assert vectorize.coverage(dev, "tokens", vectorize.vocabulary(train, "tokens", 1)).first()["oov"] == 0.5
    v = frame(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<double>")
    d = frame(spark, [(1, ["a", "a", "b", "z"])], "id int, tokens array<string>")
    x = vectorize.document_vectors(d, "id", "tokens", v, 2).first()["vector"]
    assert [round(y, 3) for y in x] == [0.667, 0.333]


def test_one_to_one_fails_on_a_repeated_key(spark):
    left, right = frame(spark, [(1,)], "k int"), frame(spark, [(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(Exception, match="duplicate key"):
        lookup.one_to_one(left, right, ["k"]).collect()


def test_one_edit_neighbours_against_all_pairs(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)})
    a = frame(spark, [(w,) for w in words], "a string")
    got = {(r["a"], r["b"]) for r in lookup.one_edit_neighbours(a, a.withColumnRenamed("a", "b"), "a", "b").collect()}
    lev = a.crossJoin(a.withColumnRenamed("a", "b")).where("levenshtein(a, b) <= 1")
    assert got == {(r["a"], r["b"]) for r in lev.collect()}


def test_blocked_match(spark):
    bank = frame(spark, [("what is the capital of france", ["paris", "rome"], 1), ("who wrote the book of songs", ["paris"], 0)], "bank_q string, options array<string>, label int")
    q = frame(spark, [(1, "what is the capital city of france", "paris"), (2, "something else", "rome")], "id int, q string, option string")
    got = lookup.blocked_match(q, bank, "id", "q", "option", "options", "bank_q").collect()
    assert [(r["id"], r["label"]) for r in got] == [(1, 1)]


@pytest.mark.parametrize("labelled", [True, False])
def test_blocked_match_against_all_pairs(spark, labelled):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, n)))
    entries = [(text(6), rng.sample("xyz", rng.randint(1, 2)), rng.randint(0, 1)) for _ in range(120)]
    entries = list({e[0]: e for e in entries}.values()) + [("a b c", ["x", "x"], 1), ("C b  a", ["x"], 1)]
    asked = [(rng.randint(0, 30), text(6), rng.choice("xyzu")) for _ in range(60)] + [(90, None, "x"), (91, "a b c", "x"), (92, "a b c", None)]
    least, lead, near = 0.5, 0.05, 0.02
    want = {}
    for row in {a[0] for a in asked}:
        found = []
        for _, q, o in (a for a in asked if a[0] == row):
            for b, options, label in entries:
                mine, theirs = set((q or "").split()), set(b.lower().split())
                score = len(mine & theirs) / len(mine | theirs) if mine | theirs else 0
                found += [(-score, b, label)] * (options.count(o) if score >= least else 0)
        found.sort()
        if found:
            best, after = -found[0][0], -found[1][0] if found[1:] else 0
            unanimous = not labelled or len({label for s, _, label in found if -s >= best - near}) == 1
            if best - after >= lead or unanimous:
                want[row] = (found[0][1], round(best, 9), round(best - after, 9), unanimous)
    bank = frame(spark, entries, "bank_q string, options array<string>, label int")
    got = lookup.blocked_match(frame(spark, asked, "id int, q string, option string"), bank if labelled else bank.drop("label"), "id", "q", "option", "options", "bank_q", least, lead, near)
    assert {r["id"]: (r["bank_q"], round(r["score"], 9), round(r["margin"], 9), r["unanimous"]) for r in got.collect()} == want and len(want) > 10


def test_blocked_match_keeps_scores_that_equal_the_least(spark):
    long = [f"w{i}" for i in range(25)]
    bank = frame(spark, [(" ".join(long), ["x"])], "bank_q string, options array<string>")
    got = lookup.blocked_match(frame(spark, [(1, " ".join(long[:14]), "x")], "id int, q string, option string"), bank, "id", "q", "option", "options", "bank_q", least=0.56)
    assert [(r["id"], r["score"]) for r in got.collect()] == [(1, 0.56)]


def test_blocked_match_compares_repeated_questions_once(spark):
    bank = spark.range(4000).select(F.concat_ws(" ", F.lit("when was the town founded"), F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), F.col("id") % 63)).alias("bank_q"), F.array(F.lit("x")).alias("options"))
    asked = spark.range(40000).select("id", F.format_string("when was the town founded a%d b7", F.col("id") % 2 * 63 + 7).alias("q"), F.lit("x").alias("option"))
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    got = lookup.blocked_match(asked, bank, "id", "q", "option", "options", "bank_q").groupBy("bank_q", "score").count().collect()
    late.cancel()
    assert sorted(map(tuple, got)) == [(f"when was the town founded a{i} b7", 1.0, 20000) for i in (7, 70)]


def test_cascade_and_policy(spark):
    d = frame(spark, [(1, 0.2, None), (2, 0.8, 0), (3, 0.9, None)], "id int, s double, hard int")
    label = lookup.policy(F.col("s"), 0.5, F.col("hard"), [(F.col("id") == 3, F.lit(0))])
    assert [r[0] for r in d.orderBy("id").select(label).collect()] == [0, 0, 0]


@pytest.mark.parametrize(("question", "right", "wrong", "rule"), cases.PROBLEMS, ids=lambda x: None)
def test_word_problems(question, right, wrong, rule):
    assert (good := wordproblems.judged(question, right)) and (good[0], good[2]) == (rule, 1)
    assert (bad := wordproblems.judged(question, wrong)) and (bad[0], bad[2]) == (rule, 0)


@pytest.mark.parametrize("question", cases.OTHERS)
def test_questions_near_a_rule_abstain(question):
    assert wordproblems.judged(question, "3") is None


def test_conflicting_rules_abstain():
    both = "square root of 16; which of these is prime?"
    assert {n for n, _ in wordproblems.solutions(both)} == {"square_root", "chosen_prime"}
    assert wordproblems.judged(both, "3") is None


def test_lost_digits_are_restored():
    up = lambda x: x * Fraction(11, 10)
    assert wordproblems.restored("12", "1320", up, "back") == 1200
    assert wordproblems.restored("00", "150", lambda x: x * Fraction(3, 10), "front", 3) == 500
    assert wordproblems.restored("12", "7", up, "back") is None
    assert wordproblems.restored("1", "5", lambda x: Fraction(5), "back") is None  # several would do


def test_quantities_have_units():
    r = wordproblems.read("ক ও খ ৬ ও ৩ দিনে, 10% হারে 1,200 টাকা, 2:3")
    assert [(q.value, q.unit) for q in r.quantities] == [(6, "day"), (3, "day"), (10, "percent"), (1200, "money")] and r.ratio == [2, 3]


def test_word_numerals():
    assert verify.word_numbers("দুই হাজার পাঁচ") == [2005]
    assert verify.word_numbers("পাঁচ শত বিশ জন ও ৩টি") == [520, 3]


def test_samas(spark):
    d = frame(spark, [("পিতা ও মাতা",), ("তিন ফলের সমাহার",), ("মন দ্বারা গড়া",), ("abc",)], "s string")
    assert [r[0] for r in d.select(verify.samas(F.col("s"))).collect()] == ["দ্বন্দ্ব", "দ্বিগু", "তৃতীয়া তৎপুরুষ", ""]
