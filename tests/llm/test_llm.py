import importlib.util
import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from textmill.llm import decontaminate, html_extract, jaccard_join, license_scan, line_dedup, mixing, ngram_lm, quality_model, quality_rules, queries, suffix_dedup  # noqa: E402
from textmill.llm._bytes import Texts  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3] if i % 5 else "a", len(t or "")) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """The same rows with columns named as the operators name theirs."""
    names = ["node", "digest", "copy", "line", "name", "words", "size", "label", "task", "bucket", "packed", "code", "spans", "kept", "component", "cluster", "share", "weight", "p", "copies"]
    return df.select("*", *(F.lit(1).alias(n) for n in names))


def test_words_and_lines():
    t = Texts(["Hello  world\nfoo\xa0bar", None, "", " a", "b "])
    assert t.n_words.tolist() == [3, 0, 0, 1, 1]
    assert [t.data[a:b].tobytes().decode() for a, b in zip(*t.words, strict=True)] == ["Hello", "world", "foo\xa0bar", "a", "b"]
    assert np.bincount(t.lines[0]).tolist() == [2, 1, 1, 1, 1]


# 1


def test_mix_reaches_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(4)
    data = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 200])), None, rng.choice(["a", "a", "a", "b", "c", "é", None]), 0) for i in range(900)] + [(None, "x y", None, "a", 0), (5000, None, None, "b", 0)]
    d = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(d).toPandas()
    assert len(got) == len(data)
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    per = got.groupby("source", dropna=False).agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (abs(per.taken - per.target) <= 200).all()
    assert abs(per.target.sum() - per["size"].sum()) < 1e-6
    again = mixing.mix(d.repartition(7)).toPandas()
    key = ["doc_id", "size"]
    assert got.sort_values(key).taken.tolist() == again.sort_values(key).taken.tolist()


def filled(sizes, cap=3.0):
    """Targets by sources in order, by bisection of the words per weight."""
    w = [(1.0, 2.0, 3.0)[k % 3] for k in range(len(sizes))]
    low, high = 0.0, cap * max([*sizes, 1])
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * s, mid * x) for s, x in zip(sizes, w, strict=True)) < sum(sizes) else (low, mid)
    return [min(cap * s, low * x) for s, x in zip(sizes, w, strict=True)]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_mix_of_the_test_tables(spark, sf):
    d = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    got = mixing.mix(d).toPandas()
    words = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in d.select("doc_id", "text").collect()}
    assert dict(zip(got.doc_id.tolist(), got["size"].tolist(), strict=True)) == words and (got.copies <= 3).all()
    per = got.groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), second=("size", lambda x: x.nlargest(2).iloc[-1]))
    assert (per["size"] == per.own).all() and np.allclose(per.target, filled(per["size"].tolist()))
    assert (abs(per.taken - per.target) <= np.minimum(per.second, np.maximum(20, 0.01 * per.target))).all()


def test_settled_documents_keep_words_and_expectation():
    rng = random.Random(3)
    size, total = [4000, 900, 300, 50], 10_000
    for target in (2500.0, 6000.0, 9000.0, 10_000.0, 21_000.0):
        sums = np.zeros(4)
        for _ in range(3000):
            copies, rate = mixing.settle(size, total, target, [rng.random() for _ in size], 3.0)
            assert abs(sum(a * b for a, b in zip(size, copies, strict=True)) + rate * (total - sum(size)) - target) < 1e-6 and 0 <= rate <= 3
            sums += copies
        if 4000 < target < 20_000:  # a copy of the largest fits in, and none leaves the rest too much
            assert np.allclose(sums / 3000, target / total, atol=0.05)
    assert mixing.settle([10], 10, 25.0, [0.9], 3.0)[0] == [2]


def test_mix_keeps_ids_and_spreads_equal_ids(spark):
    big = 2**60
    data = [(big + k, "a b c d " * (k % 5 + 1), None, "s", 0) for k in range(6)] + [(None, f"x y {k}", None, "s", 0) for k in range(50)] + [(7, "e f", None, "t", 0)] * 4
    d = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(d)
    assert sorted(r[0] for r in got.where("doc_id is not null").select("doc_id").collect()) == sorted([big + k for k in range(6)] + [7] * 4)
    rows = mixing.mixed_rows(clashing(d))
    assert "copy_" in rows.columns and rows.drop("copy_").columns == clashing(d).columns
    took = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    per = {r["source"]: r["target"] for r in got.select("source", "target").distinct().collect()}
    assert all(abs(took.get(k, 0) - t) <= 20 for k, t in per.items())
    assert rows.where("doc_id > 100").select("doc_id").distinct().join(d, "doc_id", "left_anti").count() == 0


def test_targets_are_capped_and_reshared(spark):
    s = spark.createDataFrame([("a", 10), ("b", 10), ("c", 100), (None, 880)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    # weights 1 2 3 1 of 1000; a, b and c stop at 30, 30 and 300
    assert t == {"a": 30.0, "b": 30.0, "c": 300.0, None: 640.0}


def test_targets_of_equal_sources(spark):
    s = spark.createDataFrame([("a", 100), ("b", 200), ("c", 300), ("d", 5)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    # weights 1 2 3 1 of 605: a, b and c have one ratio of size to weight; d stops at 15
    assert t["d"] == 15.0 and all(abs(t[k] - 590 * w / 6) < 1e-9 for k, w in (("a", 1), ("b", 2), ("c", 3)))


def test_pivot_keeps_words_and_expectation():
    rng = random.Random(0)
    size, p = [3, 5, 8, 2, 7], [0.2, 0.7, 0.5, 0.9, 0.4]
    sums = np.zeros(5)
    for _ in range(4000):
        q, left = mixing.pivot(size, p, [rng.random() for _ in size], False)
        assert abs(sum(a * b for a, b in zip(size, q, strict=True)) - sum(a * b for a, b in zip(size, p, strict=True))) < 1e-9
        assert sum(0 < x < 1 for x in q) == (left >= 0)
        sums += q
    assert np.allclose(sums / 4000, p, atol=0.04)


# 2


def test_leaks(spark, rows, docs):
    items = [(0, rows[3][1]), (1, rows[10][1]), (2, "a b c"), (3, None), (4, ""), (5, "one"), (6, rows[3][1]), (7, "not there at all in any text")]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(clashing(docs), b).collect()}
    want = brute.leaks(rows, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = {r[0] for r in decontaminate.decontaminated(docs, b).select("doc_id").collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in want}


def test_no_benchmark_no_leak(spark, docs):
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_blocks_find_every_item_in_the_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**16, (60, decontaminate.BLOCKS), np.uint16)
    near = prints.copy()
    for row in near:
        for bit in rng.choice(decontaminate.BITS, decontaminate.RADIUS, replace=False).tolist():
            row[bit // 16] ^= np.uint16(1 << bit % 16)
    w, i, far = decontaminate.Blocks(prints).within(near)
    assert {(k, k) for k in range(60)} <= set(zip(w.tolist(), i.tolist(), strict=True)) and far.max() <= decontaminate.RADIUS


def test_blocks_prune_and_miss_little():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, (200, 40)).astype(np.uint64)
    other = rng.integers(0, 2**63, (200, 40)).astype(np.uint64)
    near = items.copy()  # 35 of 40 shingles: a similarity of 35 / 45, close above the limit of 0.75
    near[:, :5] = rng.integers(0, 2**63, (200, 5))
    prints = lambda sets: decontaminate.simhash(np.stack([decontaminate.signs(x).sum(0, dtype=np.int32) for x in sets]))
    blocks = decontaminate.Blocks(prints(items))
    w, i = blocks.candidates(prints(other))
    assert len(w) < 0.2 * 200 * 200  # of random pairs the blocks let a sixth through, the radius none
    assert not len(blocks.within(prints(other))[0])
    w, i, _ = blocks.within(prints(near))
    assert (w == i).sum() >= 198


@pytest.mark.parametrize("words", [40, 2_000_000])
def test_blocks_of_the_benchmark(spark, rows, docs, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
    items = [(k, rows[k][1]) for k in range(0, 30, 3)]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, b).collect()}
    assert got == set(brute.leaks(rows, items))
    assert {r[0] for r in decontaminate.decontaminated(docs, b).select("doc_id").collect()} == {i for i, _ in rows} - {i for i, _ in got}


def test_leaks_of_rows_without_id_go(spark):
    item = " ".join(f"w{i}" for i in range(30))
    big = 2**60 + 1
    d = clashing(spark.createDataFrame([(None, f"before {item} after"), (None, "nothing of that"), (big, f"so {item}"), (big + 1, "clean text")], "doc_id long, text string"))
    b = spark.createDataFrame([(0, item)], "item_id long, text string")
    left = decontaminate.decontaminated(d, b)
    assert left.columns == d.columns and {(r["doc_id"], r["text"]) for r in left.collect()} == {(None, "nothing of that"), (big + 1, "clean text")}
    assert {r["doc_id"] for r in decontaminate.contaminated(d, b).collect()} == {None, big}


def test_very_long_text_with_an_item(spark):
    item = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, " ".join(["w1 w2 w3 w4 w5"] * 20_000) + " " + item)], "doc_id long, text string")
    got = decontaminate.contaminated(d, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["start_word"], r["similarity"]) for r in got] == [(1, 100_000, 1.0)]


# 3


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, rows, docs, order):
    want, p, words = brute.kneser_ney(rows, order, ngram_lm.discounts_of)
    assert math.isclose(sum(p(("<s>",) * (order - 1), w) for w in [*words, "?"]), 1.0)
    for r in ngram_lm.score_held_out(clashing(docs), order=order).collect():
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-6) and math.isclose(r["score"], w[5], rel_tol=1e-5)


def test_language_model_over_many_buckets_and_passes(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(ngram_lm, "bucket_counts", lambda texts, order: {1: 3, 2: 5, 3: 11})
    want, _, _ = brute.kneser_ney(rows, 3, ngram_lm.discounts_of)
    got = ngram_lm.score_held_out(docs).collect()
    assert len(got) == len(want) and all(math.isclose(r["score"], want[r["doc_id"]][5], rel_tol=1e-5) for r in got)


def test_split_keys_and_narrow_numbers():
    keys = np.array([1 << 8, 2 << 8, (5 << 32) + (1 << 8), (5 << 32) + (7 << 16), (5 << 32) + (9 << 16), 2**64 - 256], np.uint64)
    table = ngram_lm._split(keys, "key")
    k, found = ngram_lm._find(table, "key", keys)
    assert found.all() and k.tolist() == [0, 1, 2, 3, 4, 5]
    assert not ngram_lm._find(table, "key", np.array([0, 3 << 8, 5 << 32, (5 << 32) + (8 << 16), 6 << 32], np.uint64))[1].any()
    x = np.array([0, 254, 255, 256, 7, 1 << 40])
    assert ngram_lm._wide(ngram_lm._narrow(x, "x"), "x", np.array([5, 0, 3, 2, 1, 4])).tolist() == x[[5, 0, 3, 2, 1, 4]].tolist()


def test_registered_language_model_has_order_3(spark, rows, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want, _, _ = brute.kneser_ney(rows, 3, ngram_lm.discounts_of)
    got = queries.op3_ngram_lm(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and all(math.isclose(r["score"], want[r["doc_id"]][5], rel_tol=1e-5) for r in got)


# 4


@pytest.mark.parametrize("block", [4_000_000, 150])
def test_jaccard_components(rows, docs, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(clashing(docs)).collect()}
    assert got == brute.components(rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_connected_components(spark, seed):
    from textmill.llm._shared import components

    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(30)] + [(400, 400 + i) for i in range(30)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_one_of_each_group(rows, docs):
    want = {c for _, c in brute.components(rows).values()}
    assert {r[0] for r in jaccard_join.one_of_each(docs).select("doc_id").collect()} == want


def test_one_of_each_group_with_null_ids(spark):
    t = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*t[:k], "changed", *t[k + 1 :]])
    rows = [(None, near(0)), (2**60 + 1, near(59)), (2**60 + 2, " ".join(t)), (5, "quite another text, of more than five words"), (None, None), (None, None), (None, "a text without id, of its own, of more than five words"), (6, ""), (8, "same id, first text of two here"), (8, "same id, other text that stands alone here")]
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    left = jaccard_join.one_of_each(d)
    want = [r for r in rows if r[0] not in (2**60 + 1, 2**60 + 2)]
    assert left.columns == d.columns and sorted(map(repr, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(repr, want))
    ids = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(d).where("doc_id is not null").collect()}
    assert ids == {2**60 + 1: None, 2**60 + 2: None, 5: 5, 6: 6, 8: 8}
    copies = spark.createDataFrame([(None, near(0))] * 4 + [(1, near(0)), (1, near(0))], "doc_id long, text string")
    assert [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(copies).collect()] == [(None, near(0))]


def test_trees_prune_but_lose_nothing():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**62, rng.integers(5, 120)).astype(np.uint64)
        sets.append(np.unique(base))
        for _ in range(rng.integers(0, 4)):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 2**62, 3).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    forest, want = jaccard_join.Forest(len(sets)), jaccard_join.Forest(len(sets))
    verified = jaccard_join.link(sets, forest)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                want.join(i, j)
    assert [forest.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]
    assert verified < len(sets) * (len(sets) - 1) / 4


# 5


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(rows, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    out = suffix_dedup.dedup_suffixes(clashing(docs), with_text=True).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out}
    assert got == brute.suffixes(rows)
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in out)


@pytest.mark.parametrize("descending", [False, True])
def test_suffix_dedup_in_any_order(spark, descending):
    rng = random.Random(5)
    piece = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    low, shared, own = piece(60), piece(60), piece(300)
    five = low + own + shared  # shares `low` with a smaller doc_id and `shared` with a larger one
    rows = [(1, piece(100) + low), (5, five), (7, piece(80) + shared + piece(80)), (50, five), (100, five)]
    assert brute.suffixes(rows)[7][1] >= 60
    d = spark.createDataFrame(sorted(rows, reverse=descending), "doc_id long, text string").coalesce(1)
    out = suffix_dedup.dedup_suffixes(d).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == brute.suffixes(rows)


def test_suffix_dedup_of_one_id_with_two_texts(spark):
    rng = random.Random(9)
    piece = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    a, b = piece(120), piece(90)
    rows = [(1, piece(40) + a), (2, a + piece(30)), (2, piece(70) + b), (2, piece(10)), (3, b + a), (4, a + piece(30)), (None, b), (None, b + piece(20))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup_suffixes(d).collect())
    seen, want = {}, []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        for p in range(len(t) - 49):
            seen.setdefault(t[p : p + 50], i)
    for i, t in rows:
        gone = set()
        for p in range(len(t) - 49):
            if seen[t[p : p + 50]] != i:
                gone.update(range(p, p + 50))
        want.append((-1 if i is None else i, len(t), len(gone)))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    rng = random.Random(seed)
    n = suffix_dedup.SIZE
    data = np.array([rng.choice([0, 1, 2, 255]) if rng.random() < 0.7 else 7 for _ in range(600)] + [7] * 90 + [3] * 90 + [9, 9, 1], np.uint8)
    data = np.concatenate([data, data[40:300]])
    starts = np.array(sorted(rng.sample(range(len(data) - n + 1), 300)))
    order = suffix_dedup.suffix_array(data, starts)
    raw = data.tobytes() + bytes(3 * n)
    assert set(starts.tolist()) <= set(order.tolist()) and len(set(order.tolist())) == len(order)
    keys = [raw[i : i + n] for i in order.tolist()]
    assert keys == sorted(keys)


def test_suffix_classes():
    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.choice(b"ab\x00\xffzyxwvutsrqponm") if rng.random() < 0.5 else 97 for _ in range(2000)), np.uint8)
    data = np.concatenate([data, data[100:400], data[50:300]])
    starts = np.arange(len(data) - suffix_dedup.SIZE + 1)
    kind = suffix_dedup.classes(data, starts)
    raw = data.tobytes()
    by = {}
    for i, k in zip(starts.tolist(), kind.tolist(), strict=True):
        by.setdefault(k, set()).add(raw[i : i + suffix_dedup.SIZE])
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


# 6

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">home</a></li></ul></nav>
<div class="sidebar"><p>Some long sidebar text, with commas, and more words to see here, really</p></div><div class="post"><h2>Title</h2><p>First paragraph, which is long enough, has commas &amp; words.
<p>Second   paragraph
goes on, and it is <b>long</b> enough as&nbsp;well.<br>It ends.<ul><li>one item<li>two item</ul><form><p>Subscribe, now, please, to this long newsletter, ok</p></form></div>
<div id="comments"><p>I think, this is a comment, long enough, to count, yes, really, it is</p></div><div class="cookie-notice">We use cookies, as everybody does, sorry</div><footer>foot</footer></body></html>"""


def test_main_text():
    assert html_extract.extract(PAGE) == "Title\nFirst paragraph, which is long enough, has commas & words.\nSecond paragraph goes on, and it is long enough as well. It ends.\none item\ntwo item"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</p></div>", "<nav><p>only, a, menu</p></nav>", "<script>x", "<!-- open"])
def test_odd_pages(page):
    assert "menu" not in html_extract.extract(page)


ARTICLE = "<h2>Title</h2><p>First paragraph, which is long enough to be read, has commas, and words that go on for more than a line of text.</p><p>Second one, also long, with commas, and words.</p>"
COMMENTS = '<div id="comments"><article><p>I think, this is a comment, long enough, to count, yes, really, it is</p></article></div>'


@pytest.mark.parametrize(
    "start, end",
    [
        ('<div class="content has-sidebar">', "</div>"),
        ('<div id="page" class="header-fixed">', "</div>"),
        ('<div class="post no-comments">', "</div>"),
        ('<div class="header-fixed"><div class="no-sidebar"><article>', "</article></div></div>"),
        ('<div class="no-sidebar"><main>', "</main></div>"),
        ('<div class="header-fixed">', "</div>"),
    ],
)
def test_wrappers_of_the_article_stay(start, end):
    text = html_extract.extract(f'<body><div class="sidebar"><p>Some sidebar text, with commas</p></div>{start}{ARTICLE}{COMMENTS if "article" in start or "main" in start else ""}{end}</body>')
    assert "First paragraph" in text and "Second one" in text and "sidebar" not in text


def test_comments_and_cards_stay_cut():
    related = '<div class="related"><article><p>Another story, that is long enough, to count, with commas, and more words</p></article></div>'
    for page in (f"<body><article>{ARTICLE}</article>{COMMENTS}{related}</body>", f'<body><div class="post">{ARTICLE}</div><div class="post-comments"><p>{"a comment, that is long, " * 40}</p></div></body>'):
        text = html_extract.extract(page)
        assert "First paragraph" in text and "comment" not in text and "Another" not in text


PROSE = "which is long enough to be read, has commas, and words that go on for more than a line of text."


@pytest.mark.parametrize(
    "container",
    [
        '<div class="post hentry tag-politics">{}</div>',
        '<div class="main-content no-sidebar">{}</div>',
        '<div class="article-body with-header">{}</div>',
        '<div class="content has-footer">{}</div>',
        '<div class="review-body">{}</div>',
        '<div class="legal-text">{}</div>',
        '<div class="entry-content">{}</div>',
        '<form action="/"><article>{}</article><input name="q"></form>',
        '<form action="/"><div>{}</div><label>Search</label></form>',
        "<article>{}</article>",
        "<main>{}</main>",
        '<div role="main">{}</div>',
        '<div itemprop="articleBody">{}</div>',
        "<section><div><div>{}</div></div></section>",
        "<table><tr><td>{}</td></tr></table>",
        '<div id="story">{}</div>',
        "<div><center>{}</center></div>",
        '<div class="share-wrapper"><article>{}</article></div>',
        '<div class="blog-post related-links">{}</div>',
        '<div class="comment-free"><main>{}</main></div>',
        "<blockquote>{}</blockquote>",
    ],
)
def test_containers_come_back_whole(container):
    article = f"<h2>Title</h2><p>First paragraph, {PROSE}</p><p>Second &eacute;one,  also\nlong, {PROSE}</p>"
    page = (
        '<html><head><title>x</title></head><body><header><p>Site, with a header, quite long</p></header><nav><ul><li><a href="/">menu one</a></li></ul></nav><div class="sidebar"><p>A sidebar text, with commas, and more of it, '
        + PROSE
        + "</p></div>"
        + container.format(article)
        + '<div id="comments"><p>A comment, that somebody wrote, '
        + PROSE
        + '</p></div><div class="cookie-notice">cookies</div><footer>the foot</footer></body></html>'
    )
    assert html_extract.extract(page) == f"Title\nFirst paragraph, {PROSE}\nSecond éone, also long, {PROSE}"


def test_deep_and_wide_pages():
    deep = html_extract.extract("<body>" + "".join(f"<div>Some text, number {i}, here" for i in range(5000)))
    assert deep.count("\n") > 4000 and "number 4999" in deep


def test_pages_keep_large_ids(spark):
    d = spark.createDataFrame([(2**60 + 1, "u", PAGE), (None, "v", PAGE)], "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"] for r in html_extract.extract_pages(d).collect()} == {2**60 + 1, None}


def test_pages(spark):
    d = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (1, "u", PAGE)], "page_id long, url string, html string")
    got = html_extract.extract_pages(clashing(d)).collect()
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_pages(d.limit(0)).count() == 0


# 7


def test_rules(rows, docs):
    for r in quality_rules.quality_rules(clashing(docs)).collect():
        text = dict(rows)[r["doc_id"]]
        want = brute.rules(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_distance_of_junk(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    good = [(i, "The " + " ".join(rng.choice([word(), word(), word(), rng.choice(["the", "of", "and"])]) for _ in range(150)) + ".", "en", "s", 0) for i in range(30)]
    junk = [(100 + i, " ".join(word() + rng.choice(["***", "%%%", "$$$"]) for _ in range(150)), "en", "s", 0) for i in range(3)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(good + junk, SCHEMA)).collect()}
    assert all(got[i] for i in range(30)) and not any(got[100 + i] for i in range(3))


def test_gibberish_in_ordinary_letters_goes_and_short_texts_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    usual = lambda n: "The " + " ".join(rng.choice([word(), word(), rng.choice(["the", "of", "and", "to"])]) for _ in range(n)) + "."
    good = [(i, usual(150), "en", "s", 0) for i in range(60)] + [(200 + i, usual(12), "en", "s", 0) for i in range(20)]
    odd = [(100 + i, " ".join(word() for _ in range(400)) + ".", "en", "s", 0) for i in range(3)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(good + odd, SCHEMA)).collect()}
    assert not any(got[100 + i] for i in range(3)) and all(v for k, v in got.items() if not 100 <= k < 103)


def test_quality_of_labelled_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.quality_rules(d).where("not base_failed").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.3


def test_rejected_documents_go(rows, docs):
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs).where("kept").collect()}
    assert {r[0] for r in quality_rules.kept_documents(docs).select("doc_id").collect()} == kept


# 8


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_lines(spark, seed):
    rng = random.Random(seed)
    pool = ["a b c", "d e f g h i j k l m n", "x", "", "p q r s t", "one two three four five six seven", " ", "zz yy xx"]
    data = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(50)] + [(100, None), (101, "")]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["line"]) for r in line_dedup.repeated_lines(d, 10).collect()} == brute.lines(data, 10)


def test_lines_are_cut(rows, docs):
    gone = brute.lines(rows, line_dedup.MIN_WORDS)
    for r in line_dedup.dedup_lines(clashing(docs)).collect():
        text = dict(rows)[r["doc_id"]]
        want = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (r["doc_id"], k) not in gone)
        assert r["text"] == want and r["n_lines_removed"] == sum(i == r["doc_id"] for i, _ in gone)


def test_hot_lines_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    data = [(i, f"a common line of words\nown {i} line here\nshort\nanother common line here") for i in range(40)] + [(None, "a common line of words\nshort"), (3, "a second text of three\nown 3 line here")]
    d = clashing(spark.createDataFrame(data, "doc_id long, text string")).withColumn("__doc", F.lit(5)).withColumn("n_lines_removed", F.lit("x"))
    out = line_dedup.dedup_lines(d)
    assert out.columns == [*d.columns, "n_lines_removed_"]
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (None, "a common line of words\nshort") in got and (0, "own 0 line here\nshort\nanother common line here") in got and (7, "own 7 line here") in got
    assert {r["__doc"] for r in out.collect()} == {5}


# 9


def test_labellers_accuracies_are_found():
    rng = np.random.default_rng(0)
    n, k = 6000, len(quality_model.LABELLERS)
    truth = rng.random(n) < 0.8
    right = np.linspace(0.65, 0.95, k)
    v = np.where(rng.random((n, k)) < right, truth[:, None], ~truth[:, None]).astype(int)
    v[rng.random((n, k)) < 0.2] = -1
    patterns, counts = np.unique(((v + 1) * 3 ** np.arange(k)).sum(1), return_counts=True)
    post, found, prior = quality_model.fit_labellers(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.05 and np.abs(found - right).max() < 0.06
    of = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    assert np.mean((np.array([of[x] for x in ((v + 1) * 3 ** np.arange(k)).sum(1).tolist()]) > 0.5) == truth) > 0.95


def test_classifier_on_held_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_model.classify(d).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.9
    assert got[got.quality == 1].kept.mean() > 0.97


# 10


def test_licenses(spark):
    mit = license_scan.TEMPLATES["gpl-3.0-line"]
    texts = ["word " * 40 + mit.upper() + " more" * 40, mit, None, "", "licensed under", "Licensed\tunder  CC BY-NC 4.0. and so on", "no license here at all, sorry", " ".join(mit.split()[:11] + ["four."])]
    d = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in license_scan.scan_licenses(d).collect()}
    assert got == {(0, "gpl-3.0-line"): 1.0, (1, "gpl-3.0-line"): 1.0, (5, "cc-by-nc-4.0-line"): 1.0, (7, "gpl-3.0-line"): 7 / 8}


def test_license_texts(spark):
    texts = [f"some code here {license_scan.TEMPLATES[k]} and more of it" for k in ("mit-text", "bsd-3-clause-text", "isc-text", "apache-2.0-text", "lgpl-3.0-text", "lgpl-notice", "agpl-notice")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in license_scan.scan_licenses(d).collect()}
    want = ["mit-text", "bsd-3-clause-text", "isc-text", "apache-2.0-text", "lgpl-3.0-text", "lgpl-notice", "agpl-notice"]
    assert all(got.get((i, k)) == 1.0 for i, k in enumerate(want))


def test_own_templates_without_license_words(spark):
    clause = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    d = spark.createDataFrame([(1, f"first {clause} last"), (2, "nothing of that kind is said in here")], "doc_id long, text string")
    for own in ({"clause": clause}, {"digits": "1 2 3 4 5 6 7 8"}):
        text = next(iter(own.values()))
        e = d.unionByName(spark.createDataFrame([(3, text)], "doc_id long, text string"))
        got = {r["doc_id"] for r in license_scan.scan_licenses(e, templates=own).collect()}
        assert got == ({1, 3} if "clause" in own else {3})


def test_keywords_cover_the_templates():
    for text in license_scan.TEMPLATES.values():
        w = text.lower().split()
        sh = [w[i : i + 5] for i in range(len(w) - 4)]
        assert sum(any(k in x for x in s for k in license_scan.KEYWORDS) for s in sh) > 0.25 * len(sh)


# all


@pytest.mark.parametrize(
    "run",
    [mixing.mix, mixing.mixed_rows, ngram_lm.score_held_out, jaccard_join.jaccard_components, suffix_dedup.dedup_suffixes, quality_rules.quality_rules, line_dedup.dedup_lines, quality_model.classify, license_scan.scan_licenses],
    ids=lambda f: f.__name__,
)
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


@pytest.mark.parametrize("run", [mixing.mix, jaccard_join.jaccard_components, suffix_dedup.dedup_suffixes, quality_rules.quality_rules, line_dedup.dedup_lines, ngram_lm.score_held_out, quality_model.classify], ids=lambda f: f.__name__)
def test_null_ids_and_repeated_rows(spark, run):
    row = (None, "some words that stand here, quite a few of them, to be read more than once", None, None, None)
    d = spark.createDataFrame([row, row, (7, row[1], "en", "a", 1), (7, row[1], "en", "a", 1), (8, None, None, None, None)], SCHEMA)
    assert run(d).count() == 5


@pytest.mark.parametrize("run", [lambda d, b: quality_rules.kept_documents(d), lambda d, b: line_dedup.dedup_lines(d), lambda d, b: jaccard_join.one_of_each(d), decontaminate.decontaminated, lambda d, b: mixing.mixed_rows(d)], ids=["rules", "lines", "near", "leaks", "mix"])
def test_stage_forms_with_odd_rows(spark, empty, run):
    text = "some words that stand here, quite a few of them, to be read more than once"
    b = spark.createDataFrame([(0, "no such item stands in any text of these")], "item_id long, text string")
    d = spark.createDataFrame([(None, text, None, None, None), (7, text, "en", "a", 1), (7, text, "en", "a", 1), (8, None, None, None, None), (9, "", "en", "b", 0)], SCHEMA)
    out = run(clashing(d), b)
    assert set(clashing(d).columns) <= set(out.columns)
    assert {r["text"] for r in out.collect()} <= {text, None, ""}
    assert run(clashing(empty), b).count() == 0


def test_queries_have_their_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark):
    spec = importlib.util.find_spec("corpus_pipeline")
    if spec is None:
        pytest.skip("no pipeline")
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, d, "/root/testdata/sf0.001")
        if k < 4:
            assert out.columns == d.columns and out.dtypes == d.dtypes
        assert 0 < out.count()
        d = out.select(d.columns)
