"""Every registered query runs; those with SQL agree with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from textmill.plans import registry

DATA = "/root/testdata/sf0.001"
SLOW = {"text_classifier", "style_classifier"}


def value(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = [tuple(value(r[c]) for c in cols) for r in df.collect()]
    sql = registry.ORACLE_SQL.get(name)
    if not sql:
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = [tuple(value(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()]
    assert cols == sorted(names)
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_best_match_distance_reads_whole_texts(spark, tmp_path):
    def brute(needle, haystack):
        row = [0] * (len(haystack) + 1)
        for i, a in enumerate(needle, 1):
            old, row = row, [i]
            for j, b in enumerate(haystack, 1):
                row.append(min(old[j - 1] + (a != b), old[j] + 1, row[j - 1] + 1))
        return min(row)

    asked = "Where does the long river that passes the old town end?"
    talks = {1: (asked, "x" * 300 + asked), 2: (asked, "y" * 300 + asked[:-9]), 3: ("short", "shirt"), 4: ("", "an answer"), 5: ("a question", "")}
    rows = [(c, t, role, text) for c, pair in talks.items() for t, role, text in zip((0, 1), ("user", "assistant"), pair, strict=True)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["distance"] for r in registry.QUERIES["best_match_distance"](spark, str(tmp_path)).collect()}
    assert got == {c: brute(*pair) for c, pair in talks.items()} and got[1] == 0 and got[2] > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
