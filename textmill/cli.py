"""Command line: `python -m textmill.cli gate PATH` and `python -m textmill.cli evaluate PATH --split dev`. Exit code 1 means no."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textmill.functions.similarity import exact_in_passage
from textmill.operators import metrics, pairs
from textmill.sources.files import read_split, read_splits

SPLITS = ("train", "dev", "test")


def gate(spark: SparkSession, path: str, splits: list[str], strict: bool) -> int:
    """The corpus-level checks over the splits; 1 if they fail, or with `strict` if a record breaks a rule."""
    d = read_splits(spark, path, tuple(splits))
    row = pairs.gate(d).first()
    broken = pairs.violations(d, pairs.record_rules(), "id").groupBy("rule").count().collect()
    print(row.asDict(), {r["rule"]: r["count"] for r in broken})
    return int(not row["passed"] or strict and bool(broken))


def evaluate(spark: SparkSession, path: str, split: str, final: bool) -> int:
    """The rule baselines of a split; the test split is scored once, so it is refused without `final`."""
    if split == "test" and not final:
        print("refused: the test split is scored once, at the end; pass --final if this is it")
        return 1
    d = read_split(spark, path, split)
    rules = {"exact": exact_in_passage(F.col("candidate_answer"), F.col("context")), "always correct": F.lit(1), "always wrong": F.lit(0)}
    metrics.baseline_table(d, "label", rules, ["condition", "difficulty"]).orderBy("model", "slice", "value").show(100, truncate=False)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textmill")
    sub = parser.add_subparsers(dest="command", required=True)
    g = sub.add_parser("gate")
    g.add_argument("path")
    g.add_argument("--splits", nargs="+", choices=SPLITS, default=["train", "dev"])
    g.add_argument("--strict", action="store_true")
    e = sub.add_parser("evaluate")
    e.add_argument("path")
    e.add_argument("--split", choices=SPLITS, default="dev")
    e.add_argument("--final", action="store_true")
    a = parser.parse_args(argv)
    if spark is None:
        from textmill.session import session

        spark = session()
    return gate(spark, a.path, a.splits, a.strict) if a.command == "gate" else evaluate(spark, a.path, a.split, a.final)


if __name__ == "__main__":
    raise SystemExit(main())
