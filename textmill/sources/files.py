"""Reading and writing records: JSON lines, CSV sheets, banks, word lists, logs, caches. Schemas are given, never inferred."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW = "context string, prompt_bn string, response_bn string, label int"
RECORD = (
    "id string, pair_id string, pair_complete boolean, source string, source_corpus string, source_file string, source_line int, subject string, level string, condition string, context string, question string, "
    "reference_answer string, candidate_answer string, label int, hallucination_type string, difficulty string, generator_model string, generation_seed int, annotator_1 int, annotator_2 int, adjudicated boolean, "
    "provenance string, script_condition string, cmi double, cmi_method string, bengali_ratio double, error_span string, type_source string, excluded boolean, exclusion_reason string"
)
LOG = "run_id string, date string, model string, input_format string, preprocessing string, seed string, lr string, batch string, epochs string, split string, dev_macro_f1 double, test_macro_f1 double, notes string"


def read_json(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """JSON lines of a file or a folder; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def subject_of(file: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"(_qa)?\.[a-z]+(\.gz)?$", "")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Vendor JSON lines with source_file, source_line (from 1) and subject from the file's name. A file is one row while its lines are numbered."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    lines = whole.select("source_file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where(F.trim("line") != "")
    parsed = lines.select("source_file", (F.col("at") + 1).alias("source_line"), F.from_json("line", RAW, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*", "source_file", "source_line", subject_of(F.col("source_file")).alias("subject"))


def read_split(spark: SparkSession, path: str, split: str, include_excluded: bool = False) -> DataFrame:
    """A split's records; a row without `excluded` fails the read, excluded ones are left out."""
    df = read_json(spark, f"{path.rstrip('/')}/{split}.jsonl").withColumn("split", F.lit(split))
    checked = F.when(F.col("excluded").isNull(), F.raise_error(F.concat(F.lit("no `excluded` in "), F.col("id")))).otherwise(F.col("excluded"))
    df = df.withColumn("excluded", checked)
    return df if include_excluded else df.where(~F.col("excluded"))


def read_splits(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "dev")) -> DataFrame:
    out = read_split(spark, path, splits[0])
    for s in splits[1:]:
        out = out.unionByName(read_split(spark, path, s))
    return out


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV sheets, all strings, with or without a byte order mark."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("﻿")).withColumn("file", F.col("_metadata.file_name"))


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A word list: a line each, without comments and blanks, normalised. Lists are small by nature; over a million entries fail."""
    from textmill.functions.text import nfc

    rows = spark.read.text(path).select(F.trim("value").alias("w")).where("w <> '' and not startswith(w, '#')").select(nfc(F.col("w")).alias("w")).distinct().limit(1_000_001).collect()
    if not rows or len(rows) > 1_000_000:
        raise ValueError(f"{path}: {'no' if not rows else 'too many'} entries")
    return sorted(r[0] for r in rows)


def read_bank(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """Columns of a Parquet bank; fails if one is missing, or, when it runs, if a key stands twice."""
    df = spark.read.parquet(path)
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{path}: no columns {missing}")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.select(*columns).withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("__n")


def read_verified(spark: SparkSession, paths: list[str], sha256: str) -> str:
    """The first of the paths whose bytes have the digest."""
    found = {r[0]: r[1] for r in spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256)).collect()}
    for p in paths:
        if any(q.endswith(p.split("://")[-1].lstrip("/")) and d == sha256 for q, d in found.items()):
            return p
    raise FileNotFoundError(f"none of {paths} has sha256 {sha256}")


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a JSON document that maps keys to structs, gzip or not."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_idioms(spark: SparkSession, path: str) -> DataFrame:
    """A row per idiom and alternative term."""
    d = spark.read.parquet(path)
    return d.select(F.explode(F.array_distinct(F.concat(F.array("idiom"), F.coalesce("alternatives", F.array().cast("array<string>"))))).alias("term"), *[c for c in d.columns if c != "alternatives"])


def antonyms(pairs: DataFrame, known: DataFrame, least: float = 0.9) -> DataFrame:
    """Confident pairs of known words, both ways."""
    ok = pairs.where(F.col("ocr_confidence") >= least).join(known.select(F.col("word")), "word", "left_semi").join(known.select(F.col("word").alias("antonym")), "antonym", "left_semi").select("word", "antonym")
    return ok.unionByName(ok.select(F.col("antonym").alias("word"), F.col("word").alias("antonym"))).distinct()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The experiment log with numbers from its notes."""
    df = spark.read.schema(LOG).option("header", True).option("escape", '"').csv(path)
    note = lambda name: F.regexp_extract("notes", rf"{name} ([0-9.]+)", 1).try_cast("double")
    return df.withColumn("hard", note(r"has-context\+hard")).withColumn("seconds", note("seconds"))


def write_json(df: DataFrame, path: str, order: list[str | Column], allow: list[str] | None = None) -> None:
    """JSON lines with sorted keys in a fixed order; `allow` leaves other columns out."""
    cols = sorted(allow or df.columns)
    df.orderBy(*order).select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_sheets(df: DataFrame, path: str, batch: str = "batch") -> None:
    """A folder of CSV sheets, one per batch."""
    df.repartition(batch).write.mode("overwrite").option("header", True).option("escape", '"').partitionBy(batch).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """A results table; refuses to write nothing."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.write.mode("overwrite").option("header", True).csv(path)


def append_runs(spark: SparkSession, runs: DataFrame, path: str, key: str = "run_id") -> None:
    """Appends the runs that the log doesn't have."""
    try:
        runs = runs.join(spark.read.schema(LOG).option("header", True).csv(path).select(key), key, "left_anti").select(*runs.columns)
    except Exception as e:  # a log that doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    runs.write.mode("append").option("header", True).csv(path)


def next_attempt(log: DataFrame, run: str) -> str:
    n = log.where(F.col("run_id").rlike(rf"^{run}(_attempt[0-9]+)?$")).count()
    return run if not n else f"{run}_attempt{n + 1}"


class Cache:
    """A key-value log in a folder: appends are new files, of a key the latest entry counts; compact() rewrites it aside and swaps the name."""

    def __init__(self, spark: SparkSession, path: str, keys: str = "k string"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"{keys}, value string, at timestamp"
        self.keys = [c.strip().split()[0] for c in keys.split(",")]

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        p, fs = self._fs(self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).groupBy(*self.keys).agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))

    def put(self, df: DataFrame) -> None:
        df.select(*self.keys, "value").withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def compact(self) -> None:
        aside = f"{self.path}.{uuid.uuid4().hex}"
        self.read().write.parquet(aside)
        p, fs = self._fs(self.path)
        fs.delete(p, True)
        fs.rename(self._fs(aside)[0], p)
