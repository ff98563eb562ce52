"""Every registered query of the library, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions import similarity as S
from textmill.functions import text as X
from textmill.operators import annotate, lm, lookup, metrics, models, pairs, sampling, vectorize, wordproblems
from textmill.plans.base import GRADED, MD5, ORACLE_SQL, PAIRS, PROTECTED, QUERIES, STOP, TOKENS, WORDS, docs, graded, lower_words, pair_texts, query, r6
from textmill.session import table

FLAGSHIP = "containment_slice_metrics"


# --- text -------------------------------------------------------------------------------------------------------------------


@query(
    f"SELECT lang, count(*) AS docs, CAST(sum(len({TOKENS.format('text')})) AS BIGINT) AS tokens, CAST(sum(length(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS BIGINT) AS clean_chars FROM documents GROUP BY lang"
)
def clean_text_stats(spark, d):
    c = X.clean(F.col("text"))
    return docs(spark, d).select("lang", c.alias("c")).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(X.count_tokens(F.col("c"))).alias("tokens"), F.sum(F.length("c")).cast("long").alias("clean_chars"))


@query(f"SELECT doc_id, CAST(len({TOKENS.format('text')}) AS BIGINT) AS n_tokens FROM documents")
def token_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"""SELECT doc_id, round(CASE WHEN len(regexp_extract_all(text, '[\p{L}\p{M}]')) > 0 THEN len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE / len(regexp_extract_all(text, '[\p{L}\p{M}]')) ELSE 0 END, 6) AS latin FROM documents""")
def script_ratio(spark, d):
    return docs(spark, d).select("doc_id", r6(X.script_ratio(F.col("text"), "[A-Za-z]"), "latin"))


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, length(text)::BIGINT AS n_chars, len(ws)::BIGINT AS n_words, len(regexp_extract_all(text, '[0-9]'))::BIGINT AS n_digits, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper,
len(regexp_extract_all(text, '[A-Za-z]'))::BIGINT AS n_latin, len(regexp_extract_all(text, ','))::BIGINT AS n_commas, len(regexp_extract_all(text, '[.]'))::BIGINT AS n_stops, len(regexp_extract_all(text, '[?]'))::BIGINT AS n_questions,
len(regexp_extract_all(text, '[()\[\]]'))::BIGINT AS n_brackets, (len(regexp_extract_all(text, '\n')) + 1)::BIGINT AS n_lines, round(CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE / len(ws) ELSE 0 END, 6) AS mean_word FROM w""")
def metadata_features(spark, d):
    f = X.metadata_features(F.col("text"))
    return docs(spark, d).select("doc_id", *(r6(c, k) if k == "mean_word" else c.alias(k) for k, c in f.items()))


@query(f"""WITH t AS (SELECT lang, unnest({TOKENS.format("trim(regexp_replace(text, '\\s+', ' ', 'g'))")}) AS t FROM documents)
SELECT lang, count(*) AS v1, count(*) FILTER (t NOT IN ({", ".join(repr(w) for w in STOP if w not in PROTECTED)})) AS v2, count(*) FILTER (t NOT IN ({", ".join(map(repr, STOP))})) AS v2_demo FROM t GROUP BY lang""")
def stopword_variant_sizes(spark, d):
    n = lambda v: F.sum(F.size(X.preprocess(F.col("text"), v, STOP, PROTECTED, normalize=False))).cast("long")
    return docs(spark, d).groupBy("lang").agg(n("V1").alias("v1"), n("V2").alias("v2"), n("V2-demo").alias("v2_demo"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS word FROM documents) GROUP BY word HAVING count(*) >= 5")
def vocab_min_count(spark, d):
    return vectorize.vocabulary(docs(spark, d).withColumn("tokens", lower_words()), "tokens", 5)


@query(f"SELECT word, count(*) AS df, round(ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*))) + 1, 6) AS idf FROM (SELECT unnest(list_distinct({WORDS.format('text')})) AS word FROM documents) GROUP BY word HAVING count(*) >= 3")
def idf_weights(spark, d):
    return vectorize.idf(docs(spark, d).withColumn("tokens", lower_words()), "tokens", 3).select("word", "df", r6("idf", "idf"))


_HELD = "(('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), 1, 8))::UBIGINT / 4294967296.0 < 0.2)"


@query(f"""WITH t AS (SELECT doc_id, lang, {_HELD} AS held, unnest({WORDS.format('text')}) AS word FROM documents), v AS (SELECT word FROM t WHERE NOT held GROUP BY word HAVING count(*) >= 2)
SELECT lang, round(avg((word IN (SELECT word FROM v))::INT), 6) AS coverage, round(1 - avg((word IN (SELECT word FROM v))::INT), 6) AS oov FROM t WHERE held GROUP BY lang""")
def oov_rate(spark, d):
    t = docs(spark, d).withColumn("tokens", lower_words())
    held = sampling.hash_split("doc_id", 0.2)
    out = vectorize.coverage(t.where(held), "tokens", vectorize.vocabulary(t.where(~held), "tokens", 2), ["lang"])
    return out.select("lang", r6("coverage", "coverage"), r6("oov", "oov"))


@query(r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^[=+\-@]') THEN '''' || t ELSE t END AS cell, CASE WHEN length(t) <= 60 THEN t ELSE substr(t, 1, 40) || ' … ' || right(t, 17) END AS compact, substr(sha256(conv_id::VARCHAR || '␟' || turn::VARCHAR || '␟' || coalesce(text, '')), 1, 20) AS hash FROM c JOIN conversations USING (conv_id, turn)""")
def cells_and_hashes(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.spreadsheet_safe(F.col("text")).alias("cell"), X.compact(X.collapse_whitespace(F.col("text")), 60).alias("compact"), X.content_hash(F.col("conv_id"), F.col("turn"), F.col("text")).alias("hash"))


# --- deduplication, pairs, splits -------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedup_keep_first(spark, d):
    t = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("k"))
    return pairs.keep_first(t, ["k"], ["doc_id"]).join(t.groupBy("k").agg(F.count(F.lit(1)).alias("copies")), "k").drop("k")


@query(f"SELECT lang, source, count(DISTINCT quality) AS labels, count(*) AS n FROM ({GRADED}) GROUP BY ALL HAVING count(DISTINCT quality) > 1")
def contradictory_keys(spark, d):
    return pairs.contradictions(graded(spark, d), ["lang", "source"], "quality")


@query(r"""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY conv_id, turn) AS r FROM conversations) WHERE r = 1""")
def normalized_question_dedup(spark, d):
    c = table(spark, d, "conversations").withColumn("k", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    return pairs.keep_first(c, ["k"], ["conv_id", "turn"]).select("conv_id", "turn", "role")


@query(f"""WITH g AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {MD5.format("doc_id")}, doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, CASE WHEN pos < floor(n * 0.7::DOUBLE + 1e-9) THEN 'train' WHEN pos < floor(n * 0.85::DOUBLE + 1e-9) THEN 'dev' ELSE 'test' END AS split FROM g""")
def grouped_stratified_split(spark, d):
    return sampling.stratified_split(docs(spark, d).select("doc_id", "lang"), "doc_id", ["lang"]).select("doc_id", "split")


@query(f"""WITH s AS (SELECT md5(text) AS k, CASE WHEN {_HELD} THEN 'dev' ELSE 'train' END AS split FROM documents) SELECT k, count(DISTINCT split) AS splits FROM s GROUP BY k HAVING count(DISTINCT split) > 1""")
def split_leakage(spark, d):
    t = docs(spark, d).select(F.md5("text").alias("k"), F.when(sampling.hash_split("doc_id", 0.2), "dev").otherwise("train").alias("split"))
    return pairs.leakage(t, "k")


@query(f"""WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {MD5.format("doc_id")}, doc_id) AS turn FROM documents) SELECT doc_id, source, turn::INTEGER AS turn FROM t WHERE turn <= 20 ORDER BY turn, source LIMIT 150""")
def subject_cap_round_robin(spark, d):
    return sampling.round_robin(docs(spark, d).select("doc_id", "source"), "source", "doc_id", 150, 20)


@query(f"""WITH one AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY md5(source || lang) ORDER BY md5(concat_ws('|', concat_ws('/', md5(source || lang), doc_id::VARCHAR), '42')), doc_id) AS o FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', doc_id::VARCHAR, '43')), doc_id) AS place FROM one WHERE o = 1) SELECT doc_id, lang FROM p WHERE place <= 5""")
def quota_sample(spark, d):
    t = docs(spark, d).select("doc_id", "lang", F.md5(F.concat("source", "lang")).alias("pair"))
    return sampling.quota_sample(t, ["lang"], 5, "pair", "doc_id").select("doc_id", "lang")


@query(f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, round_even(100.0 * n / (SELECT sum(n) FROM c), 0) AS q FROM c),
t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {MD5.format("doc_id")}, doc_id) AS pos FROM documents) SELECT doc_id, lang FROM t JOIN q USING (lang) WHERE pos <= q""")
def proportional_take(spark, d):
    return sampling.proportional_take(docs(spark, d).select("doc_id", "lang"), ["lang"], 100, "doc_id").select("doc_id", "lang")


@query("""WITH n AS (SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn, length(text) AS q, lead(length(text)) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, next_turn, q::BIGINT AS question_chars, a::BIGINT AS answer_chars FROM n WHERE role = 'user' AND next_role = 'assistant'""")
def pair_pivot(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    n = table(spark, d, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.lead("turn").over(w).alias("next_turn"), F.length("text").cast("long").alias("question_chars"), F.lead(F.length("text")).over(w).cast("long").alias("answer_chars"))
    return n.where("role = 'user' and next_role = 'assistant'").drop("role", "next_role")


@query("SELECT user_id, min(g) AS gap FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) GROUP BY user_id")
def pair_min_gap(spark, d):
    return pairs.pair_gap(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN NOT (quality IN (0, 1)) THEN 'quality' END, CASE WHEN NOT (quality = 1 OR toxic = 0) THEN 'toxic_is_good' END, CASE WHEN NOT (n_chars >= 200) THEN 'short' END], lambda x: x IS NOT NULL)) AS rule FROM (""" + GRADED + ")")
def schema_violations(spark, d):
    rules = {"quality": F.col("quality").isin(0, 1), "toxic_is_good": (F.col("quality") == 1) | (F.col("toxic") == 0), "short": F.col("n_chars") >= 200}
    return pairs.violations(graded(spark, d), rules, "doc_id")


# --- scores -----------------------------------------------------------------------------------------------------------------

_F1 = """round((CASE WHEN 2*tp+fp+fn > 0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0 END + CASE WHEN 2*tn+fn+fp > 0 THEN 2.0*tn/(2*tn+fn+fp) ELSE 0 END)::DOUBLE / 2, 6)"""
_CELLS = "count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 0 AND p = 0) AS tn"


def _scores(df: DataFrame) -> DataFrame:
    return df.select("slice", "value", "n", r6("macro_f1", "macro_f1"), r6("accuracy", "accuracy"))


def _slices_sql(rows: str) -> str:
    return f"""WITH r AS ({rows}), s AS (SELECT t, p, unnest([{{'s': 'all', 'v': 'all'}}, {{'s': 'lang', 'v': lang}}, {{'s': 'source', 'v': source}}]) AS k FROM r),
g AS (SELECT k.s AS slice, k.v AS value, count(*) AS n, {_CELLS} FROM s GROUP BY ALL) SELECT slice, value, n, {_F1} AS macro_f1, round((tp + tn)::DOUBLE / n, 6) AS accuracy FROM g"""


@query(_slices_sql(f"SELECT lang, source, quality AS t, (n_chars > 1000)::INT AS p FROM ({GRADED})"))
def slice_metrics(spark, d):
    return _scores(metrics.slice_by(graded(spark, d).withColumn("pred", (F.col("n_chars") > 1000).cast("int")), "quality", "pred", ["lang", "source"]))


_CONTAIN = "EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, rtrim(trim(b.text), '।. ')))"


def _contained(spark, d) -> DataFrame:
    """(doc_id, contained): documents that hold a benchmark item."""
    items = table(spark, d, "benchmark").select(X.trim_answer(F.col("text")).alias("item"))
    return lookup.containing(docs(spark, d), items, "doc_id", "text", "item").select("doc_id", F.lit(1).alias("contained"))


@query(f"SELECT d.doc_id FROM documents d WHERE {_CONTAIN}")
def containment_rule(spark, d):
    return _contained(spark, d).select("doc_id")


@query(_slices_sql(f"SELECT d.lang, d.source, l.quality AS t, (NOT {_CONTAIN})::INT AS p FROM documents d JOIN labels l USING (doc_id)"))
def containment_slice_metrics(spark, d):
    r = graded(spark, d).join(_contained(spark, d), "doc_id", "left").withColumn("pred", F.when(F.col("contained") == 1, 0).otherwise(1))
    return _scores(metrics.slice_by(r, "quality", "pred", ["lang", "source"]))


@query(f"""WITH r AS ({GRADED}), p AS (SELECT lang, n_chars, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM r GROUP BY ALL),
w AS (SELECT *, p * (coalesce(sum(q) OVER (PARTITION BY lang ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2.0) AS won FROM p)
SELECT lang, round(CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(won)::DOUBLE / (sum(p) * sum(q))::DOUBLE END, 6) AS auc FROM w GROUP BY lang""")
def auc_tied(spark, d):
    return metrics.auc(graded(spark, d), "quality", "n_chars", ["lang"]).select("lang", r6("auc", "auc"))


_SWEEP = f"""WITH r AS (SELECT quality AS t, n_chars / 20000.0::DOUBLE AS s FROM ({GRADED})), g AS (SELECT round(0.05::DOUBLE + i / 100.0::DOUBLE, 2) AS threshold FROM range(91) x(i)),
c AS (SELECT threshold, t, (s >= threshold)::INT AS p FROM g, r), k AS (SELECT threshold, {_CELLS} FROM c GROUP BY threshold), f AS (SELECT threshold, {_F1} AS macro_f1 FROM k)"""


def _scored_length(spark, d) -> DataFrame:
    return graded(spark, d).withColumn("s", F.col("n_chars") / F.lit(20000.0))


@query(_SWEEP + " SELECT threshold, macro_f1 FROM f")
def threshold_sweep(spark, d):
    return metrics.threshold_sweep(_scored_length(spark, d), "quality", "s").select("threshold", r6("macro_f1", "macro_f1"))


@query(f"""WITH r AS ({GRADED}), x AS (SELECT 'a' AS model, quality AS t, 1 AS p FROM r UNION ALL SELECT 'b', quality, (n_chars > 1000)::INT FROM r UNION ALL SELECT 'c', quality, (n_chars > 300)::INT FROM r), g AS (SELECT model, count(*) AS n, {_CELLS} FROM x GROUP BY model)
SELECT model, n, {_F1} AS macro_f1 FROM g""")
def baseline_compare(spark, d):
    g = graded(spark, d)
    rules = {"a": F.lit(1), "b": (F.col("n_chars") > 1000).cast("int"), "c": (F.col("n_chars") > 300).cast("int")}
    x = g.select("quality", F.explode(F.array(*(F.struct(F.lit(k).alias("model"), c.alias("p")) for k, c in rules.items()))).alias("m")).select("quality", "m.*")
    return x.groupBy("model").agg(F.count(F.lit(1)).alias("n"), r6(metrics.macro_f1("quality", "p"), "macro_f1"))


@query(f"""WITH r AS (SELECT source AS pair, quality AS t, (n_chars > 1000)::INT AS p, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'junk' END AS kind FROM ({GRADED})), k AS (SELECT *, max(CASE WHEN t = 0 THEN kind END) OVER (PARTITION BY pair) AS e FROM r),
g AS (SELECT e AS error_type, count(*) FILTER (t = 0) AS n, count(*) FILTER (t = 0 AND p = 0) AS hit, {_CELLS} FROM k WHERE e IS NOT NULL GROUP BY e) SELECT error_type, n, round(CASE WHEN n > 0 THEN hit::DOUBLE / n ELSE 0 END, 6) AS caught, {_F1} AS macro_f1 FROM g""")
def error_type_caught(spark, d):
    g = graded(spark, d).withColumn("pred", (F.col("n_chars") > 1000).cast("int")).withColumn("kind", F.when(F.col("toxic") == 1, "toxic").otherwise("junk"))
    return metrics.by_error_type(g, "source", "quality", "pred", "kind").select("error_type", "n", r6("caught", "caught"), r6("macro_f1", "macro_f1"))


@query(f"""WITH r AS ({GRADED}) SELECT lang, count(*) AS n, round(avg((quality = toxic)::INT), 6) AS agreement FROM r GROUP BY lang""")
def agreement_by_slice(spark, d):
    return metrics.agreement_by(graded(spark, d), "quality", "toxic", "lang").select("lang", "n", r6("agreement", "agreement"))


@query(f"""WITH r AS (SELECT lang, quality AS a, (n_chars > 1000)::INT AS b FROM ({GRADED})), g AS (SELECT lang, count(*)::DOUBLE AS n, avg((a = b)::INT) AS o, (count(*) FILTER (a = 1) * count(*) FILTER (b = 1) + count(*) FILTER (a = 0) * count(*) FILTER (b = 0))::DOUBLE AS e FROM r GROUP BY lang)
SELECT lang, n::BIGINT AS items, round(o, 6) AS agreement, round(CASE WHEN e / (n * n) >= 1 THEN 1 ELSE (o - e / (n * n)) / (1 - e / (n * n)) END, 6) AS kappa FROM g""")
def kappa_by_lang(spark, d):
    g = graded(spark, d).withColumn("b", (F.col("n_chars") > 1000).cast("int"))
    return metrics.kappa(g, "quality", "b", ["lang"]).select("lang", "items", r6("agreement", "agreement"), r6("kappa", "kappa"))


@query(f"""WITH r AS (SELECT quality AS t, (n_chars > 1000)::INT AS a, (n_chars > 300)::INT AS b FROM ({GRADED})) SELECT count(*) FILTER (a = t AND b <> t) AS only_a, count(*) FILTER (b = t AND a <> t) AS only_b FROM r""")
def mcnemar_counts(spark, d):
    g = graded(spark, d).withColumn("a", (F.col("n_chars") > 1000).cast("int")).withColumn("b", (F.col("n_chars") > 300).cast("int"))
    return metrics.mcnemar(g, "quality", "a", "b").drop("p")


@query(f"""WITH r AS (SELECT quality AS t, (n_chars > 1000)::INT AS a, (n_chars > 300)::INT AS b FROM ({GRADED})), c AS (SELECT count(*) FILTER (a = t AND b <> t) AS only_a, count(*) FILTER (b = t AND a <> t) AS only_b FROM r), i AS (SELECT only_a, only_b, only_a + only_b AS n, unnest(range(least(only_a, only_b) + 1)) AS i FROM c)
SELECT only_a, only_b, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) END, 6) AS p FROM i GROUP BY only_a, only_b, n""")
def mcnemar_p(spark, d):
    g = graded(spark, d).withColumn("a", (F.col("n_chars") > 1000).cast("int")).withColumn("b", (F.col("n_chars") > 300).cast("int"))
    return metrics.mcnemar(g, "quality", "a", "b").withColumn("p", F.round("p", 6))


@query(f"""WITH r AS ({GRADED}), v AS (SELECT doc_id, unnest([{{'j': 1, 'v': CASE WHEN n_chars > 1000 THEN 'good' ELSE 'bad' END}}, {{'j': 2, 'v': CASE WHEN toxic = 0 THEN 'good' ELSE 'bad' END}}, {{'j': 3, 'v': CASE WHEN n_chars < 300 THEN NULL WHEN quality = 1 THEN 'good' ELSE 'bad' END}}]) AS x FROM r),
c AS (SELECT doc_id, x.v AS v, count(*) AS n, min(x.j) AS f FROM v WHERE x.v IS NOT NULL GROUP BY ALL), t AS (SELECT doc_id, arg_min(v, (-n) * 10 + f) AS value, max(n) AS n FROM c GROUP BY doc_id) SELECT doc_id, value, round(n / 3.0::DOUBLE, 6) AS agreement, n / 3.0::DOUBLE >= 0.67::DOUBLE - 1e-9 AS accepted FROM t""")
def consensus_vote(spark, d):
    j = {1: F.when(F.col("n_chars") > 1000, "good").otherwise("bad"), 2: F.when(F.col("toxic") == 0, "good").otherwise("bad"), 3: F.when(F.col("n_chars") < 300, None).when(F.col("quality") == 1, "good").otherwise("bad")}
    v = graded(spark, d).select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("judge"), c.alias("vote")) for k, c in j.items()))).alias("x")).select("doc_id", "x.*")
    return annotate.consensus(v, "doc_id", "judge", "vote", 0.67).select("doc_id", "value", r6("agreement", "agreement"), "accepted")


_EDGES = "[0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182, 0.999916758851, 0.999989750804]"


@query(f"""WITH c AS (SELECT source AS k, {_CELLS} FROM (SELECT source, quality AS t, (n_chars > 1000)::INT AS p FROM ({GRADED})) GROUP BY source), u AS (SELECT r, tp, fp, fn, tn, ('0x' || substr(md5(concat_ws('|', k, r::VARCHAR, '42')), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM c, range(1, 201) x(r)),
m AS (SELECT r, tp, fp, fn, tn, len(list_filter({_EDGES}, lambda e: u >= e::DOUBLE)) AS m FROM u), s AS (SELECT r, sum(tp * m) AS tp, sum(fp * m) AS fp, sum(fn * m) AS fn, sum(tn * m) AS tn FROM m GROUP BY r HAVING sum(m) > 0), f AS (SELECT list_sort(list({_F1})) AS s FROM s)
SELECT s[floor(len(s) * 0.025::DOUBLE)::INT + 1] AS low, s[least(floor(len(s) * 0.975::DOUBLE)::INT, len(s) - 1) + 1] AS high FROM f""")
def bootstrap_ci(spark, d):
    g = graded(spark, d).withColumn("pred", (F.col("n_chars") > 1000).cast("int"))
    return metrics.bootstrap(g, "quality", "pred", "source", 200).select(r6("low", "low"), r6("high", "high"))


@query("""WITH p AS (SELECT n_chars AS x, count(*) AS n FROM documents GROUP BY n_chars), u AS (SELECT x, sum(n) OVER (ORDER BY x) AS upto, sum(n) OVER () AS total FROM p)
SELECT min(x) FILTER (upto > floor(total * 0.5::DOUBLE)) AS p50, min(x) FILTER (upto > floor(total * 0.9::DOUBLE)) AS p90, min(x) FILTER (upto > floor(total * 0.99::DOUBLE)) AS p99, max(x) AS max FROM u""")
def length_distribution(spark, d):
    return metrics.length_distribution(docs(spark, d).select("n_chars"), "n_chars")


# --- language models, vectors -----------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT repeat(chr(2), 2) || text AS p, length(text) AS n FROM benchmark), w AS (SELECT substr(p, i::INT, 2) AS h, substr(p, i::INT + 2, 1) AS c FROM (SELECT p, unnest(range(1, n + 1)) AS i FROM g)), k AS (SELECT h, c, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT h, sum(n) AS total FROM k GROUP BY h),
q AS (SELECT conv_id * 1000 + turn AS id, repeat(chr(2), 2) || text AS p, length(text) AS n FROM conversations), qw AS (SELECT id, substr(p, i::INT, 2) AS h, substr(p, i::INT + 2, 1) AS c FROM (SELECT id, p, unnest(range(1, n + 1)) AS i FROM q)),
s AS (SELECT id, avg(ln((coalesce(k.n, 0) + 0.1::DOUBLE) / (coalesce(t.total, 0) + 0.1::DOUBLE * (SELECT count(DISTINCT c) FROM k)))) AS lp FROM qw LEFT JOIN k USING (h, c) LEFT JOIN t USING (h) GROUP BY id)
SELECT q.id, round(coalesce(lp, 0), 6) AS log_prob, round(coalesce(exp(lp), 0), 6) AS typicality FROM q LEFT JOIN s USING (id)""")
def char_ngram_lm_score(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    out = lm.char_lm_score(lm.char_lm(table(spark, d, "benchmark"), "text", 3), c, "id", "text", 3)
    return out.select("id", r6("log_prob", "log_prob"), r6("typicality", "typicality"))


@query()
def style_classifier(spark, d):
    g = docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", "text")
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return lm.style_classifier(g, "quality", c, "id", "text", 3).select("id", r6("gap", "gap"), "pred")


@query(f"""WITH tr AS (SELECT doc_id, quality, {WORDS.format('text')} AS ws FROM documents JOIN labels USING (doc_id)), w AS (SELECT quality AS c, unnest(ws) AS word FROM tr), k AS (SELECT c, word, count(*) AS n FROM w GROUP BY ALL), v AS (SELECT count(DISTINCT word) AS v FROM k),
p AS (SELECT quality AS c, ln(count(*)::DOUBLE / (SELECT count(*) FROM tr)) AS prior FROM tr GROUP BY quality), s AS (SELECT c, sum(n) + (SELECT v FROM v) AS den FROM k GROUP BY c),
q AS (SELECT conv_id * 1000 + turn AS id, unnest({WORDS.format('text')}) AS word FROM conversations), known AS (SELECT id, word FROM q WHERE word IN (SELECT word FROM k)), ids AS (SELECT conv_id * 1000 + turn AS id FROM conversations),
l AS (SELECT ids.id, p.c, any_value(prior) + coalesce(sum(CASE WHEN known.word IS NOT NULL THEN ln((coalesce(k.n, 0) + 1)::DOUBLE / s.den) END), 0) AS score FROM ids CROSS JOIN p JOIN s ON s.c = p.c LEFT JOIN known ON known.id = ids.id LEFT JOIN k ON k.word = known.word AND k.c = p.c GROUP BY ids.id, p.c)
SELECT id, arg_max(c, score) AS pred, round(max(score) - min(score), 4) AS margin FROM l GROUP BY id""")
def sql_naive_bayes(spark, d):
    g = docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("quality", lower_words().alias("tokens"))
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), lower_words().alias("tokens"))
    return lm.naive_bayes_predict(lm.naive_bayes(g, "quality", "tokens"), c, "id", "tokens").select("id", "pred", F.round("margin", 4).alias("margin"))


@query("""WITH q AS (SELECT vec_id AS q, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, vec_id, round(list_cosine_similarity(a::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE q <> vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT q, max(CASE WHEN rank = 1 THEN vec_id END) AS vec_id, max(CASE WHEN rank = 1 THEN score END) AS score, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 5) AS margin FROM r WHERE rank <= 2 GROUP BY q""")
def knn_embeddings_top2_margin(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    r = vectorize.dense_top_k(e.where("vec_id % 100 = 0"), e, "embedding", "q", "vec_id", 2)
    return vectorize.margins(r, "q").select("q", "best.vec_id", "best.score", F.round("margin", 5).alias("margin"))


@query("""SELECT label, i::INT AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL""")
def centroids(spark, d):
    c = vectorize.mean_vector(table(spark, d, "embeddings"), ["label"], "embedding", 64)
    return c.select("label", F.posexplode("vector").alias("dim", "x")).select("label", "dim", r6("x", "mean"))


_TFIDF = f"""w AS (SELECT word, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*))) + 1 AS idf FROM (SELECT unnest(list_distinct({WORDS.format('text')})) AS word FROM documents) GROUP BY word HAVING count(*) >= 2)"""


@query(f"""WITH {_TFIDF}, dt AS (SELECT doc_id, word, count(*) * any_value(idf) AS x FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS word FROM documents) JOIN w USING (word) GROUP BY ALL), dn AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM dt GROUP BY doc_id),
qt AS (SELECT item_id, word, count(*) * any_value(idf) AS x FROM (SELECT item_id, unnest({WORDS.format('text')}) AS word FROM benchmark) JOIN w USING (word) GROUP BY ALL), qn AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM qt GROUP BY item_id),
s AS (SELECT item_id, doc_id, round(sum(qt.x / qn.n * dt.x / dn.n), 6) AS score FROM qt JOIN qn USING (item_id) JOIN dt USING (word) JOIN dn USING (doc_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 3""")
def sparse_retrieval_topk(spark, d):
    t = docs(spark, d).select("doc_id", lower_words().alias("tokens"))
    w = vectorize.idf(t, "tokens", 2)
    dt = vectorize.tfidf(t, "doc_id", "tokens", w)
    qt = vectorize.tfidf(table(spark, d, "benchmark").select("item_id", lower_words().alias("tokens")), "item_id", "tokens", w)
    return vectorize.sparse_top_k(qt, dt, "item_id", "doc_id", 3)


# --- lookups, cascades ------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, n_name, coalesce(c_mktsegment = 'BUILDING', false) AS building FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def one_to_one_merge(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookup.one_to_one(table(spark, d, "customer"), n, ["c_nationkey"]).select("c_custkey", "n_name", F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False)).alias("building"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join_pushdown(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.needed_rows(table(spark, d, "customer").select("c_custkey", "c_name"), o, "c_custkey")


@query("""WITH b AS (SELECT n_name AS key, lower(replace(n_name, '_', '')) AS alias, n_nationkey AS v FROM nation), q AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'NATION_' || s_nationkey WHEN s_suppkey % 3 = 1 THEN 'nation' || s_nationkey ELSE 'none' END AS key FROM supplier),
j AS (SELECT s_suppkey, a.v AS va, c.v AS vb FROM q LEFT JOIN b a ON a.key = q.key LEFT JOIN b c ON c.alias = q.key) SELECT s_suppkey, coalesce(va, vb) AS v, CASE WHEN va IS NOT NULL THEN 'exact' WHEN vb IS NOT NULL THEN 'alias' ELSE 'none' END AS match FROM j""")
def exact_lookup_alias_fallback(spark, d):
    bank = table(spark, d, "nation").select(F.col("n_name").alias("key"), F.lower(F.replace("n_name", F.lit("_"), F.lit(""))).alias("alias"), F.col("n_nationkey").alias("v"))
    q = table(spark, d, "supplier")
    key = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("NATION_"), F.col("s_nationkey"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("nation"), F.col("s_nationkey"))).otherwise("none")
    q = q.select("s_suppkey", key.alias("key"), key.alias("alias"))
    return lookup.exact_or_alias(q, bank, "key", "alias", ["v"]).select("s_suppkey", "v", "match")


@query("""SELECT a.p_brand AS a, b.p_brand AS b, levenshtein(a.p_brand, b.p_brand)::INT AS distance FROM (SELECT DISTINCT p_brand FROM part) a, (SELECT DISTINCT p_brand FROM part) b WHERE levenshtein(a.p_brand, b.p_brand) <= 1""")
def one_edit_neighbours(spark, d):
    p = table(spark, d, "part").select("p_brand").distinct()
    return lookup.one_edit_neighbours(p.withColumnRenamed("p_brand", "a"), p.withColumnRenamed("p_brand", "b"), "a", "b")


@query("SELECT c_custkey, levenshtein(c_name, 'Customer ' || c_nationkey)::INT AS distance FROM customer")
def edit_distance_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.edit_distance(F.col("c_name"), F.concat(F.lit("Customer "), F.col("c_nationkey"))).alias("distance"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_totalprice > 300000 THEN 0 WHEN o_orderstatus = 'F' THEN 1 END AS label, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done' END AS tier FROM orders""")
def rule_cascade_tiers(spark, d):
    label, tier = lookup.cascade([("urgent", F.col("o_orderpriority") == "1-URGENT", F.lit(1)), ("large", F.col("o_totalprice") > 300000, F.lit(0)), ("done", F.col("o_orderstatus") == "F", F.lit(1))])
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"), tier.alias("tier"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_tax > 0.05 THEN 0 WHEN l_discount = 0 THEN 1 WHEN l_linestatus = 'F' THEN 1 ELSE (l_quantity >= 25)::INT END AS label FROM lineitem""")
def policy_override(spark, d):
    hard = F.when(F.col("l_linestatus") == "F", 1)
    label = lookup.policy(F.col("l_quantity"), 25.0, hard, [(F.col("l_discount") == 0, F.lit(1)), ((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.05), F.lit(0))])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))


@query("""WITH l AS (SELECT event_type, user_id, arg_max(value, event_id) AS s FROM events GROUP BY ALL), g AS (SELECT event_type, round(avg(s), 6) AS score, count(*) AS seeds FROM l GROUP BY event_type) SELECT event_type, score, seeds, row_number() OVER (ORDER BY score DESC, event_type)::INT AS rank FROM g""")
def latest_per_group_scoreboard(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", "event_id", F.col("value").alias("score"), F.col("value").alias("hard"))
    return metrics.scoreboard(e, "event_type", "user_id", "event_id", "score", "hard").select("event_type", r6("score", "score"), "seeds", "rank")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(avg(value * 2), 6) AS mean_hard, count(*) AS runs FROM events GROUP BY event_type")
def leaderboard_mean_sd(spark, d):
    e = table(spark, d, "events").withColumn("hard", F.col("value") * 2)
    return metrics.leaderboard(e, "event_type", "value", "hard").select("event_type", r6("mean", "mean"), r6("sd", "sd"), r6("mean_hard", "mean_hard"), "runs")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def reply_json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'click' END AS value, CASE WHEN event_id % 3 = 0 THEN 0.9::DOUBLE WHEN event_id % 3 = 1 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM events""")
def parse_replies(spark, d):
    e = table(spark, d, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('Sure: {"verdict": "'), F.upper("event_type"), F.lit('", "confidence": 0.9} ok'))).when(F.col("event_id") % 3 == 1, F.lit("I say click here")).otherwise(F.lit("no idea"))
    r = annotate.parse_reply(reply, "verdict", ["view", "purchase", "signup", "click", "error"])
    return e.select("event_id", r["value"].alias("value"), r["confidence"].alias("confidence"))


@query("SELECT p_partkey, 'interest_earned' AS rule, (p_partkey % 2)::INT AS verdict FROM part")
def arith_verify(spark, d):
    p = table(spark, d, "part")
    q = F.format_string("The simple interest on %d at %d%% for 4 years is what?", F.col("p_size") * 100, F.col("p_partkey") % 9 + 1)
    a = (F.col("p_size") * (F.col("p_partkey") % 9 + 1) * 4 + F.when(F.col("p_partkey") % 2 == 1, 0).otherwise(1)).cast("string")
    v = wordproblems.arithmetic(q, a)
    return p.select("p_partkey", v["rule"].alias("rule"), v["verdict"].alias("verdict"))


# --- without SQL: held against Python in the tests ---------------------------------------------------------------------------


@query()
def best_match_distance(spark, d):
    return pair_texts(spark, d).select("conv_id", "turn", S.best_match_distance(F.col("question"), F.col("answer")).alias("distance"))


@query()
def sequence_ratios(spark, d):
    c = pair_texts(spark, d)
    return c.select("conv_id", "turn", r6(S.sequence_ratio(F.col("question"), F.col("answer")), "ratio"), r6(S.token_set_ratio(F.col("question"), F.col("answer")), "token_set"))


@query()
def difficulty_flag(spark, d):
    c = pair_texts(spark, d)
    p = c.select("conv_id", "turn", F.lit("").alias("context"), F.struct(F.col("question").alias("answer")).alias("correct"), F.struct("answer").alias("wrong"))
    return pairs.difficulty(p).select("conv_id", "turn", "difficulty")


@query(r"""SELECT conv_id, turn, trim(regexp_extract(text, '^\s*(?:(?:[0-9]+(?:[.,][0-9]+)*|[A-Za-zÀ-ɏ]+|[^\s])\s*){0,20}')) AS head FROM conversations""")
def cut_to_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.cut_to_tokens(F.col("text"), 20).alias("head"))


@query()
def passage_lm(spark, d):
    c = pair_texts(spark, d)
    return c.select("conv_id", "turn", r6(lm.passage_lm_score()(F.col("question"), F.col("answer")), "score"))


_LIST = r"list_filter(regexp_split_to_array(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(f"""WITH t AS {PAIRS}, s AS (SELECT conv_id || '/' || turn AS id, list_distinct({_LIST.format("lower(question)")}) AS own, list_filter(regexp_split_to_array(answer, '[।.!?\\n]+'), lambda x: trim(x) <> '') AS pieces FROM t),
p AS (SELECT id, own, unnest(range(1, len(pieces) + 1)) AS pos, unnest(pieces) AS x FROM s), r AS (SELECT id, trim(x) AS x, row_number() OVER (PARTITION BY id ORDER BY len(list_intersect(own, {_LIST.format("lower(x)")}))::DOUBLE / greatest(len(own), 1) DESC, pos) AS rank FROM p)
SELECT s.id, array_to_string(coalesce(list(r.x ORDER BY rank) FILTER (rank <= 3), []), '|') AS sentences FROM s LEFT JOIN r USING (id) GROUP BY s.id""")
def evidence_sentences(spark, d):
    return lookup.evidence_sentences(pair_texts(spark, d).withColumn("id", F.concat_ws("/", "conv_id", "turn")), "id", "answer", "question").withColumn("sentences", F.array_join("sentences", "|"))


@query()
def text_classifier(spark, d):
    g = docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("quality").alias("label"), lower_words().alias("tokens"))
    held = sampling.hash_split("doc_id", 0.2)
    g = g.withColumn("terms", F.concat("tokens", X.word_ngrams(F.col("tokens"), 2)))
    return models.compare(g.where(~held), g.where(held), {n: models.text_model(n) for n in ("tfidf_logreg", "bow_nb")}).select("model", "n", r6("macro_f1", "macro_f1"), r6("accuracy", "accuracy"))


@query()
def metadata_probe(spark, d):
    f = X.metadata_features(F.col("text"))
    g = docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("quality").alias("label"), *(c.cast("double").alias(k) for k, c in f.items()))
    return models.probe(g, list(f), "label", "doc_id").select("model", "n", r6("macro_f1", "macro_f1"))


from textmill.plans import corpus, texts  # noqa: E402, F401  registers more queries
