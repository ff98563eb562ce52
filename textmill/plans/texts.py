"""Queries of the text functions, one table scan each; the SQL says the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import similarity as S
from textmill.functions import text as X
from textmill.operators import evidence, lm, vectorize, verify, wordproblems
from textmill.plans import cases
from textmill.plans.base import PAIRS, STOP, TOKENS, WORDS, docs, lower_words, pair_texts, query, r6
from textmill.session import table


def _conversations(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "text")


def _values(rows) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def _fixture(spark, columns: str, rows):
    return spark.createDataFrame(rows, columns)


_SP = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_TOK = "list_filter(regexp_split_to_array(" + _SP + ", ' '), lambda x: x <> '')"


@query(rf"""SELECT conv_id, turn, md5(nfc_normalize(text)) AS nfc, {_SP.format("text")} || ' 34 ' || chr(92) || 'sqrt[7]{{' AS cleaned FROM conversations""")
def clean_steps(spark, d):
    c = _conversations(spark, d)
    marked = F.concat("text", F.lit(" [12] ৩৪ \\sqrt[7]{"))
    return c.select("conv_id", "turn", F.md5(X.nfc(F.col("text"))).alias("nfc"), X.collapse_whitespace(X.unify_digits(X.remove_citations(marked))).alias("cleaned"))


@query(_values([(1, "ছেলেদেরকে", "ছেলে"), (2, "বইগুলো", "বই"), (3, "আসেনি", "আসেনি"), (4, "walking", "walking"), (5, "নদীটি", "নদী"), (6, "কলমটি", "কলমটি"), (7, "জলটি", "জলটি")]).join(["SELECT * FROM (", ") t(id, word, stem)"]))
def stemmed_words(spark, d):
    words = _fixture(spark, "id int, word string", [(1, "ছেলেদেরকে"), (2, "বইগুলো"), (3, "আসেনি"), (4, "walking"), (5, "নদীটি"), (6, "কলমটি"), (7, "জলটি")])
    known = F.array(*map(F.lit, ["ছেলে", "নদী", "আসে", "জল", "বই"]))
    stem = X.stem(F.array("word"), ["টি", "গুলো", "দেরকে", "কে", "নি", "ing"], known, ["বই"], 3)[0]
    return words.select("id", "word", F.when(F.col("word") == "বইগুলো", X.stem(F.array("word"), ["গুলো"], known, [], 2)[0]).otherwise(stem).alias("stem"))


@query(f"""SELECT lang, CAST(sum(len({_TOK.format("text")})) AS BIGINT) AS v0, CAST(sum(len({TOKENS.format(_SP.format("text"))})) AS BIGINT) AS v3 FROM documents GROUP BY lang""")
def preprocess_variants(spark, d):
    n = lambda v, **how: F.sum(F.size(X.preprocess(F.col("text"), v, normalize=False, **how))).cast("long")
    return docs(spark, d).groupBy("lang").agg(n("V0").alias("v0"), n("V3", suffixes=["টি"]).alias("v3"))


@query(f"""WITH t AS {PAIRS}, s AS (SELECT conv_id, turn, list_distinct({_TOK.format("lower(question)")}) AS q, list_distinct({_TOK.format("lower(answer)")}) AS a FROM t)
SELECT conv_id, turn, len(q)::INT AS words, round(CASE WHEN len(list_distinct(list_concat(q, a))) > 0 THEN len(list_intersect(q, a))::DOUBLE / len(list_distinct(list_concat(q, a))) ELSE 0 END, 6) AS jaccard, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, a))::DOUBLE / len(q) ELSE 0 END, 6) AS share FROM s""")
def word_set_overlaps(spark, d):
    c = pair_texts(spark, d).select("conv_id", "turn", X.word_set(F.col("question"), True).alias("q"), X.word_set(F.col("answer"), True).alias("a"))
    return c.select("conv_id", "turn", F.size("q").alias("words"), r6(S.jaccard(F.col("q"), F.col("a")), "jaccard"), r6(S.overlap_share(F.col("q"), F.col("a")), "share"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM conversations) SELECT conv_id, turn, len(w)::INT AS n, list_sort(w)[1] AS first FROM w""")
def word_sets(spark, d):
    c = _conversations(spark, d).select("conv_id", "turn", X.word_set(F.col("text")).alias("w"))
    return c.select("conv_id", "turn", F.size("w").alias("n"), F.get(F.array_sort("w"), F.lit(0)).alias("first"))


@query(f"""WITH t AS {PAIRS}, p AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN answer || ' ' || question ELSE answer END AS passage, question || '. ' AS answer FROM t)
SELECT conv_id, turn, rtrim(trim(answer), '।. ') <> '' AND contains(passage, rtrim(trim(answer), '।. ')) AS exact FROM p""")
def answers_in_passages(spark, d):
    c = pair_texts(spark, d).select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, F.concat_ws(" ", "answer", "question")).otherwise(F.col("answer")).alias("passage"), F.concat("question", F.lit(". ")).alias("a"))
    return c.select("conv_id", "turn", S.exact_in_passage(F.col("a"), F.col("passage")).alias("exact"))


@query("SELECT c_custkey, c_custkey % 5 = 4 AS has_context FROM customer")
def null_contexts(spark, d):
    words = F.array(F.lit(None).cast("string"), F.lit(" [NULL] "), F.lit("None"), F.lit(""), F.lit("a passage"))
    c = table(spark, d, "customer")
    return c.select("c_custkey", X.has_context(F.get(words, (F.col("c_custkey") % 5).cast("int"))).alias("has_context"))


@query(f"""WITH t AS (SELECT lang, unnest({TOKENS.format(_SP.format("text"))}) AS t FROM documents) SELECT lang, count(*) FILTER (regexp_matches(t, '[\\p{{L}}\\p{{N}}]')) AS words, count(*) FILTER (regexp_matches(t, '^[ঀ-৿]')) AS bengali, count(*) AS tokens FROM t GROUP BY lang""")
def token_kinds(spark, d):
    t = docs(spark, d).select("lang", F.explode(X.preprocess(F.col("text"), "V1", normalize=False)).alias("t"))
    return t.groupBy("lang").agg(F.count_if(X.is_word_token(F.col("t"))).alias("words"), F.count_if(X.is_bengali_word(F.col("t"))).alias("bengali"), F.count(F.lit(1)).alias("tokens"))


@query(f"""WITH w AS (SELECT conv_id, turn, {_TOK.format("text || CASE WHEN turn % 2 = 0 THEN ' নদী জল' ELSE '' END")} AS w FROM conversations), n AS (SELECT conv_id, turn, len(list_filter(w, lambda x: regexp_matches(x, '[ঀ-৿]'))) AS b, len(list_filter(w, lambda x: regexp_matches(x, '^[^ঀ-৿]*[A-Za-z]'))) AS l FROM w)
SELECT conv_id, turn, CASE WHEN b + l > 0 THEN round(100 * (1 - greatest(b, l)::DOUBLE / (b + l)), 2) END AS cmi FROM n""")
def code_mixing_index(spark, d):
    c = _conversations(spark, d)
    return c.select("conv_id", "turn", X.code_mixing(F.concat("text", F.when(F.col("turn") % 2 == 0, " নদী জল").otherwise(""))).alias("cmi"))


@query(rf"""SELECT conv_id, turn, {_SP.format("regexp_replace(regexp_replace(replace(text, chr(10), ' * '), '<[^>]+>', ' ', 'g'), '[*_`#]+', '', 'g')")} || ' a & b' AS plain FROM conversations""")
def markup_cleaned(spark, d):
    c = _conversations(spark, d)
    return c.select("conv_id", "turn", X.clean_markup(F.concat(F.lit("<p class='x'>"), F.replace("text", F.lit("\n"), F.lit(" * ")), F.lit("</p><br/> `a` &amp; **b**[3]"))).alias("plain"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ', ' || p_brand || '!'), '[^a-z0-9]+', ' ', 'g')) AS key, regexp_replace(lower(p_name || ', ' || p_brand || '!'), '[^a-z0-9]+', '', 'g') AS canonical FROM part")
def lookup_keys(spark, d):
    t = F.concat("p_name", F.lit(", "), "p_brand", F.lit("!"))
    return table(spark, d, "part").select("p_partkey", X.lookup_key(t).alias("key"), X.canonical_text(t).alias("canonical"))


@query("SELECT o_orderkey, '-' || replace(lower(o_orderpriority), ' ', '') || '*2.5' AS key FROM orders")
def option_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.option_key(F.concat(F.lit("−"), "o_orderpriority", F.lit(" × ২.৫।"))).alias("key"))


@query(r"""WITH n AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text || ' +007 1,250 -3.50 3/4', '[-+]?[0-9]+(?:,[0-9]{2,3})*(?:\.[0-9]+)?(?:/[0-9]+)?'), lambda x: CASE WHEN regexp_matches(replace(ltrim(x, '+'), ',', ''), '^-?[0-9]+$') THEN regexp_replace(replace(ltrim(x, '+'), ',', ''), '^(-?)0+([0-9])', '\1\2') ELSE replace(ltrim(x, '+'), ',', '') END) AS n FROM conversations)
SELECT conv_id, turn, array_to_string(n, ' ') AS numbers, len(list_distinct(n))::INT AS distinct_numbers, true AS has_digit FROM n""")
def number_lists(spark, d):
    t = F.concat("text", F.lit(" +০০৭ 1,250 -3.50 3/4"))
    return _conversations(spark, d).select("conv_id", "turn", F.array_join(X.extract_numbers(t), " ").alias("numbers"), F.size(X.distinct_numbers(t)).alias("distinct_numbers"), X.has_digit(t).alias("has_digit"))


@query("""SELECT p_partkey, 'What is a "' || p_name || '"?' AS question, p_name AS quoted, lower(p_type) AS word FROM part""")
def question_pieces(spark, d):
    q = F.concat(F.lit('What is a "'), "p_name", F.lit('"? a) thing b) tool'))
    p = table(spark, d, "part")
    return p.select("p_partkey", X.strip_options(q).alias("question"), X.quoted(q).alias("quoted"), F.coalesce(X.spelling_word(F.concat(F.lit(" '"), F.lower("p_type"), F.lit("'। "))), X.spelling_word(F.col("p_name"))).alias("word"))


@query(rf"SELECT conv_id, turn, rtrim({_SP.format('text')}, '।. ') AS cell FROM conversations")
def normalized_cells(spark, d):
    return _conversations(spark, d).select("conv_id", "turn", X.normalized_cell(F.concat(F.lit("'"), X.collapse_whitespace(F.col("text")), F.lit(" ।"))).alias("cell"))


@query(f"""SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform({_TOK.format("text")}, lambda x, i: {{'k': md5(concat_ws('|', conv_id::VARCHAR, (i - 1)::VARCHAR, '0')), 't': x}})), lambda s: s.t), ' ') AS shuffled FROM conversations""")
def shuffled_words(spark, d):
    return _conversations(spark, d).select("conv_id", "turn", F.array_join(X.shuffled_tokens(X.whitespace_tokens(F.col("text")), F.col("conv_id")), " ").alias("shuffled"))


@query(rf"""SELECT conv_id, turn, {_SP.format("regexp_replace(regexp_replace(lower(text), '<[^>]+>', ' ', 'g'), '[^a-z]', ' ', 'g')")} AS words FROM conversations""")
def lab_cleaned(spark, d):
    return _conversations(spark, d).select("conv_id", "turn", X.lab_clean(F.col("text")).alias("words"))


@query(f"""WITH w AS (SELECT lang, {WORDS.format("text")} AS w FROM documents), g AS (SELECT lang, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: array_to_string(w[i : i + 1], ' ')) ELSE [] END) AS gram FROM w) SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 5""")
def bigram_counts(spark, d):
    g = docs(spark, d).select("lang", lower_words().alias("w")).select("lang", F.explode(X.word_ngrams(F.col("w"), 2)).alias("gram"))
    return g.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query("""WITH w AS (SELECT DISTINCT ' ' || p_name || ' ' AS w FROM part), g AS (SELECT unnest(flatten([list_transform(range(1, length(w) - k + 2), lambda i: substr(w, i::INT, k::INT)) for k in [3, 4, 5] if length(w) >= k])) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def char_ngram_counts(spark, d):
    w = table(spark, d, "part").select("p_name").distinct()
    return w.select(F.explode(X.char_ngrams(F.col("p_name"), 3, 5)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_of_neighbours(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", r6(S.cosine(F.col("embedding"), F.col("other")), "cosine"))


@query("""SELECT o_orderkey, levenshtein(o_orderpriority, '5-LO') <= 1 AS one_edit, o_orderpriority = '5-LOW' AS confused FROM orders""")
def spelling_neighbours(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.within_one_edit(F.col("o_orderpriority"), F.lit("5-LO")).alias("one_edit"), S.one_substitution(F.col("o_orderpriority"), F.lit("5-LUW"), [("U", "O")]).alias("confused"))


@query(f"""WITH t AS {PAIRS}, w AS (SELECT conv_id, turn, {_TOK.format("question")} AS q, ' ' || array_to_string({_TOK.format("CASE WHEN turn % 4 = 0 THEN answer || ' ' || question ELSE answer END")}, ' ') || ' ' AS c FROM t)
SELECT conv_id, turn, len(q) >= 6 AND len(list_filter(range(1, greatest(len(q) - 4, 2)), lambda i: contains(c, ' ' || array_to_string(q[i : i + 5], ' ') || ' '))) > 0 AS has_run FROM w""")
def verbatim_runs(spark, d):
    c = F.when(F.col("turn") % 4 == 0, F.concat_ws(" ", "answer", "question")).otherwise(F.col("answer"))
    return pair_texts(spark, d).select("conv_id", "turn", S.has_verbatim_run(F.col("question"), c).alias("has_run"))


@query(f"SELECT conv_id, turn, list_filter({_TOK.format('text')}, lambda x, i: list_position(list_transform({_TOK.format('text')}, lambda y: lower(y)), lower(x)) = i)[1:5] AS kept FROM conversations".replace(" AS kept", " AS k").join(["SELECT conv_id, turn, array_to_string(k, ' ') AS kept FROM (", ")"]))
def ordered_distinct_words(spark, d):
    from textmill.operators.pairs import ordered_distinct

    return _conversations(spark, d).select("conv_id", "turn", F.array_join(ordered_distinct(X.whitespace_tokens(F.col("text")), F.lower, 5), " ").alias("kept"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN year(o_orderdate)::VARCHAR END AS born, CASE WHEN o_orderkey % 4 = 1 THEN year(o_orderdate)::VARCHAR END AS founded, CASE WHEN o_orderkey % 4 = 0 THEN 'was born in ' || year(o_orderdate) WHEN o_orderkey % 4 = 1 THEN 'was founded in ' || year(o_orderdate) ELSE '' END AS sentence, year(o_orderdate) || ' 2024' AS years FROM orders")
def passage_years(spark, d):
    o = table(spark, d, "orders")
    verb = F.when(F.col("o_orderkey") % 4 == 0, "was born in").when(F.col("o_orderkey") % 4 == 1, "was founded in").otherwise("passed by")
    t = F.concat(F.lit("It is a thing!\n "), verb, F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" \nseen 2024 and 12345"))
    return o.select("o_orderkey", evidence.birth_year(t).alias("born"), evidence.establishment_year(t).alias("founded"), evidence.predicate_sentence(t, "born|founded").alias("sentence"), F.array_join(evidence.year_list(t), " ").alias("years"))


@query("SELECT c_custkey, c_name AS alias, ['bangladesh_law', 'bangladesh_gov', 'bengali_news_2021_2024', ''][c_custkey % 4 + 1] AS domain, ['pro', 'pre', NULL][c_custkey % 3 + 1] AS prefix FROM customer")
def question_hints(spark, d):
    c = table(spark, d, "customer")
    pick = lambda n, *v: F.get(F.array(*map(F.lit, v)), (F.col("c_custkey") % n).cast("int"))
    cue = pick(4, "সংবিধান কী?", "নাগরিক  সেবা কী?", "গত বছর কী হয়?", "কী?")
    return c.select("c_custkey", evidence.without_honorific(F.concat(F.lit("স্যার ড. "), "c_name")).alias("alias"), evidence.domain_hint(cue).alias("domain"), evidence.prefix_of(pick(3, "program", "prefix", "other"), ["pr", "pro", "pre"][1:]).alias("prefix"))


@query(f"""WITH t AS (SELECT p_partkey, list_filter(list_distinct(string_split(trim(regexp_replace(lower(p_name || ' of a ' || p_brand), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: length(x) >= 2 AND x NOT IN ({", ".join(map(repr, STOP))})) AS t FROM part) SELECT p_partkey, len(t)::INT AS terms, (len(t) + greatest(len(t) - 1, 0))::INT AS with_bigrams FROM t""")
def retrieval_term_counts(spark, d):
    t = F.concat("p_name", F.lit(" of a "), "p_brand")
    return table(spark, d, "part").select("p_partkey", F.size(evidence.content_tokens(t, STOP)).alias("terms"), F.size(evidence.retrieval_terms(t, STOP)).alias("with_bigrams"))


@query(_values([(i, rule, verdict) for i, _, _, rule, verdict in cases.rows()]).join(["SELECT id, rule::VARCHAR AS rule, verdict::INT AS verdict FROM (", ") t(id, rule, verdict)"]))
def word_problems(spark, d):
    t = _fixture(spark, "id int, q string, a string", [r[:3] for r in cases.rows()])
    v = wordproblems.arithmetic("q", "a")
    return t.select("id", v["rule"].alias("rule"), v["verdict"].alias("verdict"))


_NUMERALS = [(1, "দুই হাজার পাঁচ টাকা", "2005", "2005", True), (2, "পাঁচ শত বিশ জন ও ৩টি", "520 3", "520", False), (3, "নাই", "", "7", True), (4, "এক লক্ষ দশ হাজার", "110000", "110000 ও 4", True), (5, "নব্বই", "90", "91", False)]


@query(_values([(i, n, ok) for i, _, n, _, ok in _NUMERALS]).replace("True", "true").replace("False", "false").join(["SELECT id, numbers, agree FROM (", ") t(id, numbers, agree)"]))
def word_numerals(spark, d):
    t = _fixture(spark, "id int, gold string, response string", [(i, g, r) for i, g, _, r, _ in _NUMERALS])
    return t.select("id", F.array_join(verify.semantic_numbers("gold"), " ").alias("numbers"), verify.numbers_agree(F.col("gold"), F.col("response")).alias("agree"))


_QUESTIONS = [
    (1, "UN এর পূর্ণরূপ কী?", "full_form", False), (2, "যুদ্ধ কত সালে শুরু হয়?", "when", False), (3, "শহরটি কোথায়?", "where", False), (4, "এটি কে লিখেছেন?", "who", False), (5, "নদী কীভাবে চলে?", "why", False),
    (6, "সেখানে কতজন ছিল?", "quantity", False), (7, "নিচের কোনটি ঠিক?", "which", False), (8, "নদী কী?", "what", False), (9, "বর্তমান রাজধানী কী?", "what", True),
]


@query(_values([(i, k, t) for i, _, k, t in _QUESTIONS]).replace("True", "true").replace("False", "false").join(["SELECT id, kind, temporal FROM (", ") t(id, kind, temporal)"]))
def question_kinds(spark, d):
    t = _fixture(spark, "id int, q string", [(i, q) for i, q, _, _ in _QUESTIONS])
    return t.select("id", verify.question_signature(F.col("q")).alias("kind"), verify.temporal_question(F.col("q")).alias("temporal"))


_COMPOUNDS = [
    (1, "পিতা ও মাতা", "দ্বন্দ্ব", "দ্বন্দ্ব সমাস", 1), (2, "তিন ফলের সমাহার", "দ্বিগু", "দ্বন্দ্ব", 0), (3, "মন দ্বারা গড়া", "তৃতীয়া তৎপুরুষ", "তৃতীয়া তৎপুরুষ", 1), (4, "যার বীণা পাণিতে", "বহুব্রীহি", "বহুব্রীহি", 1),
    (5, "বিলাত হইতে ফেরত", "পঞ্চমী তৎপুরুষ", "কর্মধারয়", 0), (6, "দেশের জন্য প্রেম", "চতুর্থী তৎপুরুষ", "চতুর্থী তৎপুরুষ সমাস", 1), (7, "abc", "", "x", None),
]


@query(_values([(i, k, v) for i, _, k, _, v in _COMPOUNDS]).join(["SELECT id, kind, verdict::INT AS verdict FROM (", ") t(id, kind, verdict)"]))
def compound_classes(spark, d):
    t = _fixture(spark, "id int, analysis string, answer string", [(i, s, a) for i, s, _, a, _ in _COMPOUNDS])
    return t.select("id", verify.samas(F.col("analysis")).alias("kind"), verify.samas_verdict(F.col("analysis"), F.col("answer")).alias("verdict"))


@query("""WITH g AS (SELECT repeat(chr(2), 2) || text AS p, length(text) AS n FROM benchmark), w AS (SELECT substr(p, i::INT, 2) AS h, substr(p, i::INT + 2, 1) AS c FROM (SELECT p, unnest(range(1, n + 1)) AS i FROM g)) SELECT h AS history, c AS char, count(*) AS n FROM w GROUP BY ALL""")
def char_history_counts(spark, d):
    return lm.char_counts(table(spark, d, "benchmark"), "text", 3).select("history", "char", "n")


@query(f"""WITH w AS (SELECT conv_id, turn, {_TOK.format("text")} AS w FROM conversations), p AS (SELECT unnest(w) AS center, w, unnest(range(1, len(w) + 1)) AS i FROM w), c AS (SELECT center, unnest(list_concat(w[greatest(i - 2, 1) : i - 1], w[i + 1 : i + 2])) AS context FROM p) SELECT center, context, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 3""")
def context_pair_counts(spark, d):
    c = _conversations(spark, d).select(X.whitespace_tokens(F.col("text")).alias("w")).select(F.explode(vectorize.context_pairs(F.col("w"), 2)).alias("p")).select("p.center", "p.context")
    return c.groupBy("center", "context").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
