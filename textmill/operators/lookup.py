"""Matching records to reference banks: exact and alias keys, blocked fuzzy candidates, option transfer, rule cascades.

Banks are joined by equal keys. None is broadcast by hint; Spark does that itself where a bank is small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import similarity as S
from textmill.functions import text as X


def unique_key(bank: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once."""
    return bank.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join that fails, when it runs, if a key stands twice on the right; rows of the left keep their number."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    fail = F.raise_error(F.concat(F.lit("duplicate key: "), *(F.col(k).cast("string") for k in keys))).cast("boolean")
    checked = right.withColumn("__n", n).where(F.when(F.col("__n") > 1, fail).otherwise(F.lit(True))).drop("__n")
    return left.join(checked, keys, how)


def exact_or_alias(df: DataFrame, bank: DataFrame, key: str, alias: str, value: list[str]) -> DataFrame:
    """df with the bank's values by key, else by alias; `match` tells which, `collision` if an alias stands for several keys."""
    by_key = bank.groupBy(key).agg(F.min(F.struct(*value)).alias("__a"))
    by_alias = bank.groupBy(alias).agg(F.min(F.struct(*value)).alias("__b"), (F.count_distinct(key) > 1).alias("collision"))
    out = df.join(by_key, key, "left").join(by_alias, alias, "left")
    got = F.coalesce("__a", F.when(~F.col("collision"), F.col("__b")))
    match = F.when(F.col("__a").isNotNull(), "exact").when(F.col("__b").isNotNull() & ~F.col("collision"), "alias").otherwise("none")
    return out.select(*df.columns, *(got[v].alias(v) for v in value), match.alias("match"), F.coalesce("collision", F.lit(False)).alias("collision"))


def composite_then_single(df: DataFrame, bank: DataFrame, first: str, second: str, answers: str) -> DataFrame:
    """The union of the bank's answers by both keys, else by the first alone, and whether they conflict."""
    merged = lambda keys: bank.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(answers)))).alias("__a"))
    both = merged([first, second]).withColumnRenamed("__a", "__both")
    out = df.join(both, [first, second], "left").join(merged([first]).withColumnRenamed("__a", "__one"), first, "left")
    got = F.coalesce("__both", "__one")
    return out.select(*df.columns, got.alias("references"), (F.size(got) > 1).alias("conflict"), F.col("__both").isNotNull().alias("by_both"))


def gold_or_distractor(df: DataFrame, bank: DataFrame, key: str, answer: str, gold: str = "gold_keys", distractors: str = "distractor_keys") -> DataFrame:
    """df with found and label: 1 if the answer's key is a gold one, 0 if a distractor, null else."""
    out = df.join(bank.select(key, gold, distractors), key, "left")
    label = F.when(F.array_contains(gold, F.col(answer)), 1).when(F.array_contains(distractors, F.col(answer)), 0)
    return out.select(*df.columns, F.col(gold).isNotNull().alias("found"), label.alias("label"))


def needed_rows(bank: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The bank's rows whose key df has."""
    return bank.join(df.select(key).distinct(), key, "left_semi")


def similar_sets(own: DataFrame, theirs: DataFrame, block: str, mine: str, other: str, least: float) -> DataFrame:
    """(block, mine, other, score) of pairs of word sets with word Jaccard `least` in one block; the sets must be distinct arrays.

    Their sizes tell how many words two such sets share at least. So they have a word in common among their first ones, rarest first: all but
    that many, and one more. Pairs meet under their sizes and such a word, at the first that both have, so none is compared twice.
    """
    score = S.jaccard(F.col(mine), F.col(other))
    if least <= 0:  # sets without a common word count, too
        return own.join(theirs, block).withColumn("score", score).where(F.col("score") >= least)
    counts = theirs.select(block, F.explode(other).alias("__w")).groupBy(block, "__w").agg(F.count(F.lit(1)).alias("__n"))
    sizes = F.col("__mine"), F.col("__other")
    met = [block, "__mine", "__other", "__w"]

    def first_words(sets: DataFrame, c: str, size: str, partners: DataFrame, d: str, partner: str, name: str) -> DataFrame:
        at = sets.select(block, c, F.explode(c).alias("__w")).join(counts, [block, "__w"], "left")
        ranked = at.groupBy(block, c).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__w").alias("w")))).alias(name))
        of = ranked.withColumn(size, F.size(c)).join(partners.select(block, F.size(d).alias(partner)).distinct(), block)
        of = of.where(F.least(*sizes) >= F.lit(least) * F.greatest(*sizes) - 1e-9)
        shared = F.ceil(least / (1 + least) * (sizes[0] + sizes[1]) - 1e-9).cast("int")
        length = F.greatest(F.col(size) - shared + 1, F.lit(0))  # Spark may cut before it filters
        return of.withColumn(name, F.slice(F.col(name)["w"], F.lit(1), length)).withColumn("__w", F.explode(name))

    pairs = first_words(own, mine, "__mine", theirs, other, "__other", "__a").join(first_words(theirs, other, "__other", own, mine, "__mine", "__b"), met)
    pairs = pairs.where(F.element_at(F.array_intersect("__a", "__b"), 1) == F.col("__w"))
    return pairs.select(block, mine, other, score.alias("score")).where(F.col("score") >= least)


def _leading(scored: DataFrame, keys: list[str], label: list[str], near: float) -> DataFrame:
    """What can decide the best match of a key or of any union of keys: the two best rows, and the best of each label within `near`."""
    w, order = Window.partitionBy(*keys), [F.desc("score"), "__q", *label]
    kept, keep = scored.withColumn("__rank", F.row_number().over(w.orderBy(*order))), F.col("__rank") <= 2
    if label:
        kept = kept.withColumns({"__best": F.max("score").over(w), "__nth": F.row_number().over(Window.partitionBy(*keys, *label).orderBy(*order))})
        keep |= (F.col("__nth") == 1) & (F.col("score") >= F.col("__best") - near)
    return kept.where(keep).select(*scored.columns)


def blocked_match(df: DataFrame, bank: DataFrame, row: str, question: str, option: str, options: str, bank_question: str, least: float = 0.7, lead: float = 0.05, near: float = 0.02) -> DataFrame:
    """(row, bank_question, score, margin, unanimous): bank questions that have the row's option, ranked by word Jaccard of the questions.

    An inverted index on options and rare words yields the candidates. Questions with the same words and option are compared once, however
    many rows ask them, and only what can decide a match goes back to the rows. Kept are best candidates with score `least` and a lead over
    those with another verdict; `unanimous`: all within `near` of the best agree.
    """
    label = ["label"] if "label" in bank.columns else []
    words = lambda c: F.array_sort(X.word_set(F.col(c), True))
    rows = df.select(row, words(question).alias("__own"), option)
    index = bank.select(F.col(bank_question).alias("__q"), words(bank_question).alias("__theirs"), F.explode(options).alias(option), *label)
    index = _leading(index.withColumn("score", F.lit(1.0)), [option, "__theirs"], label, near).drop("score")
    found = similar_sets(rows.select(option, "__own").distinct(), index.select(option, "__theirs").distinct(), option, "__own", "__theirs", least)
    scored = rows.join(_leading(found.join(index, [option, "__theirs"]), [option, "__own"], label, near), [option, "__own"])
    w = Window.partitionBy(row)
    order = w.orderBy(F.desc("score"), "__q", *label)
    labelled = scored.withColumn("rank", F.row_number().over(order)).withColumn("best", F.max("score").over(w)).withColumn("next", F.lead("score").over(order))
    verdicts = F.size(F.collect_set(F.when(F.col("score") >= F.col("best") - near, F.col("label"))).over(w)) if label else F.lit(1)
    out = labelled.withColumn("unanimous", verdicts <= 1).where("rank = 1").withColumn("margin", F.col("score") - F.coalesce("next", F.lit(0.0)))
    keep = (F.col("margin") >= lead) | F.col("unanimous")
    return out.where(keep).select(row, F.col("__q").alias(bank_question), "score", "margin", "unanimous", *label)


def near_options(options: Column, answer: Column, least: float = 0.8) -> Column:
    """The option nearest to an answer by character Levenshtein similarity, as struct(score, option); null below `least`."""
    score = lambda o: 1 - F.levenshtein(o, answer) / F.greatest(F.length(o), F.length(answer), F.lit(1))
    best = F.array_max(F.transform(options, lambda o: F.struct(score(o).alias("score"), o.alias("option"))))
    return F.when(best["score"] >= least, best)


def transfer_labels(df: DataFrame, samples: DataFrame, key: str, ident: str, answer: str, label: str = "label") -> DataFrame:
    """Labels for rows whose question another sample has: equal answer, its label; other answer than a correct one, 0."""
    s = samples.select(key, F.col(ident).alias("__id"), F.col(answer).alias("__a"), F.col(label).alias("__l"))
    pairs = df.select(key, ident, answer).join(s, key).where(F.col(ident) != F.col("__id"))
    verdict = F.when(F.col(answer) == F.col("__a"), F.col("__l")).when(F.col("__l") == 1, 0)
    return pairs.withColumn("verdict", verdict).where("verdict is not null").groupBy(ident).agg(F.min("verdict").alias("low"), F.max("verdict").alias("high")).select(ident, F.when(F.col("low") == F.col("high"), F.col("low")).alias("label"))


def deletions(word: Column) -> Column:
    """The word and all of it with one character deleted: words within one edit share one of them."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def one_edit_neighbours(words: DataFrame, lexicon: DataFrame, word: str, entry: str) -> DataFrame:
    """(word, entry, distance) of pairs at most one edit apart: an equi-join on deletions, then the exact distance."""
    a = words.select(word, F.explode(deletions(F.col(word))).alias("__d"))
    b = lexicon.select(entry, F.explode(deletions(F.col(entry))).alias("__d"))
    pairs = a.join(b, "__d").select(word, entry).distinct()
    return pairs.withColumn("distance", F.levenshtein(word, entry)).where("distance <= 1")


#: Characters of items that may be broadcast.
SMALL = 64 << 20


def containing(df: DataFrame, items: DataFrame, key: str, text: str, item: str, words: int = 3) -> DataFrame:
    """(key) of rows whose text holds an item, verbatim.

    An item's second to (words + 1)th words are whole words wherever it stands, so rows and items first meet on that run of words, and
    only those pairs are compared as strings. The items are broadcast if they are known to be small, else joined by the run. Items of fewer
    than words + 2 words have no such run; each is looked for in every text.
    """
    items = items.select(F.col(item).alias("__item")).where("__item <> ''").distinct()
    at = F.split(F.trim("__item"), r"(?U)\s+")
    probes = items.where(F.size(at) >= words + 2).select("__item", F.array_join(F.slice(at, 2, words), " ").alias("__run"))
    size = items.agg(F.sum(F.length("__item"))).first()[0] or 0
    own = df.select(key, X.whitespace_tokens(F.col(text)).alias("__w"))
    runs = own.select(key, F.explode(F.array_distinct(X.word_ngrams(F.col("__w"), words))).alias("__run"))
    pairs = runs.join(F.broadcast(probes) if size <= SMALL else probes, "__run").select(key, "__item").distinct()
    found = df.select(key, text).join(pairs, key).where(F.contains(text, "__item")).select(key)
    short = [r[0] for r in items.where(F.size(at) < words + 2).limit(1001).collect()]
    if len(short) > 1000:
        raise ValueError("over 1000 items of a few words: look for them by their words")
    if short:
        any_ = F.lit(False)
        for x in short:
            any_ = any_ | F.contains(F.col(text), F.lit(x))
        found = found.unionByName(df.where(any_).select(key))
    return found.distinct()


def relation_year(df: DataFrame, relations: DataFrame, subject: str, title: str, year: str, claimed: str) -> DataFrame:
    """df with the year of its subject's title and whether the claimed one agrees."""
    out = df.join(relations.select(F.col(title).alias(subject), F.col(year).alias("__year")), subject, "left")
    return out.select(*df.columns, F.col("__year").alias("expected_year"), (F.col("__year") == F.col(claimed)).alias("agrees"))


def cascade(tiers: list[tuple[str, Column, Column]]) -> tuple[Column, Column]:
    """(label, tier) of the first tier whose condition holds and whose label isn't null."""
    pick = lambda v: F.coalesce(*(F.when(cond & label.isNotNull(), v(name, label)) for name, cond, label in tiers))
    return pick(lambda n, lab: lab), pick(lambda n, lab: F.lit(n))


def policy(score: Column, threshold: float, hard: Column, overrides: list[tuple[Column, Column]]) -> Column:
    """The threshold's label, replaced by a hard one, replaced by overrides; the later wins."""
    out = F.coalesce(hard, (score >= threshold).cast("int"))
    for cond, label in overrides:
        out = F.when(F.coalesce(cond, F.lit(False)), label).otherwise(out)
    return out


def evidence_sentences(df: DataFrame, row: str, passage: str, answer: str, top: int = 3) -> DataFrame:
    """(row, sentences): the sentences of a row's own passage with the most of the answer's words, in order of score, then place."""
    pieces = F.filter(F.split(passage, "[।.!?\\n]+"), lambda s: F.trim(s) != "")
    own = X.word_set(F.col(answer), True)
    ranked = F.array_sort(F.transform(pieces, lambda s, i: F.struct((-S.overlap_share(own, X.word_set(s, True))).alias("neg"), i.alias("at"), F.trim(s).alias("sentence"))))
    return df.select(row, F.transform(F.slice(ranked, 1, top), lambda x: x["sentence"]).alias("sentences"))


def route(df: DataFrame, priority: Column, limit: int, key: str) -> DataFrame:
    """The rows with the highest priority."""
    return df.withColumn("priority", priority).orderBy(F.desc("priority"), key).limit(limit)


def cached(pending: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of rows against a key-value log; of a key the latest entry counts."""
    latest = cache.groupBy(*keys).agg(F.max_by("value", "at").alias("value"))
    return pending.join(latest, keys), pending.join(latest, keys, "left_anti")
