import random

from pyspark.sql import functions as F

from textmill.functions import similarity as S
from textmill.functions import text as X


def one(spark, value, column, schema="s string"):
    row = value if isinstance(value, tuple) else (value,)
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def test_clean_joins_digits_citations_and_space(spark):
    assert one(spark, "১৯৭১ সালে[১] স্বাধীন   হয়।", X.clean(F.col("s"))) == "1971 সালে স্বাধীন হয়।"
    assert one(spark, r"\sqrt[7]{n} [2]", X.clean(F.col("s"))) == r"\sqrt[7]{n}"
    assert one(spark, None, X.clean(F.col("s"))) == ""


def test_nfc_splits_the_precomposed_letter(spark):
    assert one(spark, "য়", X.nfc(F.col("s"))) == "য়"


def test_tokens_lose_nothing_but_space(spark):
    assert one(spark, "1971 সালে স্বাধীন হয়।", X.tokenize(F.col("s"))) == ["1971", "সালে", "স্বাধীন", "হয়", "।"]
    assert one(spark, "pi is 3.14, École!", X.tokenize(F.col("s"))) == ["pi", "is", "3.14", ",", "École", "!"]


def test_protected_words_stay(spark):
    assert one(spark, "this is not it", X.preprocess(F.col("s"), "V2", ["is", "not"], ["not"])) == ["this", "not", "it"]
    assert one(spark, "this is not it", X.preprocess(F.col("s"), "V2-demo", ["is", "not"], ["not"])) == ["this", "it"]


def test_stem_cuts_the_longest_suffix_that_leaves_a_known_word(spark):
    known = F.array(F.lit("শব্দ"))
    stem = X.stem_word(F.col("s"), ["ের", "দের", "র"], known)
    assert one(spark, "শব্দের", stem) == "শব্দ"
    assert one(spark, "করেননি", stem) == "করেননি"
    assert one(spark, "DNA", stem) == "DNA"


def test_cut_to_tokens_keeps_spacing(spark):
    assert one(spark, "one  two three", X.cut_to_tokens(F.col("s"), 2)) == "one  two"
    assert one(spark, "one", X.cut_to_tokens(F.col("s"), 5)) == "one"


def test_numbers_and_cells(spark):
    assert one(spark, "০০৭ জন, 1,000 and -2.5 of 1/2", X.extract_numbers(F.col("s"))) == ["7", "1000", "-2.5", "1/2"]
    assert one(spark, "=1+1", X.spreadsheet_safe(F.col("s"))) == "'=1+1"
    assert one(spark, "[NULL]", X.has_context(F.col("s"))) is False


def test_markup_and_keys(spark):
    assert one(spark, "<b>A &amp; B</b> [1] **c**", X.clean_markup(F.col("s"))) == "A & B c"
    assert one(spark, "Ａ-b, C!", X.lookup_key(F.col("s"))) == "a b c"


def brute(needle, hay):
    best = len(needle)
    for i in range(len(hay) + 1):
        for j in range(i, len(hay) + 1):
            a, b = needle, hay[i:j]
            row = list(range(len(b) + 1))
            for x, p in enumerate(a, 1):
                old, row[0] = row[0], x
                for y, q in enumerate(b, 1):
                    old, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, old + (p != q))
            best = min(best, row[-1])
    return best


def test_best_match_against_every_substring():
    rng = random.Random(1)
    assert S.best_match("abc", "xxabcxx") == 0
    assert S.best_match("abcd", "xyz") == 4
    assert S.best_match("abc", "") == 3
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert S.best_match(a, b) == brute(a, b)


def test_similarities(spark):
    assert one(spark, ("kitten", "sitting"), S.edit_distance(F.col("a"), F.col("b")), "a string, b string") == 3
    assert one(spark, ("ঢাকা।", "রাজধানী ঢাকা শহর"), S.exact_in_passage(F.col("a"), F.col("b")), "a string, b string") is True
    assert one(spark, ("a b c d e f g", "x a b c d e f y"), S.has_verbatim_run(F.col("a"), F.col("b")), "a string, b string") is True
    assert one(spark, ("Dhaka City", "dhaka city."), S.answer_equivalence(F.col("a"), F.col("b")), "a string, b string") is True
    assert one(spark, ("in 1971", "in 1972"), S.answer_equivalence(F.col("a"), F.col("b")), "a string, b string") is False
