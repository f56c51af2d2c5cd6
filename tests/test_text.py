"""Scalar text rules (D1-D13), including the reference's docstring examples."""

import re

from pyspark.sql import functions as F

from paraspark.functions import text as T


def py_clean(text):
    """Independent statement of the cleaning rule (regex prefix, escapes, strip)."""
    text = re.sub(r"ترجم.*?:\s*", "", text)
    for a, b in [("\\xa0", " "), ("\xa0", " "), ("\u2009", " "), ("\\'", "'"), ("\\", " ")]:
        text = text.replace(a, b)
    return text.strip()


CASES = [
    "ترجم de la suite:Hello\\xa0world",
    "the world\\'s",
    "il a dit \\ salut",
    "a\\/b",
    "  x\u2009y\xa0 ",
    "ترجم x\nترجم y: z",
    "\u3000ab\x85",
    "ترجم a: ترجم b:\t c",
    "",
    "no change",
]


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("o")).first()[0]


def test_docstring_examples(spark):
    assert _one(spark, T.clean_text("t"), "ترجم de la suite:Hello\\xa0world") == "Hello world"
    assert _one(spark, T.clean_text("t"), "the world\\'s") == "the world's"
    assert _one(spark, T.clean_text("t"), "il a dit \\ salut") == "il a dit   salut"


def test_clean_matches_python(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "t string")
    got = [r[0] for r in df.select(T.clean_text("t")).collect()]
    assert got == [py_clean(c) for c in CASES]


def test_backslash_order(spark):
    # the later "\/" -> "/" rule can never fire
    assert _one(spark, T.unescape_backslashes("t"), "a\\/b") == "a /b"


def test_newlines_and_markers(spark):
    assert _one(spark, T.drop_newlines("t", T.ROW_REPR), "a\\nb") == "ab"
    assert _one(spark, T.drop_newlines("t", T.NATIVE), "a\nb") == "ab"
    assert _one(spark, T.drop_markers("t"), "a<|user|>b<|assistant|>c") == "abc"


def test_full_prefix(spark):
    assert _one(spark, T.strip_full_prefix("t"), "ترجم من الفرنساوية للدارجة: salut ") == "salut"
    assert _one(spark, T.strip_full_prefix("t"), " keep ") == " keep "


def test_classifier(spark):
    q = lambda s: _one(spark, T.classify_question("t"), s)
    assert q("Where is the station") == "Question"
    assert q("candle light") == "Question"          # prefix inside a word counts
    assert q("I wonder how it works") == "Question"  # surrounded by spaces
    assert q("Nice weather.") == "Affirmation"
    assert q("ok?") == "Question"
    assert _one(spark, T.classify_question("t", word_boundary=True), "candle light") == "Affirmation"


def test_script_and_lines(spark):
    assert _one(spark, T.has_script("t"), "abc ب") is True
    assert _one(spark, T.has_script("t"), "abc") is False
    assert _one(spark, T.split_lines("t"), " a \n\n b\n") == ["a", "b"]


def test_mean_round(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert df.agg(T.mean_round(F.col("x"), 2)).first()[0] == 1.67


# pieces that exercise every rule: the instruction word, the colon that ends a
# prefix, Unicode whitespace (including the ones Java's '.' and trim treat
# differently from Python), literal escape sequences and plain letters
PIECES = ["ترجم", ":", " ", "\t", "\n", "\r", "\x85", " ", "　", "\x1c", "\xa0", " ",
          "\\xa0", "\\'", "\\", "\\/", "'", "a", "Z", "0", "é"]


def test_clean_random_strings_match_python(spark):
    import random
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", T.clean_text("t")).collect()}
    bad = [(t, got[i], py_clean(t)) for i, t in enumerate(texts) if got[i] != py_clean(t)]
    assert not bad, bad[:5]
