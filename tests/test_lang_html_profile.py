"""Language functions (C9-C11, E12, E14), HTML candidates (E15-E17),
histogram (F11) and batching (H7) on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paraspark.functions import html as H
from paraspark.functions import lang as L
from paraspark.operators import corpus as CO
from paraspark.operators import profile as PR


def one(spark, col, value, ddl="t string"):
    return spark.createDataFrame([(value,)], ddl).select(col.alias("o")).first()[0]


def test_normalise_and_codes(spark):
    assert one(spark, L.normalize_lang("t"), "Darija") == "dr"
    assert one(spark, L.normalize_lang("t"), "EN") == "en"
    assert one(spark, L.normalize_lang("t"), "xx") == "xx"
    assert one(spark, L.model_code("t"), "dr") == "ary_Arab"
    assert one(spark, L.model_code("t"), "de") is None
    assert one(spark, L.split_direction("t"), "fr_dr") == ["fr", "dr"]
    with pytest.raises(Exception):
        one(spark, L.split_direction("t"), "fr_dr_x")


def test_translation_map_later_wins(spark):
    df = spark.createDataFrame([("fr", "a", "fr", "b"), ("fr", "a", "dr", "c")], "sl string, st string, tl string, tt string")
    got = [r[0] for r in df.select(L.translation_map("sl", "st", "tl", "tt")).collect()]
    assert got == [{"fra_Latn": "b"}, {"fra_Latn": "a", "ary_Arab": "c"}]


@pytest.mark.parametrize("m,expected", [
    ({"fra_Latn": "a", "ary_Arab": "b"}, ("fra_Latn", "ary_Arab")),
    ({"eng_Latn": "a", "ary_Arab": "b"}, ("eng_Latn", "ary_Arab")),
    ({"fra_Latn": "a", "eng_Latn": "b"}, ("fra_Latn", "eng_Latn")),
    ({"ary_Arab": "a"}, (None, None)),
    ({"fra_Latn": "a", "ary_Arab": None, "eng_Latn": "c"}, ("fra_Latn", "eng_Latn")),
])
def test_infer_direction(spark, m, expected):
    r = spark.createDataFrame([(m,)], "m map<string,string>").select(L.infer_direction("m").alias("d")).first()["d"]
    assert (r["src_lang"], r["tgt_lang"]) == expected


PAGE = ("<html><head><title>T&amp;itle é</title><script>var t=\"</p>\";</script><style>p{}</style></head>"
        "<body><!-- <p>hidden</p> --><p class=x><b>Bold é<br><p>Marocain</p><p>plain</p>"
        "<div><p>last é &lt;ok&gt;</div></body></html>")


def test_paragraphs_and_candidates(spark):
    lo, hi = H.LATIN_ACCENTS
    df = spark.createDataFrame([(PAGE,)], "html string").select(
        "html", H.with_script_flag(H.paragraphs("html"), lo, hi).alias("ps"))
    r = df.select("ps", H.first_valid("ps").alias("fv"),
                  H.first_valid_of([H.title("html"), F.get("ps", 0)["text"]], lo, hi).alias("fb")).first()
    texts = [(p["pos"], p["text"], p["has_script"]) for p in r["ps"]]
    assert texts == [(0, "Bold é", True), (1, "Marocain", False), (2, "plain", False), (3, "last é <ok>", True)]
    assert r["fv"] == "Bold é"
    assert r["fb"] == "T&itle é"


def test_histogram_matches_numpy(spark):
    vals = [1, 2, 2, 3, 5, 8, 13, 21, 34, 55, 55]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    got = sorted((r["bin"], r["count"]) for r in PR.histogram(df, "x", 5).collect())
    counts, _ = np.histogram(vals, bins=5)
    assert [c for _, c in got] == list(counts)
    same = spark.createDataFrame([(7,), (7,)], "x int")
    assert [r["count"] for r in PR.histogram(same, "x", 4).orderBy("bin").collect()] == list(np.histogram([7, 7], bins=4)[0])


def test_batches_of_twenty(spark):
    df = spark.range(45).withColumnRenamed("id", "k")
    got = sorted((r["batch"], r["items"]) for r in CO.batches(df, ["k"]).collect())
    assert got == [(0, 20), (1, 20), (2, 5)]


def test_direction_of_any_codes(spark):
    df = spark.sql("""SELECT map('spa_Latn', 'a', 'ary_Arab', 'b') AS m UNION ALL SELECT map('spa_Latn', 'a', 'fra_Latn', 'b')
      UNION ALL SELECT map('spa_Latn', 'a') UNION ALL SELECT map('spa_Latn', 'a', 'ary_Arab', CAST(NULL AS STRING))""")
    got = [tuple(r["d"]) for r in df.select(L.infer_direction("m").alias("d")).collect()]
    assert got == [("spa_Latn", "ary_Arab"), ("fra_Latn", "spa_Latn"), (None, None), (None, None)]


def test_character_references(spark):
    df = spark.createDataFrame([("&#1605;&#1585;&eacute; &#x41;&amp;lt; &amp &nope; &#xD800;&#0; a & b &copy;",), (None,), ("",)], "t string")
    got = [r["x"] for r in df.select(H.decode_references("t").alias("x")).collect()]
    assert got == ["\u0645\u0631\u00e9 A&lt; &amp &nope; \ufffd\ufffd a & b \u00a9", None, ""]
