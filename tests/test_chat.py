"""Pair extraction (E1-E9): golden examples and a randomised pairing test."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paraspark.functions import chat as C
from paraspark.functions import text as T
from paraspark.plans import adapters as A
from paraspark.plans import pipelines as P

MSG = "array<struct<content:string,role:string>>"


def pairs_of(spark, messages, mode=T.NATIVE, fallback=None):
    rows = [("d", "1", messages, "fr_dr", None, fallback)]
    df = spark.createDataFrame(rows, f"dataset string, id string, messages {MSG}, direction string, metadata string, fb string")
    out = P.chat_to_pairs(df, mode, "fb" if fallback is not None else None).first()
    return [tuple(p) for p in out["pairs"]], out["problem"]


def test_two_messages(spark):
    assert pairs_of(spark, [("A", "user"), ("B", "assistant")])[0] == [("A", "B")]


def test_user_user_assistant_is_greedy(spark):
    assert pairs_of(spark, [("A", "user"), ("B", "user"), ("C", "assistant")])[0] == [("A", "")]


def test_marked_string(spark):
    m = [("A<|assistant|>B<|user|>ترجم x:C\xa0<|assistant|>D", "user")]
    assert pairs_of(spark, m)[0] == [("A", "B"), ("C", "D")]


def test_second_assistant_mark_is_lost(spark):
    assert pairs_of(spark, [("A<|assistant|>B<|assistant|>C", "user")])[0] == [("A", "B")]


def test_outside_assistant_fills_last_target(spark):
    m = [("A<|assistant|>B<|user|>C", "user"), ("D", "assistant")]
    assert pairs_of(spark, m)[0] == [("A", "B"), ("C", "D")]


def test_unmatched_turn_uses_fallback(spark):
    got, _ = pairs_of(spark, [("A", "user")], fallback="  fb  ")
    assert got == [("A", "fb")]


def test_no_messages_is_quarantined(spark):
    got, problem = pairs_of(spark, [])
    assert got == [] and problem is True


def test_row_repr_parse(spark):
    s = "[Row(content='a\\nb', role='user'), Row(content=\"it's\", role='assistant')]"
    df = spark.createDataFrame([(s,)], "m string")
    got = [tuple(x) for x in df.select(C.parse_row_repr("m")).first()[0]]
    assert got == [("a\\nb", "user"), ("it's", "assistant")]


def test_row_repr_mode_pairs(spark):
    s = "[Row(content='ترجم de la suite:Hello\\xa0world', role='user'), Row(content='the world\\'s', role='assistant')]"
    df = spark.createDataFrame([("d", "1", s, "fr_dr", None)], "dataset string, id string, messages string, direction string, metadata string")
    out = P.chat_to_pairs(df, T.ROW_REPR).first()["pairs"]
    assert [tuple(p) for p in out] == [("Hello world", "the world's")]


def py_greedy(msgs):
    """Independent statement of the pairing loop."""
    out, i = [], 0
    while i < len(msgs):
        if msgs[i][1] == "user":
            tgt = msgs[i + 1][0] if i + 1 < len(msgs) and msgs[i + 1][1] == "assistant" else ""
            out.append((msgs[i][0], tgt))
            i += 2
        else:
            i += 1
    return out


roles = st.lists(st.sampled_from(["user", "assistant", "system"]), max_size=12)


@settings(max_examples=40, deadline=None)
@given(st.lists(roles, min_size=1, max_size=8))
def test_greedy_fold_matches_loop(spark, convs):
    data = [[(f"m{j}", r) for j, r in enumerate(c)] for c in convs]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], f"i int, m {MSG}")
    got = {r["i"]: [tuple(p) for p in r["p"]] for r in df.select("i", C.greedy_pairs("m").alias("p")).collect()}
    for i, d in enumerate(data):
        assert got[i] == py_greedy(d)


def test_adapter_keeps_whole_conversations(spark, sf_small):
    c = spark.read.parquet(f"{sf_small}/conversations.parquet")
    assert ({r["id"]: r["n"] for r in A.raw_mix(spark, sf_small).select("id", F.size("messages").alias("n")).collect()}
            == {str(r["conv_id"]): r["count"] for r in c.groupBy("conv_id").count().collect()})


roles_or_null = st.lists(st.sampled_from(["user", "assistant", "system", None]), max_size=12)


@settings(max_examples=25, deadline=None)
@given(st.lists(roles_or_null, min_size=1, max_size=8))
def test_long_form_pairing_matches_loop(spark, convs):
    """E3 window form over turn-per-row data equals the loop (and so the fold)."""
    from paraspark.operators.pairing import greedy_pairs_long
    rows = [(i, t, f"m{t}", r) for i, c in enumerate(convs) for t, r in enumerate(c)]
    df = spark.createDataFrame(rows, "i long, turn int, content string, role string") if rows else None
    got: dict[int, list] = {}
    if df is not None:
        for r in greedy_pairs_long(df, ["i"]).collect():
            got.setdefault(r["i"], []).append((r["pos"], r["texte_cible"], r["traduction"]))
    for i, c in enumerate(convs):
        want = py_greedy([(f"m{t}", r) for t, r in enumerate(c)])
        assert [(a, b) for _, a, b in sorted(got.get(i, []))] == want
        assert [p for p, _, _ in sorted(got.get(i, []))] == list(range(len(want)))


def py_split_marked(convo):
    """Independent statement of E2 on escaped (row-repr) text: segments between
    user marks, trimmed, blanks dropped; source before the first assistant
    mark, target between the first and second; each side loses literal
    backslash-n and stray marks, then the cleaning rule."""
    from test_text import py_clean

    def side(x):
        return py_clean(x.replace("\\n", "").replace("<|assistant|>", "").replace("<|user|>", ""))

    out = []
    for seg in convo.split("<|user|>"):
        seg = seg.strip()
        if not seg:
            continue
        parts = seg.split("<|assistant|>")
        out.append((side(parts[0].strip()), side(parts[1].strip() if len(parts) > 1 else "")))
    return out


MARK_PIECES = ["<|user|>", "<|assistant|>", "ترجم", ":", " ", "\n", "\\n", "\xa0", "\\xa0", "\\",
               " ", "a", "b", "|", "<", ">"]


def test_split_marked_random_strings(spark):
    import random
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(MARK_PIECES) for _ in range(rnd.randint(0, 16))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r[0]: [tuple(p) for p in r[1]] for r in df.select("i", C.split_marked("t", T.ROW_REPR)).collect()}
    bad = [(t, got[i], py_split_marked(t)) for i, t in enumerate(texts) if got[i] != py_split_marked(t)]
    assert not bad, bad[:3]


def test_long_form_null_role_ends_a_run(spark):
    from paraspark.operators.pairing import greedy_pairs_long
    msgs = [("u1", "user"), ("n1", None), ("n2", None), ("u2", "user"), ("a2", "assistant")]
    df = spark.createDataFrame([(0, t, c, r) for t, (c, r) in enumerate(msgs)],
                               "i long, turn int, content string, role string")
    got = [(r["texte_cible"], r["traduction"]) for r in greedy_pairs_long(df, ["i"]).orderBy("pos").collect()]
    assert got == py_greedy(msgs) == [("u1", ""), ("u2", "a2")]


@pytest.mark.parametrize("n", [63, 64, 65, 66, 128, 1000])
def test_pairing_of_long_conversations(spark, n):
    """Whole conversations against the plain loop, with pairs on either side
    of every block edge and blocks of users only."""
    from paraspark.operators.pairing import greedy_pairs_long
    import random
    r = random.Random(n)
    shapes = {"mixed": [r.choice(["user", "user", "assistant", "system"]) for _ in range(n)],
              "users": ["user"] * n, "alternating": ["user", "assistant"] * (n // 2),
              "late": ["user"] * (n - 1) + ["assistant"], "odd": (["user"] * 3 + ["assistant"]) * (n // 4 + 1)}
    rows = [(name, t, role, f"{name}-{t}") for name, roles in shapes.items() for t, role in enumerate(roles)]
    df = spark.createDataFrame(rows, "c STRING, turn INT, role STRING, content STRING")
    want = {name: py_greedy([(f"{name}-{t}", role) for t, role in enumerate(roles)]) for name, roles in shapes.items()}
    for block in (1, 2, 7, 64):
        got = {}
        for x in greedy_pairs_long(df, ["c"], block=block).orderBy("c", "pos").collect():
            assert x["pos"] == len(got.setdefault(x["c"], []))
            got[x["c"]].append((x["texte_cible"], x["traduction"]))
        assert got == want, block
    arrays = df.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("turn", "content", "role"))).alias("m"))
    for x in arrays.select("c", C.greedy_pairs("m").alias("p")).collect():
        assert [(y["texte_cible"], y["traduction"]) for y in x["p"]] == want[x["c"]]


def test_message_count_against_plain_json(spark, sf_small):
    """K1: the message count of the JSON text equals Python's json module
    (NULL and broken texts count 0)."""
    import json
    r = A.raw_mix(spark, sf_small).select(C.messages_json("messages").alias("j"))
    r = r.unionByName(spark.createDataFrame([(None,), ("{broken",), ("[]",)], "j string"))

    def plain(t):
        try:
            return len(json.loads(t)) if t else 0
        except json.JSONDecodeError:
            return 0
    for x in r.select("j", C.message_count_json("j").alias("n")).collect():
        assert x["n"] == plain(x["j"])
