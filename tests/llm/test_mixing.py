import random

import duckdb

from paraspark.llm import mixing as M
from tests.llm.helpers import canon, docs


def fill(budget, caps, weights):
    """Plain water filling: cap whoever cannot use its share, share out again."""
    open_, share = set(caps), {}
    while open_:
        w = sum(weights[k] for k in open_)
        left = budget - sum(share.values())
        full = [k for k in open_ if caps[k] * w <= left * weights[k]]
        if not full:
            for k in open_:
                share[k] = left * weights[k] // w
            break
        k = min(full, key=lambda k: caps[k] / weights[k])
        share[k] = caps[k]
        open_.remove(k)
    return share


def test_share_out_against_plain_filling(spark):
    r = random.Random(5)
    for trial in range(4):
        caps = {f"c{i}": r.choice([0, 5, r.randrange(1, 2000)]) for i in range(6)}
        budget = r.randrange(0, sum(caps.values()) + 1)
        weights = {"c0": 5, "c1": 2}
        df = spark.createDataFrame([(k, c, budget) for k, c in caps.items()], "lang STRING, cap LONG, budget LONG")
        got = {x.lang: x.share for x in M.share_out(df, [], "lang", {"lang": weights}).collect()}
        assert got == fill(budget, caps, {k: weights.get(k, 1) for k in caps})


ROWS = [(i, " ".join(["w"] * (1 + i % 7)), ["en", "fr", None, "de"][i % 4], [f"src{i % 3}", "src5", "src8", None, "x"][i % 5]) for i in range(120)] + [
    (500, None, "en", "src1"), (501, "", "fr", "src8"), (502, "  ", "zz", "zero"), (503, "w " * 5000, "en", "src0"), (None, "no id here", "en", "src1")]


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    rel = con.sql(M.OP8_SQL)
    return canon(list(rel.columns), rel.fetchall())


def test_edge_cases_against_sql(spark):
    df = M.mix(docs(spark, ROWS, extra=True)).withColumnRenamed("id", "doc_id").withColumn("kept", M.F.col("copies") > 0)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == oracle(ROWS)


def test_leaf_budgets_are_met(spark):
    rows = [(i, "w " * (1 + i % 50), "en" if i % 3 else "fr", f"src{i % 10}") for i in range(3000)]
    d = docs(spark, rows)
    tree = {(r.domain, r.lang, r.source): r for r in M.budget_tree(M._rows(d, "doc_id", "text")).collect()}
    taken = {}
    for r in M.mix(d).collect():
        k = (r.domain, r.lang, r.source)
        taken[k] = taken.get(k, 0) + r.tokens * r.copies
    for k, r in tree.items():
        assert r.share <= taken[k] < r.share + 50  # over by less than the last document
    total = sum(1 + i % 50 for i in range(3000))
    assert abs(sum(r.share for r in tree.values()) - total * M.BUDGET_PERMILLE // 1000) < 100


def test_mixed_repeats_rows_as_often(spark):
    d = docs(spark, ROWS + [(7, "w", "en", "src1")], extra=True)
    copies = {}
    for r in M.mix(d).collect():
        copies[r.id] = copies.get(r.id, 0) + r.copies
    out = M.mixed(d)
    assert out.columns == d.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in copies.items() if v}


def test_empty(spark):
    assert M.mix(docs(spark, [])).count() == 0 and M.mixed(docs(spark, [])).count() == 0


def test_token_count(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, " a\n\x0bb  c "), (5, "é\xa0x")]
    got = {r.doc_id: r.n for r in docs(spark, rows).select("doc_id", M.token_count().alias("n")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 3, 5: 1}
