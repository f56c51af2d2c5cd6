import hashlib
import re

from paraspark.llm.exact_dedup import exact_dedup, keep_first
from tests.llm.helpers import docs

ROWS = [(5, "a  b\tc"), (3, "a b c"), (9, "a b  c"), (4, " a b c"), (7, None), (2, ""), (8, "x" * 300 + "1"), (6, "x" * 300 + "2"),
        (1, "y" * 100_000), (10, "y" * 100_000), (11, "solo"), (11, "solo"), (None, "solo"), (None, "nul"), (12, " "), (13, " ")]


def sha(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def test_groups_and_repeats(spark):
    got = exact_dedup(docs(spark, ROWS, extra=True)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(sha(t), []).append(i)
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (min(known) if known else None) and r.group_size == len(ids)
    kept = [(r.text_sha256, r.id) for r in got if r.kept]
    assert sorted(s for s, _ in kept) == sorted(groups)  # exactly one row of each group
    assert {s: i for s, i in kept}[sha("solo")] == 11


def test_keep_first_keeps_columns_and_one_row_each(spark):
    d = docs(spark, ROWS, extra=True)
    out = keep_first(d)
    assert out.columns == d.columns
    rows = out.collect()
    assert len(rows) == len({sha(t) for _, t in ROWS})
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((i is None, i) for i in [3, 4, 2, 8, 6, 1, 11, None, 12, 13])


def test_empty_table(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
    assert keep_first(docs(spark, [])).count() == 0


def test_without_broadcast_bound(spark, monkeypatch):
    from paraspark.llm import common
    want = sorted(map(str, exact_dedup(docs(spark, ROWS)).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert sorted(map(str, exact_dedup(docs(spark, ROWS)).collect())) == want
