"""Secret scans with one combined deterministic automaton.

A rule is a head expression followed by a run of body characters; a match is
kept when the run has at least ``least`` of them. All rules are compiled into
one minimal automaton whose transition array scans each text once, byte by
byte: the texts of a batch advance side by side as numpy lanes, and the few
that are longer than the rest end in a plain loop. The pass tells which rules can have a match in which text. Only there the exact
spans follow: the reversed expression marks every byte where a match starts,
and from the leftmost start not inside an earlier match the longest match is
taken (per rule, non-overlapping; a match of too short a run takes its bytes
and is then dropped).

Everything runs in the scan's tasks: no shuffle, nothing on the driver, memory
of a few arrays per Arrow batch.

Defined results: a NULL or empty text has no secrets; rows with NULL or
repeated ids get one answer each; an empty table gives an empty result; other
columns are ignored. Spans count code points, the end is exclusive; equal
starts are ordered by the rules' order.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraspark.llm.automaton import Automaton, compile_automaton, parse, reverse
from paraspark.llm.common import map_arrow, table
from paraspark.plans.registry import register


class Rule(NamedTuple):
    """``head`` must not be able to go on with a body character after its end
    (its longest match then ends where the body starts)."""
    kind: str
    head: str
    body: str
    least: int
    any_case: bool = False


# FIXED VALUES of the contract: the base rules.
BASE_RULES = (
    Rule("assign", """(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
# Parameters: published key formats beyond the contract's.
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]", 16),
    Rule("jwt", "eyJ", "[A-Za-z0-9_.-]", 40),
    Rule("private_key", "-----BEGIN ((RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY----", "-", 1),
)
RULES = BASE_RULES + MORE_RULES

#: Fewer texts than this still unread side by side: each is finished by itself.
MIN_LANES = 128


class _Exact(NamedTuple):
    starts: Automaton
    match: Automaton
    head: Automaton
    body: frozenset
    least: int


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        heads = [parse(r.head, r.any_case) for r in rules]
        bodies = [parse(r.body) for r in rules]
        # Only whether a rule matches is asked here, so the run need not go on beyond its
        # least length; and where a head announces the rule, one body character is enough
        # (a head may recur inside a counted run: there is a state for every set of open counts).
        least = [1 if r.head else r.least for r in rules]
        self.gate = compile_automaton([("cat", [h, ("rep", b, n, n)]) for n, h, b in zip(least, heads, bodies)], anywhere=True)
        self.gate_list = self.gate.table.tolist()
        self.exact = []
        for r, h, b in zip(rules, heads, bodies):
            whole = ("cat", [h, ("rep", b, 1, None)])
            chars = frozenset(x for x in range(256) if b[1][0][1] >> x & 1)
            autos = [a._replace(table=a.table.tolist()) for a in (compile_automaton([reverse(whole)], anywhere=True),
                                                                 compile_automaton([whole]), compile_automaton([h]))]
            self.exact.append(_Exact(*autos, chars, r.least))

    def possible(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per text the rules (bits) that the combined automaton accepts in it."""
        g = self.gate
        order = np.argsort(-lengths, kind="stable")
        at, shorter = starts[order].copy(), -lengths[order]
        state = np.full(len(order), g.start, np.int32)
        found = np.zeros(len(order), np.int64)
        j = 0
        while True:
            live = int(np.searchsorted(shorter, -j))
            if live < MIN_LANES:
                break
            s = g.table[state[:live] + data[at[:live]]]
            state[:live] = s
            at[:live] += 1
            hot = np.flatnonzero(s >= g.floor)
            if len(hot):
                found[hot] |= g.accepts[s[hot] >> 8]
            j += 1
        step, floor, accepts = self.gate_list, g.floor, g.accepts.tolist()
        for i in range(live):
            s, bits = int(state[i]), int(found[i])
            for byte in data[at[i]:at[i] - shorter[i] - j].tobytes():
                s = step[s + byte]
                if s >= floor:
                    bits |= accepts[s >> 8]
            found[i] = bits
        out = np.empty_like(found)
        out[order] = found
        return out

    def spans(self, text: bytes, rule: int) -> list[tuple[int, int]]:
        """Byte spans of the rule's matches that are long enough."""
        x = self.exact[rule]
        step, s, floor = x.starts.table, x.starts.start, x.starts.floor
        begins = []
        for p in range(len(text) - 1, -1, -1):
            s = step[s + text[p]]
            if s >= floor:
                begins.append(p)
        out, free = [], 0
        for p in reversed(begins):
            if p < free:
                continue
            free = _longest(x.match, text, p)
            # the body starts where the head's longest match before a body character ends
            body = max(e for e in _ends(x.head, text, p, free) if text[e] in x.body)
            if free - body >= x.least:
                out.append((p, free))
        return out


def _ends(a: Automaton, text: bytes, at: int, limit: int):
    """Ends below ``limit`` of the accepted words that start at ``at``."""
    s = a.start
    while at < limit:
        if s >= a.floor:
            yield at
        s = a.table[s + text[at]]
        if s == a.dead:
            return
        at += 1


def _longest(a: Automaton, text: bytes, at: int) -> int:
    step, s, dead, floor, end = a.table, a.start, a.dead, a.floor, -1
    for i in range(at, len(text)):
        s = step[s + text[i]]
        if s == dead:
            break
        if s >= floor:
            end = i + 1
    return end


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _points(text: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    if text.isascii():
        return {o: o for o in offsets}
    upto = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return {o: int(upto[o]) for o in offsets}


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rule", pa.int32()), ("kind", pa.string())]))
SPANS_DDL = "ARRAY<STRUCT<start: LONG, end: LONG, rule: INT, kind: STRING>>"


def scan_batch(sc: Scanner, texts: pa.Array) -> list[list[dict]]:
    """Spans of every text, ordered by start, then rule."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    out: list[list[dict]] = [[] for _ in range(len(raw))]
    if not len(raw):
        return out
    bits = sc.possible(data, offsets[:-1], np.diff(offsets))
    for i in np.flatnonzero(bits).tolist():
        text = data[offsets[i]:offsets[i + 1]].tobytes()
        hits = sorted((a, r, b) for r in range(len(sc.rules)) if bits[i] >> r & 1 for a, b in sc.spans(text, r))
        place = _points(text, [o for a, _, b in hits for o in (a, b)])
        out[i] = [{"start": place[a], "end": place[b], "rule": r, "kind": sc.rules[r].kind} for a, r, b in hits]
    return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
                 with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, spans`` and, with ``with_text``, the
    text as it was."""
    rules = tuple(rules)

    def run(batches):
        sc = scanner(rules)
        for b in batches:
            spans = pa.array(scan_batch(sc, b.column(1)), SPANS)
            yield pa.RecordBatch.from_arrays([b.column(0), spans, *b.columns[1:1 + with_text]], names=["doc_id", "spans", "text"][:2 + with_text])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id LONG, spans {SPANS_DDL}" + (", text STRING" if with_text else ""))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span's characters replaced by ``[kind]``; where
    spans overlap, the first one names the gap."""
    done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                                                 F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at")))
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with the secrets replaced."""
    found = find_secrets(docs, rules, id_col, text_col, with_text=True)
    return found.select("doc_id", F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("text"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _oracle() -> str:
    """Positions are the summed lengths of what precedes: pieces between the
    matches and the matches themselves."""
    def rule_sql(i, r):
        head = "".join(f"[{c.upper()}{c}]" if r.any_case and c.isalpha() and k != r.head.find("\\x") + 1 else c for k, c in enumerate(r.head.replace("\\x20", " ")))
        p = f"({head})({r.body}+)".replace("'", "''")
        groups = 2 + r.head.count("(")
        return (f"SELECT doc_id, {i} AS rule, '{r.kind}' AS kind, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps, "
                f"list_transform(regexp_extract_all(t, '{p}', {groups}), lambda b: len(b) >= {r.least}) AS ok FROM d WHERE regexp_matches(t, '{p}')")
    each = " UNION ALL ".join(rule_sql(i, r) for i, r in enumerate(RULES))
    n_base = len(BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
u AS (SELECT doc_id, rule, kind, ms, ps, ok, unnest(generate_series(1, len(ms))) AS i FROM m),
s AS (SELECT doc_id, rule, kind, list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS a, len(ms[i]) AS n
  FROM u WHERE ok[i]),
k AS (SELECT *, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS span FROM s),
g AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY a, rule) FILTER (rule < {n_base}) AS base, string_agg(span, ',' ORDER BY a, rule) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


@register("op12_combined_automaton_secrets", _oracle())
def op12_combined_automaton_secrets(spark, d):
    """Secrets of every document."""
    found = find_secrets(table(spark, d, "documents"))
    base = F.filter("spans", lambda s: s["rule"] < len(BASE_RULES))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
