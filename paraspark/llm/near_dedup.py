"""MinHash near-dedup with confirmed links.

1. One pass over the texts turns each document into its set of five-word
   shingles (64-bit hashes), the set's 128-bit key, and the band keys of a
   signature of ``bands * rows`` universal hash minima.
2. Documents with equal sets are one class; its smallest id represents it.
3. Representatives that share a band key belong to one candidate family: each
   is joined to the smallest member of its bucket (one row per member, never
   all pairs) and large-star/small-star gives the families.
4. Families are compared exactly, in chunks of bounded size: estimated by
   signature, confirmed on the full sets; a chunk returns at most one link per
   member and component. A family larger than a chunk is dealt out twice, by
   two independent hashes, so that its main component forms; then every member
   still outside that component visits every chunk of the family.
5. Large-star/small-star over the confirmed links gives the components.

The threshold, the bands and the margin of the estimate belong together in a
``LinkRule``. With 28 bands of 6 rows two documents at the threshold 0.85 share
no band with probability (1 - 0.85^6)^28 = 1.8e-6, with 34 bands of 5 rows two
at 0.80 with (1 - 0.8^5)^34 = 1.4e-6; above the threshold it is smaller.

Defined results: a NULL or empty text, or one of white space only, has no
shingles and is linked with nothing; documents of fewer than five words have
one shingle, the whole sequence; a row with a NULL id gets component NULL and
is kept; rows that share an id are one document (their texts count as linked);
repeated rows get one answer each; an empty table gives an empty result; other
columns are carried by ``keep_representatives`` and ignored otherwise.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.llm.common import checkpointed, fresh, key_table, map_arrow, per_group, table
from paraspark.llm.components import connected_components
from paraspark.plans.registry import register

SHINGLE_WORDS = 5


class LinkRule(NamedTuple):
    """Links need 100 * intersection >= percent * union. A pair whose estimated
    similarity is ``margin`` below that (over five standard deviations of the
    estimate) is not compared exactly."""
    percent: int
    bands: int
    rows: int
    margin: float


#: Similarity 0.85 or more, and 0.80 or more.
LINK_85 = LinkRule(85, 28, 6, 0.15)
LINK_80 = LinkRule(80, 34, 5, 0.17)
#: A chunk holds about this many documents and shingles.
CHUNK_DOCS, CHUNK_SHINGLES = 256, 1_000_000
WORD_CACHE = 500_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> bytes:
        import xxhash
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_digest(word)
        return h


_words = _WordHash()


def forget_words() -> None:
    """Empty the word cache when a task has ended: the worker lives on, and
    other stages need its memory."""
    _words.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and the six ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    w = np.frombuffer(b"".join(map(_words.__getitem__, words)), np.uint64)
    k = min(SHINGLE_WORDS, len(w))
    acc = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        acc = _mix(acc * _STEP + w[j:len(w) - k + 1 + j])
    return np.unique(acc)


@lru_cache(maxsize=None)
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    mul = rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    return mul, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(s: np.ndarray, rule: LinkRule = LINK_85) -> np.ndarray:
    """Minima of multiply-add-shift hashes over the set (in blocks, so that a
    very long text needs no large matrix)."""
    mul, add = _hashes(rule.bands * rule.rows)
    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, (s[i:i + 512, None] * mul + add).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, rule: LinkRule = LINK_85) -> np.ndarray:
    acc = np.arange(1, rule.bands + 1, dtype=np.uint64)
    for j in range(rule.rows):
        acc = _mix(acc * _STEP + sig.reshape(rule.bands, rule.rows)[:, j])
    return acc.view(np.int64)


def profiles(docs: DataFrame, id_col: str, text_col: str, rule: LinkRule = LINK_85) -> DataFrame:
    """``doc_id, n, k1, k2, bands`` of every document."""
    def run(batches):
        import xxhash
        for b in batches:
            n, k1, k2, bands = [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py())
                n.append(len(s))
                key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                k1.append(key[0])
                k2.append(key[1])
                bands.append(band_keys(signature(s, rule), rule) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "k1", "k2", "bands"])
        forget_words()
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run,
                     "doc_id LONG, n LONG, k1 LONG, k2 LONG, bands ARRAY<LONG>")


def shingle_sets(members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rep, family, chunks, shingles`` (packed) of the rows of ``members``
    whose text still has the class key (an id may come with several texts)."""
    def run(batches):
        import xxhash
        for b in batches:
            sets, hit = [], []
            for t, k1, k2 in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                s = shingle_set(t.as_py())
                key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                hit.append(bool(key[0] == k1 and key[1] == k2))
                sets.append(s.tobytes() if hit[-1] else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), b.column(5), pa.array(sets, pa.binary())],
                                             names=["rep", "family", "chunks", "shingles"]).filter(pa.array(hit))
        forget_words()
    return map_arrow(members.select(F.col(id_col).cast("long"), F.col(text_col), "k1", "k2", "family", "chunks"), run,
                     "rep LONG, family LONG, chunks LONG, shingles BINARY")


def link_group(ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, probe: np.ndarray | None = None,
               rule: LinkRule = LINK_85):
    """Links ``(a, b)`` that join the components of one chunk, at most one per
    member and component: a pair inside one component is not compared again.

    ``labels`` are the components known so far. With ``probe`` (a mask) only
    pairs of a probe and a member of the rest are compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flat, dense = np.unique(np.concatenate(sets), return_inverse=True)
    sig = np.stack([signature(s, rule) for s in sets])
    comp = np.unique(labels, return_inverse=True)[1]
    mark = np.zeros(len(flat), bool)
    out = []
    for i in range(len(ids)):
        if probe is not None and not probe[i]:
            continue
        other = np.arange(i) if probe is None else np.flatnonzero(~probe)
        # sizes alone, then the signature, then the full sets
        lo, hi = np.minimum(sizes[other], sizes[i]), np.maximum(sizes[other], sizes[i])
        other = other[(100 * lo >= rule.percent * hi) & (comp[other] != comp[i])]
        if not len(other):
            continue
        est = (sig[other] == sig[i]).mean(axis=1)
        near = est >= rule.percent / 100 - rule.margin
        other = other[near][np.argsort(-est[near], kind="stable")]
        mark[dense[starts[i]:starts[i] + sizes[i]]] = True
        for j in other:
            if comp[j] == comp[i]:
                continue
            common = int(mark[dense[starts[j]:starts[j] + sizes[j]]].sum())
            if 100 * common >= rule.percent * (sizes[i] + sizes[j] - common):
                out.append((ids[i], ids[j]))
                comp[comp == comp[j]] = comp[i]
        mark[dense[starts[i]:starts[i] + sizes[i]]] = False
    return out


def _links(pdf, rule):
    import pandas as pd
    pdf = pdf.sort_values("rep", kind="stable")
    sets = [np.frombuffer(x, np.uint64) for x in pdf.shingles]
    probe = pdf.probe.to_numpy(bool) if pdf.probe.any() else None
    links = link_group(pdf.rep.to_numpy(), sets, pdf.label.to_numpy(), probe, rule)
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _compared(rows: DataFrame, rule: LinkRule, *keys) -> DataFrame:
    return per_group(rows, keys, lambda pdf: _links(pdf, rule), "a LONG, b LONG")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: LinkRule = LINK_85) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``."""
    prof = checkpointed(profiles(docs, id_col, text_col, rule))
    some = prof.filter("n > 0 AND doc_id IS NOT NULL")
    classes = checkpointed(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"),
                                                        F.first("bands").alias("bands")))
    # candidate families: every representative meets the smallest of its bucket
    banded = classes.select("rep", F.explode("bands").alias("band"))
    hubs, _ = key_table(banded.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("far"))
                        .filter("hub < far").select("band", "hub"))
    families = connected_components(banded.join(hubs, "band").filter("rep != hub").select("rep", "hub").distinct(), "rep", "hub")
    fam = checkpointed(classes.select("rep", "n", "k1", "k2")
                       .join(families.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep"))
    sizes, _ = key_table(fam.groupBy("family").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / CHUNK_DOCS, F.sum("n") / CHUNK_SHINGLES)).alias("chunks")))
    members, _ = key_table(fam.join(sizes, "family").select(F.col("rep").alias("m_rep"), "k1", "k2", "family", "chunks"))
    d_id, d_text = "d_id", "d_text"
    rows = docs.select(F.col(id_col).cast("long").alias(d_id), F.col(text_col).alias(d_text))
    sets = checkpointed(shingle_sets(rows.join(members, F.col(d_id) == F.col("m_rep")), d_id, d_text)
                        .withColumn("probe", F.lit(False)))

    def chunked(x: DataFrame, seed: int) -> DataFrame:
        return x.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "rep"), "chunks"))

    own = F.col("rep").alias("label")
    links = checkpointed(_compared(chunked(sets, 1).select("*", own), rule, "family", "chunk"))
    large = sets.filter("chunks > 1")
    # only families beyond one chunk: a second, independent dealing, then the stragglers
    second = checkpointed(_compared(chunked(large, 2).select("*", own), rule, "family", "chunk"))
    links = links.unionByName(second)
    known = connected_components(links, "a", "b")
    if not large.isEmpty():
        links = known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_stragglers(chunked(large, 1), known, rule))
        known = connected_components(links, "a", "b")
    known = known.select(F.col("node").alias("rep"), "component")
    final, _ = key_table(classes.select("k1", "k2", "rep").join(known, "rep", "left")
                         .select("k1", "k2", F.coalesce("component", "rep").alias("class_component"))
                         .groupBy("k1", "k2").agg(F.min("class_component").alias("class_component")))
    comp = F.when(F.col("n") > 0, F.col("class_component")).otherwise(F.col("doc_id"))
    return (prof.select("doc_id", "n", "k1", "k2").join(final, ["k1", "k2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), comp).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _stragglers(large: DataFrame, known: DataFrame, rule: LinkRule) -> DataFrame:
    """Links of the members outside the main component of their family to any
    member of another component: each visits every chunk of the family."""
    lab = known.select(F.col("node").alias("rep"), F.col("component").alias("label"))
    rows = checkpointed(large.join(lab, "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    main, _ = key_table(rows.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
                        .groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main")))
    probes = rows.join(main, "family").filter("label != main")
    batches, _ = key_table(probes.groupBy("family").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / CHUNK_DOCS, F.sum(F.length("shingles")) / (8 * CHUNK_SHINGLES))).alias("batches")))
    probes = probes.join(batches, "family").select(
        "rep", "family", "shingles", "label", F.lit(True).alias("probe"), F.pmod(F.xxhash64(F.lit(3), "rep"), "batches").alias("batch"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    members = rows.join(batches, "family").select(
        "rep", "family", "shingles", "label", F.lit(False).alias("probe"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)).alias("batch"), "chunk")
    return checkpointed(_compared(probes.unionByName(members), rule, "family", "chunk", "batch"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: LinkRule = LINK_85) -> DataFrame:
    """``docs`` with one document of each component (the smallest id)."""
    k = fresh(docs, "gone_id")[0]
    gone, _ = key_table(near_components(docs, id_col, text_col, rule).filter("NOT kept").select(F.col("doc_id").alias(k)).distinct())
    return docs.join(gone, F.col(id_col) == F.col(k), "left_anti")


@register("op10_minhash_near_dedup")
def op10_minhash_near_dedup(spark, d):
    """Every document with its near-duplicate component."""
    return near_components(table(spark, d, "documents"))
