"""Ranked lexical search by shared accumulators (common-subexpression evaluation).

An item's score for a document is a sum over its terms, so items that share a
set of terms share the sum over that set. The items are taken in blocks of
bounded size; per block

1. Terms that occur in exactly the same items are one node (a repeated term is
   taken apart into layers, so that repeats are ordinary members). Then the two
   items with the largest common set of nodes give a new node, which replaces
   the set in every item that holds it, until no two items share two nodes.
   The result is an acyclic graph: terms, shared sets, items.
2. One pass over the documents writes, per document, its length and the counts
   of the block's terms, and counts the documents per term.
3. A second pass over these counts evaluates the graph for many documents at a
   time: every node's partial accumulators are computed once (a numpy row over
   the documents) and added up wherever an edge leads. Each task keeps the
   ``k`` best documents of an item; a window ranks them.

What is sent to the tasks is one block's terms and graph: at most
``BLOCK_ITEMS`` items and ``BLOCK_TERMS`` term occurrences (an item with more
makes a block of its own).

Defined results: a NULL or empty text has no terms; documents with a NULL id
count in the statistics and are not listed; every document row is ranked,
repeated ids too; ties go to the smaller id (equal ids: as rows come); items
with a NULL id take no part; of items that share an id the smallest text
counts; an item without a scoring document has no rows; empty tables give an
empty result; other columns are ignored. All scores are 64-bit integers.
"""

from __future__ import annotations

import math
from itertools import count as naturals
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paraspark.llm.common import checkpointed, map_arrow, per_group, table
from paraspark.operators.ranking import with_row_index
from paraspark.plans.registry import register

K = 20
BLOCK_ITEMS, BLOCK_TERMS = 512, 200_000
#: Partial statistics added up by one task.
MERGE = 64
#: Accumulators held at once by a task (64-bit cells).
CELLS = 2_000_000
# FIXED VALUES of the contract.
SCALE, TF_SCALE, TF_UNIT, LENGTH_UNIT, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 12, 25

#: ASCII letters lower-cased, digits and bytes above 127 kept, all else blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


class Graph(NamedTuple):
    """``node_terms[n]``: term numbers under a leaf node; ``parts[i]``: nodes
    that make up the later node ``len(node_terms) + i``; ``item_nodes[j]``: the
    nodes that make up item ``j``."""
    node_terms: list[np.ndarray]
    parts: list[np.ndarray]
    item_nodes: list[np.ndarray]

    @property
    def edges(self) -> int:
        return sum(map(len, self.node_terms)) + sum(map(len, self.parts)) + sum(map(len, self.item_nodes))


def share(items: list[dict[int, int]]) -> Graph:
    """The graph of ``items`` (term number -> occurrences)."""
    layers: dict[tuple[int, int], list[int]] = {}
    for j, terms in enumerate(items):
        for t, n in terms.items():
            for layer in range(n):
                layers.setdefault((t, layer), []).append(j)
    alike: dict[tuple[int, ...], list[int]] = {}
    for (t, _), held in layers.items():
        alike.setdefault(tuple(held), []).append(t)
    node_terms = [np.array(terms) for terms in alike.values()]
    holds = np.zeros((len(items), 2 * len(node_terms) + len(items) + 1), np.float32)
    for n, held in enumerate(alike):
        holds[list(held), n] = 1

    parts: list[np.ndarray] = []
    common = holds @ holds.T
    np.fill_diagonal(common, 0)
    for n in naturals(len(node_terms)):
        if not len(items) or common.max() < 2:
            break
        if n == holds.shape[1]:
            holds = np.hstack([holds, np.zeros_like(holds)])
        a, b = divmod(int(common.argmax()), len(items))
        both = np.flatnonzero(holds[a] * holds[b])
        owners = np.flatnonzero(holds[:, both].all(axis=1))
        parts.append(both)
        holds[np.ix_(owners, both)] = 0
        holds[owners, n] = 1
        common[owners] = holds[owners] @ holds.T
        common[:, owners] = common[owners].T
        common[owners, owners] = 0
    return Graph(node_terms, parts, [np.flatnonzero(row) for row in holds])


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``block, item_id, text``: items of a block are neighbours in the order
    of their least hashed words, so that items with common words meet."""
    one = (items.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("item_id"))
           .agg(F.min(F.coalesce(F.col(text_col), F.lit(""))).alias("text")))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), 0)
    one = checkpointed(one.withColumn("n", F.greatest(F.size(words), F.lit(1)))
                       .withColumn("near", F.coalesce(F.array_min(F.transform(words, lambda w: F.xxhash64(w))), F.lit(0))))
    # neighbours of the order by number, then cut where their terms are too many
    numbered = with_row_index(one, ["near", "item_id"], "at").withColumn("group", F.floor((F.col("at") - 1) / BLOCK_ITEMS))
    w = Window.partitionBy("group").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.floor(F.coalesce(F.sum("n").over(w), F.lit(0)) / BLOCK_TERMS)
    return numbered.select("item_id", "text", F.struct("group", cut.alias("cut")).alias("block"))


def _counts(batches, number: dict[bytes, int]):
    """``doc_id, n, terms, tfs`` per document, the block's terms only (numbers
    as bytes), and at the end one row with the documents and terms seen."""
    df = np.zeros(len(number), np.int64)
    docs = length = 0
    for b in batches:
        out_n, out_t, out_f = [], [], []
        for text in b.column(1):
            words = terms_of(text.as_py())
            n = len(words)
            docs += n > 0
            length += n
            hit = [t for t in map(number.get, words) if t is not None]
            t, f = np.unique(np.array(hit, np.int32), return_counts=True)
            df[t] += 1
            out_n.append(n)
            out_t.append(t.astype(np.int32).tobytes())
            out_f.append(f.astype(np.int32).tobytes())
        yield _count_rows([False] * len(b), b.column(0), out_n, out_t, out_f)
    seen = np.flatnonzero(df)
    yield _count_rows([True], pa.array([docs], pa.int64()), [length], [seen.astype(np.int32).tobytes()], [df[seen].tobytes()])


def _count_rows(stats, ids, n, terms, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(stats, pa.bool_()), ids, pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                                      names=["stats", "doc_id", "n", "terms", "counts"])


def _sum_stats(rows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and documents per term: the
    tasks' partial rows are added up, ``MERGE`` at a time, on the executors."""
    def add(batches):
        docs = length = 0
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            for d, n, t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                docs, length = docs + d, length + n
                np.add.at(df, np.frombuffer(t, np.int32), np.frombuffer(c, np.int64))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([length]), pa.array([seen.astype(np.int32).tobytes()], pa.binary()),
                                          pa.array([df[seen].tobytes()], pa.binary())], names=["doc_id", "n", "terms", "counts"])
    schema = "doc_id LONG, n LONG, terms BINARY, counts BINARY"
    part = rows.filter("stats").select("doc_id", "n", "terms", "counts")
    left = part.count()
    while left > 1:
        left = -(-left // MERGE)
        part = checkpointed(map_arrow(part.repartition(left), add, schema))
    docs = length = 0
    df = np.zeros(n_terms, np.int64)
    for r in part.collect():  # one row of one block's terms
        docs, length = docs + r.doc_id, length + r.n
        df[np.frombuffer(r.terms, np.int32)] += np.frombuffer(r.counts, np.int64)
    return docs, length, df


class Best:
    """The ``k`` best documents per item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)
        self.item = self.doc = self.score = np.empty(0, np.int64)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: items x documents."""
        i, d = np.nonzero(scores >= self.least[:, None])
        if not len(i):
            return
        item, doc, score = np.concatenate([self.item, i]), np.concatenate([self.doc, docs[d]]), np.concatenate([self.score, scores[i, d]])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        top = rank < self.k
        self.item, self.doc, self.score = item[top], doc[top], score[top]
        full = rank == self.k - 1
        self.least[item[full]] = score[full]


def evaluate(graph: Graph, contributions: np.ndarray) -> np.ndarray:
    """Items x documents from terms x documents; each node is summed once."""
    n_leaf = len(graph.node_terms)
    acc = np.empty((n_leaf + len(graph.parts), contributions.shape[1]), np.int64)
    for n, terms in enumerate(graph.node_terms):
        np.sum(contributions[terms], axis=0, out=acc[n])
    for i, nodes in enumerate(graph.parts):
        np.sum(acc[nodes], axis=0, out=acc[n_leaf + i])
    out = np.zeros((len(graph.item_nodes), contributions.shape[1]), np.int64)
    for j, nodes in enumerate(graph.item_nodes):
        np.sum(acc[nodes], axis=0, out=out[j])
    return out


def _rank(batches, sent, k: int):
    graph, weight, item_ids, docs_n, length = sent.value
    size = max(1, CELLS // (len(weight) + len(graph.node_terms) + len(graph.parts) + len(item_ids)))
    best = Best(len(item_ids), k)
    for b in batches:
        ids, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        terms, counts = b.column(2).to_pylist(), b.column(3).to_pylist()
        for at in range(0, len(ids), size):
            t, tf = (np.frombuffer(b"".join(x[at:at + size]), np.int32) for x in (terms, counts))
            some = ids[at:at + size]
            doc = np.repeat(np.arange(len(some)), [len(x) // 4 for x in terms[at:at + size]])
            m = 100 - LENGTH_SHARE + LENGTH_SHARE * n[at:at + size] * docs_n // length
            tf = tf.astype(np.int64)
            parts = np.zeros((len(weight), len(some)), np.int64)
            parts[t, doc] = weight[t] * (TF_SCALE * tf // (TF_UNIT * tf + LENGTH_UNIT * m[doc]))
            best.add(some, evaluate(graph, parts))
    yield pa.RecordBatch.from_arrays([pa.array(item_ids[best.item]), pa.array(best.doc), pa.array(best.score)], names=["item_id", "doc_id", "score"])


def _plan(key, pdf):
    """The vocabulary and the graph of one block, as one row."""
    import pickle

    import pandas as pd
    pdf = pdf.sort_values("item_id")
    number: dict[bytes, int] = {}
    items = []
    for text in pdf.text:
        terms: dict[int, int] = {}
        for w in terms_of(text):
            t = number.setdefault(w, len(number))
            terms[t] = terms.get(t, 0) + 1
        items.append(terms)
    return pd.DataFrame({"plan": [pickle.dumps((list(number), share(items), pdf.item_id.to_numpy(np.int64)))]})


def top_documents(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents per item."""
    import pickle
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for plan in per_group(item_blocks(items, item_col, item_text), ["block"], _plan, "plan BINARY").toLocalIterator():  # block by block
        words, graph, item_ids = pickle.loads(plan.plan)
        if not words:
            continue
        best = _search_block(spark, rows, {w: i for i, w in enumerate(words)}, graph, item_ids, k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item_id LONG, doc_id LONG, score LONG")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def _search_block(spark, rows: DataFrame, number: dict[bytes, int], graph: Graph, item_ids: np.ndarray, k: int) -> DataFrame:
    vocabulary = spark.sparkContext.broadcast(number)
    counted = checkpointed(map_arrow(rows, lambda batches: _counts(batches, vocabulary.value),
                                     "stats BOOLEAN, doc_id LONG, n LONG, terms BINARY, counts BINARY"))
    docs_n, length, df = _sum_stats(counted, len(number))
    weight = np.array([math.floor(SCALE * math.log((2 * docs_n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    sent = spark.sparkContext.broadcast((graph, weight, item_ids, docs_n, max(length, 1)))
    ranked = counted.filter("NOT stats AND doc_id IS NOT NULL AND octet_length(terms) > 0").select("doc_id", "n", "terms", "counts")
    return map_arrow(ranked, lambda batches: _rank(batches, sent, k), "item_id LONG, doc_id LONG, score LONG")


_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@register("op11_shared_accumulators_search", f"""
WITH w AS (SELECT doc_id, unnest({_TERMS.format("text")}) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
f AS (SELECT t, floor({SCALE} * ln((2 * max(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, g GROUP BY t),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
m AS (SELECT doc_id, {100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * nn) // ll AS m FROM n, g),
s AS (SELECT item_id, doc_id, sum(times * f.w * (({TF_SCALE} * tf) // ({TF_UNIT} * tf + {LENGTH_UNIT} * m)))::BIGINT AS score
  FROM q JOIN c USING (t) JOIN f USING (t) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}""")
def op11_shared_accumulators_search(spark, d):
    """The 20 best documents of every benchmark item."""
    return top_documents(table(spark, d, "documents"), table(spark, d, "benchmark"))
