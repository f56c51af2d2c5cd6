"""Hard negatives by segment summary filtering.

For every anchor the best rows of its own label are its positives; a hard
negative of a positive is a row of another label whose score lies in a band
under the positive's score. Scores are inner products of whole numbers.

The bounds, the blocks and the streaming of candidates are those of
``segments``. Anchors are dealt into blocks by label, and for the positives a
candidate goes only to the blocks of its own label; for the negatives an anchor
has one band per positive. No task holds more than one block of anchors and one
chunk of candidates, whatever the sizes of labels.

Defined results: rows with a NULL id or label, or a vector that is NULL, empty
or holds a NULL or non-finite component, take no part; vectors of different
lengths never meet; a row is no partner of its own id; every row counts as a
candidate, repeated rows too; of anchors that share an id the smallest (label,
vector) is the anchor; ties go to the smaller id; fewer rows than asked for are
all returned; a negative positive score has an empty band; an empty table gives
an empty result; other columns are ignored. Scores are 64-bit integers, exact
while the sum of products stays below 2^63.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraspark.llm import segments as SG
from paraspark.llm.common import checkpointed, key_table, table
from paraspark.plans.registry import register

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES = NEGATIVES = 5
#: A negative scores from LOW to HIGH percent of the positive.
LOW, HIGH = 80, 100

def mine(rows: DataFrame, is_anchor, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` for the rows whose id ``is_anchor`` selects."""
    spark = rows.sparkSession
    vecs = SG.vectors(rows, id_col, vec_col, label, scale)
    one = (vecs.filter(is_anchor(F.col("vec_id"))).groupBy("vec_id")
           .agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", F.size("x.v").alias("dim"), "x.v"))
    one = checkpointed(one)

    # a label's anchors lie in as many neighbouring blocks as they fill, from a hashed one on
    counts = one.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"))
    dims = checkpointed(counts.groupBy("dim").agg(F.ceil(F.sum("n") / SG.ANCHOR_BLOCK).cast("int").alias("n_blocks")))
    spread = counts.join(dims, "dim").select("dim", "label", "n_blocks", F.pmod(F.xxhash64("label"), "n_blocks").cast("int").alias("first"),
                                             F.ceil(F.col("n") / SG.ANCHOR_BLOCK).cast("int").alias("width"))
    spread, _ = key_table(spread)
    dims, _ = key_table(dims)
    blocks = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.pmod(F.col("first") + i, F.col("n_blocks")))
    one = one.join(spread, ["dim", "label"]).select("vec_id", "label", "dim", "v", F.get(blocks, F.pmod(F.xxhash64("vec_id"), "width").cast("int")).alias("block"))

    n = vecs.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = SG.slices_of(n, tasks)
    own = vecs.join(spread, ["dim", "label"]).select("vec_id", "label", "dim", "v", F.array_distinct(blocks).alias("blocks"))
    found = SG.dealt(one.withColumn("bounds", F.array(F.lit(-SG.FAR), F.lit(SG.FAR))), own, positives, True, slices, tasks)
    best = checkpointed(SG.best(found, positives).select("anchor_id", F.col("rank").alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # the band of each positive in whole numbers: low * p <= 100 * score <= high * p
    p = F.col("positive_score").cast("decimal(20,0)")  # room for the percentages
    bounds = F.array(F.ceil(p * low / 100).cast("long"), F.floor(p * high / 100).cast("long"))
    bands = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("band", bounds.alias("b")))).alias("bs"))
    none = F.array_repeat(F.array(F.lit(SG.FAR), F.lit(-SG.FAR)), positives)
    bands = bands.select("vec_id", F.flatten(F.slice(F.concat(F.transform("bs", lambda x: x["b"]), none), 1, positives)).alias("bounds"))
    every = vecs.join(dims, "dim").select("vec_id", "label", "dim", "v", F.sequence(F.lit(0), F.col("n_blocks") - 1).alias("blocks"))
    found = SG.dealt(one.join(bands, "vec_id"), every, negatives, False, slices, tasks)
    hard = SG.best(found, negatives).select("anchor_id", (F.col("band") + 1).alias("band"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(best, ["anchor_id", "band"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@register("op13_segment_summary_hard_negatives", f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}""")
def op13_segment_summary_hard_negatives(spark, d):
    """The hard negatives of every hundredth vector; some labels are moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, d, "embeddings"), lambda i: i % ANCHOR_EVERY == 0, label)
