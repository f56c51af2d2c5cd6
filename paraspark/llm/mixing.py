"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a domain - language - source tree. At each node the
children share their parent's budget by weight; a child that cannot use its
share (its tokens times ``max_epochs``) keeps what it can use and the rest
goes to its siblings, again by weight; only what no sibling can use is missing
from the parent, whose own siblings then take it, because a parent's capacity
is the sum of its children's. Each leaf spends its budget on whole epochs and
one partial epoch: the token-prefix of its documents in an order seeded by the
epoch, ending with the document that reaches the limit.

All sums, shares and comparisons are integers, so the result does not depend
on partitioning. Built-in functions only. The prefix of a leaf is found without
bringing the leaf together: token sums per hash byte give the byte in which the
limit falls, the same again inside that byte, and only the documents of that
1/65536 are ordered. Per-leaf tables are joined by a broadcast whose size is
counted, or beyond it by a join that AQE can split.

Defined results: a NULL or empty text has no tokens; documents without tokens
cost nothing and follow their leaf's order (in a leaf without any token each is
taken once); NULL language or source form the leaf ''; rows that repeat in id
and text get the same number of copies; an empty table gives an empty result;
the node names and the budget do not depend on other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraspark.llm.common import WS, checkpointed, fresh, key_table, table, text_or_empty
from paraspark.plans.registry import register

LEVELS = ("domain", "lang", "source")
#: Production parameters of the query and the pipeline: integer weights per
#: node name (1 where not named), budget in thousandths of all tokens, epochs.
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "fr": 2}, "source": {}}
BUDGET_PERMILLE = 900
MAX_EPOCHS = 2
SEED = 17

#: Domain of a source, by the last digit of its name.
DOMAINS = (("web", "01234"), ("books", "567"), ("code", "89"))


def domain_of(source: str = "source") -> Column:
    last = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9])$", 1)
    out = F.lit("other")
    for name, digits in DOMAINS:
        out = F.when(last.isin(*digits), name).otherwise(out)
    return out


def token_count(text: str = "text") -> Column:
    """White-space tokens."""
    t = F.trim(F.regexp_replace(text_or_empty(text), WS, " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out


def share_out(children: DataFrame, parents: list[str], key: str, weights: dict) -> DataFrame:
    """``children`` (``cap``, and ``budget`` of their parent) with ``share``.

    Children sorted by capacity per weight are capped up to the first whose
    weighted part of what is left fits its capacity; the others divide the
    rest by weight (rounded down)."""
    by = [F.col(p) for p in parents] or [F.lit(0)]
    w = Window.partitionBy(*by).orderBy((F.col("cap") / F.col("weight")).asc(), F.col(key).asc())
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    c = (children.withColumn("weight", _weight(key, weights).cast("long"))
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("weight_from", F.sum("weight").over(after))
         .withColumn("capped", F.expr("cap * weight_from <= (budget - cap_before) * weight")))
    group = Window.partitionBy(*by)
    c = (c.withColumn("cap_used", F.sum(F.expr("if(capped, cap, 0)")).over(group))
         .withColumn("weight_left", F.sum(F.expr("if(capped, 0, weight)")).over(group)))
    return c.withColumn("share", F.expr("if(capped, cap, ((budget - cap_used) * weight) div weight_left)")).drop(
        "weight", "cap_before", "weight_from", "capped", "cap_used", "weight_left", "budget")


def budget_tree(rows: DataFrame, weights: dict = WEIGHTS, permille: int = BUDGET_PERMILLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per leaf: ``avail`` tokens, its ``share``, whole ``epochs`` and the
    ``rest`` left for a partial one."""
    leaves = checkpointed(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("avail")))
    leaves = leaves.withColumn("cap", F.col("avail") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("avail"), F.lit(0)).alias("total")).select(
        F.expr(f"least(total * {permille} div 1000, total * {max_epochs})").alias("budget"))
    budget = total.first()[0]  # one number
    up: DataFrame | None = None
    for i, level in enumerate(LEVELS):
        nodes = leaves.groupBy(*LEVELS[:i + 1]).agg(F.sum("cap").alias("cap"), F.sum("avail").alias("avail"))
        if up is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(up.select(*LEVELS[:i], F.col("share").alias("budget")), list(LEVELS[:i]))
        up = share_out(nodes, list(LEVELS[:i]), level, weights)
    return up.select(*LEVELS, "avail", "share",
                     F.expr("if(avail = 0, 1L, share div nullif(avail, 0))").alias("epochs"),
                     F.expr("if(avail = 0, 0L, share % nullif(avail, 0))").alias("rest"))


def seeded_order(id_col: str, digest: str, seed: int) -> Column:
    """Hex position of a document in the epoch ``epochs`` of its leaf."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"),
                             F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(digest)))


def _within(rows: DataFrame, at: int) -> DataFrame:
    """Per leaf: the hash byte at ``at`` in which the limit falls, and the
    tokens before it."""
    b = rows.groupBy(*LEVELS, "rest", "before", F.substring("h", at, 2).alias("byte")).agg(F.sum("tokens").alias("s"))
    w = Window.partitionBy(*LEVELS).orderBy("byte").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("start", F.col("before") + F.coalesce(F.sum("s").over(w), F.lit(0)))
    return b.filter("start < rest AND rest <= start + s").select(*LEVELS, "byte", F.col("start").alias("cut_start"))


def leaf_plan(rows: DataFrame, weights: dict = WEIGHTS, permille: int = BUDGET_PERMILLE, max_epochs: int = MAX_EPOCHS,
              seed: int = SEED) -> DataFrame:
    """Per leaf: whole ``epochs`` and ``last_h``, the position of the last
    document of the partial epoch (NULL: none). ``rows`` needs the levels,
    ``id``, ``digest`` and ``tokens``."""
    plan, _ = key_table(budget_tree(rows, weights, permille, max_epochs))
    keyed = (rows.join(plan.filter("rest > 0"), list(LEVELS))
             .select(*LEVELS, "rest", "tokens", F.lit(0).cast("long").alias("before"), seeded_order("id", "digest", seed).alias("h")))
    for at in (1, 3):
        cut, _ = key_table(_within(keyed, at))
        keyed = (keyed.withColumn("byte", F.substring("h", at, 2)).join(cut, [*LEVELS, "byte"])
                 .withColumn("before", F.col("cut_start")).drop("byte", "cut_start"))
    w = Window.partitionBy(*LEVELS).orderBy("h", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = (keyed.withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(w), F.lit(0)))
            .filter("start < rest").groupBy(*LEVELS).agg(F.max("h").alias("last_h")))
    return plan.join(last, list(LEVELS), "left").select(*LEVELS, "epochs", "last_h")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), domain_of("source").alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
                       F.coalesce("source", F.lit("")).alias("source"), token_count(text_col).alias("tokens"),
                       F.md5(text_or_empty(text_col)).alias("digest"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per document: ``id``, its leaf, ``tokens``, ``copies`` taken."""
    rows = checkpointed(_rows(docs, id_col, text_col))
    plan, _ = key_table(leaf_plan(rows, **params))
    more = F.when(seeded_order("id", "digest", params.get("seed", SEED)) <= F.col("last_h"), 1).otherwise(0)
    return rows.join(plan, list(LEVELS)).select("id", *LEVELS, "tokens", (F.col("epochs") + more).alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` as often as the mixture takes each, same columns."""
    plan, _ = key_table(leaf_plan(checkpointed(_rows(docs, id_col, text_col)), **params))
    names = (*LEVELS, *("p_" + c for c in LEVELS), "digest", "epochs", "last_h", "n")
    m = dict(zip(names, fresh(docs, *("m_" + c for c in names))))
    p = plan.select(*[F.col(c).alias(m["p_" + c]) for c in LEVELS], F.col("epochs").alias(m["epochs"]), F.col("last_h").alias(m["last_h"]))
    d = (docs.withColumn(m["domain"], domain_of("source")).withColumn(m["lang"], F.coalesce("lang", F.lit("")))
         .withColumn(m["source"], F.coalesce("source", F.lit(""))).withColumn(m["digest"], F.md5(text_or_empty(text_col))))
    j = d.join(p, [F.col(m[c]) == F.col(m["p_" + c]) for c in LEVELS])
    h = F.md5(F.concat_ws(":", F.lit(str(params.get("seed", SEED))), F.col(m["epochs"]).cast("string"),
                          F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(m["digest"])))
    copies = F.col(m["epochs"]) + F.when(h <= F.col(m["last_h"]), 1).otherwise(0)
    return (j.withColumn(m["n"], copies).filter(F.col(m["n"]) > 0)
            .withColumn(m["n"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(m["n"])))).select(*docs.columns))


def _fill_sql(name: str, src: str, parents: list[str], key: str) -> str:
    weight = "CASE " + key + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[key].items()) + " ELSE 1 END" if WEIGHTS[key] else "1"
    part = "PARTITION BY " + ", ".join(parents) if parents else ""
    cols = ", ".join([*parents, key])
    return f"""{name}_w AS (SELECT {cols}, cap, avail, budget, {weight} AS weight FROM {src}),
{name}_c AS (SELECT *, cap * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS capped
  FROM {name}_w WINDOW o AS ({part} ORDER BY cap::DOUBLE / weight, {key})),
{name} AS (SELECT {cols}, cap, avail, CASE WHEN capped THEN cap ELSE ((budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER g) * weight)
    // sum(CASE WHEN capped THEN 0 ELSE weight END) OVER g END AS share FROM {name}_c WINDOW g AS ({part}))"""


_DOMAIN_SQL = ("CASE " + " ".join(f"WHEN regexp_matches(coalesce(source, ''), '[{d}]$') THEN '{n}'" for n, d in DOMAINS) + " ELSE 'other' END")
OP8_SQL = rf"""WITH t AS (SELECT doc_id, {_DOMAIN_SQL} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  md5(coalesce(text, '')) AS digest, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS w FROM documents),
b AS (SELECT doc_id, domain, lang, source, digest, CASE WHEN w = '' THEN 0 ELSE length(w) - length(replace(w, ' ', '')) + 1 END AS tokens FROM t),
leaf AS (SELECT domain, lang, source, sum(tokens) AS avail, sum(tokens) * {MAX_EPOCHS} AS cap FROM b GROUP BY ALL),
total AS (SELECT least(sum(avail) * {BUDGET_PERMILLE} // 1000, sum(avail) * {MAX_EPOCHS}) AS budget FROM leaf),
n1 AS (SELECT domain, sum(cap) AS cap, sum(avail) AS avail, any_value(budget) AS budget FROM leaf, total GROUP BY domain),
{_fill_sql("d1", "n1", [], "domain")},
n2 AS (SELECT l.domain, l.lang, sum(l.cap) AS cap, sum(l.avail) AS avail, any_value(d.share) AS budget FROM leaf l JOIN d1 d USING (domain) GROUP BY ALL),
{_fill_sql("d2", "n2", ["domain"], "lang")},
n3 AS (SELECT l.domain, l.lang, l.source, l.cap, l.avail, d.share AS budget FROM leaf l JOIN d2 d USING (domain, lang)),
{_fill_sql("d3", "n3", ["domain", "lang"], "source")},
p AS (SELECT domain, lang, source, CASE WHEN avail = 0 THEN 1 ELSE share // avail END AS epochs,
  CASE WHEN avail = 0 THEN 0 ELSE share % avail END AS rest FROM d3),
h AS (SELECT b.*, epochs, rest, md5(concat_ws(':', '{SEED}', epochs::BIGINT::VARCHAR, coalesce(doc_id::VARCHAR, ''), digest)) AS h
  FROM b JOIN p USING (domain, lang, source)),
r AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, (epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS copies,
  epochs + CASE WHEN before < rest THEN 1 ELSE 0 END > 0 AS kept FROM r"""


@register("op8_hierarchical_mixing", OP8_SQL)
def op8_hierarchical_mixing(spark, d):
    """How often the target mixture takes each document."""
    return mix(table(spark, d, "documents")).withColumnRenamed("id", "doc_id").withColumn("kept", F.col("copies") > 0)
