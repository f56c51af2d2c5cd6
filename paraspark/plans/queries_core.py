"""Registered queries, part 1: the chat -> pairs pipeline."""

from __future__ import annotations

from paraspark.plans import adapters as A
from paraspark.plans import pipelines as P
from paraspark.plans import sqltext as Q
from paraspark.plans.registry import register


@register("flagship_pairs_per_language_pair", Q.FLAGSHIP)
def flagship(spark, d):
    return P.report(P.flat_pairs_long(A.sample_turns(spark, d)))
