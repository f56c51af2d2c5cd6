"""Rows whose integer key is in a set, without shuffling the rows.

The set is a bitmap of 4 KB for every 32,768 consecutive keys that it touches,
broadcast up to ``BROADCAST_BITMAPS`` of them (80 MB); a set that is spread over
more is joined as it is, which shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraspark.session import ensure_checkpoint_dir

#: Keys of a bitmap (fixed by ``bitmap_construct_agg``), and bitmaps that are broadcast at most.
BITS, BROADCAST_BITMAPS = 32_768, 20_000


def rows_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` left semi join ``wanted`` by ``key`` (an integer column of both)."""
    def group(c: str) -> Column:
        return F.shiftright(F.col(c).cast("long"), 15)
    ensure_checkpoint_dir(rows.sparkSession)
    if wanted.select(group(key).alias("g")).distinct().limit(BROADCAST_BITMAPS + 1).count() > BROADCAST_BITMAPS:
        return rows.join(wanted, key, "left_semi")
    at = F.pmod(F.col(key).cast("long"), F.lit(BITS))
    maps = wanted.groupBy(group(key).alias("_group")).agg(F.bitmap_construct_agg(at).alias("_bits")).checkpoint(eager=True)
    byte = F.conv(F.hex(F.substr(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("_group", group(key)).join(F.broadcast(maps), "_group")
            .filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns))
