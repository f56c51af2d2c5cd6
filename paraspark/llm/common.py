"""Shared helpers of the training-data operators."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.session import ensure_checkpoint_dir

#: White space of the contracts (Java and RE2 syntax alike).
WS = r"[\x20\x09-\x0D]+"
#: Words of the contracts.
WORD = r"[^\x20\x09-\x0D]+"

#: A table of a few short columns is broadcast only up to this many counted
#: rows (tens of MB); beyond it the plain join, which AQE splits when skewed,
#: is used.
BROADCAST_ROWS = 300_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def key_table(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` (one row per key) written once, for a join; and whether it is
    within the broadcast bound (counted), in which case it carries the hint.

    Beyond the bound the join shuffles both sides; since the table is then a
    plain scan, AQE can split a hot key's partition of the other side.
    """
    t = checkpointed(df)
    fits = t.count() <= BROADCAST_ROWS
    return (F.broadcast(t) if fits else t), fits


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df``'s (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package (as ``--py-files`` would), once per
    application: their Python workers import the operators' task code."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".py"))
    digest = hashlib.sha256(b"".join(open(f, "rb").read() for f in files)).hexdigest()[:12]
    path = os.path.join(tempfile.mkdtemp(prefix="paraspark-"), f"paraspark-{digest}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, os.path.relpath(f, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped[sc.applicationId] = path


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped first. When a task has ended,
    its worker, which lives on, gives back the memory of its batches."""
    ship(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


def per_group(df: DataFrame, keys, fn, schema: str) -> DataFrame:
    """``applyInPandas`` by ``keys`` with the package shipped first."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(fn, schema)
