"""Loads: a table folder that grows by whole loads a reader sees at once.

A load is written under its own folder ``load=<id>`` through Spark's commit
protocol and becomes visible by one small file, ``_published/<id>``, created
last. ``read_loads`` reads the published folders and no others, so a reader
sees all of a load or none of it, whatever happens to the job that writes it;
a load written again under its id before it is published replaces what the
failed attempt left. ``compact`` publishes one load in the place of many.

A plain scan of the folder still works (it also sees unpublished loads); the
folder columns given as ``partition_by`` prune as in any partitioned table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paraspark import schemas as S

LOAD = "load"


def _marks(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path, "_published")
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_published(spark: SparkSession, path: str, load_id: str) -> bool:
    folder, fs = _marks(spark, path)
    return fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, load_id))


def published(spark: SparkSession, path: str) -> list[str]:
    """Ids of the visible loads (names only; one per load since the last compaction)."""
    folder, fs = _marks(spark, path)
    if not fs.exists(folder):
        return []
    names = [str(f.getPath().getName()) for f in fs.listStatus(folder)]
    ids = {n for n in names if n[0] not in "._"}
    for n in names:
        if n.startswith("compact-"):
            stream = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, n))
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            ids -= set(json.loads(text))
    return sorted(ids)


def publish(spark: SparkSession, path: str, load_id: str, replaces: list[str] = ()) -> None:
    """Make a written load visible: one rename, which a reader sees or not."""
    folder, fs = _marks(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(folder)
    draft = hadoop(folder, f"_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(list(replaces)).encode()))
    out.close()
    if not fs.rename(draft, hadoop(folder, load_id)):
        raise FileExistsError(f"load {load_id} is already published")


def write_load(df: DataFrame, path: str, load_id: str, partition_by: list[str] | None = None) -> None:
    """Write a load, not visible yet. Blank folder values are stored under a
    mark that ``read_loads`` undoes."""
    for c in partition_by or []:
        if dict(df.dtypes)[c] == "string":
            df = df.withColumn(c, F.when(F.col(c) == "", S.BLANK_FOLDER).otherwise(F.col(c)))
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{path}/{LOAD}={load_id}")


def bulk_load(df: DataFrame, path: str, partition_by: list[str] | None = None, load_id: str | None = None) -> str:
    """All rows become visible at once, or none. Returns the load's id; a
    load whose id is published already is not written again."""
    load_id = load_id or uuid.uuid4().hex
    if not is_published(df.sparkSession, path, load_id):
        write_load(df, path, load_id, partition_by)
        publish(df.sparkSession, path, load_id)
    return load_id


def read_loads(spark: SparkSession, path: str, schema: StructType | str, partition_by: list[str] | None = None,
               ids: list[str] | None = None) -> DataFrame:
    """The rows of the published loads (or of ``ids``), columns as in ``schema``."""
    want = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = [f.name for f in want.fields]
    ids = published(spark, path) if ids is None else ids
    if ids:
        df = spark.read.schema(StructType(list(want.fields)).add(LOAD, "string")).option("basePath", path).parquet(*[f"{path}/{LOAD}={i}" for i in ids])
    else:
        df = spark.createDataFrame([], StructType(list(want.fields)).add(LOAD, "string"))
    for f in want.fields:
        if f.name in (partition_by or []) and f.dataType.typeName() == "string":
            df = df.withColumn(f.name, F.when(F.col(f.name) == S.BLANK_FOLDER, "").otherwise(F.col(f.name)))
    return df.select(*names)


def compact(spark: SparkSession, path: str, schema: StructType | str, partition_by: list[str] | None = None) -> str | None:
    """One published load in the place of all: fewer and larger files. The
    replaced folders stay for readers that have begun; ``vacuum`` drops them."""
    ids = published(spark, path)
    if len(ids) < 2:
        return None
    load_id = f"compact-{uuid.uuid4().hex}"
    rows = read_loads(spark, path, schema, partition_by, ids)
    write_load(rows.hint("rebalance", *(partition_by or [])), path, load_id, partition_by)
    publish(spark, path, load_id, ids)
    return load_id


def replaced(spark: SparkSession, path: str) -> list[str]:
    """Loads that a compaction has taken the place of."""
    folder, fs = _marks(spark, path)
    if not fs.exists(folder):
        return []
    names = [str(f.getPath().getName()) for f in fs.listStatus(folder)]
    return sorted({n for n in names if n[0] not in "._"} - set(published(spark, path)))


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete the folders that a compaction replaced, and their marks (the
    compacted load's own mark keeps naming them; a name without mark is nothing)."""
    folder, fs = _marks(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for n in replaced(spark, path):
        fs.delete(hadoop(path, f"{LOAD}={n}"), True)
        fs.delete(hadoop(folder, n), False)
