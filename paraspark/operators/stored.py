"""Change sets on a stored table that rewrite only what they touch (G3-G5),
and a point lookup that reads only what it needs (C3).

The table is laid out in folders of ``width`` consecutive keys, sorted by key
inside, so a key names its folder. A change set reads and writes the folders of
its keys alone, by Spark's dynamic partition overwrite; all other files keep
their names and times. The list of touched folders is what reaches the driver
(integers, at most one per folder of the table).

One writer at a time. A folder is replaced when its job commits; folders that a
deletion leaves empty are dropped after that. The key is an integer, unique and
not NULL; blank change sets change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paraspark.operators import table as TB
from paraspark.session import remove_folder

FOLDER = "_range"
#: Keys of a folder.
WIDTH = 1_000_000


def folder_of(key: Column, width: int) -> Column:
    return F.floor(key / F.lit(width)).cast("long")


def write_ranges(df: DataFrame, path: str, key: str = "id", width: int = WIDTH, mode: str = "error", bloom: list[str] = (),
                 row_group_bytes: int | None = None) -> None:
    """Write ``df`` in folders of ``width`` keys, sorted inside (row groups are
    skipped by their least and largest key), with Parquet Bloom filters on the
    columns ``bloom`` (equality filters skip row groups by them)."""
    _write(df.withColumn(FOLDER, folder_of(F.col(key), width)).repartition(FOLDER), path, key, mode, bloom, row_group_bytes)


def _write(rows: DataFrame, path: str, key: str, mode: str, bloom: list[str] = (), row_group_bytes: int | None = None) -> None:
    """``write_ranges`` of rows that are partitioned by ``FOLDER`` already."""
    w = rows.sortWithinPartitions(FOLDER, key).write.mode(mode).partitionBy(FOLDER).option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if row_group_bytes:
        w = w.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.row.count.limit", "100")
    w.parquet(path)


def read_ranges(spark: SparkSession, path: str, schema: StructType | str, folders: list[int] | None = None) -> DataFrame:
    """The table, or some of its folders (a partition filter)."""
    want = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    df = spark.read.schema(StructType(list(want.fields)).add(FOLDER, "long")).parquet(path)
    if folders is not None:
        df = df.filter(F.col(FOLDER).isin(folders))
    return df.select(*[f.name for f in want.fields])


def lookup(spark: SparkSession, path: str, schema: StructType | str, value: int, key: str = "id", width: int = WIDTH) -> DataFrame:
    """0 or 1 row, from one folder, its other row groups skipped."""
    return read_ranges(spark, path, schema, [value // width]).filter(F.col(key) == F.lit(value))


def _touched(keys: DataFrame, key: str, width: int) -> list[int]:
    return sorted(r[0] for r in keys.select(folder_of(F.col(key), width).alias("f")).filter("f IS NOT NULL").distinct().collect())


def update_stored(spark: SparkSession, path: str, changes: DataFrame, schema: StructType | str, key: str = "id", fields: list[str] = TB.FIELDS,
                  order: str | None = None, width: int = WIDTH) -> None:
    """G4 in place: as ``table.update_by_key``; unknown keys are ignored. Rows
    and changes are shuffled once, by folder, for both the update and the write."""
    touched = _touched(changes, key, width)
    if not touched:
        return
    old = read_ranges(spark, path, schema, touched)
    by = [order] if order else []
    change = F.struct(F.struct(*by, *fields).alias("o"), F.struct(*fields).alias("n"))
    both = (old.select(F.struct(*old.columns).alias("_old"), F.col(key).alias("_key"))
            .unionByName(changes.select(change.alias("_new"), F.col(key).cast(old.schema[key].dataType).alias("_key")), allowMissingColumns=True))
    dealt = both.withColumn(FOLDER, folder_of(F.col("_key"), width)).repartition(FOLDER)
    last = F.max("_new").over(Window.partitionBy(FOLDER, "_key"))
    rows = dealt.withColumn("_last", last).filter(F.col("_old").isNotNull())
    new = rows.select(*[(F.when(F.col("_last").isNotNull(), F.col("_last.n")[c]).otherwise(F.col("_old")[c]) if c in fields else F.col("_old")[c]).alias(c)
                        for c in old.columns], FOLDER)
    _write(new, path, key, "overwrite")


def delete_stored(spark: SparkSession, path: str, keys: DataFrame, schema: StructType | str, key: str = "id", width: int = WIDTH) -> None:
    """G5 in place."""
    touched = _touched(keys, key, width)
    if not touched:
        return
    old = read_ranges(spark, path, schema, touched)
    remaining, _ = TB.delete_by_key(old, keys, key)
    kept = _touched(remaining, key, width)
    if kept:
        write_ranges(remaining, path, key, width, "overwrite")
    for f in set(touched) - set(kept):  # nothing is left to overwrite these with
        remove_folder(spark, f"{path}/{FOLDER}={f}")


def append_stored(new_rows: DataFrame, path: str, key: str = "id", width: int = WIDTH) -> None:
    """Rows with new keys are added beside the files that are there."""
    write_ranges(new_rows, path, key, width, "append")
