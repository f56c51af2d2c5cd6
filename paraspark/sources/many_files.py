"""Lines of very many small text files, with bounded memory on the driver.

Spark's file sources list every file on the driver and keep a split for each.
On a local or mounted folder the tasks list the folders here, level by level,
and read the files themselves; files of any other store, and compressed ones,
go through Spark's reader a bounded group at a time. The rows are those of
``spark.read.option("recursiveFileLookup", True).text(path)``.
"""

from __future__ import annotations

import os
import shutil
import unicodedata
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.llm.common import checkpointed, map_arrow
from paraspark.session import local_folder, remove_folder

#: Folders or files a task lists, reads or removes.
PER_TASK = 2_000
#: Files Spark's reader lists at a time.
PER_GROUP = 50_000
#: Bytes of a file that a task reads, as ``spark.sql.files.maxPartitionBytes`` has by default.
SPLIT_BYTES = 128 << 20
#: Bytes of text in a row, and in a batch of rows, about.
TEXT_BYTES = 1 << 20

# what Hadoop's codecs, found by a file's ending, make of a file is left to them
_CODECS = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".passthrough")
_BOM = b"\xef\xbb\xbf"
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-!.~'()*,;:$&+=@/")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, text`` of all files below ``path``: ``text`` is whole lines of the
    file with their line ends, ``file`` is named as ``_metadata.file_path`` names it."""
    folder = local_folder(spark, path)
    fs, at = _hadoop(spark, path)
    if folder is None and fs.exists(at) and fs.getFileStatus(at).isDirectory():
        return _grouped(spark, _listed(spark, path))
    if folder is None or not os.path.isdir(folder):     # a file or a pattern
        return _by_spark(spark.read.option("recursiveFileLookup", True).text(path))
    files = _walk(spark, folder)
    coded = F.lower("name").rlike("(" + "|".join(c.replace(".", r"\.") for c in _CODECS) + ")$")
    out = _read(files.filter(~coded), folder)
    packed = files.filter(coded).select("name")
    if packed.isEmpty():
        return out
    return out.unionByName(_grouped(spark, (os.path.join(folder, r["name"]) for r in packed.toLocalIterator())))


def remove_files(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote; where it holds many others, by tasks."""
    folder = local_folder(spark, path)
    if folder is not None and os.path.isdir(folder):
        with os.scandir(folder) as entries:
            wide = sum(1 for _ in zip(entries, range(PER_TASK + 1))) > PER_TASK
        if wide:
            def run(batches):
                for b in batches:
                    for name in b.column(0).to_pylist():
                        shutil.rmtree(os.path.join(folder, name), ignore_errors=True)
                    yield b
            top = _level(spark.createDataFrame([("",)], "name string"), folder, hidden=True)
            _dealt(top.filter("size IS NULL").select("name"), run, "name STRING").count()
    remove_folder(spark, path)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


# ------------------------------------------------- a local or mounted folder

def _dealt(df: DataFrame, fn, schema: str, weight=None) -> DataFrame:
    """``fn`` over ``df``, ``PER_TASK`` rows (or one unit of ``weight``) a task."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(weight if weight is not None else F.lit(0)), F.lit(0)).alias("w")).first()
    tasks = max(1, -(-n["n"] // PER_TASK), int(n["w"]))
    return map_arrow(df.repartition(tasks, *df.columns), fn, schema)


def _level(folders: DataFrame, root: str, hidden: bool = False) -> DataFrame:
    """``name, size`` of what stands in the folders; no size for a folder."""
    def run(batches):
        names, sizes = [], []

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "size"])
            names.clear()
            sizes.clear()
            return out
        for b in batches:
            for at in b.column(0).to_pylist():
                with os.scandir(os.path.join(root, at)) as entries:
                    for e in entries:
                        try:
                            size = None if e.is_dir() else e.stat().st_size
                        except FileNotFoundError:                # a link to nothing, or gone by now
                            continue
                        if hidden or _seen(e.name, size is None):
                            names.append(os.path.join(at, e.name))
                            sizes.append(size)
                            if len(names) >= 10_000:
                                yield rows()
        yield rows()
    return checkpointed(_dealt(folders, run, "name STRING, size LONG"))


def _seen(name: str, folder: bool) -> bool:
    """Whether Spark's file sources look at a file or folder of this name."""
    if name.startswith(".") or name.endswith("._COPYING_"):
        return False
    return not name.startswith("_") or "=" in name or folder and name.startswith(("_metadata", "_common_metadata"))


def _walk(spark: SparkSession, root: str) -> DataFrame:
    """``name, size`` of all files below ``root`` that hold something."""
    found, folders = [], spark.createDataFrame([("",)], "name string")
    while not folders.isEmpty():
        level = _level(folders, root)
        found.append(level.filter("size > 0"))
        folders = level.filter("size IS NULL").select("name")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _read(files: DataFrame, root: str) -> DataFrame:
    uri = "file:" + uri_name(root.rstrip("/"))

    def run(batches):
        names, texts, held = [], [], 0
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                file = f"{uri}/{uri_name(name)}"
                with open(os.path.join(root, name), "rb", buffering=0) as f:
                    for text in texts_of(f, start, start + SPLIT_BYTES):
                        names.append(file)
                        texts.append(text)
                        held += len(text)
                        if held >= TEXT_BYTES or len(names) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["file", "text"])
                            names, texts, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["file", "text"])

    parts = files.select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(SPLIT_BYTES).cast("long"))).alias("start"),
                         F.col("size"))
    share = F.least(F.col("size") - F.col("start"), F.lit(SPLIT_BYTES)) / SPLIT_BYTES
    return _dealt(parts.select("name", "start", "size"), run, "file STRING, text BINARY", share).withColumn("text", F.col("text").cast("string"))


def texts_of(f, start: int, end: int) -> Iterator[bytes]:
    """The lines of a file that begin after ``start`` (from the file's begin for
    0) and no later than ``end``, about ``TEXT_BYTES`` at a time. A line ends
    with a line feed, a carriage return or both."""
    f.seek(start)
    at, rest, skip = start, b"", start > 0
    while at <= end:
        more = f.read(TEXT_BYTES)
        data = rest + more
        # a carriage return at the end may be half of a line end
        cut = max(data.rfind(b"\n"), data.rfind(b"\r", 0, len(data) - 1)) + 1 if more else len(data)
        text, rest = data[:cut], data[cut:]
        if at == 0 and cut and text.startswith(_BOM):
            at, text = len(_BOM), text[len(_BOM):]
        if skip and cut:
            first = len(text.splitlines(True)[0])
            at, text, skip = at + first, text[first:], False
        if at + len(text) > end:                                 # lines up to the one that begins at or before the end
            keep = 0
            for line in text.splitlines(True):
                if at + keep > end:
                    break
                keep += len(line)
            more, text = b"", text[:keep]
        if text:
            yield text
        at += len(text)
        if not more:
            return


def uri_name(name: str) -> str:
    """A name as ``java.net.URI`` quotes it in a path."""
    if _PLAIN.issuperset(name):
        return name
    return "".join(c if c in _PLAIN or c >= "\xa0" and unicodedata.category(c)[0] != "Z" else "".join(f"%{b:02X}" for b in c.encode()) for c in name)


# ------------------------------------------------------------ other stores

def _by_spark(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _listed(spark: SparkSession, path: str) -> Iterator[str]:
    """Files below ``path``, asked from the store as they are needed."""
    fs, at = _hadoop(spark, path)
    root = fs.makeQualified(at).toString()
    files = fs.listFiles(at, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        *folders, last = name[len(root):].strip("/").split("/")
        if _seen(last, False) and all(_seen(f, True) for f in folders):
            yield name


def _grouped(spark: SparkSession, names: Iterator[str]) -> DataFrame:
    """Files read by Spark ``PER_GROUP`` at a time, each group written before the next is listed."""
    out = spark.createDataFrame([], "file string, text string")
    for group in batched(names, PER_GROUP):
        lines = spark.read.option("__globPaths__", "false").option("recursiveFileLookup", True).text(list(group))
        out = out.union(checkpointed(_by_spark(lines).coalesce(max(1, -(-len(group) // PER_TASK)))))
    return out
