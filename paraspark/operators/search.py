"""C14 over an index: case-insensitive substring search by trigrams.

The index holds, for every distinct trigram of the rows' lower-cased texts, the
keys of the rows that have it (a list per slice of the table), in folders by the
trigram's hash. A search reads the folders of the needle's
trigrams only, keeps the keys that have all of them, and looks the needle up in
those rows' texts, so the result is that of the scan. A needle of fewer than
three characters has no trigram; it is searched by the scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.operators import table as TB

FOLDER = "_bucket"
FOLDERS = 256
#: Characters of the texts a task holds as trigrams at a time.
SLICE = 4_000_000


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters (NULL and short texts: none)."""
    # neighbours are zipped, so the text is taken apart three times and not once per character
    chars = F.split(text, "")
    pairs = F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda x, y: F.concat(x, y))
    runs = F.zip_with(pairs, F.slice(chars, 3, F.size(chars)), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.array_compact(runs))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def _postings(rows: DataFrame, schema: str) -> DataFrame:
    """``gram, keys`` from rows of a key and lower-cased texts: one row per
    distinct trigram of a slice of about ``SLICE`` characters (longer when one
    text is), with the keys of the slice's rows that have it."""
    limit = SLICE

    def grouped(keys, texts):
        """Posting lists of the rows; code points are numbered from 0, so that
        a trigram and a row make one integer."""
        n = len(keys)
        points = [np.frombuffer("".join(c).encode("utf-32-le"), np.uint32) for c in texts]
        alphabet = np.unique(np.concatenate([np.unique(p) for p in points]))
        size = len(alphabet)
        if size ** 3 * n >= 1 << 63:
            yield from grouped(keys.slice(0, n // 2), [c[:n // 2] for c in texts])
            yield from grouped(keys.slice(n // 2), [c[n // 2:] for c in texts])
            return
        number = np.zeros(int(alphabet[-1]) + 1 if size else 0, np.int64)
        number[alphabet] = np.arange(size)
        found = []
        for c, p in zip(texts, points):
            x = number[p]
            row = np.repeat(np.arange(n), [len(t) for t in c])
            gram = (x[:-2] * size + x[1:-1]) * size + x[2:]
            found.append((gram * n + row[2:])[row[:-2] == row[2:]])
        codes = np.unique(np.concatenate(found))
        if not len(codes):
            return
        gram, row = np.divmod(codes, n)
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        g = gram[first]
        joined = alphabet[np.stack([g // (size * size), g // size % size, g % size], 1)].astype("<u4").tobytes().decode("utf-32-le")
        offsets = np.concatenate((first, [len(codes)])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), keys.take(pa.array(row)))
        yield pa.RecordBatch.from_arrays([pa.array([joined[i:i + 3] for i in range(0, len(joined), 3)], pa.string()), lists], names=["gram", "keys"])

    def run(batches):
        for b in batches:
            texts = [[t or "" for t in c.to_pylist()] for c in b.columns[1:]]
            sizes = np.cumsum([sum(map(len, row)) for row in zip(*texts)])
            at = 0
            while at < b.num_rows:
                # at least one row
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
                yield from grouped(b.column(0).slice(at, end - at), [c[at:end] for c in texts])
                at = end

    return rows.mapInArrow(run, schema)


def write_index(df: DataFrame, path: str, key: str = "id", cols: tuple[str, ...] = ("source_text", "target_text"), mode: str = "error") -> None:
    """(gram, keys) rows of every text column, in folders by gram, sorted by it
    (a search skips row groups of other grams). A row holds the keys of one
    slice of the table, so what is shuffled is little more than the keys."""
    rows = _postings(df.select(key, *[F.lower(c).alias(f"_t{i}") for i, c in enumerate(cols)]),
                     f"gram STRING, keys ARRAY<{df.schema[key].dataType.simpleString()}>")
    rows = rows.withColumn(FOLDER, _bucket(F.col("gram")))
    rows.repartition(FOLDER).sortWithinPartitions(FOLDER, "gram").write.mode(mode).partitionBy(FOLDER).parquet(path)


def read_index(spark: SparkSession, path: str, key_type: str = "LONG") -> DataFrame:
    return spark.read.schema(f"gram STRING, keys ARRAY<{key_type}>, {FOLDER} INT").parquet(path)


def candidates(index: DataFrame, needle: str, key: str = "id") -> DataFrame:
    """Keys whose texts have all trigrams of ``needle`` (three characters or more)."""
    spark = index.sparkSession
    # the needle's trigrams: at most its length, computed by the same expression
    grams = spark.range(1).select(F.explode(trigrams(F.lower(F.lit(needle)))).alias("g")).select("g", _bucket(F.col("g")).alias("b")).collect()
    near = index.filter(F.col(FOLDER).isin(sorted({r.b for r in grams}))).filter(F.col("gram").isin([r.g for r in grams]))
    return near.select("gram", F.explode("keys").alias(key)).groupBy(key).agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") == len(grams)).select(key)


def text_search_indexed(df: DataFrame, index: DataFrame, needle: str, source_lang: str | None = None, target_lang: str | None = None,
                        key: str = "id") -> DataFrame:
    """C14 by the index: the rows ``table.text_search`` gives."""
    lowered = df.sparkSession.range(1).select(F.length(F.lower(F.lit(needle)))).first()[0]
    if lowered < 3:
        return TB.text_search(df, needle, source_lang, target_lang)
    return TB.text_search(df.join(candidates(index, needle, key), key, "left_semi"), needle, source_lang, target_lang)
