"""Splittable reading of files whose records may span lines (A3, A7: CSV with
line breaks inside quotes; A4, A5: one JSON document or array per file).

Spark's own readers take such a file in one task, since a byte range alone
does not show whether it begins inside a quoted text. Here the file is read in
ordinary splits of pieces that end at a separator byte (a line feed; a closing
brace), and

1. each split's pieces are counted: its quotes (and, for JSON, its change of
   nesting depth under either start state), one row per split;
2. a running sum over a file's splits gives every split its start state;
3. each split is cut into records from that state; the record that runs across
   a border leaves a part on either side, and the parts, at most two a split,
   are joined by file and order.

The texts are never shuffled, apart from the parts at the borders. The table of
splits (one row per ``maxPartitionBytes`` of input) is broadcast up to
``BROADCAST_SPLITS`` rows; beyond, the pieces are joined by split and sorted.

Expected input: RFC 4180 CSV (a field that holds a quote is quoted and doubles
it) and valid JSON, both UTF-8. A NULL-free contract: empty files give no
records. Records of any length are kept whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paraspark.session import ensure_checkpoint_dir

BROADCAST_SPLITS = 300_000
#: Kinds of a split's output: a part that ends a record begun before (or runs
#: through the whole split), a whole record, a part that begins one.
ENDS, WHOLE, BEGINS = 0, 1, 2
_PARTS = "file STRING, block LONG, kind INT, first BOOLEAN, text STRING"


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``file, block, at, value``: pieces in file order inside each split;
    ``file`` is JSON text of the path and the folder columns."""
    t = spark.read.option("lineSep", separator).text(path)
    folders = [c for c in t.columns if c != "value"]
    file = F.to_json(F.struct(F.col("_metadata.file_path").alias("_path"), *[F.col(f"`{c}`").cast("string").alias(c) for c in folders]))
    return t.select(file.alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), "value")


def _before(*order: str):
    return Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _with_starts(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """The pieces with their split's start state, still in order."""
    ensure_checkpoint_dir(pieces.sparkSession)
    starts = starts.checkpoint(eager=True)
    if starts.count() <= BROADCAST_SPLITS:
        return pieces.join(F.broadcast(starts), ["file", "block"])
    return pieces.join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "at")


def _records(parts: DataFrame, separator: str) -> DataFrame:
    """``file, first, text`` of the whole records and of those put together
    from parts; ``first``: the first of its file."""
    border = parts.filter(F.col("kind") != WHOLE)
    # a part belongs to the record that the last beginning before it has begun
    number = F.sum((F.col("kind") == BEGINS).cast("int")).over(
        Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = (border.withColumn("record", number).groupBy("file", "record")
              .agg(F.sort_array(F.collect_list(F.struct("block", "kind", "text"))).alias("p"), F.max("first").alias("first"))
              .select("file", "first", F.array_join(F.transform("p", lambda x: x["text"]), separator).alias("text")))
    return parts.filter(F.col("kind") == WHOLE).select("file", "first", "text").unionByName(joined)


# ------------------------------------------------------------------- CSV

def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, first, text``: the logical records of CSV files; ``first`` marks
    each file's header."""
    lines = _pieces(spark, path, "\n")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    totals = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    starts = totals.select("file", "block", (F.coalesce(F.sum("quotes").over(_before("block")), F.lit(0)) % 2 == 1).alias("open"))

    def cut(batches):
        key, held, kind, first = None, [], 0, False
        for b in batches:
            out = []
            for file, block, value, is_open in zip(*(b.column(i).to_pylist() for i in range(4))):
                if key != (file, block):
                    if held:
                        out.append((*key, kind, first, "\n".join(held)))
                    # inside a quoted field the split continues a record
                    key, held, kind, quoted, first = (file, block), [], 0 if is_open else 2, is_open, block == 0
                held.append(value)
                quoted ^= value.count('"') % 2 == 1
                if not quoted:
                    out.append((file, block, 0 if kind == 0 else 1, first, "\n".join(held)))
                    held, kind, first = [], 2, False
            yield _parts(out)
        if held:
            yield _parts([(*key, kind, first, "\n".join(held))])

    def _parts(rows):
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "block", "kind", "first", "text"])

    parts = _with_starts(lines, starts).select("file", "block", "value", "open").mapInArrow(cut, _PARTS)
    # CRLF files: the line feed was the separator
    return _records(parts, "\n").select("file", "first", F.regexp_replace("text", "\r$", "").alias("text"))


def read_csv_split(spark: SparkSession, path: str, schema: StructType | str, header: list[str] | None = None,
                   folders: StructType | None = None) -> DataFrame:
    """A3: the rows a ``multiLine`` scan with header gives, from many tasks a
    file. With ``header`` every file's header must name these columns;
    ``folders`` are the columns that come from folder names."""
    want = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    records = csv_records(spark, path)
    if header is not None:
        names = F.from_csv(F.regexp_replace("text", "^\ufeff", ""), ", ".join(f"c{i} STRING" for i in range(len(header) + 1)), options)
        wanted = F.struct(*[F.lit(h).alias(f"c{i}") for i, h in enumerate([*header, None])])
        fits = F.to_json(names) == F.to_json(wanted)
        bad = F.raise_error(F.concat(F.lit("the header does not fit: "), F.col("text")))
        records = records.filter(F.when(F.col("first"), F.when(F.coalesce(fits, F.lit(False)), F.lit(False)).otherwise(bad.cast("boolean"))).otherwise(F.lit(True)))
    else:
        records = records.filter(~F.col("first"))
    rows = records.filter(F.col("text") != "")
    if folders:
        return rows.select(F.from_csv("text", _ddl(want), options).alias("r"), F.from_json("file", _ddl(folders)).alias("f")).select("r.*", "f.*")
    return rows.select(F.from_csv("text", _ddl(want), options).alias("r")).select("r.*")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


# ------------------------------------------------------------------ JSON

def json_elements(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """``text`` of the objects that lie ``level`` brackets deep: 1 for files
    that are an array of objects, 2 for ``{"name": [objects]}``."""
    pieces = _pieces(spark, path, "}")
    # what matters of a piece: escapes (skipped), quotes, brackets
    token = re.compile(r'\\.|["\[\]{]', re.S)

    def outside(value, quoted):
        """Depth gained outside strings, and whether the piece ends inside one."""
        gained = 0
        for t in token.findall(value):
            if t == '"':
                quoted = not quoted
            elif not quoted and len(t) == 1:
                gained += -1 if t == "]" else 1
        return gained - (not quoted), quoted  # the closing brace that ends the piece

    def count(batches):
        key, state = None, None

        def row():
            return (*key, state[0][1], state[0][0], state[1][0])
        for b in batches:
            out = []
            for file, block, value in zip(*(b.column(i).to_pylist() for i in range(3))):
                if key != (file, block):
                    if key:
                        out.append(row())
                    key, state = (file, block), [(0, False), (0, True)]
                for s in (0, 1):
                    gained, quoted = outside(value, state[s][1])
                    state[s] = (state[s][0] + gained, quoted)
            yield _batch(out, [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()], ["file", "block", "flips", "plain", "quoted"])
        if key:
            yield _batch([row()], [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()], ["file", "block", "flips", "plain", "quoted"])

    def _batch(rows, kinds, names):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    totals = pieces.select("file", "block", "value").mapInArrow(count, "file STRING, block LONG, flips BOOLEAN, plain LONG, quoted LONG")
    is_open = F.coalesce(F.sum(F.col("flips").cast("int")).over(_before("block")), F.lit(0)) % 2 == 1
    starts = totals.withColumn("open", is_open)
    gained = F.when(F.col("open"), F.col("quoted")).otherwise(F.col("plain"))
    starts = starts.select("file", "block", "open", F.coalesce(F.sum(gained).over(_before("block")), F.lit(0)).alias("depth"))

    def cut(batches):
        key, held, kind = None, [], 2
        for b in batches:
            out = []
            for file, block, value, is_open, depth0 in zip(*(b.column(i).to_pylist() for i in range(5))):
                if key != (file, block):
                    if held:
                        out.append((*key, kind, False, "}".join(held)))
                    key, held, quoted, depth = (file, block), [], is_open, depth0
                    kind = 0 if depth > level else 2
                begin = 0 if depth > level else None  # where an element's text starts in this piece
                for m in token.finditer(value):
                    t = m.group()
                    if t == '"':
                        quoted = not quoted
                    elif not quoted and len(t) == 1:
                        if t == "{" and depth == level:
                            begin = m.start()
                        depth += -1 if t == "]" else 1
                if begin is not None:
                    held.append(value[begin:])
                if not quoted:
                    depth -= 1
                    if depth == level and held:
                        out.append((file, block, 0 if kind == 0 else 1, False, "}".join(held) + "}"))
                        held, kind = [], 2
            yield _batch(out, [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()], ["file", "block", "kind", "first", "text"])
        if held:
            yield _batch([(*key, kind, False, "}".join(held))], [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()],
                         ["file", "block", "kind", "first", "text"])

    parts = _with_starts(pieces, starts).select("file", "block", "value", "open", "depth").mapInArrow(cut, _PARTS)
    return _records(parts, "}").select("text")
