"""Quoted CSV and JSON record arrays, read by many tasks a file.

Records of such files may hold the character that ends them: a line break inside a quoted value, a brace inside a string
or a nested object. Whether a piece between two of these characters begins inside a value depends on all that comes before it in
its file. Three steps find out, without any task that reads a whole file:

1. Spark's text reader cuts the files into splits and pieces. Each task counts quotes and brackets on the bytes of its pieces and adds
   them up as if its splits began outside and as if they began inside a value; the pieces are written once, with these sums and their place.
2. One row per split holds its sums. A window over the rows of a file tells the state in which each split really begins.
3. A piece that is a record by itself goes on as it is. Only pieces of longer records are shuffled, and joined in their order. Sums over quotes number
   the records of a CSV file; those of JSON are numbered by a window over their pieces.

The pieces are written since a second reading of the files could cut them elsewhere, for example after an executor was lost.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.session import materialize

SPLIT = ["_file", "_block"]
RECORD = "record"
#: From the bytes of pieces and their offsets: whether the quotes of each are odd in number, and its depth if begun outside and inside a value.
Steps = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
ADDED = T.StructType([
    *[T.StructField(name, T.IntegerType()) for name in ("_odd", "_outer", "_inner")], T.StructField("_no", T.LongType()),
    T.StructField("_odds", T.IntegerType()), T.StructField("_depth0", T.LongType()), T.StructField("_depth1", T.LongType()),
])


def _is_header() -> Column:
    """Whether a record is the first of its file."""
    return (F.col("_block") == 0) & (F.col("_no") == 0)


def _letters(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, and where each text starts and the last one ends."""
    values = values.cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _csv_steps(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every piece: whether its quotes are odd in number. There is no depth."""
    n = len(offsets) - 1
    quotes = np.bincount(np.searchsorted(offsets, np.flatnonzero(data == ord('"')), "right") - 1, minlength=n)
    return quotes % 2, np.zeros(n, np.int64), np.zeros(n, np.int64)


_OPENS, _CLOSES, _QUOTE = 1, 2, 3
_MARKS = np.zeros(256, np.int8)
_MARKS[[ord("{"), ord("[")]], _MARKS[ord("]")], _MARKS[ord('"')] = _OPENS, _CLOSES, _QUOTE


def _escaped(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes after a run of backslashes that is odd in length, within one piece."""
    slashes = np.flatnonzero(data == ord("\\"))
    piece = np.searchsorted(offsets, slashes, "right") - 1
    begins = np.ones(len(slashes), bool)
    begins[1:] = (np.diff(slashes) != 1) | (np.diff(piece) != 0)
    first = np.flatnonzero(begins)
    length = np.diff(np.append(first, len(slashes)))
    after = slashes[first] + length
    return after[(length % 2 == 1) & (after < offsets[piece[first] + 1])]


def _json_steps(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every piece: whether its quotes are odd in number, and how much deeper it and the brace after it lead, begun outside and inside a string."""
    n = len(offsets) - 1
    marks = _MARKS[data]
    marks[_escaped(data, offsets)] = 0
    at = np.flatnonzero(marks)
    kind, piece = marks[at], np.searchsorted(offsets, at, "right") - 1
    quote = kind == _QUOTE
    quotes = np.bincount(piece[quote], minlength=n)
    side = (np.cumsum(quote) - (np.cumsum(quotes) - quotes)[piece]) % 2
    deeper = [
        np.bincount(piece[here & (kind == _OPENS)], minlength=n) - np.bincount(piece[here & (kind == _CLOSES)], minlength=n)
        for here in (side == 0, side == 1)
    ]
    odd = quotes % 2  # the brace after the piece closes, unless it stands in a string
    return odd, deeper[0] - (odd == 0), deeper[1] - (odd == 1)


def _running(count: Steps) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add to each piece its own steps and what its split holds before it: pieces, odd ones, and depth for both states the split may begin in."""

    def run(batches):
        place, sums = None, np.zeros(4, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            files, blocks = batch.column("_file"), batch.column("_block").to_numpy()
            moved = pc.not_equal(files.slice(1), files.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(moved | (blocks[1:] != blocks[:-1])) + 1), n]
            odd, outer, inner = count(*_letters(batch.column("value")))
            before = np.empty((4, n), np.int64)
            for at, end in zip(starts, starts[1:]):
                here = (files[at].as_py(), blocks[at])
                if here != place:
                    place, sums = here, np.zeros(4, np.int64)
                part = slice(at, end)
                odds = sums[1] + np.cumsum(odd[part])
                inside = (odds - odd[part]) % 2 == 1
                steps = np.stack([
                    np.ones(end - at, np.int64), odd[part],
                    np.where(inside, inner[part], outer[part]), np.where(inside, outer[part], inner[part]),
                ])
                after = sums[:, None] + np.cumsum(steps, axis=1)
                before[:, part] = after - steps
                sums = after[:, -1]
            made = [odd.astype(np.int32), outer.astype(np.int32), inner.astype(np.int32), before[0], before[1].astype(np.int32), before[2], before[3]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=[*batch.schema.names, *ADDED.fieldNames()])

    return run


def _pieces(spark: SparkSession, path: str, separator: str, count: Steps) -> DataFrame:
    """Step 1: the pieces of all files, with the sums before each in its split."""
    read = spark.read.option("lineSep", separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
    )
    return materialize(read.mapInArrow(_running(count), T.StructType([*read.schema.fields, *ADDED.fields])), "pieces")


def _splits(pieces: DataFrame) -> DataFrame:
    """Step 2: state and depth in which each split begins, and the first character of its file that is no blank.

    The window holds one small row per split of a file. A file that ends inside a value or an open bracket is refused:
    the rest of it would be one value. (What follows the last brace of a file counts as if one more brace ended it.)
    """
    flat = F.col("_odds") % 2 == 0
    head = F.when((F.col("_block") == 0) & (F.col("_no") == 0), F.substring(F.ltrim(F.regexp_replace("value", r"^[\s\x{FEFF}]+", "")), 1, 1))
    sums = pieces.groupBy(*SPLIT).agg(
        (F.sum("_odd") % 2).alias("odd"), F.sum("_odd").alias("odds"), F.max(head).alias("head"),
        F.sum(F.when(flat, F.col("_outer")).otherwise(F.col("_inner"))).alias("deeper0"),
        F.sum(F.when(flat, F.col("_inner")).otherwise(F.col("_outer"))).alias("deeper1"),
    )
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opened = sums.withColumn("_open", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    deeper = F.when(F.col("_open") == 0, F.col("deeper0")).otherwise(F.col("deeper1"))
    opening = F.shiftright(F.col("odds") + 1 - F.col("_open"), 1)  # odd pieces open and close a value by turns
    table = materialize(opened.withColumn("deeper", deeper).select(
        *SPLIT, "_open", "odd", "deeper",
        F.coalesce(F.sum(deeper).over(before), F.lit(0)).alias("_base"),
        F.coalesce(F.sum(opening).over(before), F.lit(0)).alias("_earlier"),
        F.max("head").over(Window.partitionBy("_file")).alias("_head"),
    ), "splits")
    broken = table.groupBy("_file").agg((F.sum("odd") % 2).alias("odd"), F.sum("deeper").alias("deeper"))
    for row in broken.filter("odd <> 0 or deeper not in (0, -1)").select("_file").take(1):
        raise ValueError(f"{row['_file']} ends inside a quoted value or an open bracket")
    return table.drop("odd", "deeper")


def _placed(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """Every piece with the state (0 outside, 1 inside a value) and the depth it begins and ends in.

    ``_opened`` counts the pieces of its file, up to itself, that begin outside a value and end inside one.
    """
    state = (F.col("_odds") % 2).bitwiseXOR(F.col("_open"))
    opened = F.col("_earlier") + F.shiftright(F.col("_odds") + F.col("_odd") + 1 - F.col("_open"), 1)
    depth = F.col("_base") + F.when(F.col("_open") == 0, F.col("_depth0")).otherwise(F.col("_depth1"))
    return pieces.join(splits, SPLIT).select(
        *SPLIT, "_no", "_head", "value", opened.alias("_opened"), state.alias("state"), state.bitwiseXOR(F.col("_odd")).alias("end_state"), depth.alias("depth"),
        (depth + F.when(state == 0, F.col("_outer")).otherwise(F.col("_inner"))).alias("end_depth"),
    )


def _numbered(parts: DataFrame, starts: str) -> DataFrame:
    """Pieces with the number ``_record`` of their record in its file.

    Pieces are numbered by record within their split; one row per split adds the records that began before it, so a record that crosses
    splits keeps its number.
    """
    within = Window.partitionBy(*SPLIT).orderBy("_no")
    begun = parts.groupBy(*SPLIT).agg(F.sum(F.col(starts).cast("int")).alias("n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = begun.select(*SPLIT, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    numbered = parts.withColumn("_local", F.sum(F.col(starts).cast("int")).over(within)).join(base, SPLIT)
    return numbered.withColumn("_record", F.col("_before") + F.col("_local"))


def _joined(numbered: DataFrame, separator: str) -> DataFrame:
    """Step 3: pieces of records that take several, by file and record, joined in their order."""
    whole = numbered.groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_block", "_no", "value"))).alias("_parts"))
    return whole.select(
        "_file", F.col("_parts")[0]["_block"].alias("_block"), F.col("_parts")[0]["_no"].alias("_no"),
        F.array_join(F.transform("_parts", lambda p: p["value"]), separator).alias(RECORD),
    )


def _csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of CSV files; ``_record`` numbers the records of several lines in their file, from 1."""
    pieces = _pieces(spark, path, "\n", _csv_steps)
    return _placed(pieces, _splits(pieces)).withColumnRenamed("_opened", "_record")


def _csv_records(lines: DataFrame) -> DataFrame:
    """The records of lines: a line that begins and ends outside a value is one, the others are joined by their numbers."""
    alone = (F.col("state") == 0) & (F.col("end_state") == 0)
    short = lines.filter(alone).select(*SPLIT, "_no", F.col("value").alias(RECORD))
    records = short.unionByName(_joined(lines.filter(~alone), "\n"))
    return records.withColumn(RECORD, F.regexp_replace(RECORD, "\r$", "")).filter((F.length(RECORD) > 0) | _is_header())


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as text in ``record``, with the place of their first line; a place of zeros is a file's header.

    Values that hold quotes or line breaks are quoted, quotes in them doubled. Lines end in a line feed, with or without a carriage return.
    Empty lines between records are skipped.
    """
    return _csv_records(_csv_lines(spark, path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """CSV files with header in the column order of ``schema``; a header with other names is refused.

    Same rows as Spark's reader gives with ``multiLine``, but a file is read by as many tasks as it has splits. Line breaks inside values
    stay as they are in the file.
    """
    lines = _csv_lines(spark, path)
    records = _csv_records(lines)
    # A header is its file's first line or, over several lines, its first record of several lines: no other record is put together for it.
    first = _csv_records(lines.filter(_is_header() | (F.col("_record") == 1)))
    settings = {"quote": '"', "escape": '"', **options}
    names = F.from_csv(F.regexp_replace(RECORD, r"^\x{FEFF}", ""), ", ".join(f"c{i} string" for i in range(len(schema))), settings)
    headers = first.filter(_is_header()).select("_file", names.alias("_names"))
    same = [F.lower(F.col(f"_names.c{i}")).eqNullSafe(name.lower()) for i, name in enumerate(schema.fieldNames())]
    for row in headers.filter(~reduce(Column.__and__, same)).select("_file").take(1):
        raise ValueError(f"the header of {row['_file']} does not name the columns {schema.fieldNames()}")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.filter(~_is_header()).select(F.from_csv(RECORD, ddl, settings).alias("_row")).select("_row.*")


def record_texts(spark: SparkSession, path: str, key: str = "records") -> DataFrame:
    """The objects of arrays as JSON text in ``record``: of files ``[{...}, ...]`` or ``{"records": [{...}, ...], ...}``, in any layout.

    Which of the two a file is, its first character tells; it may hold several such documents. Members beside ``key`` and entries
    that are no objects are passed over. A second array of objects beside ``key`` is refused.
    """
    placed = _pieces(spark, path, "}", _json_steps)
    level = F.when(F.col("_head") == "[", 1).otherwise(2)
    reached = F.col("end_depth") + F.when(F.col("end_state") == 0, 1).otherwise(0)  # before that brace
    pieces = _placed(placed, _splits(placed)).withColumns({
        "_inside": F.col("depth") > level,
        "_starts": (F.col("depth") <= level) & (reached > level),
        "_closes": (F.col("end_state") == 0) & (reached == level + 1),
    }).filter("_inside or _starts")
    texts = pieces.withColumn("value", F.when(F.col("_inside"), F.col("value")).otherwise(_from_brace(key)))
    short = texts.filter("_starts and _closes").select(F.concat("value", F.lit("}")).alias(RECORD))
    long = _joined(_numbered(texts.filter("not (_starts and _closes)"), "_starts"), "}")
    return short.unionByName(long.select(F.concat(RECORD, F.lit("}")).alias(RECORD))).filter(F.col(RECORD).startswith("{"))


def _from_brace(key: str) -> Column:
    """A piece in which a record begins, from its brace on; empty for an object that is no entry of the array."""
    following = F.regexp_extract("value", r'(?s)^[^{"\[]*(\{.*)$', 1)
    wrapped = F.regexp_extract("value", rf'(?s)"{re.escape(key)}"\s*:\s*\[[^{{"\[]*(\{{.*)$', 1)
    opening = F.regexp_extract("value", r'(?s)\[[^{"\[]*(\{.*)$', 1)
    outside = F.array_join(F.filter(F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1), lambda _, i: i % 2 == 0), '""')
    refused = F.raise_error(F.concat(F.lit(f"an array of objects beside {key}: "), F.col("_file")))
    return (
        F.when((F.col("depth") == F.when(F.col("_head") == "[", 1).otherwise(2)) & (following != ""), following)
        .when(F.col("_head") == "[", opening)
        .when(wrapped != "", wrapped)
        .when(outside.rlike(r"\[\s*\{"), refused)
        .otherwise("")
    )


def read_records(spark: SparkSession, path: str, schema: T.StructType, key: str = "records") -> DataFrame:
    """The records of ``record_texts`` as rows; one that cannot be parsed gives a row of nulls."""
    return record_texts(spark, path, key).select(F.from_json(RECORD, schema).alias("_row")).select("_row.*")
