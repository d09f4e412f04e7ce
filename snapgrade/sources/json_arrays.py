"""Large JSON arrays read by many tasks.

A file is read as the pieces between closing braces, so Spark splits it at any byte. The pieces of a split are
packed into chunks of about 1 MB, which are written once. What a chunk means depends on whether it starts inside a
string and how deep; both follow from the chunks before it:

* a chunk's number of quotes that are not escaped says whether it changes from inside a string to outside;
* its change of depth is counted for both starts, and how many braces lead to which depth;
* sums over the chunks of a file tell which start is the right one, and how many elements end before.

An element ends at a closing brace that leads back to depth 1 outside a string. The text up to there is
one part: an element with its comma (and any plain values before it), which is parsed alone. Parts are cut where their
chunk is read; only what lies across the border of two chunks is shuffled. A file counts only if
every part of it parses, the first starts with the array's bracket and the last ends with it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from snapgrade.session import materialise_packed as materialise

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 20  # of text; a longer piece is a chunk of its own

_AT = ["source_file", "split", "chunk"]
_QUOTE, _SLASH, _BRACE = b'"\\}'
_STEP = np.zeros(256, np.int8)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1


def _escaped(data: np.ndarray) -> np.ndarray:
    """Bytes behind a backslash that is not escaped itself. The brace that ends a piece is never one."""
    slash = np.flatnonzero(data == _SLASH)
    starts = np.diff(slash, prepend=-2) != 1
    place = slash - slash[starts][np.cumsum(starts) - 1]
    behind = slash[place % 2 == 0] + 1
    behind = behind[behind < len(data)]
    return behind[data[behind] != _BRACE]


def _scan(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, their changes of depth were they outside of strings, and whether a quote is open if none was before."""
    data = np.frombuffer(text, np.uint8)
    quote, step = data == _QUOTE, _STEP[data]
    if b"\\" in text:
        escaped = _escaped(data)
        quote[escaped], step[escaped] = False, 0
    return data, step, (np.cumsum(quote, dtype=np.uint8) & 1).astype(bool)


def _braces(text: bytes, opened: bool) -> tuple[np.ndarray, np.ndarray]:
    """Closing braces outside of strings, in a chunk that starts inside a string or not, and the depth behind
    them over that of the start."""
    data, step, odd = _scan(text)
    outside = odd == opened
    found = np.flatnonzero((data == _BRACE) & outside)
    return found, np.cumsum(np.where(outside, step, 0), dtype=np.int64)[found]


def _levels(text: bytes) -> list[dict]:
    """How many braces lead to which depth, for both starts."""
    found = []
    for opened in (False, True):
        levels, counts = np.unique(_braces(text, opened)[1], return_counts=True)
        found += [{"opened": opened, "level": v, "ends": n} for v, n in zip(levels.tolist(), counts.tolist())]
    return found


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a split, in order, as chunks with their sums."""
    names = [*_AT, "text", "quotes", "outside", "inside", "levels"]
    level = pa.struct([("opened", pa.bool_()), ("level", pa.int64()), ("ends", pa.int64())])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.list_(level)]
    held: list[bytes] = []
    size, chunk, here = 0, 0, None

    def row() -> pa.RecordBatch:
        text = b"}".join(held) + b"}"
        _, step, odd = _scan(text)
        inside = int(step[odd].sum(dtype=np.int64))
        values = [*here, chunk, text, int(odd[-1]), int(step.sum(dtype=np.int64)) - inside, inside, _levels(text)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        if not len(batch):
            continue
        files, splits, pieces = batch.columns
        sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ids = splits.to_numpy(zero_copy_only=False)
        moved = (ids[1:] != ids[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
        borders = [0, *(np.flatnonzero(moved) + 1).tolist(), len(batch)]
        upto = np.cumsum(sizes)
        for start, end in zip(borders, borders[1:]):
            split = (files[start].as_py(), int(ids[start]))
            if split != here:
                if held:
                    yield row()
                held, size, chunk, here = [], 0, 0, split
            while start < end:
                before = int(upto[start - 1]) if start else 0
                stop = min(end, int(np.searchsorted(upto, before + CHUNK_BYTES - size, side="right")))
                stop = max(stop, start if held else start + 1)
                held += pieces[start:stop].to_pylist()
                size += int(upto[stop - 1]) - before if stop > start else 0
                if stop < end:
                    yield row()
                    held, size, chunk = [], 0, chunk + 1
                start = stop
    if held:
        yield row()


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the files with the parity of their quotes, and for a start outside and inside a string their change of
    depth and the depths behind their braces. The brace that ends a piece is in it, also behind the last piece of a file."""
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("piece"),
    )
    return lines.mapInArrow(
        _packed,
        "source_file string, split long, chunk long, text binary, quotes long, outside long, inside long, "
        "levels array<struct<opened: boolean, level: long, ends: long>>",
    )


def _before(column: str) -> Column:
    """The sum over the chunks of the file before this one; a window of a row per chunk."""
    order = Window.partitionBy("source_file").orderBy("split", "chunk")
    return F.coalesce(F.sum(column).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def _starts(chunks: DataFrame) -> DataFrame:
    """A row per chunk: whether it starts inside a string, how deep and in which part, and whether it is its file's first
    or last."""
    order = Window.partitionBy("source_file").orderBy("split", "chunk")
    opened = chunks.select(
        *_AT, "outside", "inside", (_before("quotes") % 2 == 1).alias("opened"), F.lag("split").over(order).isNull().alias("is_first"),
        F.lead("split").over(order).isNull().alias("is_last"),
    )
    change = opened.withColumn("change", F.when(F.col("opened"), F.col("inside")).otherwise(F.col("outside")))
    deep = change.select(*_AT, "opened", "is_first", "is_last", _before("change").alias("depth"))
    # an element ends where a brace leads back to depth 1; files of levels are small for their rows
    levels = chunks.select(*_AT, F.inline("levels"))
    ended = deep.withColumn("level", 1 - F.col("depth")).join(levels.hint("merge"), [*_AT, "opened", "level"], "left")
    return ended.withColumn("ends", F.coalesce("ends", F.lit(0).cast("long"))).select(
        *_AT, "opened", "is_first", "is_last", "depth", _before("ends").alias("first_part")
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of chunks; ``across`` marks fragments, which go on before or behind their chunk.

    The last brace of a file was put there and is taken off.
    """
    for batch in batches:
        for at in range(len(batch)):
            row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
            text = row["text"][:-1] if row["is_last"] else row["text"]
            found, levels = _braces(text, row["opened"])
            cuts = np.concatenate([[0], found[levels == 1 - row["depth"]] + 1, [len(text)]]).astype(np.int32)
            places = np.arange(len(cuts) - 1)
            head, tail = places == 0, places == places[-1]
            columns = [
                *(pa.array([row[c]] * len(places), batch.schema.field(c).type) for c in _AT),
                pa.array(places + row["first_part"]), pa.array(tail & row["is_last"]),
                pa.array((head & (not row["is_first"])) | (tail & (not row["is_last"]))),
                pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(cuts), pa.py_buffer(text)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*_AT, "part", "last", "across", "text"])


def _with_elements(parts: DataFrame) -> DataFrame:
    """Add the elements of parts of files as an array of variants; null if a part is damaged.

    A part starts with the array's bracket (the first) or a comma, and ends with a brace, or with the
    array's bracket (the last). Between both is a list of values.
    """
    text, first, last = F.col("text"), F.col("part") == 0, F.col("last")
    blank = r"[ \t\r\n]*"
    start = F.when(first, F.regexp_extract(text, rf"(?s)^\ufeff?{blank}\[(.*)$", 1)).otherwise(
        F.regexp_extract(text, rf"(?s)^{blank},(.*)$", 1)
    )
    opened = F.when(first, text.rlike(rf"^\ufeff?{blank}\[")).otherwise(text.rlike(rf"^{blank},"))
    # the last part may be the bracket alone
    bare = last & ~first & text.rlike(rf"^{blank}\]{blank}$")
    closed = ~last | text.rlike(rf"\]{blank}$")
    body = F.when(last, F.regexp_replace(start, rf"\]{blank}$", "")).otherwise(start)
    # columns of their own, so that a text is parsed once and not wherever its values are asked for
    whole = F.lit("$")
    roots = F.try_variant_get(F.try_parse_json(F.concat(F.lit("[["), body, F.lit("]]"))), whole, "array<variant>")
    # what would close the brackets put around it and open new ones is more than one value
    values = F.when(F.size("_roots") == 1, F.try_variant_get(F.get("_roots", F.lit(0)), whole, "array<variant>"))
    # only a whole array may be empty
    sound = opened & closed & ((F.size("_values") > 0) | (first & last))
    elements = F.when(bare, F.array().cast("array<variant>")).otherwise(F.when(sound, F.col("_values")))
    return parts.withColumn("_roots", roots).withColumn("_values", values).withColumn("elements", elements).drop("_roots", "_values")


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table, and read it in no more tasks than wrote it, however small the splits of the landed files are."""
    table = materialise(df, label)
    return table.coalesce(max(1, len(table.inputFiles())))


def json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``source_file, source_row, element`` (variant) of all files; a damaged file is one row with nulls.

    Tasks hold chunks and single elements, never a file. An element may have 128 MB, the most that one
    value may have. Elements that are not objects are read with the object that follows them, or with the
    end of the file.
    """
    chunks = _stored(_chunks(spark, path), "chunks")
    # only a row per chunk is broadcast
    placed = chunks.select(*_AT, "text").join(F.broadcast(_starts(chunks)), _AT)
    cut = placed.mapInArrow(
        _cut, "source_file string, split long, chunk long, part long, last boolean, across boolean, text binary"
    ).withColumn("text", F.col("text").cast("string"))
    across = F.col("across")
    kept = _stored(
        _with_elements(cut.withColumns({"far": F.when(across, F.col("text")), "text": F.when(~across, F.col("text"))})).drop("text"), "elements"
    )
    # only what lies across chunks is shuffled; it counts where it starts
    pieces = F.array_sort(F.collect_list(F.struct("split", "chunk", "far")))
    joined = kept.where("across").groupBy("source_file", "part").agg(pieces.alias("pieces"), F.max("last").alias("last")).select(
        "source_file", F.col("pieces")[0]["split"].alias("split"), F.col("pieces")[0]["chunk"].alias("chunk"), "part", "last",
        F.array_join(F.transform("pieces", lambda p: p["far"]), "").alias("text"),
    )
    whole = kept.where("not across").select(*_AT, "part", "elements")
    read = whole.unionByName(_stored(_with_elements(joined).select(*_AT, "part", "elements"), "across"))
    size = F.when(F.col("elements").isNotNull(), F.size("elements")).cast("long")
    sized = read.select(*_AT, "part", size.alias("size"))
    # sums over the parts of a chunk, then over the chunks of a file: a row per chunk
    sums = _stored(
        sized.groupBy(*_AT).agg(
            F.sum("size").alias("sum"), F.max("size").alias("most"), F.min("part").alias("first_part"), F.max(F.col("size").isNull()).alias("bad")
        ),
        "sums",
    )
    whole_file = Window.partitionBy("source_file")
    at = sums.select(*_AT, "first_part", "most", _before("sum").alias("before"), F.max("bad").over(whole_file).alias("damaged")).where("not damaged")
    # where no part holds more than one element (a last one may hold none), parts number the elements
    plain = read.join(F.broadcast(at.where("most <= 1")), _AT).select(
        "source_file", "elements", (F.col("before") + F.col("part") - F.col("first_part")).alias("first")
    )
    mixed = at.where("most > 1").select(*_AT, "before")
    local = Window.partitionBy(*_AT).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sized.join(F.broadcast(mixed), _AT).select(
        "source_file", "part", (F.col("before") + F.coalesce(F.sum("size").over(local), F.lit(0))).alias("first")
    )
    others = read.select("source_file", "part", "elements").join(numbered.hint("merge"), ["source_file", "part"])
    sound = plain.unionByName(others.drop("part")).select("source_file", F.posexplode("elements").alias("at", "element"), "first")
    rows = sound.select("source_file", (F.col("first") + F.col("at")).alias("source_row"), "element")
    bad = sums.where("bad").select("source_file").distinct()
    lost = bad.select("source_file", F.lit(None).cast("long").alias("source_row"), F.lit(None).cast("variant").alias("element"))
    return rows.unionByName(lost)
