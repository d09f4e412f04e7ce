"""WARC archives: written as text parts, read back by verified record boundaries.

An archive part is split at every occurrence of the record magic, also those inside payloads, and by
many tasks. Each piece that parses as a header is a candidate with the offset of its successor. Only
candidates that a chain of successors reaches from the start of the file are records: inside a block
of a file the chain is followed by the block's task, between blocks by pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from snapgrade.session import materialise

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MAGIC = MAGIC.encode()
_END = END.encode()


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of binary data in upper-case base 32: five hexadecimal digits give four characters; null for null."""
    digits = F.sha1(payload)
    part = lambda i: F.conv(F.substring(digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    four = lambda v: F.concat(
        *(F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0))
    )
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), part)
    return F.when(digits.isNotNull(), F.array_join(F.transform(groups, four), ""))


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add record_type and refers_to to rows (page_id, payload, digest).

    Of equal payloads of at least ``least_bytes`` bytes the smallest page_id is the response. Only
    digests that occur more than once are joined back, and the payloads move only if these are too
    many for Spark to broadcast on its own.
    """
    counted = pages.where(F.octet_length("payload") >= least_bytes).groupBy(F.col("digest").alias("_digest"))
    copies = counted.agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    copies = materialise(copies.select("_digest", "_first"), "copies")
    joined = pages.join(copies, (F.col("digest") == F.col("_digest")) & (F.octet_length("payload") >= least_bytes), "left")
    again = F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        *pages.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
    )


def _header(name: str, value: Column) -> Column:
    """A header line without line breaks in its value; no line for null.

    A blank, which readers strip, follows a value that would make the magic with its line end.
    """
    flat = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    flat = F.when(flat.endswith(MAGIC.rstrip()), F.concat(flat, F.lit(" "))).otherwise(flat)
    return F.coalesce(F.concat(F.lit(f"{name}: "), flat, F.lit("\r\n")), F.lit(""))


def write_archive(
    pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0
) -> None:
    """Write one WARC record per page, as uncompressed parts below ``path``, one part per task.

    The payload is the html in UTF-8, null counts as empty. A revisit record has no payload, but its
    length and digest, and refers to the response. Rows that repeat a page_id and payload are all of
    the same type. Line breaks in an url become blanks; a null url has no line, a null page_id an
    empty one. An empty table writes an empty archive.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"))
    marked = mark_revisits(rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))), least_bytes)
    again = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"),
        _header("Content-Length", F.octet_length("payload")),
        F.lit("\r\n"),
    )
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", name("page_id")),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, _header("WARC-Refers-To", name("refers_to"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
        F.col("block"),
    )
    marked.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).text(path)


_PLACE = [("file", pa.string()), ("block", pa.int64()), ("at", pa.int64())]
_PIECE = pa.schema([*_PLACE, ("size", pa.int64()), ("next", pa.int64()), ("whole", pa.bool_()), ("data", pa.binary())])
_PIECES = "file string, block long, at long, size long, next long, whole boolean, data binary"
RECORD = "file string, offset long, record_type string, page_id long, url string, refers_to long, digest string, payload_length long, payload binary"


def _head_end(piece: bytes) -> tuple[int, int] | None:
    """Length of a candidate's header and of its block, if the piece starts with a header."""
    end = piece.find(_END)
    if end < 0:
        return None
    for line in piece[:end].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return end + len(_END), int(value)
    return None


def _pieces(spark: SparkSession, path: str, with_data: bool) -> DataFrame:
    """What stands between occurrences of the magic, in scan order.

    ``at`` is where the piece starts, counted from where the first piece of its block does; ``next``
    where the piece of the successor would start; ``whole`` tells that the record ends with the piece.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for batch in batches:
            rows = []
            for file, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != here:
                    here, at = (file, block), 0
                found = _head_end(data) if block or at else None  # nothing precedes the first piece of a file
                length = found[0] + found[1] + len(_END) if found else None
                rows.append(
                    (
                        file, block, at, len(data),
                        at + length + len(_MAGIC) if found else None,
                        length == len(data),
                        data if with_data else None,
                    )
                )
                at += len(data) + len(_MAGIC)
            columns = zip(*rows) if rows else [[]] * len(_PIECE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE
            )

    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("value").cast("binary")
    ).mapInArrow(parse, _PIECES)


def _exits(block: pd.DataFrame) -> pd.DataFrame:
    """For each candidate, where the chain from it leaves the block; none if it ends in the block."""
    block = block[block["next"].notna()].sort_values("at")
    at, following = block["at"].to_numpy(np.int64), block["next"].to_numpy(np.int64)
    total = int(block["total"].iloc[0]) if len(block) else 0
    place = np.searchsorted(at, following)
    inside = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == following) if len(at) else np.zeros(0, bool)
    out = np.where(following >= total, following, -1)
    for i in np.flatnonzero(inside)[::-1]:  # successors stand behind
        out[i] = out[place[i]]
    return pd.DataFrame({"file": block["file"], "block": block["block"], "at": at, "out": out})


def _walk(block: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that the chain reaches from where it enters."""
    following = {int(a): int(n) for a, n in zip(block["at"], block["next"], strict=True) if n == n and n is not None}
    reached = []
    for at in map(int, entries["at"]):
        while at in following:
            reached.append(at)
            at = following[at]
    found = block[block["at"].isin(reached)]
    return found[["file", "block", "at"]]


def reached_records(pieces: DataFrame) -> DataFrame:
    """(file, block, at, start, whole) of the records; ``start`` counts from the start of the file."""
    totals = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + len(_MAGIC)).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(totals.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))), "blocks")
    sized = pieces.join(bases.select("file", "block", "total"), ["file", "block"])
    exits = sized.select("file", "block", "at", "next", "total").groupBy("file", "block")
    exits = exits.applyInPandas(_exits, "file string, block long, at long, out long")
    # candidates from which the chain goes on in a later block
    jumps = exits.where("out >= 0").join(bases, ["file", "block"])
    jumps = materialise(jumps.select("file", (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("out")).alias("jump")), "jumps")
    placed = pieces.where("next is not null").join(bases, ["file", "block"])
    starts = placed.select("file", "block", "at", (F.col("base") + F.col("at")).alias("start"))
    entries = bases.select("file").distinct().withColumn("start", F.lit(len(_MAGIC)).cast("long"))
    entries = materialise(entries, "entries")
    known = entries.count()
    while bool(jumps.take(1)):
        hop = entries.join(jumps, ["file", "start"]).select("file", F.col("jump").alias("start"))
        entries = materialise(entries.union(hop).distinct(), "entries")
        size = entries.count()
        if size == known:
            break
        known = size
        twice = jumps.alias("a").join(
            jumps.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.jump") == F.col("b.start"))
        )
        jumps = materialise(twice.select("a.file", "a.start", "b.jump"), "jumps")
    entered = materialise(starts.join(entries, ["file", "start"]).select("file", "block", "at"), "entered")
    reached = (
        pieces.select("file", "block", "at", "next")
        .groupBy("file", "block")
        .cogroup(entered.groupBy("file", "block"))
        .applyInPandas(_walk, "file string, block long, at long")
    )
    return reached.join(placed, ["file", "block", "at"]).select(
        "file", "block", "at", (F.col("base") + F.col("at")).alias("start"), "whole"
    )


def _records():
    """Parse whole records, given as the piece behind their magic."""
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def number(value: bytes | None) -> int | None:
        inner = (value or b"").strip().removeprefix(b"<urn:page:").removesuffix(b">")
        return int(inner) if inner.lstrip(b"-").isdigit() else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, start, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head, length = _head_end(data)
                fields = {}
                for line in data[:head].split(b"\r\n"):
                    name, _, value = line.partition(b":")
                    fields[name.strip().lower()] = value.strip()
                http, _, payload = data[head : head + length].partition(_END)
                sizes = [v for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if n.strip().lower() == b"content-length"]
                kind = fields.get(b"warc-type", b"").decode()
                rows.append(
                    (
                        file, start - len(_MAGIC), kind, number(fields.get(b"warc-record-id")),
                        fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None,
                        number(fields.get(b"warc-refers-to")),
                        fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:") or None,
                        number(sizes[0]) if sizes else None,
                        None if kind == "revisit" else payload,
                    )
                )
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in RECORD.split(", ")]
            )

    return parse


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``: file, offset, record_type, page_id, url, refers_to, digest, payload_length, payload.

    ``digest`` and ``payload_length`` are as the record states them; the payload of a revisit is null.
    Files are read in splits. A record whose payload holds the magic lies in several pieces, which are
    put together again; all others are taken from the scan without a shuffle of payloads, because
    the pieces that are not whole records are few and are left out by a join with their places.
    A file that does not start with the magic has no records, and a broken record ends its file.
    """
    pieces = materialise(_pieces(spark, path, False).drop("data"), "warc")
    reached = materialise(reached_records(pieces), "reached")
    known = reached.select("file", "block", "at", "start", "whole")
    bases = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + len(_MAGIC)).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(bases.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases")
    rest = pieces.select("file", "block", "at").join(known.where("whole").select("file", "block", "at"), ["file", "block", "at"], "left_anti")
    rest = materialise(rest, "rest")
    data = _pieces(spark, path, True).select("file", "block", "at", "data")
    single = data.join(rest, ["file", "block", "at"], "left_anti").join(bases, ["file", "block"])
    records = single.select("file", (F.col("base") + F.col("at")).alias("start"), "data")
    # pieces of records that go on over a magic: to the last record that starts at or before them
    split = rest.join(known.where("not whole"), ["file", "block", "at"], "left").join(bases, ["file", "block"])
    if known.where("not whole").take(1):
        order = Window.partitionBy("file").orderBy("here").rowsBetween(Window.unboundedPreceding, 0)
        whole_starts = known.where("whole").select("file", F.col("start").alias("here"), F.lit(None).cast("long").alias("start"), F.lit(True).alias("other"))
        loose = split.select("file", (F.col("base") + F.col("at")).alias("here"), "start", F.lit(False).alias("other"), "block", "at")
        # a whole record between ends the reach of the split one before it
        lines = loose.unionByName(whole_starts, allowMissingColumns=True)
        owner = F.last(F.when(F.col("other"), F.lit(-1)).otherwise(F.col("start")), ignorenulls=True).over(order)
        owned = lines.withColumn("owner", owner).where("not other and owner >= 0").select("file", "block", "at", "here", "owner")
        joined = data.join(materialise(owned, "owned"), ["file", "block", "at"])
        text = F.array_sort(F.collect_list(F.struct("here", "data")))
        glued = joined.groupBy("file", F.col("owner").alias("start")).agg(text.alias("parts"))
        together = F.aggregate(
            F.slice(F.col("parts"), F.lit(2), F.size("parts")),
            F.col("parts")[0]["data"],
            lambda acc, p: F.concat(acc, F.lit(_MAGIC), p["data"]),
        )
        records = records.union(glued.select("file", "start", together.alias("data")))
    return records.mapInArrow(_records(), RECORD)
