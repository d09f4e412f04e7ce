"""Fill-in-middle over texts kept as seekable compressed frames.

A text is stored as independent zstandard frames of a fixed number of code points, each with the number
of code points before it. A cut decompresses the frames it falls in and no others; a digest streams
the frames in the order of the output. A task so holds one frame of a text besides the compressed ones.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_type

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FRAME_UNITS = 1 << 15
LEVEL = 3

_STORED_ARROW = pa.struct(
    [
        ("units", pa.int64()),
        ("marked", pa.bool_()),
        ("frames", pa.list_(pa.struct([("first", pa.int64()), ("units", pa.int64()), ("data", pa.binary())]))),
    ]
)
_DIGESTS_ARROW = pa.struct([("output_sha256", pa.string()), ("restored_sha256", pa.string())])


class Frames:
    """The frames of one text, read by ranges of code points."""

    def __init__(self, frames: list[dict] | None) -> None:
        self.frames = frames or []
        self.firsts = [f["first"] for f in self.frames]
        self.reader = zstandard.ZstdDecompressor()

    def select(self, low: int, high: int) -> Iterator[bytes]:
        """UTF-8 pieces of the code points from ``low`` up to ``high``; other frames stay compressed."""
        at = max(bisect_right(self.firsts, low) - 1, 0)
        while low < high and at < len(self.frames):
            frame = self.frames[at]
            data = self.reader.decompress(frame["data"])
            first, end = frame["first"], frame["first"] + frame["units"]
            if low > first or high < end:
                data = data.decode("utf-8")[low - first : high - first].encode("utf-8")
            yield data
            low, at = end, at + 1


def frames_of(text: str, units: int = FRAME_UNITS, level: int = LEVEL) -> list[dict]:
    writer = zstandard.ZstdCompressor(level=level)
    cuts = range(0, len(text), units)
    pieces = ((at, text[at : at + units]) for at in cuts)
    return [{"first": at, "units": len(p), "data": writer.compress(p.encode("utf-8"))} for at, p in pieces]


def output_pieces(frames: Frames, form: str, units: int, low: int, high: int) -> Iterator[bytes]:
    """The output of one text, a frame at a time."""
    parts = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, units)}
    if form == "plain":
        yield from frames.select(0, units)
        return
    for mark in (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE):
        yield mark.encode()
        yield from frames.select(*parts[mark])


def _between_marks(pieces: Iterator[bytes], marks: tuple[str, ...]) -> Iterator[tuple[int, bytes]]:
    """(number of marks passed, bytes) of a stream in which each mark stands once, in this order."""
    wanted = [m.encode() for m in marks]
    passed, held = 0, b""
    for piece in pieces:
        held += piece
        while passed < len(wanted) and (at := held.find(wanted[passed])) >= 0:
            yield passed, held[:at]
            held = held[at + len(wanted[passed]) :]
            passed += 1
        # the start of a mark may end a piece
        ready = len(held) - (len(wanted[passed]) - 1 if passed < len(wanted) else 0)
        if ready > 0:
            yield passed, held[:ready]
            held = held[ready:]
    yield passed, held


def restored_pieces(output: Iterator[bytes], form: str, level: int = LEVEL) -> Iterator[bytes]:
    """The text again, from its output and form: the suffix is held compressed until the middle has passed."""
    if form == "plain":
        yield from output
        return
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    held, writer = [], zstandard.ZstdCompressor(level=level)
    for passed, piece in _between_marks(output, order):
        if passed and order[passed - 1] == SUFFIX:
            held.append(writer.compress(piece))
        else:
            yield piece
    reader = zstandard.ZstdDecompressor()
    for frame in held:
        yield reader.decompress(frame)


def _digest(pieces: Iterator[bytes]) -> str:
    total = sha256()
    for piece in pieces:
        total.update(piece)
    return total.hexdigest()


def stored(text: Column, units: int = FRAME_UNITS) -> Column:
    """A text as (units, marked, frames): its code points, whether it holds a mark, its frames; null is empty."""

    @F.arrow_udf(from_arrow_type(_STORED_ARROW))
    def frame(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            whole = value.as_py() or ""
            marked = any(m in whole for m in (PREFIX, SUFFIX, MIDDLE))
            rows.append({"units": len(whole), "marked": marked, "frames": frames_of(whole, units)})
        return pa.array(rows, _STORED_ARROW)

    return frame(text)


@F.arrow_udf(from_arrow_type(_DIGESTS_ARROW))
def _digests(store: pa.Array, form: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    rows = []
    for one, kind, start, end in zip(store, form, low, high, strict=True):
        row, kind = one.as_py(), kind.as_py()
        frames = Frames(row["frames"])
        output = lambda: output_pieces(frames, kind, row["units"], start.as_py(), end.as_py())  # noqa: B023, E731
        rows.append({"output_sha256": _digest(output()), "restored_sha256": _digest(restored_pieces(output(), kind))})
    return pa.array(rows, _DIGESTS_ARROW)


@F.arrow_udf(T.StringType())
def _outputs(store: pa.Array, form: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    texts = []
    for one, kind, start, end in zip(store, form, low, high, strict=True):
        row = one.as_py()
        pieces = output_pieces(Frames(row["frames"]), kind.as_py(), row["units"], start.as_py(), end.as_py())
        texts.append(b"".join(pieces).decode("utf-8"))
    return pa.array(texts, pa.string())


def store_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", units: int = FRAME_UNITS) -> DataFrame:
    """(doc_id, store) of every document, to be written as a table and read by ``cut_texts``."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), stored(F.col(f"`{text}`"), units).alias("store"))


def cut_texts(
    stores: DataFrame, *, plain_percent: int = 10, spm_percent: int = 20, salt: str = "1:"
) -> DataFrame:
    """Add n, form, low, high to (doc_id, store): where the two cuts fall and how the parts are put.

    Cuts and form follow from the hash of the salt and the doc_id alone, so copies of a row are cut alike; a
    null doc_id counts as an empty one. A text that is empty or holds a mark, and ``plain_percent`` of the others, stay
    plain, with both cuts at 0; ``spm_percent`` of the rest put the suffix first. Cuts are even over all
    n + 1 places and may coincide, so each part may be empty. Very long texts are cut like any other.
    """
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    part = lambda i: F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long")
    n = F.col("store.units")
    cuts = [part(0) % (n + 1), part(1) % (n + 1)]
    plain = (n == 0) | F.col("store.marked") | (part(2) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(part(3) % 100 < spm_percent, "spm").otherwise("psm")
    zero = F.lit(0).cast("long")
    return stores.select(
        "doc_id", "store", n.alias("n"), form.alias("form"),
        F.when(plain, zero).otherwise(F.least(*cuts)).alias("low"), F.when(plain, zero).otherwise(F.greatest(*cuts)).alias("high"),
    )


def outputs(cut: DataFrame) -> DataFrame:
    """(doc_id, form, output): the training texts."""
    return cut.select("doc_id", "form", _outputs("store", "form", "low", "high").alias("output"))


def digests(cut: DataFrame) -> DataFrame:
    """(doc_id, n, form, low, high, output_sha256, restored_sha256), streamed from the frames."""
    return cut.withColumn("_digests", _digests("store", "form", "low", "high")).select(
        "doc_id", "n", "form", "low", "high", "_digests.output_sha256", "_digests.restored_sha256"
    )
