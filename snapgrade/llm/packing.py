"""Harmonic packing of token ids into sequences of a fixed capacity.

Piece lengths are partitioned into reciprocal-capacity classes: class j holds the lengths from which
exactly j pieces fit, that is floor(C/j) and what is above floor(C/(j+1)). Each worker fills the bins
of every class with j pieces, whatever other workers do. Documents may be cut, so a document's rest is
cut at the class sizes first and little of a slot stays empty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from snapgrade.llm.tokens import END_ID, column_names, encoder, vocabulary_path
from snapgrade.session import materialise

CAPACITY = 2048
PIECE_COST = 8  # tokens of padding that one more cut may save at least
FAN_IN = 32  # workers whose unfinished bins one worker of the next round takes
_FLUSH_BYTES = 4 << 20

SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, part int"
ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens")]
    + [("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int32())]
)


@lru_cache(maxsize=8)
def cuts(capacity: int, piece_cost: float) -> list[tuple[int, ...]]:
    """Piece lengths for each rest up to the capacity: least padding, a piece counting as some padding too.

    Every piece but the last fills a slot of its class.
    """
    waste = [0.0] + [capacity / (capacity // n) - n + piece_cost for n in range(1, capacity + 1)]
    slots = sorted({capacity // j for j in range(1, capacity + 1)})
    cost, table = [0.0], [()]
    for n in range(1, capacity + 1):
        best = min((s for s in slots if s < n), key=lambda s: waste[s] + cost[n - s], default=n)
        if best == n or waste[n] <= waste[best] + cost[n - best]:
            best = n
        cost.append(waste[best] + cost[n - best])
        table.append((best, *table[n - best]))
    return table


Piece = tuple  # doc_id, start, length, doc_tokens, ids


class Bins:
    """Open bins of one worker: per class less than j pieces, so less than the capacity in tokens."""

    def __init__(self, capacity: int, level: int, part: int):
        self.capacity, self.part = capacity, part
        self.next_id = (level << 59) | (part << 32)
        self.open: dict[int, list[Piece]] = {}
        self.out: list[tuple] = []
        self.out_bytes = 0

    def emit(self, pieces: Iterable[Piece], sequence: bool) -> None:
        offset = 0
        for piece in pieces:
            self.out.append((*piece, self.next_id if sequence else None, offset if sequence else None, self.part))
            self.out_bytes += 64 + len(piece[4])
            offset += piece[2]
        self.next_id += sequence

    def add(self, piece: Piece) -> None:
        count = self.capacity // piece[2]
        pieces = self.open.setdefault(count, [])
        pieces.append(piece)
        if len(pieces) == count:
            self.emit(self.open.pop(count), True)

    def close(self, last: bool) -> None:
        """Pass on what is in unfinished bins, or finish it: then pieces are cut wherever a sequence is full."""
        rest = [p for count in sorted(self.open) for p in self.open[count]]
        self.open = {}
        if not last:
            self.emit(rest, False)
            return
        room, sequence = self.capacity, []
        for doc, start, length, total, ids in rest:
            while length:
                take = min(room, length)
                sequence.append((doc, start, take, total, ids[: 4 * take]))
                start, length, ids, room = start + take, length - take, ids[4 * take :], room - take
                if not room:
                    self.emit(sequence, True)
                    room, sequence = self.capacity, []
        if sequence:
            self.emit(sequence, True)

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.out and self.out_bytes >= least:
            columns = zip(*self.out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW
            )
            self.out, self.out_bytes = [], 0


def _pack_documents(path: str, capacity: int, piece_cost: float, end_id: int):
    end = struct.pack("<I", end_id)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_ids, rests = encoder(path).text_ids, cuts(capacity, piece_cost)
        bins = Bins(capacity, 1, TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = text_ids(text.as_py()) + end
                total = len(ids) // 4
                full, rest = divmod(total, capacity)
                start = 0
                for length in (*[capacity] * full, *rests[rest]):
                    bins.add((doc_id.as_py(), start, length, total, ids[4 * start : 4 * (start + length)]))
                    start += length
                yield from bins.flush(_FLUSH_BYTES)
        bins.close(last=False)
        yield from bins.flush(0)

    return pack


def _pack_pieces(capacity: int, level: int, last: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, level, TaskContext.get().partitionId())
        for batch in batches:
            for piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bins.add(piece)
            yield from bins.flush(_FLUSH_BYTES)
        bins.close(last)
        yield from bins.flush(0)

    return pack


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    piece_cost: float = PIECE_COST,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers; ``doc_tokens`` counts the
    document's ids with its end id. Each id is in exactly one piece; a sequence's pieces follow each
    other from offset 0. A null or empty text is the end id alone; a null doc_id is kept; rows that
    repeat are packed each for itself; an empty table gives no rows.

    The bins of one worker are independent of all others. Pieces left in unfinished bins (under one
    bin per class and worker) go to a 32nd of the workers, and so on; only the last worker, which has
    at most what 32 workers left over, closes bins that aren't full.
    """
    pieces = docs.select(*column_names(docs, doc_id=doc_id, text=text)).mapInArrow(
        _pack_documents(path or vocabulary_path(), capacity, piece_cost, end_id), SCHEMA
    )
    rounds = [materialise(pieces, "pieces")]
    workers = (rounds[0].agg(F.max("part")).first()[0] or 0) + 1
    level, last = 2, False
    while not last:
        workers = -(-workers // FAN_IN)
        last = workers == 1
        left = rounds[-1].where(F.col("sequence_id").isNull()).select("doc_id", "start", "length", "doc_tokens", "ids")
        rounds.append(
            materialise(left.repartition(workers).mapInArrow(_pack_pieces(capacity, level, last), SCHEMA), "pieces")
        )
        level += 1
    result = rounds[0]
    for more in rounds[1:]:
        result = result.unionByName(more)
    return result.where(F.col("sequence_id").isNotNull()).drop("part")
