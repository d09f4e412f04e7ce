"""Similarity join on word shingles: the grouped prefix join, made for corpora with hot shingles and copies.

A document is the set of its distinct shingles of five words, each a 64-bit hash. Shingles have one order
for all documents: those with a partner nowhere else, then by the number of documents that have them,
then the heavy ones. Two sets of Jaccard similarity p or more share a shingle among the first n - ceil(p n) + 1
of each (their prefixes).

* A bounded sketch of the occurrences of all shingles tells the heavy ones, which stay with their documents;
  a shingle that a third of all documents share so never meets in one task.
* The others are dealt out by hash slices, in packed blocks of many documents. A slice counts its shingles
  and sends back those that two documents or more have. A document whose other shingles fill its
  prefix has no partner; most end here. The others get their prefix.
* Equal sets are one set from here on. Sets of equal size and prefix are one group. Groups that meet at
  a shingle are filtered by size and by the positions at which they meet, then expanded to their
  members, which are verified on their whole sets.
* First each shingle's list is compared with one group of it only, which links most of a family of near
  copies in linear work. Then only pairs of different components are left to compare, set by set, and all
  of these are that parity marks of the sets don't rule out.

Hashes below the heavy ones are compared by 44 bits or more (12 to choose a slice, 32 in it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from snapgrade.llm.components import components
from snapgrade.session import materialise, scratch_path

SHINGLE_WORDS = 5
PERCENT = 80
SKETCH_BITS = 18  # counters of the sketch: 2 MB
HEAVY = 8  # a shingle is heavy if its counter passes this many times the mean, and
HEAVY_LEAST = 64  # this
BLOCK_SHINGLES = 1 << 20
BLOCK_DOCUMENTS = 1 << 15
SLICES = 1 << 12  # at least
SLICE_SHINGLES = 1 << 23
STAR_ROUNDS = 1
MARK_WORDS = 8  # 64-bit words of the parity marks of a set
_PIECE_BYTES = 2 << 20  # of text hashed at once
_MOST = (1 << 32) - 1
_OWN, _META = -1, -2  # rows of a block that no slice gets: heavy shingles, and facts about its documents

_U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well-spread bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses


def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(count, np.uint64)
    out[0] = 1
    done = 1
    while done < count:
        step = min(done, count - done)
        with np.errstate(over="ignore"):
            out[done : done + step] = out[:step] * _U64(pow(base, done, 1 << 64))
        done += step
    return out


class Hasher:
    """Hashes of words and shingles, by whole arrays."""

    def __init__(self, words: int = SHINGLE_WORDS) -> None:
        self.words = words
        self.up = self.down = np.empty(0, np.uint64)

    def _room(self, count: int) -> None:
        if len(self.up) < count:
            size = max(count, _PIECE_BYTES)
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)

    def _piece_words(self, data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word; ``firsts`` are the places at which texts begin."""
        self._room(len(data) + 1)
        space = _SPACE[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = space[:-1]
        edge[firsts] = True
        starts = np.flatnonzero(~space & edge[:-1])
        ends = np.flatnonzero(~space & np.append(space[1:] | edge[1:-1], True)) + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[_LOWER[data]] * self.up[: len(data)], out=sums[1:])
            value = (sums[ends] - sums[starts]) * self.down[starts]
            return _mix(value + (ends - starts).astype(np.uint64) * _U64(0xD6E8FEB86659FD93)), starts

    def word_hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in order, and the number of words of each text."""
        hashes, places = [], []
        at, size = 0, len(data)
        while at < size:
            end = min(at + _PIECE_BYTES, size)
            # cut behind a blank, so that no word is cut; a longer word is taken whole
            while end < size and not (blank := np.flatnonzero(_SPACE[data[at:end]])).size:
                end = min(end + _PIECE_BYTES, size)
            if end < size:
                end = at + int(blank[-1]) + 1
            inside = offsets[(offsets >= at) & (offsets < end)] - at
            found, starts = self._piece_words(data[at:end], inside)
            hashes.append(found)
            places.append(starts + at)
            at = end
        if not hashes:
            return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
        bounds = np.searchsorted(np.concatenate(places), offsets)
        return np.concatenate(hashes), np.diff(bounds)

    def shingles(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of all shingles, repeats included; a text of fewer words has one, of all of them."""
        words, counts = self.word_hashes(data, offsets)
        firsts = np.cumsum(counts) - counts
        full = self.words
        with np.errstate(over="ignore"):
            key = lambda k: _U64(pow(_BASE, k + 1, 1 << 64))
            total = len(words)
            sums = np.zeros(max(total - full + 1, 0), np.uint64)
            for k in range(full):
                sums += words[k : k + len(sums)] * key(k)
            text = np.repeat(np.arange(len(counts)), counts)
            left = np.repeat(firsts + counts, counts) - np.arange(total)
            whole = left[: len(sums)] >= full
            values, owners = [sums[whole] + _U64(full)], [text[: len(sums)][whole]]
            for size in range(1, full):
                at = np.flatnonzero(counts == size)
                if len(at):
                    short = sum((words[firsts[at] + k] * key(k) for k in range(size)), np.zeros(len(at), np.uint64))
                    values.append(short + _U64(size))
                    owners.append(at)
        return _mix(np.concatenate(values)), np.concatenate(owners)


def _text_runs(batch: pa.RecordBatch, most_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, last row) of runs of the batch's texts; a null text has no bytes."""
    texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, last
        first = last


def _sketch(words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counters = Hasher(words), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for data, offsets, _, _ in _text_runs(batch, _PIECE_BYTES):
                hashes, _ = hasher.shingles(data, offsets)
                counters += np.bincount((hashes >> _U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counters))
        parts = counters.reshape(64, -1)
        yield pa.record_batch({"part": pa.array(range(64), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})

    return count


def _add_up(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), np.int64) for c in group.column("counts"))
    return pa.table({"part": group.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _heavy_counters(texts: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """Which counters of the sketch are heavy, and the number of all shingles, repeats included."""
    partial = texts.mapInArrow(_sketch(words), "part int, counts binary")
    rows = partial.groupBy("part").applyInArrow(_add_up, "part int, counts binary").orderBy("part").collect()  # 64 rows, 2 MB
    counters = np.concatenate([np.frombuffer(r.counts, np.int64) for r in rows]) if rows else np.zeros(1 << SKETCH_BITS, np.int64)
    return counters > max(HEAVY_LEAST, HEAVY * counters.mean()), int(counters.sum())


_BLOCK = "block long, slice long, docs binary, shingles binary, counts binary, ids binary"
_BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("slice", pa.int64()), *((c, pa.binary()) for c in ("docs", "shingles", "counts", "ids"))]
)


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCK_ARROW, strict=True)], schema=_BLOCK_ARROW
    )


def _packed(docs: np.ndarray) -> bytes:
    """Ascending document numbers as differences, all low bytes before all high ones, which compresses well."""
    steps = np.diff(docs.astype(np.uint16), prepend=np.uint16(0)).astype("<u2")
    return steps.view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(data, np.uint8).reshape(2, -1).astype(np.int64)
    return np.cumsum(low | high << 8)


class Blocks:
    """Documents' distinct shingles, packed by slice for up to a number of documents and shingles at a time."""

    def __init__(self, heavy: np.ndarray, slices: int) -> None:
        self.heavy, self.slices = heavy, slices
        self.next_id = TaskContext.get().partitionId() << 32
        self.clear()

    def clear(self) -> None:
        self.ids: list = []
        self.hashes: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, hashes: np.ndarray, docs: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.docs.append(docs + len(self.ids))
        self.ids += ids
        self.size += len(hashes)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        hashes, docs = np.concatenate(self.hashes), np.concatenate(self.docs)
        order = np.lexsort((hashes, docs))
        hashes, docs = hashes[order], docs[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
        hashes, docs = hashes[new], docs[new]
        n = np.bincount(docs, minlength=len(self.ids))
        # two sums over a set's shingles name the set
        names = np.zeros((2, len(n) + 1), np.uint64)
        ends = np.concatenate(([0], np.cumsum(n)))
        with np.errstate(over="ignore"):
            for row, seed in enumerate((0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407)):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(hashes ^ _U64(seed)))))
                names[row, :-1] = sums[ends[1:]] - sums[ends[:-1]]
        heavy = self.heavy[hashes >> _U64(64 - SKETCH_BITS)]
        block, rows = self.next_id, []
        self.next_id += 1
        known = pa.array(self.ids, pa.int64())
        valid = np.array([i is not None for i in self.ids], np.uint8)
        rows.append(
            (block, _META, valid.tobytes(), names[:, :-1].tobytes(), n.astype(np.int64).tobytes(), known.fill_null(0).to_numpy().tobytes())
        )
        own = -1 - (hashes[heavy] >> _U64(1)).astype(np.int64)
        rows.append((block, _OWN, _packed(docs[heavy]), own.tobytes(), None, None))
        hashes, docs = hashes[~heavy], docs[~heavy]
        where = (_mix(hashes) % _U64(self.slices)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        where, low, docs = where[order], hashes[order].astype(np.uint32), docs[order]
        cuts = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(where)])) if len(where) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows.append((block, int(where[a]), _packed(docs[a:b]), low[a:b].tobytes(), None, None))
        for at in range(0, len(rows), 8192):
            yield _block_rows(rows[at : at + 8192])
        self.clear()


def _pack(words: int, heavy: np.ndarray, slices: int):
    packed = np.packbits(heavy)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, blocks = Hasher(words), Blocks(np.unpackbits(packed).astype(bool), slices)
        for batch in batches:
            ids = batch.column(0)
            for data, offsets, first, last in _text_runs(batch, _PIECE_BYTES):
                for low in range(first, last, BLOCK_DOCUMENTS):
                    high = min(low + BLOCK_DOCUMENTS, last)
                    span = offsets[low - first : high - first + 1]
                    hashes, docs = hasher.shingles(data[span[0] : span[-1]], span - span[0])
                    if len(blocks.ids) + high - low > BLOCK_DOCUMENTS or blocks.size + len(hashes) > BLOCK_SHINGLES:
                        yield from blocks.flush()
                    blocks.add(ids[low:high].to_pylist(), hashes, docs)
        yield from blocks.flush()

    return pack


def _shared(group: pa.Table) -> pa.Table:
    """Of one slice's shingles, those of two documents or more, with their counts, for every block."""
    low = [np.frombuffer(x.as_py(), np.uint32) for x in group.column("shingles")]
    docs = [_unpacked(x.as_py()) for x in group.column("docs")]
    every = np.concatenate(low)
    _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    counts = counts[inverse]
    rows, at = [], 0
    slice_id = group.column("slice")[0].as_py()
    for block, mine, owners in zip(group.column("block").to_pylist(), low, docs, strict=True):
        number = counts[at : at + len(mine)]
        at += len(mine)
        keep = number > 1
        if keep.any():
            few = np.minimum(number[keep], _MOST).astype(np.uint32)
            rows.append((block, slice_id, _packed(owners[keep]), mine[keep].tobytes(), few.tobytes(), None))
    return pa.Table.from_batches([_block_rows(rows)] if rows else [], schema=_BLOCK_ARROW)


SETS = "doc_id long, n long, set string, alone long, shingles array<long>, marks array<long>"
_SETS_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.string()), ("alone", pa.int64()),
        ("shingles", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())),
    ]
)


def _marks(docs: np.ndarray, shingles: np.ndarray, count: int) -> pa.Array:
    """Per document, for each of some classes of shingles, whether it has an odd number of them."""
    bits = 64 * MARK_WORDS
    cell = docs.astype(np.int64) * bits + (_mix(shingles.view(np.uint64)) % _U64(bits)).astype(np.int64)
    cells, number = np.unique(cell, return_counts=True)
    words = np.zeros(count * MARK_WORDS, np.uint64)
    odd = cells[number % 2 == 1]
    np.bitwise_or.at(words, odd // 64, _U64(1) << (odd % 64).astype(np.uint64))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, MARK_WORDS), pa.int32()), pa.array(words.view(np.int64)))


def _assemble(percent: int) -> Callable[[pa.Table], pa.Table]:
    def assemble(group: pa.Table) -> pa.Table:
        """A block's documents, those that can have a partner with their shared shingles in the global order."""
        rows = group.to_pylist()
        meta = next(r for r in rows if r["slice"] == _META)
        n = np.frombuffer(meta["counts"], np.int64)
        ids, valid = np.frombuffer(meta["ids"], np.int64), np.frombuffer(meta["docs"], np.uint8).astype(bool)
        names = np.frombuffer(meta["shingles"], np.uint64).reshape(2, -1)
        parts = [r for r in rows if r["slice"] != _META]
        docs = np.concatenate([_unpacked(r["docs"]) for r in parts])
        shingles = np.concatenate(
            [
                np.frombuffer(r["shingles"], np.int64) if r["slice"] == _OWN
                else np.frombuffer(r["shingles"], np.uint32).astype(np.int64) | r["slice"] << 32
                for r in parts
            ]
        )
        # heavy shingles come last
        counts = np.concatenate(
            [np.frombuffer(r["counts"], np.uint32) if r["counts"] is not None else np.full(len(r["docs"]) // 2, _MOST + 1) for r in parts]
        )
        alone = n - np.bincount(docs, minlength=len(n))
        able = (alone <= n - (percent * n + 99) // 100) & (n > 0)
        keep = able[docs]
        order = np.lexsort((shingles[keep], counts[keep], docs[keep]))
        docs, shingles = docs[keep][order], shingles[keep][order]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=len(n)))))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(shingles, pa.int64()), mask=pa.array(~able))
        marks = _marks(docs, shingles, len(n))
        return pa.Table.from_arrays(
            [
                pa.array(ids, pa.int64(), mask=~valid), pa.array(n, pa.int64()),
                pa.array([f"{a:016x}{b:016x}" for a, b in names.T.tolist()], pa.string()), pa.array(alone, pa.int64()), lists, marks,
            ],
            schema=_SETS_ARROW,
        )

    return assemble


def shingle_sets(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per document: doc_id, n, set, alone, shingles.

    ``n`` is the number of distinct shingles, ``set`` names the set (equal sets have equal names), ``alone``
    counts the shingles that no other document has. ``shingles`` are the others, in the global order;
    null where ``alone`` leaves no room for a partner of the similarity asked for. ``marks`` are parity bits of them.
    The rows are a table; the blocks that they come from, the largest table of the operator, are emptied.
    """
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    heavy, total = _heavy_counters(texts, words)
    slices = max(SLICES, total // SLICE_SHINGLES)
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "blocks")
    texts.mapInArrow(_pack(words, heavy, slices), _BLOCK).write.parquet(path)
    blocks = spark.read.schema(_BLOCK).parquet(path)
    shared = blocks.where("slice >= 0").groupBy("slice").applyInArrow(_shared, _BLOCK)
    rows = shared.unionByName(blocks.where("slice < 0"))
    sets = materialise(rows.groupBy("block").applyInArrow(_assemble(percent), SETS), "sets")
    spark.createDataFrame([], _BLOCK).write.mode("overwrite").parquet(path)
    return sets


def _required(na: Column, nb: Column, percent: int) -> Column:
    """Least number of shared shingles of two sets of these sizes."""
    return F.ceil(F.lit(percent) * (na + nb) / (100 + percent))


def _can_meet(a: str, b: str, percent: int) -> Column:
    """Whether sets that first meet at these positions can be similar: by size, and by what stands behind."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    behind = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    size = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    return size & (behind >= _required(na, nb, percent))


def _marks_allow(a: str, b: str, percent: int) -> Column:
    """Whether two sets can be similar by their marks: each class in which they differ, and each shingle
    that one of them has alone, is a difference."""
    differ = reduce(add, (F.bit_count(F.col(f"{a}.marks")[i].bitwiseXOR(F.col(f"{b}.marks")[i])) for i in range(MARK_WORDS)))
    size = F.col(f"{a}.n") + F.col(f"{b}.n")
    known = F.col(f"{a}.alone") + F.col(f"{b}.alone") + differ
    return known <= size - 2 * _required(F.col(f"{a}.n"), F.col(f"{b}.n"), percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that are similar."""
    side = lambda x: sets.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def similar_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of every set that links reach; ``sets(set, n, alone, shingles, marks)``, each set once."""
    reach = (F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - F.col("alone")).cast("int")
    prefixed = sets.withColumn("prefix", F.slice("shingles", 1, F.greatest(reach, F.lit(0))))
    groups = prefixed.groupBy("n", "alone", "prefix").agg(
        F.min("set").alias("group"), F.count(F.lit(1)).alias("members")
    )
    groups = materialise(groups, "groups")
    at = ["n", "alone", "prefix"]
    member = materialise(prefixed.join(groups, at).select("set", "group"), "members")
    entries = groups.select("n", "group", "alone", "members", F.posexplode("prefix").alias("at", "shingle")).select(
        "shingle", "group", "members", "n", (F.col("at") + F.col("alone")).alias("pos")
    )
    # lists of more than one set
    first = entries.groupBy("shingle").agg(F.min(_spot("group")).alias("f"), F.sum("members").alias("size"))
    entries = materialise(
        entries.join(first.where("size > 1").select("shingle", "f"), "shingle").select("shingle", F.struct("group", "n", "pos").alias("e"), "f"),
        "entries",
    )
    # linear work: every list against one group of it, every group's members against its first set
    starred = entries.where((F.col("e.group") != F.col("f.group")) & _can_meet("e", "f", percent))
    starred = starred.select(F.col("f.group").alias("a"), F.col("e.group").alias("group")).distinct().join(member, "group")
    inside = member.where("set <> `group`").select(F.col("group").alias("a"), F.col("set").alias("b"))
    pairs = starred.select("a", F.col("set").alias("b")).unionByName(inside).distinct()
    links = materialise(_verified(pairs, sets, percent), "links")
    # the same again, every list against one of its components, drawn anew
    for turn in range(STAR_ROUNDS):
        parts, spread = _open_lists(entries, member, links)
        drawn = _spot("e.group", "e.part", "shingle", F.lit(turn), part=F.col("e.part"))
        first = spread.groupBy("shingle").agg(F.min(drawn).alias("f"))
        starred = spread.join(first, "shingle").where((F.col("e.part") != F.col("f.part")) & _can_meet("e", "f", percent))
        links = materialise(links.unionByName(_verified(_expanded(starred, parts, "f", "e"), sets, percent)), "links")
    # what is left: pairs of different components in one list
    parts, spread = _open_lists(entries, member, links)
    marked = parts.join(prefixed.select("set", "alone", "marks", "prefix"), "set").select(
        F.col("group").alias("_group"), F.col("part").alias("_part"), "set", "alone", "marks", "prefix"
    )
    spread = spread.join(marked, (F.col("e.group") == F.col("_group")) & (F.col("e.part") == F.col("_part")))
    left = _across(spread.select("shingle", "e.n", "e.pos", "e.part", "set", "alone", "marks", "prefix"), percent)
    return components(links.unionByName(_verified(left, sets, percent)))


def _across(listed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that can be similar; each pair where it first meets, so one
    row however many lists both sets are in. ``listed(shingle, n, pos, part, set, alone, marks, prefix)``."""
    before = F.slice("prefix", 1, (F.col("pos") - F.col("alone")).cast("int")).alias("before")
    side = lambda name: listed.select("shingle", F.struct("n", "pos", "part", "set", "alone", "marks", before).alias(name))
    may = (F.col("x.part") < F.col("y.part")) & _can_meet("x", "y", percent) & _marks_allow("x", "y", percent)
    met = side("x").join(side("y"), "shingle").where(may & ~F.arrays_overlap("x.before", "y.before"))
    return met.select(F.col("x.set").alias("a"), F.col("y.set").alias("b"))


def _spot(group: str, *seed: str | Column, part: Column | None = None) -> Column:
    """A group's place in a list, for the least by hash of the seed."""
    prefix = group[: -len("group")]
    columns = [F.col(f"{prefix}{c}").alias(c) for c in ("group", "n", "pos")]
    return F.struct(F.xxhash64(*(seed or (group,))).alias("h"), *columns, *([part.alias("part")] if part is not None else []))


def _open_lists(entries: DataFrame, member: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set, group, part) by the components of the links so far, and the lists in which several parts meet."""
    roots = components(links).withColumnRenamed("node", "set")
    parts = materialise(
        member.join(roots, "set", "left").select("set", "group", F.coalesce("root", "set").alias("part")), "parts"
    )
    kinds = parts.select("group", "part").distinct()
    spread = entries.select("shingle", "e").join(kinds, F.col("e.group") == F.col("group")).select(
        "shingle", F.struct("e.group", "e.n", "e.pos", "part").alias("e")
    )
    several = spread.groupBy("shingle").agg(F.min("e.part").alias("low"), F.max("e.part").alias("high")).where("low <> high")
    return parts, materialise(spread.join(several.select("shingle"), "shingle", "left_semi"), "open")


def _expanded(met: DataFrame, parts: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs (a, b) of sets from pairs of (group, part) that meet."""
    of = lambda side, s: parts.select(
        F.col("group").alias(f"group_{side}"), F.col("part").alias(f"part_{side}"), F.col("set").alias(s)
    )
    ends = met.select(*(F.col(f"{c}.{f}").alias(f"{f}_{side}") for side, c in (("x", x), ("y", y)) for f in ("group", "part")))
    pairs = ends.distinct().join(of("x", "a"), ["group_x", "part_x"]).join(of("y", "b"), ["group_y", "part_y"])
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Two documents link when ``100 * intersection >= percent * union`` of their shingles (A-Z in lower case, split
    at ASCII blanks); a component is all that links reach, and component_id its smallest doc_id. Texts with the
    same words are one set and linked. A text of fewer words than a shingle is one shingle of all its words. A
    null or empty text, or one of blanks, has no shingle and is alone: its component_id is its own doc_id. A
    null doc_id counts as none, so a component only of such rows has a null id. Repeated rows give a row each;
    an empty table none; further columns are ignored. Texts of any length are taken whole.
    """
    rows = shingle_sets(docs, doc_id=doc_id, text=text, words=words, percent=percent)
    able = rows.where(F.col("shingles").isNotNull())
    sets = able.groupBy("set").agg(*(F.first(c).alias(c) for c in ("n", "alone", "shingles", "marks")))
    roots = materialise(similar_sets(materialise(sets, "distinct-sets"), percent), "roots")
    known = rows.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"))
    placed = known.join(roots, F.col("set") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = materialise(placed.join(least, "root").select(F.col("set").alias("_set"), "component_id"), "set-components")
    joined = rows.join(by_set, F.col("set") == F.col("_set"), "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
