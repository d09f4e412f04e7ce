"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a context tree over the bytes before it, up to
DEPTH. A node counts the zeros and ones seen in its context; its Krichevsky-Trofimov estimate is mixed
half and half with the product of its children's, which gives every node a weight against what lies
below it. The counts come from all learning texts, and every node counts, however many there are.

No task holds the whole tree. Texts go in batches with the distinct grams of DEPTH + 1 bytes that they
have, dealt to buckets by their nearest context bytes. Where a bucket's grams are, their subtrees are
weighted and the grams of all texts scored; only the nodes above, of up to two context bytes, go to the
driver and from there to all tasks. Then each batch gets the scores of its grams and sums its texts'. A
context that no learning text has predicts like the next shorter one.

The words of the unigram base go the same way: a batch sends its distinct words, in slices of their hashes, and
gets their counts. Grams and words do not come back with scores and counts: a batch's texts give them
again, in the same order.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from snapgrade.session import materialise

DEPTH = 6  # at most 6: a gram and its depth are one 64-bit number
LOCAL_DEPTH = 3  # nodes of this depth and below are weighted in one task per subtree
SLOT_BITS = 22  # of a node's 54-bit key; no two nodes share a key but by chance
END = 0xFF  # a byte that UTF-8 never has ends a text, and stands before its start

_CHUNK = 1 << 20
_MERGE = 1 << 21
_SUBTREE_GRAMS = 1 << 17
_AT_ONCE = 1 << 16
_TEXTS = 500
_BATCH_GRAMS = 1 << 21  # distinct grams at which a batch of texts ends
_BATCH_BYTES = 1 << 25
_BATCH_WORDS = 1 << 19  # distinct words at which it ends
_BUCKET_BITS = 12
_SLICE_BITS = 12
_HASH = np.uint64(0x9E3779B97F4A7C15)
_TABLE = 4096
_U = np.uint64


def normal_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return text.encode("utf-8").lower().split() if text else []


def _items(texts: Iterable[bytes], depth: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(number of the text, bytes before, bytes to code): texts with their end, long ones in chunks."""
    for i, text in enumerate(texts):
        body, before = text + bytes([END]), bytes([END]) * depth
        for at in range(0, len(body), _CHUNK):
            yield i, before, body[at : at + _CHUNK]
            before = body[at : at + _CHUNK][-depth:].rjust(depth, bytes([END])) if depth else b""


def _grams(items: list[tuple[int, bytes, bytes]], depth: int) -> np.ndarray:
    """One number per coded byte: itself in the low 8 bits, the byte before in the next, and so on."""
    data = np.frombuffer(b"".join(before + body for _, before, body in items), np.uint8).astype(np.uint64)
    grams = data.copy()
    for k in range(1, depth + 1):
        grams[k:] |= data[: len(data) - k] << _U(8 * k)
    ends = np.cumsum([depth + len(body) for _, _, body in items])
    coded = np.ones(len(data), bool)
    for start in np.concatenate(([0], ends[:-1])):
        coded[start : start + depth] = False
    return grams[coded]


def gram_batches(texts: Iterable[bytes], depth: int) -> Iterator[tuple[list, np.ndarray]]:
    """Items and their grams, a bounded number of bytes at a time."""
    held, size = [], 0
    for item in _items(texts, depth):
        held.append(item)
        size += len(item[2])
        if size >= _CHUNK:
            yield held, _grams(held, depth)
            held, size = [], 0
    if held:
        yield held, _grams(held, depth)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def _log_gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(_TABLE)
    half = np.concatenate(([0.0], np.cumsum(np.log(k[1:] - 0.5)))) + 0.5 * math.log(math.pi)
    whole = np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))
    return half, whole


_HALF, _WHOLE = _log_gamma_tables()


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of that many zeros and ones."""

    def half(n: np.ndarray) -> np.ndarray:  # log gamma(n + 1/2)
        return np.where(n < _TABLE, _HALF[np.minimum(n, _TABLE - 1)], _stirling(np.maximum(n, 1) + 0.5))

    total = zeros + ones
    whole = np.where(total < _TABLE, _WHOLE[np.minimum(total, _TABLE - 1)], _stirling(total + 1.0))
    return half(zeros) + half(ones) - math.log(math.pi) - whole


def level_counts(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one depth: key (context bytes, then the bits of the byte so far behind a 1), zeros, ones."""
    short, place = np.unique(grams & _U((1 << (8 * (depth + 1))) - 1), return_inverse=True)
    n = np.bincount(place, weights=counts, minlength=len(short))
    byte, context = (short & _U(255)).astype(np.int64), short >> _U(8) << _U(8)
    keys = np.concatenate([context | ((1 << j) | (byte >> (8 - j))).astype(np.uint64) for j in range(8)])
    bits = np.concatenate([(byte >> (7 - j)) & 1 for j in range(8)])
    node, place = np.unique(keys, return_inverse=True)
    ones = np.bincount(place, weights=np.tile(n, 8) * bits, minlength=len(node)).astype(np.int64)
    return node, np.bincount(place, weights=np.tile(n, 8), minlength=len(node)).astype(np.int64) - ones, ones


def parent_keys(nodes: np.ndarray, depth: int) -> np.ndarray:
    """Keys one level up: without the oldest byte of the context."""
    return nodes & _U((1 << (8 * depth)) - 1)


def weigh(levels: dict[int, tuple], below: tuple[np.ndarray, np.ndarray] | None) -> dict[int, tuple]:
    """From the deepest level up: (nodes, zeros, ones, log of the node's weight against its children, log mixed).

    ``below`` has the sums of the children's log probability for the nodes of the deepest level; None
    if that level has no children.
    """
    weighed = {}
    for depth in sorted(levels, reverse=True):
        nodes, zeros, ones = levels[depth]
        own = log_kt(zeros, ones)
        if depth + 1 in weighed:
            child_nodes, *_, child_mixed = weighed[depth + 1]
            place = np.searchsorted(nodes, parent_keys(child_nodes, depth + 1))
            children = np.bincount(place, weights=child_mixed, minlength=len(nodes))
        elif below is not None:
            children = np.zeros(len(nodes))
            children[np.searchsorted(nodes, below[0])] = below[1]
        else:
            weighed[depth] = (nodes, zeros, ones, np.full(len(nodes), np.inf), own)
            continue
        weighed[depth] = (nodes, zeros, ones, own - children, np.logaddexp(own, children) - math.log(2))
    return weighed


def _slots(nodes: np.ndarray, depth: int, slot_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and 32-bit tag of each node."""
    mixed = (nodes | _U(depth + 1) << _U(56)) * _HASH
    mixed = (mixed ^ (mixed >> _U(29))) * _HASH
    return (mixed >> _U(64 - slot_bits)).astype(np.int64), (mixed >> _U(64 - slot_bits - 32)).astype(np.uint32)


NODE = pa.schema(
    [(n, pa.int64()) for n in ("slot", "rank", "payload")]
    + [("weight", pa.float32()), ("children", pa.float64())]
)
NODE_SCHEMA = "slot long, rank long, payload long, weight float, children double"


def node_rows(weighed: dict[int, tuple], above: tuple | None, slot_bits: int) -> Iterator[pa.RecordBatch]:
    """Table rows of all nodes: slot, rank, tag and smaller probability, log weight.

    Slot and tag are a node's key. The rank is what a node saves: how much shorter its own estimate
    codes its data than its parent's does. ``above`` is the level over the first one.
    """
    for depth, (nodes, zeros, ones, weight, _) in sorted(weighed.items()):
        parents = weighed.get(depth - 1, above)
        if depth and parents is not None:
            place = np.searchsorted(parents[0], parent_keys(nodes, depth))
            one = (parents[2][place] + 0.5) / (parents[1][place] + parents[2][place] + 1.0)
            saved = np.maximum(log_kt(zeros, ones) - zeros * np.log1p(-one) - ones * np.log(one), 0)
        else:
            saved = np.full(len(nodes), 2.0**30)
        slot, tag = _slots(nodes, depth, slot_bits)
        rank = np.minimum(saved * 1024, 2.0**40).astype(np.int64) << 22 | (tag & np.uint32((1 << 22) - 1)).astype(np.int64)
        # the probability of the rarer bit; below zero if that is the zero
        less = (np.minimum(zeros, ones) + 0.5) / (zeros + ones + 1.0)
        signed = np.where(ones <= zeros, less, -less).astype(np.float32)
        payload = (tag.astype(np.uint64) << _U(32) | signed.view(np.uint32).astype(np.uint64)).view(np.int64)
        columns = [pa.array(slot), pa.array(rank), pa.array(payload), pa.array(np.clip(weight, -60, 60).astype(np.float32))]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(nodes), pa.float64())], schema=NODE)


class ContextModel:
    """Nodes by key; predicts grams. ``above`` has the nodes of less than LOCAL_DEPTH context bytes, if not these."""

    def __init__(
        self, depth: int, slot_bits: int, slot: np.ndarray, payload: np.ndarray, weight: np.ndarray,
        above: ContextModel | None = None,
    ):
        self.depth, self.slot_bits, self.above = depth, slot_bits, above
        bits = payload.view(np.uint64)
        keys = slot.astype(np.uint64) << _U(32) | bits >> _U(32)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.rare = (bits[order] & _U(0xFFFFFFFF)).astype(np.uint32).view(np.float32)
        self.weight = np.exp(weight[order])  # against what lies below, not its log

    def find(self, nodes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places among ``nodes`` of those there are, the signed probability of the rarer bit, weight."""
        if self.above is not None and depth < LOCAL_DEPTH:
            return self.above.find(nodes, depth)
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        slot, tag = _slots(nodes, depth, self.slot_bits)
        keys = slot.astype(np.uint64) << _U(32) | tag
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == keys)
        return hit, self.rare[place[hit]].astype(np.float64), self.weight[place[hit]]

    def log10_of(self, grams: np.ndarray) -> np.ndarray:
        """Log10 of the probability of each gram's last byte after the others."""
        total = np.zeros(len(grams))
        byte = (grams & _U(255)).astype(np.int64)
        for j in range(8):
            part = ((1 << j) | (byte >> (8 - j))).astype(np.uint64)
            one = ((byte >> (7 - j)) & 1).astype(bool)
            mixed, deeper = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
            for depth in range(self.depth, -1, -1):
                keys = grams >> _U(8) << _U(8) & _U((1 << (8 * (depth + 1))) - 1) | part
                hit, rare, weight = self.find(keys, depth)
                estimate = np.abs(rare)
                estimate = np.where((rare > 0) == one[hit], estimate, 1 - estimate)
                # the deepest context that there is predicts by itself
                mixed[hit] = np.where(deeper[hit], (weight * estimate + mixed[hit]) / (weight + 1), estimate)
                deeper[hit] = True
            total += np.log10(mixed)
        return total


def _count_grams(depth: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def emit(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(key), 1 << 18):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at : at + (1 << 18)].view(np.int64)), pa.array(n[at : at + (1 << 18)])], names=["gram", "n"]
                )

        for batch in batches:
            for _, grams in gram_batches((b" ".join(normal_words(t)) for t in batch.column(0).to_pylist()), depth):
                key, n = np.unique(grams, return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > _MERGE:
                    key, n = merged(keys, counts)
                    if len(key) > _MERGE // 2:
                        yield from emit(key, n)
                        key, n = key[:0], n[:0]
                    keys, counts, held = [key], [n], len(key)
        if keys:
            yield from emit(*merged(keys, counts))

    return count


def _packed(values: np.ndarray) -> bytes:
    """Rising numbers as compressed differences, byte by byte."""
    return zlib.compress(np.diff(values, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel())


def _joined(texts: Iterable[bytes]) -> bytes:
    """Texts, each with its end, compressed together."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(t + bytes([END]) for t in texts))


def _parted(data: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).split(bytes([END]))[:-1]


def _packed_scores(scores: np.ndarray) -> bytes:
    """Scores byte by byte: the first two bytes of each compress."""
    return zlib.compress(scores.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked_scores(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.float32).ravel()


def _buckets(grams: np.ndarray) -> np.ndarray:
    """Grams with the same nearest context bytes share a bucket."""
    near = grams >> _U(8) & _U((1 << (8 * LOCAL_DEPTH)) - 1)
    return (near * _HASH >> _U(64 - _BUCKET_BITS)).astype(np.int32)


def _by_bucket(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket of grams that rise, and the buckets in that order."""
    bucket = _buckets(grams)
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    return order, bucket[order]


def _spans(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal numbers."""
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(places), 1), bool), places[1:] != places[:-1])))
    return starts, np.append(starts[1:], len(places)).astype(np.int64)


def _hashes(words: Iterable[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64)


class _Batch:
    """Texts with their distinct grams and words, and how often learning texts have these."""

    def __init__(self, number: int, depth: int):
        self.number, self.depth, self.bytes = number, depth, 0
        self.texts: list[tuple[int | None, bool, bytes]] = []
        self.words: Counter[bytes] = Counter()
        self.new: dict[bool, list] = {False: [], True: []}
        self.new_bytes = self.held = 0
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: int | None, held_out: bool, found: list[bytes]) -> None:
        text = b" ".join(found)
        self.texts.append((doc_id, held_out, text))
        if held_out:
            for word in found:
                self.words.setdefault(word, 0)
        else:
            self.words.update(found)
        for item in _items([text], self.depth):
            self.new[held_out].append(item)
            self.new_bytes += len(item[2])
            if self.new_bytes >= _CHUNK:
                self.count()
        self.bytes += len(text) + 1

    def count(self) -> None:
        for held_out, items in self.new.items():
            if items:
                grams = np.sort(_grams(items, self.depth))
                first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
                times = np.diff(np.append(first, len(grams)))
                self.keys.append(grams[first])
                self.counts.append(np.zeros_like(times) if held_out else times)
                self.held += len(first)
        self.new, self.new_bytes = {False: [], True: []}, 0
        if self.held > 2 * _BATCH_GRAMS:
            self.merge()

    def merge(self) -> None:
        key, n = merged(self.keys, self.counts)
        self.keys, self.counts, self.held = [key], [n], len(key)

    @property
    def full(self) -> bool:
        many = self.held >= _BATCH_GRAMS and len(self.keys) == 1 or len(self.words) >= _BATCH_WORDS
        return many or self.bytes >= _BATCH_BYTES

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.count()
        for at in range(0, len(self.texts), _TEXTS):
            ids, held, data = zip(*self.texts[at : at + _TEXTS], strict=True)
            columns = {"doc_ids": pa.array([ids], pa.list_(pa.int64())), "held_out": pa.array([held], pa.list_(pa.bool_()))}
            yield self._rows(1, data=pa.array([_joined(data)], pa.binary()), **columns)
        self.merge()
        order, bucket = _by_bucket(self.keys[0])
        yield from self._keyed("bucket", bucket, self.keys[0][order], self.counts[0][order], _packed)
        if self.words:
            word, times = merged([_hashes(self.words)], [np.fromiter(self.words.values(), np.int64)])
            yield from self._keyed("slice", (word >> _U(64 - _SLICE_BITS)).astype(np.int32), word, times, np.ndarray.tobytes)

    def _keyed(self, name: str, places: np.ndarray, keys: np.ndarray, counts: np.ndarray, pack) -> Iterator[pa.RecordBatch]:
        starts, ends = _spans(places)
        for at in range(0, len(starts), 1024):
            spans = list(zip(starts[at : at + 1024].tolist(), ends[at : at + 1024].tolist(), strict=True))
            columns = {
                name: pa.array(places[starts[at : at + 1024]], pa.int32()),
                "keys": pa.array([pack(keys[a:b]) for a, b in spans], pa.binary()),
                "counts": pa.array([zlib.compress(counts[a:b].tobytes(), 1) for a, b in spans], pa.binary()),
            }
            yield self._rows(len(spans), **columns)

    def _rows(self, size: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["batch"] = pa.array(np.full(size, self.number, np.int64))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in READ], schema=READ)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (bucket, batch, keys, counts) that come by bucket, in pieces that hold whole buckets."""
    held, size, last = [], 0, None
    for part in batches:
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if row[0] != last and size >= 8 * _SUBTREE_GRAMS:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[2])
            last = row[0]
    if held:
        yield held


def _weighed(group: list[tuple], depth: int) -> tuple[np.ndarray, dict[int, tuple]]:
    """All distinct grams of some buckets, and the weighed subtrees of those that learning texts have."""
    keys, counts, held = [], [], 0
    for _, _, grams, times in group:
        keys.append(_unpacked(grams))
        counts.append(np.frombuffer(zlib.decompress(times), np.int64))
        held += len(keys[-1])
        if held > _MERGE:
            key, n = merged(keys, counts)
            keys, counts, held = [key], [n], 0
    key, n = merged(keys, counts)
    seen, n = key[n > 0], n[n > 0]
    return key, weigh({d: level_counts(seen, n, d) for d in range(LOCAL_DEPTH, depth + 1)}, None) if len(seen) else {}


def _top_nodes(depth: int):
    """Counts and children's log probability of the nodes right above the buckets' subtrees."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            _, weighed = _weighed(group, depth)
            if weighed:
                nodes, zeros, ones, _, mixed = weighed[LOCAL_DEPTH]
                top, place = np.unique(parent_keys(nodes, LOCAL_DEPTH), return_inverse=True)
                sums = [np.bincount(place, weights=v, minlength=len(top)) for v in (zeros, ones, mixed)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(top.astype(np.int64)), *(pa.array(v.astype(np.int64)) for v in sums[:2]), pa.array(sums[2])],
                    names=["node", "zeros", "ones", "children"],
                )

    return tops


def _model_of(weighed: dict[int, tuple], above_level: tuple | None, depth: int, above: ContextModel | None = None) -> ContextModel:
    parts = [pa.Table.from_batches(node_rows(weighed, above_level, SLOT_BITS))] if weighed else []
    slot, payload, weight = (
        parts[0].column(i).to_numpy() if parts else np.zeros(0, t) for i, t in ((0, np.int64), (2, np.int64), (3, np.float32))
    )
    return ContextModel(depth, SLOT_BITS, slot, payload, weight, above)


VALUES = "batch long, place int, values binary"


def _values(rows: list[tuple], values: list[bytes], **more: pa.Array) -> pa.RecordBatch:
    columns = {
        "batch": pa.array([r[1] for r in rows], pa.int64()),
        "place": pa.array([r[0] for r in rows], pa.int32()),
        "values": pa.array(values, pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns | more)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a slice how often learning texts have its words, and of the first how many words of its piece they have."""
    for group in _groups(batches):
        words = [np.frombuffer(r[2], np.uint64) for r in group]
        key, n = merged(words, [np.frombuffer(zlib.decompress(r[3]), np.int64) for r in group])
        seen = np.zeros(len(group), np.int64)
        seen[0] = np.count_nonzero(n)
        for at in range(0, len(group), 1024):
            to = slice(at, at + 1024)
            yield _values(group[to], [n[np.searchsorted(key, w)].tobytes() for w in words[to]], seen=pa.array(seen[to]))


def _score_grams(depth: int, shared):
    """For each row of a bucket the scores of its grams, in their order."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, above = shared.value
        for group in _groups(batches):
            key, weighed = _weighed(group, depth)
            model = _model_of(weighed, level, depth, above)
            # grams with the same near bytes after each other look up the same nodes
            found = np.concatenate([model.log10_of(key[i : i + _AT_ONCE]) for i in range(0, len(key), _AT_ONCE)])
            found = found.astype(np.float32)
            for at in range(0, len(group), 1024):
                rows = group[at : at + 1024]
                yield _values(rows, [_packed_scores(found[np.searchsorted(key, _unpacked(r[2]))]) for r in rows])

    return scores


TEXTS = "doc_id long, held_out boolean, n_words long, bytes long, score double, logs double, known long"


def _sum_grams(texts: list[bytes], values: list[bytes], depth: int) -> np.ndarray:
    """Score of each of a batch's texts, from its grams' scores by bucket."""
    keys, size = [], 0
    for _, found in gram_batches(texts, depth):
        keys.append(_distinct([found]))
        size += len(keys[-1])
        if size > 2 * _BATCH_GRAMS:
            keys = [_distinct(keys)]
            size = len(keys[0])
    grams = _distinct(keys)
    scores = np.empty(len(grams), np.float32)
    scores[_by_bucket(grams)[0]] = np.concatenate([_unpacked_scores(v) for v in values])
    totals = np.zeros(len(texts))
    for held, found in gram_batches(texts, depth):
        key, place = np.unique(found, return_inverse=True)
        score = scores[np.searchsorted(grams, key)].astype(np.float64)[place]
        ends = np.cumsum([len(body) for _, _, body in held])
        np.add.at(totals, [i for i, _, _ in held], np.add.reduceat(score, np.concatenate(([0], ends[:-1]))))
    return totals


def _distinct(keys: list[np.ndarray]) -> np.ndarray:
    key = np.sort(np.concatenate(keys))  # much faster than by np.unique, which hashes
    return key[np.concatenate(([True], key[1:] != key[:-1]))]


def _sum_words(texts: list[bytes], values: list[bytes]) -> Iterator[tuple[int, float, int]]:
    """Words of each of a batch's texts, the sum of log10(count + 1) over them and how many are known."""
    words: defaultdict[bytes, int] = defaultdict()
    words.default_factory = words.__len__
    places = [np.fromiter(map(words.__getitem__, t.split()), np.int32) for t in texts]
    hashes = _hashes(words)
    counts = np.concatenate([np.frombuffer(v, np.int64) for v in values]) if values else np.zeros(0, np.int64)
    log = np.log10(counts + 1.0)[np.unique(hashes, return_inverse=True)[1]]
    for place in places:
        logs = log[place]
        yield len(logs), float(logs.sum()), int(np.count_nonzero(logs))


def _sum_texts(depth: int):
    def sums(rows: pa.Table, found: pa.Table) -> pa.Table:
        """A batch's texts with their sums over the scores of its grams and the counts of its words."""
        texts = [t for data in rows.column("data").to_pylist() for t in _parted(data)]
        found = found.sort_by("place")
        values = [found.column("values").filter(m).to_pylist() for m in (pc.greater_equal(found.column("place"), 0), pc.less(found.column("place"), 0))]
        score = _sum_grams(texts, values[0], depth)
        n, logs, known = zip(*_sum_words(texts, values[1]), strict=True)
        sizes = pa.array([len(t) for t in texts], pa.int64())
        columns = [pa.array(n, pa.int64()), sizes, pa.array(score), pa.array(logs), pa.array(known, pa.int64())]
        names = ["doc_id", "held_out", "n_words", "bytes", "score", "logs", "known"]
        return pa.table([pc.list_flatten(rows.column("doc_ids")), pc.list_flatten(rows.column("held_out")), *columns], names=names)

    return sums


def _upper(tops: pa.Table, depth: int) -> tuple[tuple | None, ContextModel]:
    """The lowest level above the buckets' subtrees, and a model of all levels there."""
    if not tops.num_rows:
        return None, _model_of({}, None, depth)
    node, zeros, ones, children = (tops.column(c).to_numpy() for c in ("node", "zeros", "ones", "children"))
    order = np.argsort(node)
    nodes, zeros, ones, children = node[order].astype(np.uint64), zeros[order], ones[order], children[order]
    levels = {LOCAL_DEPTH - 1: (nodes, zeros, ones)}
    for d in range(LOCAL_DEPTH - 1, 0, -1):
        below, *counts = levels[d]
        up, place = np.unique(parent_keys(below, d), return_inverse=True)
        levels[d - 1] = (up, *(np.bincount(place, weights=c, minlength=len(up)).astype(np.int64) for c in counts))
    return levels[LOCAL_DEPTH - 1], _model_of(weigh(levels, (nodes, children)), None, depth)


def _dealt(made: DataFrame, place: str, count: int) -> DataFrame:
    """The rows of keys that have this place, each place in one task."""
    rows = made.where(F.col(place).isNotNull()).select(place, "batch", "keys", "counts")
    return rows.repartition(count, place).sortWithinPartitions(place)


def _text_sums(made: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """One row per text (``TEXTS``), from what ``_read`` makes, and how many words learning texts have.

    The driver gets the nodes of two context bytes. A task holds the grams of some buckets, or the words of
    some slices, packed for each batch of texts that has them.
    """
    spark = made.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = _dealt(made, "bucket", count)
    tops = packed.mapInArrow(_top_nodes(depth), "node long, zeros long, ones long, children double")
    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "children")]
    shared = spark.sparkContext.broadcast(_upper(tops.groupBy("node").agg(*sums).toArrow(), depth))
    scored = packed.mapInArrow(_score_grams(depth, shared), VALUES)
    counted = materialise(_dealt(made, "slice", count).mapInArrow(_count_words, VALUES + ", seen long"), "words")
    # slices stand before all buckets, in their order
    found = scored.unionByName(counted.select("batch", (F.col("place") - (1 << _SLICE_BITS)).alias("place"), "values"))
    texts = made.where("data is not null").select("batch", "doc_ids", "held_out", "data")
    summed = texts.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_sum_texts(depth), TEXTS)
    return summed, counted.agg(F.sum("seen").alias("seen")).first().seen or 0


READ = pa.schema(
    [("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("data", pa.binary())]
    + [("bucket", pa.int32()), ("slice", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
)
READ_SCHEMA = "batch long, doc_ids array<long>, held_out array<boolean>, data binary, bucket int, slice int, keys binary, counts binary"


def _read(depth: int):
    """Rows of texts, of packed grams and of packed words, from rows (doc_id, text, held_out)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        part = _Batch(number, depth)
        for batch in (b.slice(i, _TEXTS) for b in batches for i in range(0, b.num_rows, _TEXTS)):
            for doc_id, text, held_out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part.add(doc_id, bool(held_out), normal_words(text))
                if part.full:
                    yield from part.rows()
                    number += 1
                    part = _Batch(number, depth)
        if part.texts:
            yield from part.rows()

    return read


def score_texts(docs: DataFrame, held_out, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bytes, bits_per_byte.

    The model learns from all rows where ``held_out`` is false. A text is scored as its words in lower
    case, one blank between them, and its end: the same that the unigram base scores as tokens. Null
    and empty texts are an end alone; rows that repeat are scored each; without learning rows every
    bit has chance 1/2.

    Words of the base are counted by the 64-bit hash of each word. A word is one number per batch of
    texts, so one that all texts hold is a number per batch.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), held_out.alias("held_out")
    )
    made = materialise(rows.mapInArrow(_read(DEPTH), READ_SCHEMA), "read")
    summed, distinct = _text_sums(made, DEPTH)
    texts = materialise(summed, "scored")
    size = texts.where("not held_out").agg(F.sum("n_words").alias("words"), F.count("*").alias("texts")).first()
    learning = size.texts
    tokens, distinct = (size.words or 0) + learning, distinct + (learning > 0)
    n_tokens = F.col("n_words") + 1
    logs = F.col("logs") + F.lit(math.log10(learning + 1))
    return texts.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("known") + F.lit(int(learning > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (logs - n_tokens * F.lit(math.log10(tokens + distinct + 1))).alias("base_score"),
        "score",
        "bytes",
        (-F.col("score") * math.log2(10) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )
