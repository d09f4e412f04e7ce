"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value is within r bits of both. So every
distinct fingerprint stands for all variants within r = 2 flipped bits (2081 of 64-bit values), and
fingerprints that share a variant are linked. A variant is shuffled as its first bits: a fingerprint
goes to the bucket of each prefix within r flips of its own, with the number of flips used, and the
variants that lie in a bucket are made there. Each variant exists once over all buckets, as if every
one had been a row of its own, but 37 rows travel per fingerprint at 8 prefix bits instead of 2081.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from snapgrade.llm.components import components
from snapgrade.session import materialise

BITS = 64
SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
BUCKET_FINGERPRINTS = 1024  # own fingerprints of an average bucket, which sets the first prefix
BUCKET_VARIANTS = 1 << 24  # a bucket with more variants is split by further bits
SPLIT_BITS = 4
_TASK_VARIANTS = 1 << 22  # variants that a task holds at once
_HASHED_AT_ONCE = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def text_fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit number; no word gives 0."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    size = min(shingle, len(words))
    firsts = np.concatenate(([0], ends[: len(words) - size]))
    lasts = ends[size - 1 :] - 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(firsts), _HASHED_AT_ONCE):
        spans = zip(firsts[at : at + _HASHED_AT_ONCE].tolist(), lasts[at : at + _HASHED_AT_ONCE].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > len(firsts), bitorder="little").view(np.int64)
    return int(value[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([text_fingerprint(text.as_py()) for text in texts], pa.int64())


def fingerprint(text: Column | str) -> Column:
    """SimHash of the 4-word shingles of a text, A-Z in lower case; null has no words."""
    return _fingerprints(text)


def hex_text(value: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _masks(bits: int, flips: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(bits), n)]


def _signed(values: list[int]) -> list[int]:
    return [v - (1 << 64) if v >= 1 << 63 else v for v in values]


def _arrivals(rows: DataFrame, used: Column, bucket: Column, depth: int, bits: int, half: int) -> DataFrame:
    """Rows (bucket, used, fp), the prefix longer by ``bits`` bits and all flips of them that are left."""
    masks = F.array(*(F.lit(m).cast("long") for m in _signed(_masks(bits, half))))
    part = F.shiftrightunsigned("fp", BITS - depth - bits).bitwiseAND(F.lit((1 << bits) - 1))
    spread = rows.select("fp", used.alias("_used"), bucket.alias("_bucket"), F.explode(masks).alias("_mask"))
    now = F.col("_used") + F.bit_count("_mask")
    return spread.where(now <= half).select(
        F.shiftleft("_bucket", bits).bitwiseOR(part.bitwiseXOR(F.col("_mask"))).alias("bucket"),
        now.cast("byte").alias("used"),
        "fp",
    )


def _ball(bits: int, flips: int) -> int:
    return len(_masks(bits, flips)) if flips >= 0 else 0


def _collisions(low: np.ndarray, used: np.ndarray, owner: np.ndarray, bits: int, half: int) -> Iterator[tuple]:
    """Pairs of owners that share a variant of their last ``bits`` bits, one chain per variant."""
    size = {u: _ball(bits, half - u) for u in range(half + 1)}
    if bits and sum(int((used == u).sum()) * n for u, n in size.items()) > _TASK_VARIANTS:
        top = np.uint64(bits - 1)
        flag = (low >> top).astype(np.int64)
        below = low & np.uint64((1 << (bits - 1)) - 1)
        for side in (0, 1):
            now = used + (flag != side)
            keep = now <= half
            yield from _collisions(below[keep], now[keep], owner[keep], bits - 1, half)
        return
    room = max(int(owner.max(initial=0)).bit_length(), 1)
    keys = []
    for u in range(half + 1):
        at = used == u
        if at.any():
            masks = np.array(_masks(bits, half - u), np.uint64)
            variants = (low[at][:, None] ^ masks[None, :]).ravel() * _MIX
            keys.append(variants >> np.uint64(room) << np.uint64(room) | np.repeat(owner[at], len(masks)))
    if not keys:
        return
    # a key is the upper bits of the mixed variant and the owner, so one sort brings owners together
    keys = np.sort(np.concatenate(keys))
    group = keys >> np.uint64(room)
    same = np.flatnonzero(group[1:] == group[:-1])
    owners = (keys & np.uint64((1 << room) - 1)).astype(np.int64)
    yield owners[same], owners[same + 1], group[same]


def _local_links(fps: np.ndarray, used: np.ndarray, depth: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least fingerprint it is connected with) among the arrivals of one bucket."""
    distinct, owner = np.unique(fps.view(np.uint64), return_inverse=True)
    root = np.arange(len(distinct))
    bits = BITS - depth
    low = distinct[owner] & np.uint64((1 << bits) - 1)
    for a, b, group in _collisions(low, used.astype(np.int64), owner.astype(np.uint64), bits, half):
        near = np.bitwise_count(distinct[a] ^ distinct[b]) <= 2 * half
        mixed = np.unique(group[~near | (a == b)])
        if len(mixed):  # different variants under one key: compare all that have it
            at = np.isin(group, mixed)
            more = []
            for key in mixed:
                members = np.unique(np.concatenate((a[group == key], b[group == key])))
                more += [(x, y) for x, y in combinations(members, 2)]
            pairs = np.array(more, np.int64).reshape(-1, 2)
            a = np.concatenate((a[~at], pairs[:, 0]))
            b = np.concatenate((b[~at], pairs[:, 1]))
            near = np.bitwise_count(distinct[a] ^ distinct[b]) <= 2 * half
        pairs = np.unique(a[near] * len(distinct) + b[near])
        a, b = pairs // len(distinct), pairs % len(distinct)
        while True:  # hook roots to the least root, then shorten the ways
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            least = np.minimum(ra, rb)
            np.minimum.at(root, ra, least)
            np.minimum.at(root, rb, least)
            while (root[root] != root).any():
                root = root[root]
    at = np.flatnonzero(root != np.arange(len(distinct)))
    return distinct[at].view(np.int64), distinct[root[at]].view(np.int64)


def _bucket_links(depth: int, half: int):
    def link(bucket: pa.Table) -> pa.Table:
        fps, used = bucket.column("fp").to_numpy(), bucket.column("used").to_numpy()
        a, b = _local_links(fps, used, depth, half)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fp`` within ``radius`` bits.

    ``distinct`` holds each fingerprint once. Within a bucket a component is already one star, so
    there are at most as many links as arrivals. A bucket whose variants pass a bound is dealt out
    again by its next bits, as often as needed, so similar fingerprints do not meet in one task.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: each side flips half of it")
    half = radius // 2
    count = distinct.count()
    depth = min(max((count // BUCKET_FINGERPRINTS).bit_length(), SPLIT_BITS), BITS // 2)
    level = _arrivals(distinct.select("fp"), F.lit(0), F.lit(0).cast("long"), 0, depth, half)
    links = None
    while True:
        sizes = [F.when(F.col("used") == u, F.lit(_ball(BITS - depth, half - u))) for u in range(half + 1)]
        hot = level.groupBy("bucket").agg(F.sum(F.coalesce(*sizes)).alias("_variants")).where(F.col("_variants") > BUCKET_VARIANTS)
        hot = materialise(hot.select("bucket"), "hot")
        split = depth + SPLIT_BITS <= BITS and bool(hot.take(1))
        cold = level.join(hot, "bucket", "left_anti") if split else level
        found = cold.groupBy("bucket").applyInArrow(_bucket_links(depth, half), "a long, b long")
        links = found if links is None else links.union(found)
        if not split:
            return links
        level = materialise(
            _arrivals(level.join(hot, "bucket", "left_semi"), F.col("used").cast("int"), F.col("bucket"), depth, SPLIT_BITS, half),
            "arrivals",
        )
        depth += SPLIT_BITS


def near_classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Add ``class_fp`` to rows with ``fp``: equal for rows whose fingerprints are connected by links."""
    distinct = materialise(rows.select("fp").distinct(), "distinct")
    roots = components(near_links(distinct, radius))
    joined = rows.join(roots, F.col("fp") == F.col("node"), "left")
    return joined.withColumn("class_fp", F.coalesce("root", "fp")).drop("node", "root")


def _row_hash(docs: DataFrame) -> Column:
    """Hash of all columns that can be compared."""
    return F.xxhash64(*(F.col(f"`{n}`") for n, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """One row per document: doc_id, fp, row_hash (of all its columns), class_fp, component_id.

    Fingerprints link at ``radius`` or fewer differing bits; a component is all that links reach, and
    component_id its smallest doc_id (null only if none has an id). Exact copies share a fingerprint
    and are one node. Null and empty texts have fingerprint 0, which links like any other. Rows that
    repeat give a row each; an empty table gives none.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), fingerprint(F.col(f"`{text}`")).alias("fp"), _row_hash(docs).alias("row_hash")
    )
    rows = materialise(rows, "fingerprints")
    # classes of distinct fingerprints, each with its smallest document
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    classes = materialise(near_classes(firsts, radius), "classes")
    least = classes.groupBy("class_fp").agg(F.min("first_id").alias("component_id"))
    by_fp = classes.select("fp", "class_fp").join(least, "class_fp").select(F.col("fp").alias("_fp"), "class_fp", "component_id")
    return rows.join(by_fp, F.col("fp") == F.col("_fp")).drop("_fp")


def keep_one_per_class(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents, one of each class: that with the smallest doc_id, ids before nulls."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, radius=radius)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    stay = found.groupBy("class_fp").agg(F.min(order).alias("_stays")).select("_stays.doc_id", "_stays.row_hash")
    stay = stay.select(F.col("doc_id").alias("stay_id"), F.col("row_hash").alias("stay_hash"))
    packed = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("id"), _row_hash(docs).alias("hash"))
    same = (F.col("hash") == F.col("stay_hash")) & F.col("id").eqNullSafe(F.col("stay_id"))
    return packed.join(stay, same, "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
