"""Language of texts by nearest centroid.

A text's vector counts its letter n-grams (1 to 3 letters, words lower-cased and set apart by blanks),
hashed to a fixed number of dimensions, damped, weighted by inverse document frequency and
normalised. Each language has several centroids, the clusters of its sample; a text takes the language
of the centroid with the largest cosine, and is rejected when that is below the language's limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from snapgrade.session import materialise

BITS = 13  # 8192 dimensions
CLUSTERS = 4
SAMPLE = 1000  # labelled texts a language is learned from, at most
MAX_LANGUAGES = 500  # with BITS and CLUSTERS, bounds the model that is sent to workers
REJECT_BELOW = 0.04  # least cosine that is accepted
REJECT_SHARE = 0.3  # a language's limit is this part of its sample's low cosine with their mean, if that is more
REJECT_RANK = 0.001  # which is the quantile of this rank
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")
_ROUNDS = 12
_OVERSAMPLE = 2
_MORE = 50  # so that small samples are full too
_BLOCK = 1 << 18
_AT_ONCE = 256
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def gram_counts(text: str | None, bits: int = BITS) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None if it has no letter."""
    letters = _NO_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not any(map(str.isalpha, letters)):
        return None
    letters = f" {letters} "
    counts = np.zeros(1 << bits, np.int64)
    shift = np.uint32(32 - bits)
    for at in range(0, len(letters), _BLOCK):  # a block starts two letters early, for the grams across its start
        early = min(at, 2)
        codes = np.frombuffer(letters[at - early : at + _BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        one = codes * _FACTORS[0]
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _FACTORS[1] + codes[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _FACTORS[2] + codes[2:]
        for n, grams in enumerate((one, two, three)):
            new = grams[max(early - n, 0) :]
            counts += np.bincount(new * _FACTORS[0] >> shift, minlength=1 << bits)
    return counts


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts).astype(np.float32) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def _clusters(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from texts spread evenly by their cosine with the mean."""
    near_middle = np.argsort(vectors @ vectors.mean(axis=0), kind="stable")
    chosen = near_middle[[int((i + 0.5) * len(vectors) / k) for i in range(k)]] if len(vectors) > k else near_middle
    centroids = vectors[chosen]
    for _ in range(_ROUNDS):
        own = np.argmax(vectors @ centroids.T, axis=1)
        for c in range(len(centroids)):
            if (own == c).any():
                total = vectors[own == c].sum(axis=0)
                centroids[c] = total / max(float(np.linalg.norm(total)), 1e-12)
    return centroids, np.argmax(vectors @ centroids.T, axis=1)


@dataclass(frozen=True)
class LanguageModel:
    """Centroids row by row with their language and limit, and the dimensions' weights."""

    languages: list[str]
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        languages = [UNKNOWN] * len(texts)
        scores, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.languages:
            return languages, scores, rejected
        for start in range(0, len(texts), _AT_ONCE):
            counted = [(i, gram_counts(t)) for i, t in enumerate(texts[start : start + _AT_ONCE].to_pylist(), start)]
            counted = [(i, c) for i, c in counted if c is not None]
            if counted:
                cosines = _vectors(np.stack([c for _, c in counted]), self.idf) @ self.centroids.T
                best = np.argmax(cosines, axis=1)
                for (i, _), b, row in zip(counted, best, cosines, strict=True):
                    languages[i], scores[i] = self.languages[b], min(max(float(row[b]), 0.0), 1.0)
                    rejected[i] = scores[i] < self.limits[b]
        return languages, scores, rejected


def fit(labelled: DataFrame, *, sample: int = SAMPLE, clusters: int = CLUSTERS) -> LanguageModel:
    """Learn from rows (lang, text) with a language.

    At most ``sample`` distinct texts per language are used, those with the smallest hashes, so that
    the same rows give the same model; their whole texts count. Texts are picked by hash first, in
    the share of a language's distinct texts that gives about twice the sample, so what is ranked has
    a bounded size however many rows and copies a language has. No row gives an empty model.
    """
    usable = labelled.where("lang is not null and text is not null").select("lang", "text")
    hashes = usable.select("lang", F.xxhash64("text").alias("_hash")).distinct()
    sizes = hashes.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    # share of all hashes, from -1/2 to 1/2, below which a language's texts are picked
    most = _OVERSAMPLE * sample + _MORE
    bounds = [F.when(F.col("lang") == r.lang, F.lit(min(1.0, most / r["count"]) - 0.5)) for r in sizes]
    place = F.xxhash64("text").cast("double") / 2.0**64
    picked = usable.where(place < F.coalesce(*bounds, F.lit(0.5))).withColumn("_key", F.md5(F.col("text").cast("binary")))
    distinct = picked.groupBy("lang", "_key").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "_key")
    chosen = materialise(distinct.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, c) for lang, text in zip(*(x.to_pylist() for x in batch.columns), strict=True) if (c := gram_counts(text)) is not None]
            places = [np.flatnonzero(c) for _, c in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for lang, _ in rows], pa.string()),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array([c[p] for (_, c), p in zip(rows, places, strict=True)], pa.list_(pa.int64())),
                ],
                names=["lang", "places", "counts"],
            )

    counted = materialise(
        chosen.select("lang", "text").mapInArrow(count, "lang string, places array<int>, counts array<long>"), "grams"
    )
    texts = counted.count()
    # at most one row per dimension
    found = counted.select(F.explode("places").alias("place")).groupBy("place").count().collect()
    idf = np.full(1 << BITS, np.log(1 + texts), np.float32)
    for place, n in found:
        idf[place] = np.log((1 + texts) / (1 + n)) + 0.1

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((len(group), 1 << BITS), np.float32)
        for i, (places, counts) in enumerate(zip(group["places"], group["counts"], strict=True)):
            dense[i, places] = counts
        vectors = _vectors(dense, idf)
        centroids, own = _clusters(vectors, clusters)
        middle = vectors.mean(axis=0)
        low = float(np.quantile(vectors @ (middle / max(float(np.linalg.norm(middle)), 1e-12)), REJECT_RANK))
        limit = max(REJECT_BELOW, REJECT_SHARE * low)
        lang = group["lang"].iloc[0]
        rows = [(lang, c, limit, centroids[c].tolist()) for c in range(len(centroids)) if (own == c).any()]
        return pd.DataFrame(rows, columns=["lang", "cluster", "limit", "centroid"])

    learned = counted.groupBy("lang").applyInPandas(learn, "lang string, cluster int, limit double, centroid array<float>")
    rows = sorted(learned.collect(), key=lambda r: (r.lang, r.cluster))
    return LanguageModel(
        [r.lang for r in rows],
        np.array([r.centroid for r in rows], np.float32).reshape(len(rows), 1 << BITS),
        np.array([r.limit for r in rows]),
        idf,
    )


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text", output: str = "language") -> DataFrame:
    """The documents' columns plus ``language``: struct(lang, score, rejected).

    ``lang`` is the nearest centroid's, also where it is rejected; a null text or one without a letter
    is ``und`` with score 0 and rejected. ``score`` is the cosine, from 0 to 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("lang string, score double, rejected boolean")
    def language(texts: pa.Array) -> pa.Array:
        lang, score, rejected = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], fields=list(schema))

    return docs.withColumn(output, language(F.col(f"`{text}`")))


def known_language(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents whose text is near a language that the labelled ones teach, with the same columns."""
    model = fit(docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")))
    whole = docs.select(F.struct("*").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    return predict(whole, model, text="_text", output="_language").where("not _language.rejected").select("_doc.*")
