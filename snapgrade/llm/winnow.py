"""Document fingerprints by winnowing, and the likeness of documents to their neighbours in id order.

Grams of GRAM words are hashed by a polynomial of the words' hashes (the value that rolling from word
to word gives); of every WINDOW grams in a row the smallest hash is kept, the rightmost if some tie,
with its position. Two texts that share GRAM + WINDOW - 1 letters in a row share a kept hash. Letters
of the method are words in lower case, and the single characters of a word of more than LONG_WORD, so
that scripts without blanks, minified code and encoded data are cut as finely as they can be shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from snapgrade.llm.secrets import let

GRAM = 3
WINDOW = 4
LONG_WORD = 24  # code points; longer words give their characters as letters
PRIME = (1 << 31) - 1
BASE = 0x2F0B4C47  # below 2**30, so that a product and a sum stay in 63 bits
BUCKETS_PER_PARTITION = 4
_POSITIONS = 1 << 32
_COARSE = 64


def _least_with(by: int):
    """The lesser of each element of an array and the one ``by`` places after it."""

    def shifted(values: Column) -> Column:
        rest = F.greatest(F.size(values) - by, F.lit(0))
        ahead = F.slice(values, F.lit(1 + by), rest)
        return F.zip_with(F.slice(values, F.lit(1), rest), ahead, lambda a, b: F.least(a, b))

    return shifted


def letter_hashes(text: Column, long_word: int = LONG_WORD) -> Column:
    """Hashes (31 bits) of the words of a text in lower case, and of each character of a long word.

    Characters are read at their place in UTF-32, as numbers only: no string is made for each of them.
    """
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    reduced = lambda value: F.xxhash64(value).bitwiseAND(F.lit(PRIME)) % PRIME

    def characters(bits: Column) -> Column:
        last = F.shiftright(F.octet_length(bits), 2) - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: reduced(F.substring(bits, i * 4 + 1, F.lit(4))))

    def letters(word: Column) -> Column:
        long = let(F.encode(word, "UTF-32"), characters)
        return F.when(F.length(word) > long_word, long).otherwise(F.array(reduced(word)))

    def all_letters(words: Column) -> Column:
        mixed = F.exists(words, lambda w: F.length(w) > long_word)
        return F.when(mixed, F.flatten(F.transform(words, letters))).otherwise(F.transform(words, reduced))

    return let(words, all_letters)


def gram_hashes(text: Column, gram: int = GRAM) -> Column:
    """Hashes (31 bits) of all grams of a text; one of all its letters if it has fewer; none without words."""
    hashes = letter_hashes(text)

    def next_word(place: int):
        def roll(s: Column) -> Column:
            size = F.greatest(F.size(s["acc"]) - 1, F.lit(0))
            return F.zip_with(
                F.slice(s["acc"], F.lit(1), size),
                F.slice(s["all"], F.lit(place + 1), size),
                lambda a, b: (a * BASE + b) % PRIME,
            )

        return roll

    def fold(hashes: Column, short: int) -> Column:
        folded = hashes
        for place in range(1, short):
            folded = let(F.struct(folded.alias("acc"), hashes.alias("all")), next_word(place))
        return folded

    def choose(hashes: Column) -> Column:
        by_length = F.when(F.size(hashes) >= gram, fold(hashes, gram))
        for short in range(gram - 1, 0, -1):
            by_length = by_length.when(F.size(hashes) == short, fold(hashes, short))
        return by_length.otherwise(F.array().cast("array<long>"))

    return let(hashes, choose)


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The kept grams in text order: hash * 2**32 + (2**32 - 1 - position), position in letters from 0.

    Smaller is a smaller hash, then a later position, so a window's least value is its rightmost
    minimum. A text with fewer grams than a window keeps its one minimum; one without words none.
    """

    def marked(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: h * _POSITIONS + (F.lit(_POSITIONS - 1) - i))

    def least(values: Column) -> Column:
        # least of 2, 4, ... in a row, then of two such runs that overlap
        span, runs = 1, values
        while 2 * span <= window:
            runs = let(runs, _least_with(span))
            span *= 2
        if span < window:
            runs = let(runs, _least_with(window - span))
        return (
            F.when(F.size(values) >= window, F.array_distinct(runs))
            .when(F.size(values) > 0, F.array(F.array_min(values)))
            .otherwise(values)
        )

    return let(marked(gram_hashes(text, gram)), least)


def hashes_of(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 32)))


def fingerprint_text(kept: Column) -> Column:
    """hash:position of each kept gram, hashes in hexadecimal, joined by blanks."""
    position = lambda x: F.lit(_POSITIONS - 1) - x.bitwiseAND(F.lit(_POSITIONS - 1))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.hex(F.shiftright(x, 32)), position(x))), " ")


def likeness(left: Column, right: Column) -> Column:
    """Shared part of two sets of hashes (Jaccard); 1 for two empty ones."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(1.0))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds are above the id, found in two steps; nulls come after all."""
    above = lambda values: F.size(F.filter(values, lambda b: b > doc_id))
    longs = lambda values: F.array(*map(F.lit, values)).cast("array<long>")
    coarse = above(longs(bounds[::_COARSE]))
    fine = F.slice(longs(bounds), F.greatest((coarse - 1) * _COARSE + 1, F.lit(1)), F.lit(_COARSE))
    found = F.when(coarse > 0, (coarse - 1) * _COARSE + above(fine)).otherwise(0)
    return F.when(doc_id.isNull(), len(bounds) + 1).otherwise(found)


def with_next_text(rows: DataFrame) -> tuple[DataFrame, Window]:
    """Add ``next_text`` to rows (doc_id, text): that of the next row, descending by doc_id, cyclically.

    Rows of one doc_id follow each other by their text's hash, rows without one come last. Rows are
    dealt to buckets of ids between percentiles, each ordered by itself, and shuffled once: the first
    row of every bucket also goes, as a ghost, behind the last row of the bucket before. Returns the
    rows with ghosts (``_ghost``) still there, and the window they are ordered by. What the driver
    gets is one bound and one first key per bucket, whose number follows the shuffle partitions.
    """
    spark = rows.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [(i + 1) / buckets for i in range(buckets - 1)]
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10000, 20 * buckets))).first()[0]
    bounds = sorted(set(found or []), reverse=True)
    keyed = rows.withColumns({"_bucket": _bucket(F.col("doc_id"), bounds), "_tie": F.xxhash64("text")})
    key = F.struct(F.bitwise_not("doc_id").alias("id"), F.col("_tie").alias("tie"))
    firsts = sorted(keyed.groupBy("_bucket").agg(F.min(key).alias("key")).collect(), key=lambda r: r["_bucket"])
    before = {r["_bucket"]: firsts[i - 1]["_bucket"] for i, r in enumerate(firsts)}
    first_of = {r["_bucket"]: r["key"] for r in firsts}
    size = len(bounds) + 2
    array = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("_bucket"))
    is_first = F.bitwise_not("doc_id").eqNullSafe(
        array([first_of[b]["id"] if b in first_of else None for b in range(size)], "long")
    ) & (F.col("_tie") == array([first_of[b]["tie"] if b in first_of else None for b in range(size)], "long"))
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("ghost"))
    ghost = F.struct(array([before.get(b, 0) for b in range(size)], "int").alias("bucket"), F.lit(True).alias("ghost"))
    placed = keyed.withColumn("_place", F.explode(F.when(is_first, F.array(own, ghost)).otherwise(F.array(own))))
    placed = placed.select(
        *rows.columns, "_tie", F.col("_place.bucket").alias("_bucket"), F.col("_place.ghost").alias("_ghost")
    )
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), "_tie")
    return placed.withColumn("next_text", F.lead("text").over(order)), order


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and likenesses; one row per document.

    The edited text has its last third (n_chars div 3 code points) replaced by the first as many
    characters of the next document's text, or all of them. A null text counts as empty; an empty text
    has an empty fingerprint, and two empty ones are alike. A word of very many characters, or a whole text
    without blanks, is cut by its characters. A table of one row is its own next; rows
    that repeat are rows of their own; an empty table gives none.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ordered, order = with_next_text(rows)
    cut = F.expr("length(text) div 3").cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)
    )
    made = ordered.withColumns({"_edited": edited, "_kept": winnow(F.col("text")), "n_chars": F.length("text").cast("long")})
    made = made.withColumns({"_next_kept": F.lead("_kept").over(order), "_edited_kept": winnow(F.col("_edited"))})
    made = made.where("not _ghost")
    sets = made.withColumns({"_own_set": hashes_of(F.col("_kept")), "_edited_set": hashes_of(F.col("_edited_kept"))})
    return sets.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("_kept")).alias("fingerprint"),
        fingerprint_text(F.col("_edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("_own_set"), F.col("_edited_set")).alias("near_edited"),
        likeness(F.col("_own_set"), hashes_of(F.col("_next_kept"))).alias("near_next"),
    )
