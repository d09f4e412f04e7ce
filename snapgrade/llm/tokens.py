"""Token ids of a public vocabulary, computed batch by batch in Python workers.

Each word between ASCII white space is encoded by itself: for a vocabulary that drops white space
no token crosses it, so a document's ids are its words' ids in a row. Words are looked up in a
bounded cache of the worker first.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CACHED_WORDS = 250_000  # per generation, two generations per worker
CACHED_BYTES = 64  # longer words are not kept


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a vocabulary file of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Western letters, which one code point each writes in both cases, then at most ASCII punctuation: to
# normalise and split such a word is to lower-case it and cut it in two.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
# Byte-level vocabularies write printable bytes of Latin-1 as themselves, the others from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class WordEncoder(dict):
    """Maps a word (UTF-8 bytes) to its ids (little-endian unsigned 32-bit), encoding it if it is new.

    A full generation of words becomes the older one; the one before that is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.older.clear()
                self.older.update(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        parts = PLAIN.fullmatch(text)
        if parts:
            letters = parts[1].lower()
            if not letters.isascii():
                letters = letters.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)
            ids = [token.id for token in self.model.tokenize(letters)]
            if parts[2]:
                ids += [token.id for token in self.model.tokenize(parts[2])]
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def text_ids(self, text: str | None) -> bytes:
        """Ids of a whole text; no text has none."""
        return b"".join(map(self.__getitem__, text.encode("utf-8").split())) if text else b""


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder of that vocabulary."""
    return WordEncoder(path)


def token_counts(text: Column | str, path: str | None = None) -> Column:
    """Number of ids of each text (null: 0), without an end id."""
    file = path or vocabulary_path()

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        ids = encoder(file).text_ids
        return pa.array([len(ids(t.as_py())) // 4 for t in texts], pa.int64())

    return count(text)


def column_names(df: DataFrame, **wanted: str) -> list[Column]:
    """Columns of ``df`` under the names an operator works with, whatever else the table holds."""
    return [F.col(f"`{c}`").alias(name) for name, c in wanted.items()]
