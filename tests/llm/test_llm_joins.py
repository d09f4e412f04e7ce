"""Similarity join, fill-in-middle and manifest on hand-made rows: nulls, empty and long texts, ties, repeats, no rows."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapgrade.llm import fim, jaccard, merkle
from snapgrade.session import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, set string, block long, pos int, tree string, units int, form string"
EXTRA = ("s", 1, 2, "t", 3, "f")  # further columns with names that the operators use themselves
VOCABULARY = [f"w{i}" for i in range(400)]


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def family(rng, size, words, edits):
    base = rng.choices(VOCABULARY, k=words)
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = rng.choice(VOCABULARY)
        yield " ".join(text)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passage = " ".join(rng.choices(VOCABULARY, k=40))
    found = [t for size, words, edits in ((30, 120, 6), (25, 40, 2), (20, 300, 14), (12, 7, 1)) for t in family(rng, size, words, edits)]
    found += [f"{passage} {' '.join(rng.choices(VOCABULARY, k=rng.randrange(1, 60)))}" for _ in range(40)]
    found += ["one", "ONE", "one two", "two one", "", None, " \t\n", "one two three", found[0].upper(), found[0], found[3], "a b c d e", "a b c d e f"]
    found += ["x" * 70_000, " ".join(rng.choices(VOCABULARY, k=30_000)), "日本語 текст ünïcödé 🎉 é ß"]
    return found


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def least_by_links(ids, sets, percent=80):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("heavy", [jaccard.HEAVY_LEAST, 0], ids=["none heavy", "all heavy"])
def test_components_by_brute_force(spark, texts, monkeypatch, heavy):
    monkeypatch.setattr(jaccard, "HEAVY_LEAST", heavy)
    monkeypatch.setattr(jaccard, "HEAVY", 8 if heavy else 0)
    docs = table(spark, [(100 - i, t, "en", "a", 1) for i, t in enumerate(texts)]).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    sets = {100 - i: shingles(t) for i, t in enumerate(texts)}
    least = least_by_links(sorted(sets), sets)
    assert got == {i: (len(s), least[i]) for i, s in sets.items()}
    assert len(set(least.values())) < len(least) - 40


def test_join_of_repeated_and_null_ids_and_no_rows(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "A B c d e f g"), (None, "alone here"), (7, None), (8, "")]
    found = jaccard.jaccard_components(table(spark, [(*r, "en", "a", 1) for r in rows])).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(
        [(5, 3, 5), (5, 3, 5), (None, 3, 5), (None, 1, None), (7, 0, 7), (8, 0, 8)], key=repr
    )
    assert jaccard.jaccard_components(table(spark, [])).collect() == []


def test_sets_of_many_common_lists_are_paired_once(spark):
    prefixes = {"a": ("p", 1, [1, 2, 3, 4]), "b": ("q", 0, [0, 1, 2, 3, 4]), "c": ("p", 0, [2, 4])}
    rows = [
        (shingle, 40, alone + at, part, name, alone, [0] * jaccard.MARK_WORDS, prefix)
        for name, (part, alone, prefix) in prefixes.items() for at, shingle in enumerate(prefix)
    ]
    listed = spark.createDataFrame(
        rows, "shingle long, n long, pos long, part string, set string, alone long, marks array<long>, prefix array<long>"
    )
    assert sorted(map(tuple, jaccard._across(listed, 80).collect())) == [("a", "b"), ("c", "b")]


def test_blocks_of_shingles_do_not_stay(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard, "scratch_path", lambda spark, label: str(tmp_path / label))
    docs = table(spark, [(i, f"one two three four five six {i % 3}", "en", "a", 1) for i in range(9)])
    assert jaccard.shingle_sets(docs).count() == 9
    assert spark.read.schema(jaccard._BLOCK).parquet(str(tmp_path / "blocks")).count() == 0


def test_hashes_of_pieces_are_those_of_whole_texts(texts, monkeypatch):
    data = [(t or "").encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    whole = jaccard.Hasher().shingles(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert [len(set(whole[0][whole[1] == i])) for i in range(len(data))] == [len(shingles(t)) for t in texts]
    monkeypatch.setattr(jaccard, "_PIECE_BYTES", 50)
    cut = jaccard.Hasher().shingles(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_text_runs_hold_every_row():
    batch = pa.record_batch({"id": [1, 2, 3, 4], "text": ["aa", None, "b" * 50, ""]})
    runs = [(first, last, bytes(data)) for data, _, first, last in jaccard._text_runs(batch.slice(1), 10)]
    assert runs == [(0, 1, b""), (1, 2, b"b" * 50), (2, 3, b"")]


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    return "".join(rng.choices("abcé日🎉 \n<>PSM", k=150_000)).replace("<P>", "").replace("<S>", "").replace("<M>", "")


def test_fill_in_middle_by_definition(spark, long_text):
    plain = [None, "", "holds <S> a mark", "x", "日本語🎉", "<", "ends with <S", "<M", long_text]
    rows = [(i, plain[i % len(plain)], "en", "a", 1) for i in range(90)] + [(3, "x", "en", "a", 1), (None, "no id at all", "en", "a", 1)]
    for units in (2, fim.FRAME_UNITS):
        part = rows if units > 2 else [r for r in rows if r[1] is not long_text]
        cut = fim.cut_texts(materialise(fim.store_texts(table(spark, part).repartition(4), units=units), "frames"))
        texts = {(r.doc_id, r.form): r.output for r in fim.outputs(cut).collect()}
        found = fim.digests(cut).collect()
        assert len(found) == len(part)
        by_id = {r[0]: r[1] or "" for r in part}
        for r in found:
            text = by_id[r.doc_id]
            digest = sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
            h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
            low, high = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
            pre, mid, suf = text[:low], text[low:high], text[high:]
            if not text or "holds" in text or h[2] % 100 >= 90:
                form, output = "plain", text
            elif h[3] % 100 < 20:
                form, output = "spm", f"<S>{suf}<P>{pre}<M>{mid}"
            else:
                form, output = "psm", f"<P>{pre}<S>{suf}<M>{mid}"
            assert (r.n, r.form, texts[r.doc_id, form]) == (len(text), form, output)
            assert r.output_sha256 == sha256(output.encode()).hexdigest() and r.restored_sha256 == sha256(text.encode()).hexdigest()
            assert (r.low, r.high) == ((0, 0) if form == "plain" else (low, high))
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.digests(fim.cut_texts(fim.store_texts(table(spark, [])))).collect() == []


def test_a_cut_reads_no_other_frame(long_text, monkeypatch):
    frames = fim.Frames(fim.frames_of(long_text, 1000))
    read = []
    plain = frames.reader.decompress
    monkeypatch.setattr(frames, "reader", type("Reader", (), {"decompress": staticmethod(lambda d: read.append(d) or plain(d))}))
    assert b"".join(frames.select(4990, 6010)).decode() == long_text[4990:6010] and len(read) == 3
    assert list(frames.select(700, 700)) == [] and len(read) == 3


def h(text):
    return sha256(text.encode()).hexdigest()


def proofs_by_definition(rows, shown):
    """Per row (leaf, subroot, root, proof, folded root), by whole lists."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(map(part, (r[0], r[3], r[2], r[4], text))))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))

    def climb(nodes):
        ways = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for i in range(len(ways)):
                first = at[i] // 8 * 8
                ways[i].append((nodes[first : at[i]], nodes[at[i] + 1 : first + 8]))
                at[i] //= 8
            nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        return nodes[0], ways

    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    grown = {t: climb([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in order}
    root, above = climb([grown[t][0] for t in order])
    out = []
    for t, beyond in zip(order, above, strict=True):
        for (_, _, d, r), way in zip(sorted(trees[t], key=lambda x: x[:3]), grown[t][1], strict=True):
            x = leaf(r, shown(r))
            for before, after in way + beyond:
                x = h("".join(before) + x + "".join(after))
            proof = h("".join("".join(b + a) for b, a in way + beyond))
            out.append((r[0], d, grown[t][0], root, proof, x, x == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
@pytest.mark.parametrize("size", [1, 9, 700])
def test_manifest_by_definition(spark, size, height):
    rng = random.Random(size)
    langs = ["en"] if size == 1 else [None, "en", "en", "en", "ü", "z", ""] + [f"l{i}" for i in range(size // 9)]
    rows = [(i, rng.choice([None, "", "Some TEXT é", "no capitals"]), rng.choice(langs), rng.choice(["a", None]), i % 3 or None) for i in range(size)]
    if size > 1:
        rows += [rows[0], rows[0], (1, "another text", "en", "a", 2), (None, "no id", "en", "a", 2)]
    tampered = lambda r: zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 0
    shown = lambda r: r[1].lower() if r[1] and tampered(r) else r[1]
    docs = table(spark, rows).repartition(3)
    mark = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    got = sorted((tuple(r) for r in merkle.manifest(merkle.document_leaves(docs, mark), height=height).collect()), key=repr)
    assert got == proofs_by_definition(rows, shown)


def test_manifest_of_no_rows(spark):
    assert merkle.manifest(merkle.document_leaves(table(spark, []), F.lit(True))).collect() == []
