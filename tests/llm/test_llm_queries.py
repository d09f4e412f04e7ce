"""The registered text queries against their SQL, or against brute force on the smallest tables."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from conftest import SF, TABLES
from snapgrade.llm import ctw, secrets, simhash, tokens, winnow
from snapgrade.llm.catalogue import QUERIES, SQL

NAMES = {
    "op1_harmonic_packing", "op2_winnowing", "op3_context_tree_scores", "op4_secret_spans", "op5_source_mix",
    "op6_language_centroids", "op7_host_rules", "op8_length_histogram", "op9_simhash_components", "op10_warc_round_trip",
    "op11_jaccard_components", "op12_fill_in_middle", "op13_merkle_manifest",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def of(name):
        if name not in done:
            done[name] = QUERIES[name](spark, SF).collect()
        return done[name]

    return of


def crc_rest(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_all_are_registered():
    assert set(QUERIES) == NAMES and NAMES | {"pipeline"} <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, result, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = connection.execute(SQL[name])
    columns = [c[0] for c in wanted.description]
    rows = [r.asDict() for r in result(name)]
    assert set(rows[0]) == set(columns)
    assert sorted(repr([r[c] for c in columns]) for r in rows) == sorted(repr(list(r)) for r in wanted.fetchall())


def encoded(text):
    from tokenizers import Tokenizer

    encoder = encoded.__dict__.setdefault("tokenizer", Tokenizer.from_file(tokens.vocabulary_path()))
    return encoder.encode(text or "", add_special_tokens=False).ids


def check_packing(rows, texts):
    """Every id in one piece, sequences gapless and at most 2048 long; the share of padding."""
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids = np.array([*encoded(texts[doc_id]), 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            crc = r.ids_crc32 if "ids_crc32" in r else zlib.crc32(r.ids)
            assert (r.start, r.doc_tokens, crc) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert 0 < at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / total


def test_packing(result, docs):
    assert check_packing(result("op1_harmonic_packing"), {k: d.text for k, d in docs.items()}) < 0.02


def test_length_histogram(result, docs):
    lengths = sorted(len(encoded(d.text)) for d in docs.values())
    assert sorted(r.length for r in result("op8_length_histogram")) == sorted(set(lengths))
    for r in result("op8_length_histogram"):
        above = [n for n in lengths if n >= r.length]
        assert (r.n_docs, r.docs_from, r.tokens_from) == (lengths.count(r.length), len(above), sum(above))
        assert r.truncated_tokens == sum(min(n, r.length) for n in lengths) and r.total_tokens == sum(lengths)
        assert r.docs_to == sum(n <= r.length for n in lengths) and r.share_to == r.docs_to / len(lengths)


def kept_grams(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    letters = [x for w in words for x in ([w.encode()] if len(w) <= winnow.LONG_WORD else [c.encode("utf-32-be") for c in w])]
    hashes = [(xxhash.xxh64_intdigest(x, 42) & winnow.PRIME) % winnow.PRIME for x in letters]
    size, grams = min(winnow.GRAM, len(hashes)), []
    for i in range(len(hashes) - size + 1 if hashes else 0):
        value = 0
        for h in hashes[i : i + size]:
            value = (value * winnow.BASE + h) % winnow.PRIME
        grams.append(value)
    kept = []
    for i in range(max(1, len(grams) - winnow.WINDOW + 1) if grams else 0):
        window = grams[i : i + winnow.WINDOW]
        least = min(window)
        at = (least, i + max(j for j, g in enumerate(window) if g == least))
        if at not in kept:
            kept.append(at)
    return kept


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing(result, docs):
    order = sorted(docs, reverse=True)
    follows = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    text_of = lambda kept: " ".join(f"{h:X}:{p}" for h, p in kept)
    assert len(result("op2_winnowing")) == len(docs)
    for r in result("op2_winnowing"):
        text, after = docs[r.doc_id].text, docs[follows[r.doc_id]].text
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, new = kept_grams(text), kept_grams(edited)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (text_of(own), text_of(new))
        assert r.near_edited == pytest.approx(likeness(own, new))
        assert r.near_next == pytest.approx(likeness(own, kept_grams(after)))


def test_unigram_base_of_scores(result, docs):
    counts = collections.Counter()
    for d, row in docs.items():
        if crc_rest(d, 7) != 2:
            counts.update(row.text.encode().lower().split())
            counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    for r in result("op3_context_tree_scores"):
        words = [*docs[r.doc_id].text.encode().lower().split(), None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (crc_rest(r.doc_id, 7) == 2, len(words), total)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words))


def test_scores_are_those_of_a_model_made_in_one_piece(result, docs):
    texts = [d.text for k, d in docs.items() if crc_rest(k, 7) != 2]
    batches = ctw._count_grams(ctw.DEPTH)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]))
    grams, counts = (np.concatenate(c) for c in zip(*[(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]))
    weighed = ctw.weigh({d: ctw.level_counts(grams, counts, d) for d in range(ctw.DEPTH + 1)}, None)
    rows = pa.Table.from_batches(ctw.node_rows(weighed, None, ctw.SLOT_BITS))
    slot, rank, payload, weight = (rows.column(i).to_numpy() for i in range(4))
    order = np.argsort(rank, kind="stable")
    model = ctw.ContextModel(ctw.DEPTH, ctw.SLOT_BITS, slot[order], payload[order], weight[order])
    bits = size = 0.0
    for r in result("op3_context_tree_scores"):
        spelled = b" ".join(ctw.normal_words(docs[r.doc_id].text))
        wanted = sum(model.log10_of(g).sum() for _, g in ctw.gram_batches([spelled], ctw.DEPTH))
        assert r.score == pytest.approx(wanted, rel=1e-3) and r.bytes == len(spelled)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (r.bytes + 1))
        if r.held_out:
            bits, size = bits - r.score * math.log2(10), size + r.bytes + 1
    # half a MB of learning text is too little to beat word counts (README), but far better than none
    assert bits < 2.8 * size


BASE = (
    re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
)


def base_spans(text):
    found = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            if len(m[2 if kind == 0 else 0]) >= (6, 20, 24)[kind]:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_secrets(result, docs):
    for r in result("op4_secret_spans"):
        spans = base_spans(docs[r.doc_id].text)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{e}" for a, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert set(text.split(",")) <= set(r.spans.split(","))


def bits(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in collections.Counter(window).values())


def entropy_spans(text, base):
    found = set()
    for alphabet, least in (("0-9a-fA-F", 3.0), ("0-9a-zA-Z+/_=\\-", 4.0)):
        for run in re.finditer(f"[{alphabet}]{{24,}}", text):
            start = run.start()
            # segments and separators in turn; segments with a placeholder word end a candidate
            candidates, at = [[start, start]], start
            for piece in re.split("([/_=-])", run[0]):
                if re.search("example|placeholder|dummy|redacted", piece, re.I):
                    candidates.append([at + len(piece)] * 2)
                else:
                    candidates[-1][1] = at + len(piece)
                at += len(piece)
            for a, b in candidates:
                part = text[a:b]
                if not re.search("[0-9]", part) or not re.search("[a-zA-Z]", part) or re.fullmatch("[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}", part, re.I):
                    continue
                hot = [i for i in range(a, b - 23) if bits(text[i : i + 24]) >= least - 1e-9]
                if hot and not any(x <= hot[0] and hot[-1] + 24 <= y for x, _, y in base):
                    found.add((hot[0], 3, hot[-1] + 24))
    return found


def all_spans(text):
    base = base_spans(text)
    kinds = ("assign", "access", "hex", "entropy")
    return ",".join(f"{kinds[k]}:{a}:{e}" for a, k, e in sorted([*base, *entropy_spans(text, base)]))


def test_all_secret_spans_by_brute_force(result, docs):
    for r in result("op4_secret_spans"):
        assert r.spans == all_spans(docs[r.doc_id].text or "")


def test_secret_spans_of_made_texts_by_brute_force(spark):
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits + "+/_=-"
    parts = [" ", "\n", "é🎉", "/", "-", "example", "/Dummy/", "token=", "password: ", "AKIA", "123e4567-e89b-12d3-a456-426614174000"]
    texts = []
    for _ in range(150):
        pieces = []
        for _ in range(rng.randint(1, 12)):
            alphabet = rng.choice((letters, "0123456789ABCDEF", "0123456789abcdef", "abcdefgh", "0123456789"))
            pieces += [rng.choice(parts), "".join(rng.choices(alphabet, k=rng.choice((3, 10, 23, 24, 25, 40, 120))))]
        texts.append("".join(pieces))
    found = secrets.scan_secrets(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = found.select("text", secrets.spans_text(F.col("secrets.spans")).alias("spans")).collect()
    assert len(got) == len(texts) and sum("entropy" in r.spans for r in got) > 50
    for r in got:
        assert r.spans == all_spans(r.text)


def test_language_of_held_out_documents(result, docs):
    out = [r for r in result("op6_language_centroids") if r.held_out]
    assert len(result("op6_language_centroids")) == len(docs) and all(crc_rest(r.doc_id, 4) == 2 for r in out)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in result("op6_language_centroids"))
    assert sum(r.rejected for r in result("op6_language_centroids")) <= 0.01 * len(docs)


def fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_of(prints):
    """Smallest id that links of 4 or fewer bits reach, by comparing all pairs."""
    least = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_near_duplicate_components(result, docs):
    prints = {d: fingerprint(r.text) for d, r in docs.items()}
    least = component_of(prints)
    wanted = {(d, f"{prints[d]:016x}", least[d]) for d in prints}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in result("op9_simhash_components")} == wanted
    assert simhash.text_fingerprint(None) == 0


def test_pipeline_stage_by_stage(spark, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "secrets", "mix", "packing"] and corpus_pipeline.ORACLE_SQL is None
    table = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    known = {r.doc_id for r in stages["language"](spark, table, SF).collect()}
    assert len(known) >= 0.99 * len(docs)

    prints = {d: fingerprint(r.text) for d, r in docs.items()}
    one = stages["near_duplicates"](spark, table, SF).collect()
    assert sorted(r.doc_id for r in one) == sorted(set(component_of(prints).values()))
    assert all(docs[r.doc_id] == r for r in one)

    clean = {r.doc_id for r in stages["secrets"](spark, table, SF).collect()}
    assert clean == {d for d, r in docs.items() if not base_spans(r.text)}

    mixed = stages["mix"](spark, table, SF)
    assert mixed.columns == table.columns
    taken = {r.doc_id: r for r in QUERIES["op5_source_mix"](spark, SF).collect()}
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert copies == {d: -(-r.taken // r.size) for d, r in taken.items() if r.taken}

    packed = stages["packing"](spark, table, SF).collect()
    assert check_packing(packed, {k: d.text for k, d in docs.items()}) < 0.02


def test_pipeline_is_its_stages_in_a_row(spark, tmp_path):
    rows = corpus_pipeline.run(spark, SF)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, SF).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
    plain = lambda df: sorted((r.doc_id, r.start, r.length, zlib.crc32(r.ids)) for r in df.collect())
    assert plain(rows) == plain(table)
