"""Queries over whole tables: fill-in-middle and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapgrade.llm import fim, merkle
from snapgrade.llm.registry import query, table
from snapgrade.session import materialise


@query(
    "op12_fill_in_middle",
    """
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
    hashed AS (SELECT *, length(text) AS n, list_transform(range(4), lambda i: ('0x' || substr(h, (8 * i + 1)::INT, 8))::BIGINT) AS p
      FROM texts),
    cut AS (SELECT *, least(p[1] % (n + 1), p[2] % (n + 1)) AS lo, greatest(p[1] % (n + 1), p[2] % (n + 1)) AS hi,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR p[3] % 100 >= 90 THEN 'plain'
          WHEN p[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
    parts AS (SELECT *, substr(text, 1, lo) AS pre, substr(text, lo + 1, hi - lo) AS mid, substr(text, hi + 1) AS suf FROM cut)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo::BIGINT END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN (hi - lo)::BIGINT END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
      sha256(text) AS restored_sha256
    FROM parts""",
)
def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    """Every document cut in three, put in its form and put back together."""
    stores = materialise(fim.store_texts(table(spark, sf, "documents")), "frames")
    found = fim.digests(fim.cut_texts(stores))
    cut = F.col("form") != "plain"
    return found.select(
        "doc_id", "n", "form", F.when(cut, F.col("low")).alias("prefix_chars"),
        F.when(cut, F.col("high") - F.col("low")).alias("middle_chars"), "output_sha256", "restored_sha256",
    )


def _tree_sql(name: str, nodes: str, rows: str, levels: int) -> str:
    """SQL: (id, top, siblings, folded) of each of ``rows(id, node, shown)`` in the trees over ``nodes(id, tree, pos, d)``.

    A tree that has come to one node stays as it is on all further levels.
    """
    above = [
        f"""l{i} AS (SELECT tree, pos // 8 AS pos, CASE WHEN n = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d,
          count(*) OVER (PARTITION BY tree) AS n FROM l{i - 1} GROUP BY tree, pos // 8, n)"""
        for i in range(1, levels + 1)
    ]
    # the others of a node's run, if its tree has more than one node on the level
    around = [
        f"""b{i} AS (SELECT s.id, coalesce(string_agg(l.d, '' ORDER BY l.pos) FILTER (l.pos < s.pos // {8**i}), '') AS before,
          coalesce(string_agg(l.d, '' ORDER BY l.pos) FILTER (l.pos > s.pos // {8**i}), '') AS after, max(l.n) > 1 AS inside
        FROM {nodes} s JOIN l{i} l ON l.tree = s.tree AND l.pos // 8 = s.pos // {8 ** (i + 1)} GROUP BY s.id)"""
        for i in range(levels)
    ]
    folds = [
        f"""f{i + 1} AS (SELECT f.id, f.node, siblings || CASE WHEN inside THEN before || after ELSE '' END AS siblings,
          CASE WHEN inside THEN sha256(before || x || after) ELSE x END AS x FROM f{i} f JOIN b{i} b ON b.id = f.node)"""
        for i in range(levels)
    ]
    return f"""{name} AS (WITH l0 AS (SELECT tree, pos, d, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}), {", ".join(above)},
      {", ".join(around)}, f0 AS (SELECT id, node, '' AS siblings, shown AS x FROM {rows}), {", ".join(folds)}
      SELECT f.id, l.d AS top, siblings, x AS folded FROM f{levels} f JOIN {nodes} s ON s.id = f.node JOIN l{levels} l ON l.tree = s.tree)"""


def _manifest_sql(levels: int) -> str:
    """The manifest, of fewer than 8^levels rows a tree and as many trees."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = part(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")
    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
    return f"""
    WITH named AS (SELECT *, coalesce('=' || lang, '') AS tree, xor({crc}, 4294967295) % 3 = 0 AS tampered FROM documents),
    digests AS (SELECT doc_id, tree, sha256({head} || {part("text")}) AS d,
      sha256({head} || CASE WHEN tampered THEN {lower} ELSE {part("text")} END) AS shown FROM named),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, d) - 1 AS pos,
      row_number() OVER (ORDER BY tree, doc_id, d) AS id FROM digests),
    leaf_rows AS (SELECT id, id AS node, shown FROM leaves),
    {_tree_sql("in_tree", "leaves", "leaf_rows", levels)},
    subroots AS (SELECT tree AS id, '' AS tree, any_value(top) AS d, row_number() OVER (ORDER BY tree) - 1 AS pos
      FROM leaves JOIN in_tree USING (id) GROUP BY tree),
    folded_rows AS (SELECT id, tree AS node, folded AS shown FROM leaves JOIN in_tree USING (id)),
    {_tree_sql("in_root", "subroots", "folded_rows", levels)}
    SELECT doc_id, d AS leaf, t.top AS subroot, r.top AS root, sha256(t.siblings || r.siblings) AS proof_sha256,
      r.folded AS folded_root, r.folded = r.top AS verified
    FROM leaves JOIN in_tree t USING (id) JOIN in_root r USING (id)"""


@query("op13_merkle_manifest", _manifest_sql(8))
def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's proof in the manifest of all, checked with a third of the texts tampered with."""
    docs = table(spark, sf, "documents")
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    found = merkle.manifest(merkle.document_leaves(docs, tampered))
    return found.withColumnRenamed("key", "doc_id")
