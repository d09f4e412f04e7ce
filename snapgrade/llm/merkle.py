"""Merkle manifest of a dataset: one tree per group of rows, one over the groups, a proof per row.

Rows are leaves; every 8 consecutive nodes of a level give one of the next, the last run of a level
may be shorter, and a tree ends with one node. Positions in a tree come from distributed prefix sums.
A superblock is the 8^4 consecutive nodes under one node four levels up. Going up, every superblock is
reduced in a task of its own and the tops are the nodes of the next round, so a tree of any size, even
one that holds all rows, is many bounded groups. Going down, the nodes of a superblock are cogrouped
with the one row that holds what they need from outside: the siblings from the superblock's top to
the root. That task finishes the local levels, joins both parts of every proof and folds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from snapgrade.llm.totals import running_totals
from snapgrade.session import materialise

FAN = 8
HEIGHT = 4  # levels of a superblock
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# a node's siblings on one level
_PATH = "array<struct<before: string, after: string>>"


def digest_of(*values: Column) -> Column:
    """H of the values: each ``-`` if null, else its UTF-8 byte count, a colon and its text."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _hash(nodes: str) -> str:
    return sha256(nodes.encode()).hexdigest()


def _levels(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """The nodes and the levels above them: ``height`` levels, or as many as leave one node."""
    levels = [nodes]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        below = levels[-1]
        levels.append([_hash("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def _local_paths(levels: list[list[str]]) -> Iterator[list[tuple[str, str]]]:
    """For every node of the lowest level, its siblings on all levels but the last."""
    for at in range(len(levels[0])):
        path = []
        for level in levels[:-1]:
            first = at - at % FAN
            path.append(("".join(level[first:at]), "".join(level[at + 1 : first + FAN])))
            at //= FAN
        yield path


def _top(height: int):
    def top(block: pd.DataFrame) -> pd.DataFrame:
        nodes = block.sort_values("pos")["digest"].tolist()
        return pd.DataFrame(
            {
                "tree": block["tree"].iloc[:1],
                "block": block["block"].iloc[:1],
                "full": _levels(nodes, height)[-1][0],
                "short": _levels(nodes)[-1][0],
            }
        )

    return top


def _in_blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN**height))


def _climb(nodes: DataFrame, height: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The rounds' nodes (tree, pos, digest), and per round the trees that end in it (tree, digest)."""
    rounds, ends = [], []
    while True:
        rounds.append(nodes)
        blocks = _in_blocks(nodes, height).groupBy("tree", "block")
        tops = materialise(blocks.applyInPandas(_top(height), "tree string, block long, full string, short string"), "tops")
        size = tops.groupBy("tree").agg(F.max("block").alias("last")).withColumnRenamed("tree", "_tree")
        sized = tops.join(size, F.col("tree") == F.col("_tree")).drop("_tree")
        ends.append(sized.where("last = 0").select("tree", F.col("short").alias("digest")))
        nodes = materialise(sized.where("last > 0").select("tree", F.col("block").alias("pos"), F.col("full").alias("digest")), "nodes")
        if nodes.isEmpty():
            return rounds, ends


def _split(outer: pd.DataFrame, height: int) -> tuple[list[tuple[str, str]], int | None, str]:
    row = outer.iloc[0]
    return [(p["before"], p["after"]) for p in row["path"]], None if row["whole"] else height, row["subroot"]


def _node_paths(height: int):
    def paths(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        path, levels, subroot = _split(outer, height)
        local = _local_paths(_levels(nodes["digest"].tolist(), levels))
        whole = [[{"before": b, "after": a} for b, a in [*own, *path]] for own in local]
        return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "subroot": subroot, "path": whole})

    return paths


def _proofs(height: int):
    def proofs(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("pos")
        path, levels, subroot = _split(outer, height)
        beyond = "".join(before + after for before, after in path)
        hashes, folded = [], []
        for shown, own in zip(leaves["shown"], _local_paths(_levels(leaves["digest"].tolist(), levels)), strict=True):
            hashes.append(_hash("".join(before + after for before, after in own) + beyond))
            for before, after in (*own, *path):
                shown = _hash(before + shown + after)
            folded.append(shown)
        return pd.DataFrame(
            {"key": leaves["key"], "leaf": leaves["digest"], "subroot": subroot, "proof_sha256": hashes, "folded_root": folded}
        )

    return proofs


def _outer_rows(paths: DataFrame, ends: DataFrame, end_paths: DataFrame) -> DataFrame:
    """What each superblock of a round needs: (tree, block, whole, subroot, path).

    ``paths`` has the paths of the round above, whose nodes are this round's superblocks;
    ``end_paths`` (tree, subroot, path) those of the trees that end with this round.
    """
    named = end_paths.withColumnRenamed("tree", "_tree")
    ended = ends.select("tree").join(named, F.col("tree") == F.col("_tree")).select(
        "tree", F.lit(0).cast("long").alias("block"), F.lit(True).alias("whole"), "subroot", "path"
    )
    inner = paths.select("tree", F.col("pos").alias("block"), F.lit(False).alias("whole"), "subroot", "path")
    return ended.unionByName(inner)


def _descend(rounds: list[DataFrame], ends: list[DataFrame], end_paths: DataFrame, height: int) -> DataFrame:
    """Outer rows of the lowest round's superblocks."""
    paths = end_paths.withColumn("pos", F.lit(0).cast("long")).where(F.lit(False))
    for nodes, ended in zip(rounds[:0:-1], ends[:0:-1], strict=True):
        outer = _outer_rows(paths, ended, end_paths)
        both = _in_blocks(nodes, height).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
        paths = materialise(both.applyInPandas(_node_paths(height), f"tree string, pos long, subroot string, path {_PATH}"), "paths")
    return _outer_rows(paths, ends[0], end_paths)


def manifest(leaves: DataFrame, *, height: int = HEIGHT) -> DataFrame:
    """Proofs of the rows of ``leaves(tree, key, digest, shown)``.

    Gives key, leaf, subroot, root, proof_sha256, folded_root, verified: the root folded from ``shown``
    with the siblings of the row's own leaf, and whether it is the root. Leaves of a tree ascend by key,
    then digest, so that rows with one key have a defined order (equal leaves can stand for each other);
    a null key comes first. Trees ascend bytewise, a null tree first. A row that is its whole tree is
    its subroot; if that is the only tree it is the root, with a proof of nothing. No rows give none.
    ``height`` is that of a superblock, 8^height nodes of which a task holds at once.
    """
    # a null tree gets a name before all others
    named = leaves.select(
        F.coalesce(F.concat(F.lit("="), "tree"), F.lit("")).alias("tree"), "key", "digest", "shown", F.lit(1).alias("one")
    )
    placed = materialise(running_totals(named, ["key", "digest"], {"pos": "one"}, by="tree").drop("one"), "leaves")
    rounds, ends = _climb(placed.select("tree", "pos", "digest"), height)
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.union(more)
    ordered = running_totals(subroots.withColumn("one", F.lit(1)), ["tree"], {"pos": "one"})
    ordered = materialise(ordered.select(F.lit("").alias("tree"), "pos", "digest", F.col("tree").alias("name")), "subroots")
    top_rounds, top_ends = _climb(ordered.select("tree", "pos", "digest"), height)
    root = top_ends[-1].first()  # one row at most: the trees' own tree
    above = top_ends[-1].select("tree", F.col("digest").alias("subroot"), F.array().cast(_PATH).alias("path"))
    outer = _descend(top_rounds, top_ends, above, height)
    tops = _in_blocks(top_rounds[0], height).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    tops = tops.applyInPandas(_node_paths(height), f"tree string, pos long, subroot string, path {_PATH}")
    end_paths = materialise(
        ordered.join(tops.select("pos", "path"), "pos").select(
            F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path"
        ),
        "subroot-paths",
    )
    outer = _descend(rounds, ends, end_paths, height).groupBy("tree", "block")
    # as text, since a column of whole numbers with a null among them is one of floats to pandas
    key = placed.schema["key"].dataType
    found = (
        _in_blocks(placed.withColumn("key", F.col("key").cast("string")), height)
        .groupBy("tree", "block")
        .cogroup(outer)
        .applyInPandas(_proofs(height), "key string, leaf string, subroot string, proof_sha256 string, folded_root string")
    )
    root = F.lit(root["digest"] if root else None).cast("string")
    return found.select(
        F.col("key").cast(key).alias("key"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


def document_leaves(
    docs: DataFrame, tampered: Column, *, doc_id: str = "doc_id", tree: str = "lang", text: str = "text",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
) -> DataFrame:
    """Leaves of documents for ``manifest``; where ``tampered`` the row shown has its text in lower case.

    A null or empty field has a digest part of its own (``-`` and ``0:``), so both are leaves like any other;
    repeated rows are a leaf each, and further columns don't enter.
    """
    column = lambda name: F.col(f"`{name}`")
    leaf = digest_of(*(column(f) for f in fields))
    changed = digest_of(*(ascii_lower(column(f)) if f == text else column(f) for f in fields))
    return docs.select(
        column(tree).cast("string").alias("tree"), column(doc_id).alias("key"), leaf.alias("digest"),
        F.when(tampered, changed).otherwise(leaf).alias("shown"),
    )
