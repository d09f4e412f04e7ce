"""Mixing sources to target weights, by word counts.

Each document gets a hash-random key; documents are range-sorted by it within their source,
distributed prefix sums of the sizes find the row where a source's budget ends, and that one row per
source decides over all its documents. A budget above the source's size repeats whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from snapgrade.llm.totals import running_totals
from snapgrade.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"


def word_count(text: Column | str) -> Column:
    """Number of runs of characters other than space and \\t to \\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(doc_id: Column | str, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def source_targets(
    sizes: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """Add ``target`` to rows (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. They share ``share`` times all sizes
    by weight; no target exceeds ``most`` times its source, and the excess goes to the others by
    weight until none is above. That is one level per weight unit: the sources with the smallest
    size per weight are full first, so prefix sums in that order give the level.
    """
    sizes = running_totals(
        sizes.withColumn("_one", F.lit(1)), [F.col("source").asc_nulls_last()], {"_rank": "_one"}
    )
    step = F.pmod(F.col("_rank"), F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (step + 1).cast("int")).cast("long")
    ranked = sizes.withColumns({"_weight": weight, "_full": F.col("source_size") * most}).withColumn(
        "_ratio", F.col("_full") / F.col("_weight")
    )
    ranked = materialise(running_totals(ranked, ["_ratio", "_rank"], {"_spent": "_full", "_used": "_weight"}), "levels")
    total = ranked.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    level = (F.lit(share * (total.size or 0)) - F.col("_spent")) / (F.lit(total.weight or 1) - F.col("_used"))
    found = (
        ranked.withColumn("_level", level)
        .where("_level <= _ratio")
        .agg(F.min(F.struct("_ratio", "_rank", "_level")).alias("at"))
        .first()
    )
    full = F.col("_full").cast("double")
    target = full if found.at is None else F.least(F.lit(found.at["_level"]) * F.col("_weight"), full)
    return ranked.select("source", "source_size", target.alias("target"))


def mixing_plan(rows: DataFrame, **targets) -> DataFrame:
    """One row per source: size, target, epochs taken whole, and the document on the cut.

    ``rows`` has source, doc_id, size and _key. ``cut_words`` is what the last epoch takes of the
    document(s) at the cut; rows that repeat it share that evenly.
    """
    summed = running_totals(rows, ["_key", "doc_id", "size"], {"_before": "size"}, by="source")
    summed = materialise(summed, "prefixes")
    sizes = summed.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = source_targets(sizes, **targets).select(
        F.col("source").alias("_source"), "source_size", "target", F.floor("target").cast("long").alias("_budget")
    )
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(0))
    goal = materialise(goal.withColumn("_rest", F.expr("_budget - epochs * source_size")), "targets")
    same = F.col("source").eqNullSafe(F.col("_source"))
    # rows at the cut: the one whose words pass the budget, and rows equal to it
    rows_at = summed.join(goal, same).withColumn("_at", F.struct("_key", "doc_id", "size"))
    first = rows_at.where("_before <= _rest and _before + size > _rest").groupBy("source").agg(F.min("_at").alias("cut"))
    first = materialise(first.withColumnRenamed("source", "_cut_source"), "cuts")
    tied = (
        rows_at.join(first, F.col("source").eqNullSafe(F.col("_cut_source")) & F.col("_at").eqNullSafe(F.col("cut")))
        .groupBy("source")
        .agg(F.expr("(max(_rest) - min(_before)) div count(*)").alias("cut_words"), F.first("cut").alias("cut"))
        .withColumnRenamed("source", "_tied_source")
    )
    plan = goal.join(tied, F.col("_source").eqNullSafe(F.col("_tied_source")), "left")
    return materialise(plan.select("_source", "source_size", "target", "epochs", "cut", "cut_words"), "plan")


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = SEED,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
) -> DataFrame:
    """The documents' columns plus ``mix`` (in place of one of that name): struct(size, source_size, target, taken).

    ``taken`` counts the words that the mix takes of the document, repeats included; a source's sum
    is its target rounded down, less at most one word per row that repeats the row on the cut. Null
    or empty texts have size 0 and take 0; a null source is a source; a null doc_id sorts first among
    equal keys; an empty table gives no rows. The same rows give the same result in any partitioning.
    """
    # the whole row in one column, so that no name of the table meets one of the operator's
    packed = docs.select(
        F.struct("*").alias("row"),
        F.col(f"`{source}`").alias("source"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        word_count(f"`{text}`").alias("size"),
    )
    rows = packed.select("source", "doc_id", "size").withColumn("_key", random_key("doc_id", seed))
    plan = mixing_plan(rows, weights=weights, share=share, most=most)
    whole = packed.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    at = F.struct(random_key("doc_id", seed).alias("_key"), "doc_id", "size")
    last = (
        F.when(F.col("cut").isNull(), F.lit(0))
        .when(at < F.col("cut"), F.col("size"))
        .when(at == F.col("cut"), F.col("cut_words"))
        .otherwise(0)
    )
    taken = (F.col("size") * F.col("epochs") + last).cast("long").alias("taken")
    others = [F.col(f"row.`{c}`") for c in docs.columns if c != "mix"]
    found = whole.select("row", F.struct("size", "source_size", "target", taken).alias("found"))
    return found.select(*others, F.col("found").alias("mix"))


def mixed_documents(docs: DataFrame, **columns) -> DataFrame:
    """The mix as documents: each whole document as often as the mix takes from it, with the same columns.

    Texts are not cut: the document on a source's cut is taken whole, so a source may pass its
    target by less than one document. Documents without words are not in the mix.
    """
    names = {"doc_id": "doc_id", "text": "text", "source": "source"} | {k: v for k, v in columns.items() if k in ("doc_id", "text", "source")}
    rest = {k: v for k, v in columns.items() if k not in names}
    packed = docs.select(F.struct("*").alias("document"), *(F.col(f"`{v}`").alias(k) for k, v in names.items()))
    copies = F.expr("sequence(1L, (mix.taken + mix.size - 1) div mix.size)")
    taken = mix(packed, **rest).where("mix.taken > 0")
    return taken.select("document", F.explode(copies)).select("document.*")
