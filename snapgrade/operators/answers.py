"""Answers of an external model, kept by the content they were asked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from snapgrade import schemas
from snapgrade.session import materialise
from snapgrade.sources.sinks import append_rows, read_or_empty


def kept_answers(sent: DataFrame, path: str, model: str) -> DataFrame:
    """The answer kept for each text digest under one model: digest, answer.

    If two attempts asked the same text at a time, the least of their answers counts, on every read.
    """
    kept = read_or_empty(sent.sparkSession, path, schemas.ANSWERS).where(F.col("model") == model)
    return kept.groupBy("digest").agg(F.min("answer").alias("answer"))


def ask_missing(
    sent: DataFrame, path: str, ask: Callable[[DataFrame], DataFrame], *, model: str, at: Column | None = None
) -> DataFrame:
    """Answers (batch, text) of ``sent`` (batch, text); only texts that have none yet are asked.

    A text is known by its SHA-256 and the model's name, so a repeated or resumed run, or another run
    that sends the same text, asks nothing again. Of equal texts the least batch is asked. ``ask`` may
    leave a batch out or answer null: nothing is kept for it, it gives no row here, and the next run
    asks it again while the others go on. A null text is never asked. ``ask`` is not called at all
    when everything has an answer. Answers are stored before they are used: a failure later in a run
    finds them there.
    """
    digested = materialise(sent.select("batch", "text", F.sha2("text", 256).alias("digest")), "sent")
    known = kept_answers(sent, path, model).select("digest")
    open_texts = digested.where("digest is not null").groupBy("digest").agg(F.min(F.struct("batch", "text")).alias("first"))
    fresh = open_texts.join(known, "digest", "left_anti").select("digest", "first.batch", "first.text")
    fresh = materialise(fresh, "unanswered")
    if not fresh.isEmpty():
        replies = ask(fresh.select("batch", "text")).select("batch", F.col("text").alias("answer")).where("answer is not null")
        new = fresh.select("digest", "batch").join(replies, "batch").select(
            "digest", "answer", (F.current_timestamp() if at is None else at).alias("asked_at"), F.lit(model).alias("model")
        )
        append_rows(new, path, ["model"])
    answers = kept_answers(sent, path, model)
    return digested.join(answers, "digest").select("batch", F.col("answer").alias("text"))
