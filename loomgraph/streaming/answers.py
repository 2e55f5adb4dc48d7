"""Streams of answers: scored as they arrive, appended once each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import files_of
from ..sources.tables import ANSWER, with_answer_ids


def stream_answers(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(ANSWER).option("maxFilesPerTrigger", files_at_once).json(folder)


def first_answers(answers: DataFrame) -> DataFrame:
    """One answer a question of a stream: of the earliest batch that has any, the one of the least answer_id.

    What is kept is one mark a question, in the state store, partitioned by question: a batch costs
    as much as it holds, however many answers came before.
    """
    columns = [f.name for f in ANSWER]

    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in parts:
            if not state.exists and len(pdf):
                least = pdf.sort_values("answer_id").head(1)
                best = least if best is None or least.answer_id.iloc[0] < best.answer_id.iloc[0] else best
        if best is not None:
            state.update((True,))
            yield best[columns]

    known = with_answer_ids(answers.where("question_id is not null")).select(*columns)
    return known.groupBy("question_id").applyInPandasWithState(first, ANSWER, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def append_stream(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each question's first answer (first_answers) below path; replayed batches and restarts add nothing twice.

    A batch has a folder of its own, named after the checkpoint and the batch, and a replay of it
    writes the same again. A stream that begins anew, without its checkpoint, leaves out the
    questions that path holds at that time: they are read once a batch of that stream, and do not grow with it.
    """
    spark = answers.sparkSession
    own = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    at, files = files_of(spark, path)
    held = [f.getPath().toString() for f in files.listStatus(at)] if files.exists(at) else []
    before = [p for p in held if not p.rsplit("/", 1)[-1].startswith((f"stream-{own}-", "_", "."))]
    if before:
        done = spark.read.schema(ANSWER).option("recursiveFileLookup", "true").json(before).select("question_id").distinct()
        answers = answers.join(done, "question_id", "left_anti")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/stream-{own}-{number}")

    return first_answers(answers).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_accuracy(answers: DataFrame) -> DataFrame:
    """Link accuracy so far, as an updating aggregate."""
    yes = F.contains(F.trim("text"), F.lit("yes"))
    right = (yes & F.contains(F.trim("gt"), F.lit("yes"))) | (~yes & F.contains(F.trim("gt"), F.lit("no")))
    return answers.groupBy().agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"))
