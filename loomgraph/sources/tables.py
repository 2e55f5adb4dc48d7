"""Reading and writing nodes, edges, vectors, prompts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stash

PROMPT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("graph", T.ArrayType(T.LongType())),
        T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]))),
    ]
)
ANSWER = T.StructType([T.StructField("question_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("prompt", "text", "gt", "answer_id")), T.StructField("graph", T.ArrayType(T.LongType())), T.StructField("logit", T.ArrayType(T.DoubleType()))])


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text, y, split): embeddings' ids and labels with documents' texts; three fifths train, one val, one test."""
    v = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"))
    d = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    part = F.when(F.col("id") % 5 < 3, "train").when(F.col("id") % 5 == 3, "val").otherwise("test")
    return v.join(d, "id", "left").select("id", "text", "y", part.alias("split"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, e): vectors in double."""
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROMPT).json(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """All answers below path: those of runs, and those of a stream's batches in folders of their own."""
    return spark.read.schema(ANSWER).option("recursiveFileLookup", "true").json(path)


def write_prompts(prompts: DataFrame, path: str, skip_if_there: bool = False) -> None:
    """One JSON object a line; an existing folder is replaced, or left alone."""
    prompts.write.mode("ignore" if skip_if_there else "overwrite").json(path)


def with_answer_ids(answers: DataFrame) -> DataFrame:
    """answers with an answer_id where it lacks one: 22 characters that follow from the question, its prompt and the answer, so that a repeated task writes the same."""
    said = F.concat_ws("\x1f", F.col("question_id").cast("string"), *(F.coalesce(c, F.lit("")) for c in ("prompt", "text") if c in answers.columns))
    made = F.substring(F.sha2(said, 256), 1, 22)
    return answers.withColumn("answer_id", F.coalesce("answer_id", made) if "answer_id" in answers.columns else made)


def append_answers(todo: DataFrame, path: str) -> int:
    """Append the answers whose question is not yet in path; how many were. A run that was cut off goes on from there."""
    spark = todo.sparkSession
    try:
        done = read_answers(spark, path).select("question_id")
    except Exception as e:  # only a path that is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], "question_id long")
    from ..operators.batching import not_yet_written

    new = stash(with_answer_ids(not_yet_written(todo, done.distinct())), "answers")  # path is read once
    new.write.mode("append").json(path)
    return new.count()


def write_shards(rows: DataFrame, path: str) -> None:
    """rows has shard: a folder of files for each."""
    rows.write.mode("overwrite").partitionBy("shard").parquet(path)
