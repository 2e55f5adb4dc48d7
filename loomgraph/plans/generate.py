"""From a graph's tables to prompt records, and from answers to scores: what a user calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import prompts as P
from ..operators import scoring as S
from ..session import stash
from ..sources import catalog
from ..sources.tables import write_prompts


def context_prompts(dataset: str, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, split: str = "test", classes: list[str] | None = None, threshold: float = 0.1, beta: float = C.BETA, large: bool = False) -> DataFrame:
    """(id, graph, conversations) of every node of a split: its context sequence, its prompt, its class.

    nodes is (id, y, split) with text, title or abstract; large caps each step's candidates
    and samples coherence with return, as suits graphs with very large neighbourhoods.
    """
    for c in ("text", "title", "abstract"):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast("string"))
    own = nodes.where(F.col("split") == split)
    centers = own.select("id")
    starts = C.start_neighbors(centers, edges)
    coh = stash(C.coherence(vectors, edges, returns=large), "coherence")
    walk = C.walks(starts, edges, vectors, coh, beta=beta, threshold=threshold, cap=C.CAP if large else None, eps=0.0 if large else 1e-10)
    names = classes if classes is not None else P.CLASSES[dataset]
    label = F.get(F.array(*(F.lit(x) for x in names)), F.col("y").cast("int"))
    human = P.render(dataset, {c: F.col(c) for c in ("text", "title", "abstract")}, classes)
    rows = C.sequences(centers, starts, walk).withColumnRenamed("center", "id").join(own, "id")
    return rows.select(P.record(F.col("id"), F.col("graph"), human, label).alias("r")).select("r.*")


def write_dataset(dataset: str, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, folder: str, force_train: bool = False, **options) -> list[str]:
    """Prompt files of the splits that the data set has them for; their paths."""
    paths = []
    for split in catalog.splits(dataset, force_train):
        write_prompts(context_prompts(dataset, nodes, edges, vectors, split, **options), path := f"{folder}/ocs_{split}.jsonl")
        paths.append(path)
    return paths


def _generic(answers: DataFrame, labels: DataFrame) -> DataFrame:
    return S.generic_classes(answers).agg(F.count(F.lit(1)).alias("n"), S.rounded(F.avg(F.col("correct").cast("double"))).alias("acc"))


def _ranked(answers: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = F.col("logit")[0], F.col("logit")[1]
    return S.ranking(answers.select("gt", S.rounded(1 / (1 + F.exp(b - a))).alias("score")))


#: Scorers by data set and task; a data set that is not listed has those under None.
SCORERS = {
    (None, "nc"): _generic,
    (None, "lp"): lambda answers, labels: S.link_accuracy(answers),
    (None, "lprank"): _ranked,
    ("arxiv", "nc"): S.coded_classes,
    ("products", "nc"): S.tolerant_classes,
    ("arxiv", "nd"): lambda answers, labels: S.description_accuracy(answers),
    ("pubmed", "nd"): lambda answers, labels: S.description_accuracy(answers, None, 18),
    ("cora", "nc-first"): S.first_token_classes,
    ("pubmed", "nc-suffix"): S.suffix_classes,
}


def evaluate(dataset: str, task: str, answers: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The score of answers (question_id, text, gt, and logit for lprank) to a task; labels is (label)."""
    scorer = SCORERS.get((dataset, task)) or SCORERS.get((None, task))
    if scorer is None:
        raise ValueError(f"no scorer for {dataset} {task}")
    return scorer(answers, labels if labels is not None else answers.select(F.col("gt").alias("label")).distinct())
