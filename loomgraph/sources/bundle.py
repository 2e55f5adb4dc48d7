"""Weights as a bundle: a table of matrix rows, and a manifest that says what they are and what they fit.

A bundle is published at once and never half: it is written under another name and renamed. It is
checked before any matrix is read: what the manifest says against what is asked for, and the
table's names and shapes, counted by Spark, against the manifest.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import files_of, publish

VERSION = 1


class BundleError(ValueError):
    """A bundle that must not be loaded, and why."""


def found_shapes(weights: DataFrame) -> dict[str, list[int]]:
    """Shape of each matrix of (name, row, e); one whose rows are not numbered from 0, or of several lengths, is an error."""
    size = F.size("e")
    counted = weights.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row").alias("rows"), F.min("row").alias("first"), F.max("row").alias("last"), F.min(size).alias("short"), F.max(size).alias("long"), F.count_if(F.exists("e", lambda x: x.isNull() | F.isnan(x))).alias("bad"))
    out = {}
    for r in counted.collect():  # a row a matrix
        if (r.n, r.first, r.last) != (r.rows, 0, r.rows - 1):
            raise BundleError(f"{r.name} lacks rows, or has some twice")
        if r.short != r.long:
            raise BundleError(f"{r.name} has rows of {r.short} and of {r.long} numbers")
        if r.bad:
            raise BundleError(f"{r.name} holds numbers that are null or none")
        out[r.name] = [r.n, r.long]
    return out


def write_bundle(weights: DataFrame, path: str, kind: str, hidden: int, backbone: str, step: int = 0, prefixes: tuple[str, ...] = ()) -> None:
    """Publish (name, row, e) at path, which must be free; with prefixes, only matrices whose names begin with one of them."""
    spark = weights.sparkSession
    own = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    if prefixes:
        chosen = F.lit(False)
        for p in prefixes:
            chosen = chosen | F.startswith("name", F.lit(p))
        weights = weights.where(chosen)
    weights.select("name", "row", "e").repartition("name").sortWithinPartitions("name", "row").write.parquet(f"{own}/weights")
    shapes = found_shapes(spark.read.parquet(f"{own}/weights"))
    manifest = {"version": VERSION, "kind": kind, "hidden": hidden, "backbone": backbone, "step": step, "shapes": shapes}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{own}/manifest")
    if not publish(spark, own, path):
        raise BundleError(f"there is something at {path} already")


def read_manifest(spark: SparkSession, path: str) -> dict:
    at, files = files_of(spark, f"{path}/manifest/_SUCCESS")
    if not files.exists(at):
        raise BundleError(f"there is no whole bundle at {path}")
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest.get("version") != VERSION:
        raise BundleError(f"the bundle is of version {manifest.get('version')}, not {VERSION}")
    return manifest


def read_bundle(spark: SparkSession, path: str, kind: str | None = None, hidden: int | None = None, backbone: str | None = None, shapes: dict[str, tuple[int, int]] | None = None) -> dict[str, np.ndarray]:
    """The matrices by name, after every check that was asked for; shapes are those that a model needs, all of them and no others."""
    manifest = read_manifest(spark, path)
    for what, want in (("kind", kind), ("hidden", hidden), ("backbone", backbone)):
        if want is not None and manifest[what] != want:
            raise BundleError(f"the bundle's {what} is {manifest[what]!r}, and {want!r} is asked for")
    stated = {k: tuple(v) for k, v in manifest["shapes"].items()}
    if shapes is not None:
        if lost := sorted(shapes.keys() - stated.keys()):
            raise BundleError(f"missing matrices: {lost}")
        if more := sorted(stated.keys() - shapes.keys()):
            raise BundleError(f"unexpected matrices: {more}")
        for name, want in shapes.items():
            if stated[name] != tuple(want):
                raise BundleError(f"{name} is {stated[name]} in the bundle, and {tuple(want)} in the model")
    table = spark.read.parquet(f"{path}/weights")
    held = {k: tuple(v) for k, v in found_shapes(table).items()}
    if held != stated:
        wrong = sorted(k for k in held.keys() | stated.keys() if held.get(k) != stated.get(k))
        raise BundleError(f"the table does not hold what the manifest states: {wrong}")
    out = {name: np.empty(shape) for name, shape in stated.items()}
    for r in table.toLocalIterator():
        out[r.name][r.row] = r.e
    return out
