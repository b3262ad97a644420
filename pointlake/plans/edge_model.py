"""Pair classifier on patch features: does one patch have to be turned against the other?

Spark ML fits it on the distributed sample table; only the weights reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from pointlake.functions.geometry import XYZ


def _inputs(samples: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Both features, their products (whose sign carries agreement) and the offset of the centres, as ``_v``.

    The features themselves stay only if ``keep`` names them.
    """
    rest = [c for c in samples.columns if c not in ("fa", "fb") or c in keep]
    offset = [f"d{c}" for c in XYZ]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (_matrix(batch.column(c)) for c in ("fa", "fb"))
            apart = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in offset], 1)
            every = np.hstack([a, b, a * b, apart])
            values = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * every.shape[1], pa.array(every.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), values], [*rest, "_v"])

    types = dict(samples.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in rest)
    return samples.mapInArrow(run, f"{schema}, _v array<double>").withColumn("_v", array_to_vector("_v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(samples: DataFrame, kind: str = "logistic", hidden: list[int] = (32,), max_iter: int = 20, seed: int = 42) -> PipelineModel:
    """``samples``: fa, fb, dx, dy, dz, label (1 = the ends differ)."""
    data = _inputs(samples).withColumn("label", F.col("label").cast("double"))
    assemble = VectorAssembler(inputCols=["_v"], outputCol="inputs")
    if kind == "logistic":
        learner = LogisticRegression(featuresCol="inputs", labelCol="label", maxIter=max_iter, regParam=1e-3)
    elif kind == "mlp":
        width = samples.select(F.size("fa") * 3 + 3).first()[0]
        learner = MultilayerPerceptronClassifier(
            featuresCol="inputs", labelCol="label", layers=[width, *hidden, 2], maxIter=max_iter, seed=seed
        )
    else:
        raise ValueError(f"unknown edge model {kind}")
    return Pipeline(stages=[assemble, learner]).fit(data)


def score(model: PipelineModel, samples: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(cloud_id, src, dst, logit, probability) and the kept columns: large logits ask the ends to differ."""
    out = model.transform(_inputs(samples, keep))
    raw, prob = vector_to_array("rawPrediction"), vector_to_array("probability")
    return out.select(
        "cloud_id", F.col("i").alias("src"), F.col("j").alias("dst"), raw[1].alias("logit"), prob[1].alias("probability"), *keep
    )


def score_with(fn: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], samples: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(cloud_id, src, dst, logit, probability) and the kept columns from a plugged-in scorer.

    ``fn`` maps two feature matrices (pairs x width) and the offsets of the centres (pairs x 3) to one logit per pair; it
    sees the pairs in batches, as they come.
    """
    names = ["cloud_id", "i", "j", *keep]
    types = dict(samples.dtypes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("fa", "fb")]
            offset = np.stack([batch.column(f"d{c}").to_numpy(zero_copy_only=False) for c in XYZ], 1)
            logit = np.asarray(fn(*sides, offset), np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(logit)], [*names, "logit"])

    rows = samples.select(*names, "fa", "fb", *[f"d{c}" for c in XYZ])
    out = rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", logit double")
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))
    return out.select("cloud_id", F.col("i").alias("src"), F.col("j").alias("dst"), "logit", probability.alias("probability"), *keep)


def evaluate(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """Binary metrics of the classifier on labelled samples."""
    from pointlake.operators.metrics import binary_metrics

    keep = samples.select("cloud_id", F.col("i"), F.col("j"), "fa", "fb", *[f"d{c}" for c in XYZ], "label")
    out = model.transform(_inputs(keep)).select(
        vector_to_array("rawPrediction")[1].alias("logit"), F.col("label").alias("target")
    )
    return binary_metrics(out)
