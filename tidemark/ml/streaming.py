"""Streaming models whose state is a table in the shared folder: one row of parameters per batch number.

A batch reads the model that the batch before it left and writes its own under its number. A batch
that is repeated after a failure starts from the same model and gives the same one, a job that is
started again goes on where the last one stopped, and nothing lives in the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.ml.training import StreamingKMeans, _dot, _gradient

SCHEMA = "batch bigint, n bigint, moved double, parameters string"


@dataclass(frozen=True)
class States:
    """Models by batch number below ``path``; batch -1 is the model before the first batch."""

    spark: SparkSession
    path: str

    def folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def write(self, batch: int, n: int, moved: float, parameters: dict) -> None:
        """The model that ``batch`` leaves; a repeated batch writes the same one again."""
        row = self.spark.createDataFrame([(n, moved, json.dumps(parameters))], "n bigint, moved double, parameters string")
        row.coalesce(1).write.mode("overwrite").parquet(self.folder(batch))

    def start(self, parameters: dict) -> None:
        """The model before the first batch, unless a job before wrote one."""
        if not self.exists(-1):
            self.write(-1, 0, 0.0, parameters)

    def exists(self, batch: int) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder(batch)}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def before(self, batch: int) -> dict:
        """The parameters that the batch before left; numbers of batches have no gaps."""
        return json.loads(self.spark.read.parquet(self.folder(batch - 1)).first()["parameters"])  # one row

    def history(self) -> DataFrame:
        """(batch, n, moved, parameters) of all batches."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows.where("batch >= 0").select("batch", "n", "moved", "parameters")

    def latest(self) -> dict:
        newest = self.spark.read.schema(SCHEMA).parquet(self.path).orderBy(F.desc("batch")).first()
        return json.loads(newest["parameters"])


Step = Callable[[DataFrame, dict], tuple[dict, int, float]]


def train(stream: DataFrame, states: States, step: Step, checkpoint: str, each: Callable[[DataFrame, int, dict], None] | None = None) -> None:
    """Run all batches that are there: ``step(batch, parameters)`` gives new parameters, rows and movement.

    ``checkpoint`` belongs to the states: a later call with both goes on with the next batch. ``each``
    sees every batch with the model as it was before it.
    """
    def run(batch: DataFrame, number: int) -> None:
        before = states.before(number)
        if each is not None:
            each(batch, number, before)
        after, n, moved = step(batch, before)
        states.write(number, n, moved, after)

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def linear_step(label: str, features: list[str], rate: float, rounds: int = 5, logistic: bool = False) -> Step:
    """Gradient steps of a linear or logistic regression; an empty batch leaves the model as it is."""
    def step(batch: DataFrame, parameters: dict) -> tuple[dict, int, float]:
        start = np.array(parameters["weights"], np.float64)
        weights, n = start.copy(), 0
        kept = batch.select(F.col(label).cast("double").alias(label), *features).persist()
        for i in range(rounds):
            g, n = _gradient(kept, predicted(weights, features, logistic) - F.col(label), features)
            weights = weights - rate / np.sqrt(i + 1) * g
        kept.unpersist()
        return {"weights": weights.tolist()}, n, float(np.linalg.norm(weights - start))

    return step


def predicted(weights, features: list[str], logistic: bool = False):
    """The prediction of a linear or logistic model as a column."""
    z = _dot(np.asarray(weights, np.float64), features)
    return 1 / (1 + F.exp(-z)) if logistic else z


def k_means_step(column: str, decay: float = 1.0) -> Step:
    """Centres move to the batch's means; the weight of what they have seen fades by ``decay``."""
    def step(batch: DataFrame, parameters: dict) -> tuple[dict, int, float]:
        model = StreamingKMeans(np.array(parameters["centres"], np.float64), decay)
        model.weights = np.array(parameters["weights"], np.float64)
        model.update(batch, 0, column)
        _, n, moved = model.history[0]
        return {"centres": model.centres.tolist(), "weights": model.weights.tolist()}, n, moved

    return step


def predict_on(stream: DataFrame, states: States, step: Step, checkpoint: str, path: str, key: str, label: str, features: list[str], logistic: bool = False) -> DataFrame:
    """Predict every record with the model as it was before its batch, then learn from the batch.

    (batch, key, label, prediction), a folder per batch, so a repeated batch replaces its own rows.
    """
    def each(batch: DataFrame, number: int, parameters: dict) -> None:
        rows = batch.select(key, F.col(label).cast("double").alias("label"), predicted(parameters["weights"], features, logistic).alias("prediction"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    train(stream, states, step, checkpoint, each)
    return states.spark.read.parquet(path)
