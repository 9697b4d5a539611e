"""Predictors behind one interface, with three carriers.

A scorer has a name, a version, a flag that marks stand-ins, and turns a frame
with its inputs into the same frame with a prediction column. What carries the
model differs:

* ``ExpressionScorer``: a column expression, inside whole-stage code;
* ``PipelineScorer``: a stored Spark ML ``PipelineModel``, loaded once;
* ``ArrowScorer``: any model that predicts a matrix, shipped once per
  executor as bytes and built once per worker process.

``save_scorer`` writes a description beside the model; ``load_scorer`` reads it
and gives the right carrier, so a caller that looked up the active model needs
to know only its folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from larder.operators import features as fe
from larder.operators.gram import LinearFit


class Scorer(Protocol):
    name: str
    version: str
    features: list[str]
    is_mock: bool

    def transform(self, df: DataFrame, output: str = "predicted") -> DataFrame: ...


@dataclass
class ExpressionScorer:
    name: str
    version: str
    features: list[str]
    expression: Callable[[DataFrame], Column]
    is_mock: bool = False

    def transform(self, df: DataFrame, output: str = "predicted") -> DataFrame:
        return df.withColumn(output, self.expression(df))


@dataclass
class PipelineScorer:
    """Stored pipeline over the named inputs; rows with a missing input get no prediction."""

    name: str
    version: str
    features: list[str]
    path: str
    is_mock: bool = False
    _model: PipelineModel | None = field(default=None, repr=False)

    def transform(self, df: DataFrame, output: str = "predicted") -> DataFrame:
        if self._model is None:
            self._model = PipelineModel.load(self.path)
        given = [f for f in df.columns]
        ready = F.lit(True)
        for f in self.features:
            ready = ready & F.col(f).isNotNull()
        # The assembler needs numbers: a missing one is replaced and its prediction dropped.
        inputs = df.withColumns({f"_in_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features})
        return self._model.transform(inputs).select(*given, F.when(ready, F.col("prediction")).alias(output))


_BUILT: dict[tuple[str, str], Callable[[np.ndarray], np.ndarray]] = {}


@dataclass
class ArrowScorer:
    """``build`` turns the model's bytes into a function of a matrix; a missing input is passed as NaN and gets no prediction."""

    name: str
    version: str
    features: list[str]
    payload: bytes
    build: Callable[[bytes], Callable[[np.ndarray], np.ndarray]]
    is_mock: bool = False

    def transform(self, df: DataFrame, output: str = "predicted") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.payload)  # one model, bounded by what a worker can hold
        features, build, key = self.features, self.build, (self.name, self.version)
        schema = StructType([*df.schema.fields, StructField(output, DoubleType())])
        inputs = df.select("*", F.array(*[F.col(f).cast("double") for f in features]).alias("_inputs"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if key not in _BUILT:
                    _BUILT[key] = build(shared.value)
                rows = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(features))
                missing = np.isnan(rows).any(axis=1)
                made = pa.array(_BUILT[key](rows), pa.float64(), mask=missing)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], output])

        return inputs.mapInArrow(run, schema)


def scaled(df: DataFrame, ranges: dict[str, tuple[float, float]], features: list[str]) -> dict[str, Column]:
    """Inputs on the training range, missing ones as null."""
    return {f: fe.min_max_scale(F.col(f).cast("double"), F.lit(ranges[f][0]), F.lit(ranges[f][1])) for f in features}


def linear_scorer(fit: LinearFit, ranges: dict[str, tuple[float, float]], target: str, name: str = "ridge", version: str = "1") -> ExpressionScorer:
    """A linear model of scaled inputs and target as an expression: inverse-scaled and clipped at 0."""
    lo, hi = ranges[target]

    def expression(df: DataFrame) -> Column:
        raw = fit.expression(scaled(df, ranges, fit.features))
        return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), fe.min_max_inverse(raw, F.lit(lo), F.lit(hi))))

    return ExpressionScorer(name, version, fit.features, expression)


def save_scorer(spark: SparkSession, path: str, carrier: str, name: str, version: str, features: list[str], model: dict | None = None,
                is_mock: bool = False) -> None:
    """Describe a model under ``path``: ``carrier`` is linear, pipeline (stored at ``path``/model) or the key of a builder."""
    text = json.dumps({"carrier": carrier, "name": name, "version": version, "features": features, "model": model, "is_mock": is_mock})
    spark.createDataFrame([(text,)], "description string").coalesce(1).write.mode("overwrite").text(f"{path}/description")


def load_scorer(spark: SparkSession, path: str, builders: dict[str, Callable] | None = None) -> Scorer:
    """The scorer described under ``path``; no fit and no data is needed."""
    d = json.loads(spark.read.text(f"{path}/description").first()[0])
    if d["carrier"] == "linear":
        m = d["model"]
        ranges = {k: tuple(v) for k, v in m["ranges"].items()}
        scorer = linear_scorer(LinearFit(d["features"], m["weights"], m["intercept"]), ranges, m["target"], d["name"], d["version"])
        scorer.is_mock = d["is_mock"]
        return scorer
    if d["carrier"] == "pipeline":
        return PipelineScorer(d["name"], d["version"], d["features"], f"{path}/model", d["is_mock"])
    if d["carrier"] in (builders or {}):
        return ArrowScorer(d["name"], d["version"], d["features"], json.dumps(d["model"]).encode(), builders[d["carrier"]], d["is_mock"])
    raise ValueError(f"unknown model carrier {d['carrier']!r}")
