"""Transformers as stages of a pyspark.ml Pipeline, saved to and loaded from the cluster's file system.

A `FrameStage` holds one of the transformers of `estimators` (or a chain of them) with its columns and confounds. Fitting gives
a `FrameModel`. Both are written with the metadata of the stage, as Spark does: what was fitted is a few numbers
for each column, however many rows there were.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from varistrata.functions import kernels
from varistrata.operators import estimators, linear

#: What can be written, by name.
KINDS = {c.__name__: c for c in (estimators.Estimator, estimators.Standardise, estimators.RobustScale, estimators.QuantileNormal, estimators.Square, estimators.MeanImpute, estimators.RegressionImpute, estimators.SelectColumns, estimators.Deconfound, estimators.Components, estimators.Chain, kernels.NanPca, linear.Imputation)}


def encoded(x):
    """Plain values for JSON; arrays, tuples, mappings and the objects of KINDS are told apart."""
    if type(x).__name__ in KINDS and type(x) is KINDS[type(x).__name__]:
        return {"kind": type(x).__name__, "held": encoded(dict(x.__dict__))}
    if isinstance(x, np.ndarray):
        return {"array": x.tolist(), "type": x.dtype.str}
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, dict):
        return {"pairs": [[encoded(k), encoded(v)] for k, v in x.items()]}
    if isinstance(x, tuple):
        return {"tuple": [encoded(v) for v in x]}
    if isinstance(x, list):
        return [encoded(v) for v in x]
    if x is None or isinstance(x, bool | int | float | str):
        return x
    raise TypeError(f"a {type(x).__name__} can't be written")


def decoded(x):
    if isinstance(x, list):
        return [decoded(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "kind" in x:
        if x["kind"] not in KINDS:
            raise TypeError(f"there is no {x['kind']} to read")
        out = object.__new__(KINDS[x["kind"]])
        out.__dict__.update(decoded(x["held"]))
        return out
    if "array" in x:
        return np.array(x["array"], dtype=x["type"])
    return {decoded(k): decoded(v) for k, v in x["pairs"]} if "pairs" in x else tuple(decoded(v) for v in x["tuple"])


class _Parameters(Params):
    definition = Param(Params._dummy(), "definition", "the transformer, as JSON", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "the columns it is fitted on", TypeConverters.toListString)
    confounds = Param(Params._dummy(), "confounds", "columns that are regressed out", TypeConverters.toListString)


class FrameStage(Estimator, _Parameters, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer to be fitted; the stages before it must leave its columns and confounds there."""

    def __init__(self, step: estimators.Estimator | None = None, columns: Sequence[str] = (), confounds: Sequence[str] = ()):
        super().__init__()
        if step is not None:
            self._set(definition=json.dumps(encoded(step)))
        self._set(columns=list(columns), confounds=list(confounds))

    def _fit(self, dataset: DataFrame) -> FrameModel:
        step = decoded(json.loads(self.getOrDefault(self.definition)))
        fitted = step.fit(dataset, self.getOrDefault(self.columns), self.getOrDefault(self.confounds))
        return self._copyValues(FrameModel(fitted))


class FrameModel(Model, _Parameters, MLReadable, MLWritable):
    """A fitted transformer; `fitted` has what it found, `fitted.columns_out` what became of its columns."""

    def __init__(self, fitted: estimators.Estimator | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: FrameModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"fitted": encoded(self.instance.fitted)})


class _Reader(MLReader):
    def load(self, path: str) -> FrameModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = FrameModel(decoded(metadata["fitted"]))
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out
