"""The encoder and the outcome model as stages of ``pyspark.ml`` pipelines, which are saved and loaded with them."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model as Stage
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from foretell.operators.models import Encoder, Linear, Model, fit_encoder, fit_logistic


class _Given(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to encode", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector of encoded values", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "outcome, 0 to 2", TypeConverters.toString)
    pruneAt = Param(Params._dummy(), "pruneAt", "absolute correlation from which a column goes; above 1: none goes", TypeConverters.toFloat)
    dropIfBinary = Param(Params._dummy(), "dropIfBinary", "one indicator for texts of two values", TypeConverters.toBoolean)
    c = Param(Params._dummy(), "c", "weight of the loss against half the squared weights", TypeConverters.toFloat)
    state = Param(Params._dummy(), "state", "what was learned, as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(outputCol="features", labelCol="target_label", pruneAt=2.0, dropIfBinary=False, c=1.0)

    def _prune(self) -> float | None:
        at = self.getOrDefault(self.pruneAt)
        return at if at <= 1 else None


class FeatureEncoder(Estimator, _Given, DefaultParamsReadable, DefaultParamsWritable):
    """Learns medians, modes, scales and, with ``pruneAt``, which correlated columns go."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", labelCol="target_label", pruneAt=2.0, dropIfBinary=False):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FeatureEncoderModel:
        encoder = fit_encoder(dataset, self.getOrDefault(self.inputCols), self._prune(), self.getOrDefault(self.dropIfBinary), self.getOrDefault(self.labelCol))
        return self._copyValues(FeatureEncoderModel()._set(state=json.dumps(asdict(encoder))))


class FeatureEncoderModel(Stage, _Given, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the encoded values as a vector."""

    @property
    def encoder(self) -> Encoder:
        return Encoder(**json.loads(self.getOrDefault(self.state)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOrDefault(self.outputCol), self.encoder.vector())


class OutcomeLogistic(Estimator, _Given, DefaultParamsReadable, DefaultParamsWritable):
    """The penalised logistic model over encoded columns; encoding is learned with it."""

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="target_label", pruneAt=2.0, dropIfBinary=False, c=1.0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> OutcomeLogisticModel:
        model = fit_logistic(dataset, self.getOrDefault(self.inputCols), self.getOrDefault(self.c), self.getOrDefault(self.labelCol), self._prune(), self.getOrDefault(self.dropIfBinary))
        return self._copyValues(OutcomeLogisticModel()._set(state=json.dumps(asdict(model))))


class OutcomeLogisticModel(Stage, _Given, DefaultParamsReadable, DefaultParamsWritable):
    """Adds p0, p1 and p2."""

    @property
    def model(self) -> Model:
        held = json.loads(self.getOrDefault(self.state))
        return Model(Encoder(**held["encoder"]), held["classes"], Linear(**held["fitted"]), held["columns"], held["converged"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.predict(dataset)
