"""Scale-and-encode transformer as a pipeline stage.

Fitting yields two tables, not driver objects: one row of mean and scale per
numeric column, and the class dictionary. Both are saved as parquet beside the
parameters, so that a pipeline with this stage can be saved and loaded.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame

from meterline import schemas as S
from meterline.operators import lookups as LK
from meterline.sources.staging import stage


class _TripParams(Params):
    numericalFeatures = Param(
        Params._dummy(), "numericalFeatures", "columns to scale", TypeConverters.toListString
    )
    categoricalFeatures = Param(
        Params._dummy(), "categoricalFeatures", "columns to encode", TypeConverters.toListString
    )
    scaleNumerical = Param(
        Params._dummy(), "scaleNumerical", "whether to scale", TypeConverters.toBoolean
    )
    skewed = Param(
        Params._dummy(), "skewed", "whether hot classes are found and split", TypeConverters.toBoolean
    )

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            numericalFeatures=list(S.TRANSFORMER_NUMERICAL),
            categoricalFeatures=list(S.TRANSFORMER_CATEGORICAL),
            scaleNumerical=True,
            skewed=False,
        )

    def _columns(self, df: DataFrame) -> tuple[list[str], list[str]]:
        numeric = self.getOrDefault(self.numericalFeatures)
        if not self.getOrDefault(self.scaleNumerical):
            numeric = []
        text = self.getOrDefault(self.categoricalFeatures)
        return [c for c in numeric if c in df.columns], [c for c in text if c in df.columns]


class TripFeatureTransformer(Estimator, _TripParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **params) -> None:
        super().__init__()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> "TripFeatureModel":
        numeric, text = self._columns(dataset)
        # Staged, so that transforming never refits and joins know the sizes.
        scaler = stage(LK.scaler_fit(dataset, numeric), "scaler") if numeric else None
        classes = stage(LK.encoder_fit(dataset, text), "classes") if text else None
        return self._copyValues(TripFeatureModel(scaler, classes))


class TripFeatureModel(Model, _TripParams, MLReadable, MLWritable):
    def __init__(self, scaler: DataFrame | None = None, classes: DataFrame | None = None) -> None:
        super().__init__()
        self.scaler, self.classes = scaler, classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Same rows and columns; an unseen class gives -1."""
        numeric, text = self._columns(dataset)
        out = dataset
        if self.scaler is not None and numeric:
            out = LK.scaler_apply(out, self.scaler, numeric)
        if self.classes is not None and text:
            out = LK.encode_lookup(out, self.classes, text, self.getOrDefault(self.skewed))
        return out.select(*dataset.columns)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: TripFeatureModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        """The whole target is new: the caller refuses or clears one that exists."""
        fitted = {"scaler": self.model.scaler, "classes": self.model.classes}
        tables = {name: table for name, table in fitted.items() if table is not None}
        DefaultParamsWriter.saveMetadata(
            self.model, path, self.sparkSession, extraMetadata={"tables": sorted(tables)}
        )
        for name, table in tables.items():
            table.write.parquet(f"{path}/{name}")


class _ModelReader(MLReader):
    def load(self, path: str) -> TripFeatureModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = {t: self.sparkSession.read.parquet(f"{path}/{t}") for t in metadata["tables"]}
        model = TripFeatureModel(**tables)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
