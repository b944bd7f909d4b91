"""The steps of an analysis as stages of a machine-learning pipeline, to be fitted, saved and loaded.

Tokens, hashed vectors and density topics as ``pyspark.ml`` stages: a fitted pipeline is written with
``save`` and gives the same rows after ``PipelineModel.load``.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
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

from voxtally.functions.text import tokenize
from voxtally.operators.assign import FittedSpace, assign_topics, fitted_space, load_space, save_space
from voxtally.operators.clusters import density_topics
from voxtally.operators.embed import FEATURES, fit_weights, weigh
from voxtally.operators.reduce import reduce_random
from voxtally.session import materialize
from voxtally.sources.lexicons import Lexicon


def _int(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toInt)


class ReviewTokenizer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Dictionary-first tokens of the texts in ``inputCol``, by the word lists of a lexicon."""

    lexicon = Param(Params._dummy(), "lexicon", "the word lists as JSON", TypeConverters.toString)
    low = Param(Params._dummy(), "low", "whether the low-rating scope's stop words apply", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol="content_clean", outputCol="tokens", lexicon="{}", low=False):
        super().__init__()
        self._setDefault(inputCol="content_clean", outputCol="tokens", lexicon="{}", low=False)
        self._set(**self._input_kwargs)

    @staticmethod
    def of(lexicon: Lexicon, **columns) -> ReviewTokenizer:
        return ReviewTokenizer(lexicon=json.dumps(asdict(lexicon), ensure_ascii=False), **columns)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        lexicon = Lexicon(**json.loads(self.getOrDefault(self.lexicon)))
        return tokenize(
            dataset, lexicon, self.getInputCol(), self.getOutputCol(), low=self.getOrDefault(self.low)
        )


class _Features(HasInputCol, HasOutputCol):
    features = _int("features", "the number of features")


class HashedVectors(Estimator, _Features, DefaultParamsReadable, DefaultParamsWritable):
    """Hashed TF-IDF vectors of the tokens in ``inputCol``; the weights are those of the fitted texts."""

    @keyword_only
    def __init__(self, *, inputCol="tokens", outputCol="embedding", features=FEATURES):
        super().__init__()
        self._setDefault(inputCol="tokens", outputCol="embedding", features=FEATURES)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> HashedVectorsModel:
        weights = fit_weights(dataset, self.getInputCol(), self.getOrDefault(self.features))
        return self._copyValues(HashedVectorsModel(weights=weights))


class HashedVectorsModel(Model, _Features, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "one weight per feature", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol="tokens", outputCol="embedding", features=FEATURES, weights=None):
        super().__init__()
        self._setDefault(inputCol="tokens", outputCol="embedding", features=FEATURES)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return weigh(dataset, self.getOrDefault(self.weights), self.getInputCol(), self.getOutputCol())


class _TopicParams(HasInputCol, HasOutputCol):
    idCol = Param(Params._dummy(), "idCol", "a unique number of each row", TypeConverters.toString)
    components = _int("components", "dimensions to cluster in")
    minClusterSize = _int("minClusterSize", "rows that make a topic")
    minSamples = _int("minSamples", "the neighbour that says how dense a row lies")
    neighbors = _int("neighbors", "neighbours a row may be linked to")
    epsQuantile = Param(Params._dummy(), "epsQuantile", "share of rows that are dense", TypeConverters.toFloat)

    DEFAULTS = {
        "inputCol": "embedding",
        "outputCol": "topic",
        "idCol": "review_id",
        "components": 5,
        "minClusterSize": 50,
        "minSamples": 10,
        "neighbors": 15,
        "epsQuantile": 0.9,
    }

    def _reduced(self, dataset: DataFrame) -> DataFrame:
        key, components = self.getOrDefault(self.idCol), self.getOrDefault(self.components)
        rows = dataset.select(key, self.getInputCol())
        return materialize(
            reduce_random(rows, self.getInputCol(), "_reduced", components).select(key, "_reduced"), "reduced"
        )


class DensityTopics(Estimator, _TopicParams, DefaultParamsReadable, DefaultParamsWritable):
    """Density topics over the vectors in ``inputCol``; later rows are placed by the fitted ones."""

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> DensityTopicsModel:
        key, get = self.getOrDefault(self.idCol), self.getOrDefault
        rows = self._reduced(dataset)
        shared = {
            "min_samples": get(self.minSamples),
            "n_neighbors": get(self.neighbors),
            "eps_quantile": get(self.epsQuantile),
        }
        topics = density_topics(rows, key, "_reduced", min_cluster_size=get(self.minClusterSize), **shared)
        model = DensityTopicsModel(fitted_space(rows, topics, key, "_reduced", **shared))
        return self._copyValues(model)


class DensityTopicsModel(Model, _TopicParams, MLWritable, MLReadable):
    """Adds to each row the topic of the nearest fitted row it is linked to, -1 where there is none."""

    def __init__(self, space: FittedSpace | None = None):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self.space = space

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, output = self.getOrDefault(self.idCol), self.getOutputCol()
        found = assign_topics(self._reduced(dataset), self.space, key, "_reduced")
        return dataset.join(found.select(key, found["topic"].alias(output)), key, "left")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, instance: DensityTopicsModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        save_space(self.instance.space, f"{path}/space")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> DensityTopicsModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(load_space(self.sparkSession, f"{path}/space"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
