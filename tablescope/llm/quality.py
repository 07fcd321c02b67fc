"""Quality scores by co-training: a text classifier and a metadata classifier teach each other.

Both are logistic regressions.  In every round each of them labels the rows of an
unlabelled pool that it is sure of, and the other one learns from those labels in
the next round.  Labelled rows that neither has seen calibrate each view and weigh
the two against each other; the result scores all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablescope.llm.text import NOT_SPACE, Words, buffers, col, extend
from tablescope.llm.toxicity import held_out
from tablescope.session import checkpoint

MAX_LABELLED = 20_000  # rows that are learnt from, the smallest by hash of their key
MAX_POOL = 20_000  # unlabelled rows that are labelled in the rounds, chosen alike
ROUNDS = 2
SURE = 0.97
SLOTS = 256  # of the hashed metadata
FEATURES = (
    "words, bytes a word, distinct words, upper case, digits, beyond ASCII, symbols, closing marks, lines, repeated lines, "
    "words ending in a symbol, longest word"
).split(", ")


def _flags(*ranges) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


CLASSES = {
    "upper case": _flags((65, 90)),
    "digits": _flags((48, 57)),
    "beyond ASCII": _flags((128, 255)),
    "symbols": _flags((35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 126)),
    "closing marks": _flags((33, 33), (46, 46), (63, 63)),
}


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; zeros for an empty one."""
    raw, bounds = buffers(texts)
    words = Words(texts, NOT_SPACE)
    n, size = words.counts, np.diff(bounds)
    some, filled = np.maximum(n, 1), np.maximum(size, 1)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[bounds[1:]] - total[bounds[:-1]]

    out = {name: count(flags[raw]) / filled for name, flags in CLASSES.items()}
    out["words"] = np.log1p(n)
    out["bytes a word"] = size / some
    hashes = words.hashes()
    order = np.lexsort((hashes, words.doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    out["distinct words"] = np.bincount(words.doc[order][fresh], minlength=len(texts)) / some
    symbol = CLASSES["symbols"][words.data[words.end - 1]] if len(words.end) else np.zeros(0, bool)
    out["words ending in a symbol"] = np.bincount(words.doc[symbol], minlength=len(texts)) / some
    longest = np.zeros(len(texts))
    np.maximum.at(longest, words.doc, words.end - words.start)
    out["longest word"] = np.log1p(longest)
    lines = [t.split("\n") if t else [] for t in texts.to_pylist()]
    out["lines"] = np.log1p([len(x) for x in lines])
    out["repeated lines"] = np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])
    return np.stack([out[f] for f in FEATURES], axis=1) if len(texts) else np.zeros((0, len(FEATURES)))


def with_views(docs: DataFrame, text: str, metadata: list[str], keep: list[str]) -> DataFrame:
    """``keep`` with the vectors ``text_view`` and ``metadata_view``.

    Metadata are hashed by name and value; numbers also by their power of two.
    """

    def make():
        def work(texts):
            rows = text_features(texts)
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES), pa.int32())
            return [pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1)))]

        return work

    given, names = [], []
    for i, name in enumerate(metadata):
        kind = docs.schema[name].dataType
        if isinstance(kind, T.NumericType):
            size = F.log2(F.abs(col(name).cast("double")) + 1)
            given += [F.coalesce(size, F.lit(0.0)).alias(f"__llm_m{i}"), F.coalesce(F.floor(size).cast("string"), F.lit("")).alias(f"__llm_p{i}")]
            names += [f"__llm_m{i}", f"__llm_p{i}"]
        else:
            given.append(F.coalesce(col(name).cast("string"), F.lit("")).alias(f"__llm_m{i}"))
            names.append(f"__llm_m{i}")
    source = docs.select(*[col(c) for c in keep], col(text).alias("__llm_t"), *given)
    kind = T.ArrayType(T.DoubleType(), False)
    rows = extend(source, "__llm_t", [T.StructField("__llm_text", kind)], make, [*keep, *names])
    rows = FeatureHasher(inputCols=names, outputCol="metadata_view", numFeatures=SLOTS).transform(rows)
    return rows.select(*[col(c) for c in keep], array_to_vector("__llm_text").alias("text_view"), "metadata_view")


VIEWS = ("text_view", "metadata_view")


def learner(view: str) -> LogisticRegression:
    return LogisticRegression(
        featuresCol=view, labelCol="label", weightCol="weight", predictionCol="p", probabilityCol="q", rawPredictionCol="r",
        maxIter=25, regParam=0.01,
    )


@dataclass
class Cotrained:
    """The two views' models and how their margins combine; ``constant`` is set if there is nothing to learn."""

    models: dict[str, LogisticRegressionModel]
    platt: dict[str, tuple[float, float]]
    joint: tuple[float, float, float]
    constant: float | None = None

    def margin(self, view: str) -> Column:
        return vector_to_array(f"r_{view}")[1]

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``text_score``, ``metadata_score`` and ``score``."""
        if self.constant is not None:
            return rows.select("*", *[F.lit(self.constant).alias(c) for c in ("text_score", "metadata_score", "score")])
        for view, model in self.models.items():
            model = model.copy({model.rawPredictionCol: f"r_{view}", model.predictionCol: "", model.probabilityCol: ""})
            rows = model.transform(rows)
        sigmoid = lambda x: 1 / (1 + F.exp(-x))
        single = [sigmoid(a * self.margin(v) + b) for v, (a, b) in self.platt.items()]
        a, b, c = self.joint
        both = sigmoid(a * self.margin(VIEWS[0]) + b * self.margin(VIEWS[1]) + c)
        scored = rows.select("*", single[0].alias("text_score"), single[1].alias("metadata_score"), both.alias("score"))
        return scored.drop("r_text_view", "r_metadata_view")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    metadata: tuple[str, ...] = ("lang", "source", "n_chars"),
    key: str = "doc_id",
    label: str = "quality",
    rounds: int = ROUNDS,
    sure: float = SURE,
    max_labelled: int = MAX_LABELLED,
    max_pool: int = MAX_POOL,
) -> Cotrained:
    """Co-train on at most ``max_labelled`` labelled rows that are not held out and ``max_pool`` unlabelled ones.

    Every fifth labelled row, by hash of its key, is kept for calibration.
    """
    own = labels.where(col(key).isNotNull() & col(label).isNotNull() & ~held_out(col(key)))
    own = own.groupBy(col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    sample = own.orderBy(F.xxhash64("key"), "key").limit(max_labelled)
    known = docs.join(F.broadcast(sample.withColumnsRenamed({"key": "__llm_key", "label": "__llm_label"})), col(key) == F.col("__llm_key"))
    rows = checkpoint(with_views(known, text, list(metadata), ["__llm_key", "__llm_label"]))
    rows = rows.select(F.col("__llm_key").alias("key"), F.col("__llm_label").alias("label"), F.lit(1.0).alias("weight"), *VIEWS)
    apart = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("calibration")), F.lit(5)) == 0
    train, check = rows.where(~apart), rows.where(apart)
    facts = rows.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
    kinds = [r.agg(F.count_distinct("label")).first()[0] for r in (train, check)]
    if min(kinds) < 2:
        return Cotrained({}, {}, (0.0, 0.0, 0.0), float(facts["p"]) if facts["n"] else 0.5)

    ids = docs.where(col(key).isNotNull()).select(col(key).alias("key")).join(labels.select(col(key).alias("key")), "key", "left_anti")
    ids = ids.distinct().orderBy(F.xxhash64("key"), "key").limit(max_pool)
    pool = docs.join(F.broadcast(ids.withColumnRenamed("key", "__llm_key")), col(key) == F.col("__llm_key"))
    pool = checkpoint(with_views(pool, text, list(metadata), ["__llm_key"]))
    models = {v: learner(v).fit(train) for v in VIEWS}
    for _ in range(rounds):
        lessons = {}
        for teacher, pupil in (VIEWS, VIEWS[::-1]):
            p = vector_to_array("q")[1]
            said = models[teacher].transform(pool).select(
                (p >= 0.5).cast("double").alias("label"), F.lit(0.5).alias("weight"), *VIEWS, F.greatest(p, 1 - p).alias("sure")
            )
            lessons[pupil] = said.where(F.col("sure") >= sure).drop("sure")
        models = {v: learner(v).fit(train.select("label", "weight", *VIEWS).unionByName(lessons[v])) for v in VIEWS}

    half = Cotrained(models, {v: (1.0, 0.0) for v in VIEWS}, (1.0, 0.0, 0.0))
    margins = check
    for view, model in models.items():
        margins = model.copy({model.rawPredictionCol: f"r_{view}", model.predictionCol: "", model.probabilityCol: ""}).transform(margins)
    margins = checkpoint(margins.select("label", "weight", *[half.margin(v).alias(f"m_{v}") for v in VIEWS]))

    def logistic(*names: str) -> tuple[float, ...]:
        ready = margins.select("label", "weight", array_to_vector(F.array(*names)).alias("x"))
        fitted = LogisticRegression(featuresCol="x", weightCol="weight", maxIter=25, regParam=0.001).fit(ready)
        return (*map(float, fitted.coefficients), float(fitted.intercept))

    platt = {v: logistic(f"m_{v}") for v in VIEWS}
    return Cotrained(models, platt, logistic(*[f"m_{v}" for v in VIEWS]))


def score(
    docs: DataFrame, model: Cotrained, text: str = "text", metadata: tuple[str, ...] = ("lang", "source", "n_chars"), keep: list[str] | None = None
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with ``text_score``, ``metadata_score`` and ``score``.

    Scores are calibrated chances of label 1.  A null or empty text has all-zero
    text features and is scored by them; null metadata are values of their own;
    repeated rows score alike; without labelled rows of both kinds every score is
    the share of label 1 (0.5 without labels); an empty table gives no rows.
    Input columns with the names of results are replaced.
    """
    names = ("text_score", "metadata_score", "score", *VIEWS)
    shown = [c for c in docs.columns if c.lower() not in names and (keep is None or c in keep)]
    return model.transform(with_views(docs, text, list(metadata), shown)).drop(*VIEWS)


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """Fit on the labelled rows that are not held out and score all rows; see ``fit`` and ``score``."""
    model = fit(docs, labels, **options)
    given = {k: v for k, v in options.items() if k in ("text", "metadata")}
    return score(docs, model, keep=keep, **given)
