"""Quality classifier: Bradley-Terry pairwise ranking.

Every text becomes a vector of surface features (shares of symbols, capitals, repeats and the like). Preference pairs
put a document labelled good against one labelled bad; logistic loss on the difference of their features learns the
weights of a utility, so that the better document of a pair tends to have the larger one. A one-dimensional logistic
fit maps the utility to a score between 0 and 1. The operator keeps documents whose score reaches a quantile of the
training documents' scores: the one at the share of bad labels, half way between the scores on both sides of it. So as
large a share goes as the labels call bad.

Fitted on at most SAMPLE labelled documents of each class (the bound on labelled rows; chosen by a hash of doc_id) and
PAIRS pairs; every document is scored. Labels, lang, source and doc_id are no features.

Defined results: null or empty text: all features 0, scored like any other. No pairs (a class has no training labels): every
score is the share of good labels among the training labels, 0.5 if there are none. Repeated rows: one result each. Extra
columns are ignored by the query and kept by the filter, whatever their names. No labels: the filter keeps all. Empty
table: empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.llm.common import DOC_COLUMNS, fresh, table
from docaudit.llm.labelled import fit_logistic, held_out, label_sample, sigmoid

SAMPLE, PAIRS = 8_000, 40_000
FEATURES = (
    "log words", "symbols", "symbol words", "shouts", "digits", "capitals", "capitals over half", "sentence marks", "bars", "one minus variety", "adjacent repeats",
    "most frequent word", "repeated triples", "repeated lines", "word length", "no words",
)
_SYMBOLS = np.array([ord(c) for c in "#*$%&|<>~^=+_{}[]@\\/"])
_MARKS = np.array([ord(c) for c in ".,;:?'\"-()"])


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    n = len(words)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    solid = sum(map(len, words))
    capitals, small = int(seen[65:91].sum()), int(seen[97:123].sum())
    counts = Counter(words)
    pairs = max(1, n - 1)
    triples = max(1, n - 2)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    high = capitals / max(1, capitals + small)
    return [
        np.log1p(n) / 10,
        np.sqrt(seen[_SYMBOLS].sum() / solid),
        sum(1 for w in words if w[-1] in b"#*$%&|<>~^=+_") / n,
        np.sqrt(seen[33] / solid),
        seen[48:58].sum() / solid,
        high,
        max(0.0, high - 0.5),
        seen[_MARKS].sum() / solid,
        np.sqrt(counts.get(b"|", 0) / n),
        (1 - len(counts) / n),
        np.sqrt(sum(map(eq, words, words[1:])) / pairs),
        counts.most_common(1)[0][1] / n if n > 5 else 0.0,
        np.sqrt(max(0, n - 2 - len(set(zip(words, words[1:], words[2:], strict=False)))) / triples),
        1 - len(set(lines)) / len(lines),
        solid / n / 20,
        0.0,
    ]


@dataclass(frozen=True)
class Ranker:
    """Utility weights, and the scale and shift that map a utility to a score; prior: the score if nothing was learnt."""

    weights: np.ndarray | None
    scale: float
    shift: float
    prior: float
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.weights is None else sigmoid(self.scale * (x @ self.weights) + self.shift)


def fit(x: np.ndarray, y: np.ndarray, *, pairs: int = PAIRS, prevalence: float | None = None) -> Ranker:
    """x: features, y: 1 good, 0 bad. prevalence: the share of good labels, if the sample is not in proportion."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    share = prevalence if prevalence is not None else (len(good) / len(y) if len(y) else 0.5)
    if not len(good) or not len(bad):
        return Ranker(None, 1.0, 0.0, share, 0.0)
    rng = np.random.default_rng(0)
    preferred, other = rng.choice(good, pairs), rng.choice(bad, pairs)
    weights = fit_logistic(x[preferred] - x[other], np.ones(pairs), bias=False, ridge=1e-3)
    utility = x @ weights
    weight = np.where(y == 1, share / len(good), (1 - share) / len(bad)) * len(y)
    scale, shift = fit_logistic(utility[:, None], y.astype(float), weight, ridge=1e-4)
    ranker = Ranker(weights, float(max(scale, 0.0)), float(shift), share, 0.0)
    return Ranker(weights, ranker.scale, ranker.shift, share, quantile(ranker.scores(x), weight, 1 - share))


def quantile(scores: np.ndarray, weight: np.ndarray, level: float) -> float:
    """The middle between the last score within the share `level` of the weight and the next one."""
    order = np.argsort(scores, kind="stable")
    below = int((np.cumsum(weight[order]) <= (level + 1e-9) * weight.sum()).sum())
    if not below:
        return 0.0
    s = scores[order]
    return float((s[below - 1] + s[min(below, len(s) - 1)]) / 2)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Ranker:
    chosen = label_sample(labels, "quality", (sample, sample))
    shares = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("quality")).first()[0]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(F.broadcast(chosen), F.col("id") == F.col("l_id")).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["label", "x"])

    got = texts.mapInArrow(run, "label int, x array<double>").toArrow()  # at most 2 * sample rows
    x = np.array(got.column("x").to_pylist()).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # rows arrive in any order; the fit must not depend on it
    return fit(x[order], got.column("label").to_numpy()[order], prevalence=shares)


def score(docs: DataFrame, ranker: Ranker, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each text; a column of that name is replaced."""
    rest = [c for c in docs.columns if c != name]
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranker.scores(x))], names=[*rest, name])

    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(name, T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches the quantile threshold, with their columns. Nulls, ties, repeated rows and
    empty tables as above; equal texts share their fate."""
    ranker, name = train(docs.select(*DOC_COLUMNS[:2]), labels), fresh(docs, "__score")
    return score(docs, ranker, name=name).where(F.col(name) >= ranker.threshold).drop(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
