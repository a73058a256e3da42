"""Quality scores by Bradley-Terry pairwise ranking.

A document is described by ratios and counts of its whole text. Of a labelled
pair the better one wins with probability sigmoid(w.(x - y)): the logistic loss
on feature differences gives w. The scores of all labelled documents that are
not held out then give the threshold: the quantile that leaves below it the
share of them labelled 0.
A score is mapped to 0..1 so that the threshold lies at ``CUT``.

The fit is on at most ``SAMPLE`` labelled documents, those of the smallest hash
of their id, which a cut on the hash picks before anything is sent to the
driver; threshold and spread cover all that may be learned from. Features,
scores and decisions cover every row, and are row-local.
Labels are joined to features, not to texts.

Defined results: null and empty texts have the features of an empty text, and
so a score; a null id is scored, and never used to learn; repeated rows get
equal scores; a label that is repeated counts once for each row of its id; without labels of both kinds every score is 1; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.plans.arrow import giving_back, map_rows, slices
from factloom.plans import skew
from factloom.plans.scratch import Scratch

#: Labelled documents that are learned from at most, pairs drawn of them, and the score at the threshold.
SAMPLE, PAIRS, CUT = 20_000, 100_000, 0.3

_CLASS = np.zeros(256, np.int64)
_CLASS[list(range(0x61, 0x7B))] = 1
_CLASS[list(range(0x41, 0x5B))] = 2
_CLASS[list(range(0x30, 0x3A))] = 3
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[0x0A] = 5
_CLASS[[0x2E, 0x2C, 0x3B, 0x3A, 0x27, 0x3F]] = 6
_CLASS[0x21] = 7
_CLASS[[0x7C, 0x3C, 0x3E, 0x7B, 0x7D, 0x5B, 0x5D, 0x5C]] = 8
_CLASS[[i for i in range(0x21, 0x7F) if _CLASS[i] == 0]] = 9
_CLASS[range(0x80, 0x100)] = 10
_SENTENCE = re.compile(rb"[.?!](?=\s|$)")


def features(text: str) -> list[float]:
    """What a text is like, whatever its words mean."""
    raw = text.encode()
    n = len(raw)
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11) / max(1, n)
    words = raw.split()
    count = len(words)
    distinct = len(set(words))
    lowered = len({x.lower() for x in words}) if distinct else 0
    lines = raw.split(b"\n")
    pairs = len(set(zip(words, words[1:])))  # noqa: B905
    ends = len(_SENTENCE.findall(raw))
    length = np.log1p(count)
    letters = share[1] + share[2] + share[10]
    return [
        length,
        length**2 / 10,
        count < 8,
        min(1.0, 10 * share[2]),
        share[2] / max(1e-9, letters) if letters else 0.0,
        min(1.0, 20 * share[3]),
        share[4],
        min(1.0, 20 * share[6]),
        min(1.0, 50 * share[7]),
        min(1.0, 50 * share[8]),
        min(1.0, 50 * share[9]),
        distinct / count if count else 1.0,
        lowered / count if count else 1.0,
        pairs / (count - 1) if count > 1 else 1.0,
        min(1.0, (n / count) / 20) if count else 0.0,
        len(set(lines)) / len(lines),
        min(1.0, ends / count * 10) if count else 0.0,
        min(1.0, count / (ends + 1) / 60),
        1.0 if raw[:1].isupper() else 0.0,
    ]


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-4, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, weights) from features and labels, of all pairs of better and worse, or of so many drawn of them."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - centre) / scale
    better, worse = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if len(better) * len(worse) <= pairs:
        pairs = len(better) * len(worse)
        d = (z[better][:, None] - z[worse][None]).reshape(pairs, -1)
    else:
        rng = np.random.default_rng(0)
        d = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton's method on the mean logistic loss
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, w


class Model(NamedTuple):
    """A score is the logistic function of shift + slopes . features."""

    shift: float
    slopes: tuple[float, ...]

    def linear(self, x: str) -> F.Column:
        total = F.lit(self.shift)
        for i, v in enumerate(self.slopes):
            total = total + F.col(x)[i] * F.lit(v)
        return total

    def column(self, x: str) -> F.Column:
        return 1 / (1 + F.exp(-self.linear(x)))


def held_out(id_column: F.Column) -> F.Column:
    """Whether labels of this id are not learned from."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def describe(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, x): the features of each text."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def make():
        def work(ids, texts):
            return {"id": ids, "x": [[float(v) for v in features(t or "")] for t in texts]}

        return work

    return map_rows(df.select(id_col, text_col), make, schema)


def quantile(df: DataFrame, column: str, n: int, share: float, accuracy: int = 10_000) -> float:
    """The exact quantile of ``n`` values, between two of them as in numpy; only values near it reach the driver."""
    at = share * (n - 1)
    k, v = int(at), F.col(column)
    near = [max(0.0, k / n - 2 / accuracy), min(1.0, (k + 2) / n + 2 / accuracy)]
    low, high = df.agg(F.percentile_approx(v, near, accuracy)).first()[0]
    seen = df.where(v < low).count()
    found: list[float] = []
    for value, count in df.where(v.between(low, high)).groupBy(v).count().orderBy(v).collect():
        seen += count
        found += [value] * (int(seen > k) + int(seen > k + 1) - len(found))
    if not found:
        raise ValueError("the quantile lies outside of its bounds")
    return float(found[0] + (found[-1] - found[0]) * (at - k))


def usable(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Distinct (id, y) of the labels that may be learned from."""
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    return given.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()


def smallest(df: DataFrame, n: int, sample: int) -> list:
    """The ``sample`` rows of the smallest hash of ``df`` (h, id, y) of ``n`` rows; hardly more of them reach the driver."""
    share = 1.2 * sample / max(n, 1) + 1e-9
    while True:
        under = df.where(F.col("h") <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * 2.0**64)))) if share < 1 else df
        rows = under.orderBy("h", "id", "y").limit(sample).collect()
        if share >= 1 or len(rows) >= min(n, sample):
            return rows
        share *= 2


def learn(described: DataFrame, marks: DataFrame, cut: float, sample: int) -> Model | None:
    """The model of the rows of ``described`` that ``marks`` (id, y) label; None without labels of both kinds."""
    scratch = Scratch(described.sparkSession, "quality")
    used = scratch.save(skew.salted_join(described.where(F.col("id").isNotNull()), marks, "id", F.monotonically_increasing_id(), described.count()), "used")
    known = smallest(used.withColumn("h", F.xxhash64("id")), used.count(), sample)
    y = np.array([r["y"] for r in known])
    if len(set(y.tolist())) < 2:
        return None
    x = np.array([r["x"] for r in known])
    centre, scale, w = fit(x, y)
    raw = Model(float(-(centre @ (w / scale))), tuple(map(float, w / scale)))
    scored = scratch.save(used.select(raw.linear("x").alias("s"), "y"), "scores")
    n, worse, deviation = scored.agg(F.count("s"), F.count_if(F.col("y") == 0), F.stddev_pop("s")).first()
    threshold, spread = quantile(scored, "s", n, worse / n), max(deviation, 1e-9)
    scratch.drop(scored)
    scratch.drop(used)
    slopes = w / scale / spread * 2
    return Model(float(-(centre @ slopes) - 2 * threshold / spread + np.log(cut / (1 - cut))), tuple(map(float, slopes)))


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``df``: id, held_out, score, predicted.

    Labels whose id has crc32(id as text) mod 5 = 0 are held out of learning.
    """
    described = Scratch(df.sparkSession, "quality").save(describe(df, id_col, text_col), "features")
    model = learn(described, usable(labels, id_col, label_col), cut, sample)
    score = F.lit(1.0) if model is None else model.column("x")
    out = described.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``df`` that ``score_quality`` predicts as 1, all columns as they are.

    The texts stay where they are: the model goes to the rows, which are
    described again, as that is cheaper than to write and read them once more.
    """
    marks = Scratch(df.sparkSession, "quality").save(usable(labels, id_col, label_col), "marks")
    # only labelled texts are described to learn from, if their ids are few enough to come to the texts
    ids = Scratch(df.sparkSession, "quality").save(marks.select(F.col("id").alias(id_col)).distinct(), "ids")
    few = skew.sized(ids)
    labelled = df if few is ids else df.join(few, id_col, "left_semi")
    described = Scratch(df.sparkSession, "quality").save(describe(labelled, id_col, text_col), "features")
    model = learn(described, marks, cut, sample)
    if model is None:
        return df
    at, floor = df.columns.index(text_col), np.log(cut / (1 - cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slopes = np.array(model.slopes)
        for whole in batches:
            for batch in slices(whole):
                keep = [model.shift + float(np.dot(slopes, features(t or ""))) >= floor for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(giving_back(run), df.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return score_quality(read("documents"), read("labels"))
