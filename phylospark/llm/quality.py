"""Compression classifier: zstandard dictionaries of good and of bad text, and the difference of what they save.

Two dictionaries are trained, one on texts labelled good and one on texts labelled bad. A text is cut into chunks of 2 KB, so that
a dictionary weighs alike in short and long texts, and every chunk is compressed with both. The sum of sizes under the bad
dictionary less that under the good one, divided by the sum of both, is the normalised difference; a text that repeats itself
compresses to almost nothing with either, so the larger compressed size per byte is kept beside it. On labelled texts that the dictionaries
have not seen, smoothed densities of both values among good and bad texts give log likelihood ratios, and a logistic regression
weighted by the share of good labels turns these into the probability of label 1.

What the fit reads is bounded: at most ``max_texts`` labelled texts a class, one a key (of several the least by hash), the first by a
hash of their key, and of these at most ``max_bytes`` bytes a class on the driver; whole texts, half for the dictionaries and half
for the calibration. A text above an eighth of ``max_bytes`` trains nothing, so it neither ends the sample nor fills it; a key's other
texts may still train. Texts that no longer fit are left out and smaller ones after them kept. Shares of labels are counted over all
of them. Every text is scored whole.

Defined cases: an empty or null text has difference 0 and density 1; a key whose label is null or that has several different labels trains
nothing; where both classes have labelled texts but one has fewer than two to train on, because of their length, the fit fails; without
labels of both classes, or with fewer than two labelled texts in one, every score is the share of good labels (0.5 without any); repeated rows score alike; an
empty table gives an empty result; the score is a column expression of the text alone, so further columns don't matter.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospark.llm._shared import small_batches

CHUNK, LEVEL, DICTIONARY = 2048, 3, 64 << 10
THRESHOLD = 0.3
FOLDS = 5
#: A text above this part of the bytes of a class trains nothing.
SHARE = 8


@dataclass(frozen=True)
class Model:
    """Dictionaries; a curve of log likelihood ratios for the difference and one for the density; the weights of both and a constant."""

    good: bytes
    bad: bytes
    curves: tuple
    weights: tuple[float, ...]


def chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


class Sizes:
    """Compressed sizes with two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.packs = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.packs.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))

    def measure(self, text: bytes) -> tuple[float, float]:
        """The normalised difference, and the density: the larger compressed size per byte."""
        if not text:
            return 0.0, 1.0
        good, bad = (sum(len(p.compress(c)) for c in chunks(text)) for p in self.packs)
        return (bad - good) / (bad + good), max(good, bad) / len(text)


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text for training, the text itself."""
    pieces = [c for t in texts for c in chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:].ljust(8, b" ")


def log_ratio(good: np.ndarray, bad: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Points (value, log of the smoothed density among good over that among bad)."""
    both = np.concatenate((good, bad))
    grid = np.linspace(both.min() - 0.02, both.max() + 0.02, 200)

    def density(x: np.ndarray) -> np.ndarray:
        spread = min(x.std(), np.subtract(*np.percentile(x, [75, 25])) / 1.34 or x.std())
        width = max(1.06 * spread * len(x) ** -0.2, 2e-3)
        return np.exp(-0.5 * ((grid[:, None] - x) / width) ** 2).sum(1) / (len(x) * width * 2.5066) + 1e-2 / (grid[-1] - grid[0])

    return tuple(grid.tolist()), tuple(np.log(density(good) / density(bad)).tolist())


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, the last one constant, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.linalg.solve(curve, x.T @ (w * (y - p)) - ridge * beta)
    return beta


def fit(good: list[bytes], bad: list[bytes], prior: float) -> Model:
    """Even texts train the dictionaries, odd ones the calibration."""
    if len(good) < 2 or len(bad) < 2:
        return Model(b" " * 8, b" " * 8, (), (0.0, 0.0, float(np.log(prior / (1 - prior)))))
    own = dictionary(good[::2]), dictionary(bad[::2])
    sizes = Sizes(*own)
    seen = [np.array([sizes.measure(t) for t in texts[1::2]]) for texts in (good, bad)]
    curves = tuple(log_ratio(seen[0][:, i], seen[1][:, i]) for i in (0, 1))
    x = np.column_stack([np.interp(np.concatenate(seen)[:, i], *curves[i]) for i in (0, 1)])
    y = np.repeat([1.0, 0.0], [len(seen[0]), len(seen[1])])
    w = np.repeat([prior / len(seen[0]), (1 - prior) / len(seen[1])], [len(seen[0]), len(seen[1])]) * len(y)
    return Model(*own, curves, tuple(logistic(x, y, w).tolist()))


def apply(model: Model, measured: np.ndarray) -> np.ndarray:
    """Scores of rows (difference, density)."""
    logs = [np.interp(measured[:, i], *c) for i, c in enumerate(model.curves)] or [np.zeros(len(measured))] * 2
    margin = model.weights[0] * logs[0] + model.weights[1] * logs[1] + model.weights[2]
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_texts: int = 2000, max_bytes: int = 16 << 20) -> Model:
    """Fit on labelled rows outside the held-out fold."""
    marks = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    marks = marks.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("k", "y")
    count = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    total = sum(count.values())
    prior = (count.get(1, 0) + 1) / (total + 2)
    order = F.crc32(F.concat(F.lit("sample"), F.col("k").cast("string")).cast("binary"))
    few = [marks.where(F.col("y") == y).orderBy(order, "k").limit(max_texts) for y in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]).withColumn("o", order))  # at most 2 * max_texts rows
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("binary").alias("t")).where(F.col("t").isNotNull())
    stamped = texts.join(chosen, "k").select("k", "y", "o", F.octet_length("t").alias("n"), F.xxhash64("t").alias("h"))
    fitting = F.when(F.col("n") <= max_bytes // SHARE, F.col("h"))
    found = stamped.groupBy("k", "y", "o").agg(F.min(fitting).alias("h"), F.min_by("n", fitting).alias("n")).collect()  # numbers of each key, no texts
    picked, place, used, long = [], {}, {0: 0, 1: 0}, {0: 0, 1: 0}
    for r in sorted(found, key=lambda r: (r["o"], str(r["k"]))):
        if r["h"] is None:
            long[r["y"]] += 1
        elif used[r["y"]] + r["n"] <= max_bytes:
            used[r["y"]] += r["n"]
            place[r["k"]] = r["y"], len(picked)
            picked.append((r["k"], r["h"]))
    for y, other in ((0, 1), (1, 0)):
        if sum(v == y for v, _ in place.values()) < 2 and count.get(y) and count.get(other):
            if long[y]:
                raise ValueError(f"label {y} has too few texts of at most {max_bytes // SHARE} bytes to train on")
            warnings.warn(f"label {y} has fewer than two texts; every score is the share of good labels", stacklevel=2)
    few = F.broadcast(docs.sparkSession.createDataFrame(picked, f"k {texts.schema['k'].dataType.simpleString()}, h bigint"))
    rows = small_batches(texts).withColumn("h", F.xxhash64("t")).join(few, ["k", "h"]).select("k", "t")
    rows = rows.mapInArrow(once, rows.schema).dropDuplicates(["k"]).collect()
    rows.sort(key=lambda r: place[r["k"]])
    sides = {y: [bytes(r["t"]) for r in rows if place[r["k"]][0] == y] for y in (0, 1)}
    return fit(sides[1], sides[0], prior)


def once(batches):
    """The first row of every key that a task meets: copies of a frequent key don't leave it."""
    seen = set()
    for batch in batches:
        new = []
        for i, k in enumerate(batch.column("k").to_pylist()):
            if k not in seen:
                seen.add(k)
                new.append(i)
        if new:
            yield batch.take(pa.array(new))


_sizes: dict[int, Sizes] = {}


def scorer(model: Model):
    """A function from a text column to the score column."""
    stamp = zlib.crc32(model.good + model.bad)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        sizes = _sizes.get(stamp)
        if sizes is None:
            _sizes.clear()
            sizes = _sizes[stamp] = Sizes(model.good, model.bad)
        found = np.array([sizes.measure(bytes(t) if t is not None else b"") for t in texts]).reshape(-1, 2)
        return pd.Series(apply(model, found))

    return lambda text: score(text.cast("binary"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    score = scorer(train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
