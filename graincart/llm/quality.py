"""A quality classifier: a factorisation machine on words, structure and metadata.

The score is the sigmoid of w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, and the pairs
are summed in linear time as half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2 in each of the few
dimensions of v. Words are hashed into buckets; structure statistics and the length that the
table states come as binned indicators beside them. It is trained by AdaGrad in numpy on a bounded
sample of labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import beside, held_out, small_batches

BUCKETS = 1 << 14
BINS = 16
STATS = 11
SIZE = BUCKETS + (STATS + 2) * BINS


@dataclass(frozen=True)
class Settings:
    """About ``rows`` labelled rows are learned from, whole texts each."""

    rows: int = 6000
    dim: int = 4
    epochs: int = 4
    rate: float = 0.08
    decay: float = 1e-5


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray = field(repr=False)
    pairs: np.ndarray = field(repr=False)


def structure(text: str) -> list[float]:
    """Shares and rates between 0 and 1 of a text's make-up."""
    n = max(len(text), 1)
    words = text.split()
    m = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.bincount(np.minimum(points, 128), minlength=129)
    upper = low[65:91].sum()
    letters = upper + low[97:123].sum() + low[128]
    return [
        letters / n,
        upper / max(letters, 1),
        low[48:58].sum() / n,
        low[124] / m,
        (low[33:48].sum() + low[58:65].sum() + low[91:97].sum() + low[123:128].sum() - low[44] - low[46]) / m,
        (low[33] + low[63]) / m,
        (low[44] + low[46]) / m,
        min(sum(map(len, words)) / m / 20, 1.0),
        len(set(words)) / m,
        len(set(lines)) / max(len(lines), 1),
        sum(map(str.__eq__, words, words[1:])) / m,
    ]


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values: words of length 1 in all as a vector, indicators of 0.5."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    ids, counts = np.unique(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % BUCKETS, return_counts=True)
    values = np.sqrt(counts)
    values /= np.sqrt((values**2).sum()) or 1.0
    stats = [*structure(text), min(np.log1p(len(text)) / 14, 1.0)]
    stated = min(np.log1p(max(float(n_chars), 0.0)) / 14, 1.0) if n_chars is not None and n_chars == n_chars else None
    bins = [BUCKETS + i * BINS + min(int(min(max(s, 0.0), 1.0) ** 0.5 * BINS), BINS - 1) for i, s in enumerate(stats)]
    if stated is not None:
        bins.append(BUCKETS + len(stats) * BINS + min(int(stated * BINS), BINS - 1))
    return np.concatenate([ids.astype(np.int64), bins]), np.concatenate([values, np.full(len(bins), 0.5)])


def margin(model: Model, ids: np.ndarray, values: np.ndarray) -> float:
    parts = model.pairs[ids] * values[:, None]
    pairs = 0.5 * ((parts.sum(axis=0) ** 2).sum() - (parts**2).sum())
    return float(model.bias + model.linear[ids] @ values + pairs)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings = Settings(), seed: int = 11) -> Model:
    """A model of label 1 from (indexes, values, label); without rows, one that scores 0.5."""
    rng = np.random.default_rng(seed)
    linear, pairs = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, settings.dim))
    if not rows:
        return Model(0.0, linear, pairs * 0)
    share = np.clip(np.mean([y for _, _, y in rows]), 0.01, 0.99)
    bias = float(np.log(share / (1 - share)))
    sum_linear, sum_pairs = np.full(SIZE, 0.1), np.full((SIZE, settings.dim), 0.1)
    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)):
            ids, x, y = rows[i]
            parts = pairs[ids] * x[:, None]
            total = parts.sum(axis=0)
            z = bias + linear[ids] @ x + 0.5 * ((total**2).sum() - (parts**2).sum())
            wrong = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g = wrong * x + settings.decay * linear[ids]
            sum_linear[ids] += g**2
            linear[ids] -= settings.rate * g / np.sqrt(sum_linear[ids])
            g = wrong * x[:, None] * (total - parts) + settings.decay * pairs[ids]
            sum_pairs[ids] += g**2
            pairs[ids] -= settings.rate * g / np.sqrt(sum_pairs[ids])
            bias -= 0.01 * wrong
    return Model(float(bias), linear, pairs)


def _train_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [features(t, n) for t, n in zip(batch["text"], batch["n_chars"], strict=True)]
        out = batch[["draw", "tie", "quality"]].copy()
        out["ids"], out["values"] = [x.astype(np.int32).tobytes() for x, _ in found], [y.astype(np.float32).tobytes() for _, y in found]
        yield out


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on labelled rows of ``docs`` that are not held out, a sample by a hash of the id.

    Labels without doc_id or quality say nothing; of labels that repeat an id each counts. Texts are
    read whole, in tasks. Ties of the hash go by the text's own hash and the label.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    total = known.count()
    draw = F.crc32(F.concat(F.lit("quality-"), F.col("doc_id").cast("string"))) / 2.0**32
    label = (F.col("quality") == 1).cast("int")
    # some rows of a table of labels by a hash of their ids: of ids that repeat the first so many
    known = known.select("doc_id", draw.alias("draw"), label.alias("quality")).where(F.col("draw") < settings.rows / max(total, 1))
    known = known.orderBy("draw", "doc_id", "quality").limit(2 * settings.rows)
    rows = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")).join(F.broadcast(known), "doc_id")
    small_batches(docs.sparkSession)
    rows = rows.select("draw", F.xxhash64("text").alias("tie"), "quality", "text", "n_chars")
    rows = rows.mapInPandas(_train_rows, "draw double, tie long, quality int, ids binary, values binary")
    rows = rows.orderBy("draw", "tie", "quality").limit(4 * settings.rows).toPandas()
    return fit([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.values, np.float32).astype(float), r.quality) for r in rows.itertuples()], settings)


def score_quality(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry`` and score for each row of ``docs`` (doc_id, text, n_chars).

    A null text counts as empty, and is scored by its structure and n_chars; a null n_chars says
    nothing. Repeated rows have equal scores. Texts are read whole. An empty table gives an empty
    result; without labels every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None], sizes: list[float | None]) -> list:
        z = np.array([margin(shared.value, *features(t, n)) for t, n in zip(texts, sizes, strict=True)], dtype=float)
        return [1 / (1 + np.exp(-np.clip(z, -30, 30)))]

    rows = docs.select("doc_id", "text", *[c for c in carry if c != "text"], F.col("n_chars").cast("double").alias("_stated"))
    return beside(rows, ("text", "_stated"), ("doc_id", *carry), work, {"score": "double"})


def quality_digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``; see ``learn`` and ``score_quality``.

    A row without doc_id is not held out. Texts of any length are scored whole; other columns are ignored.
    """
    scored = score_quality(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
