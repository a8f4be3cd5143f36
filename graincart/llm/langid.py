"""Language identification by averaged embeddings of hashed subwords.

A text is the mean of the embeddings of its subwords, the runs of 2 to 4 characters of its words
with a mark at each end of a word, hashed into buckets. A softmax layer on the mean names the
language. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows, each text as the shares of its subwords; the model is small and is broadcast to the tasks. A part of the sample
calibrates the softmax temperature and the two bounds below which a prediction is rejected: its
score, and the share of its subwords that training has seen.
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

UNKNOWN = "und"
BUCKETS = 1 << 17
ORDERS = (2, 3, 4)
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_letters: np.ndarray | None = None


@dataclass(frozen=True)
class Settings:
    """About ``rows`` labelled rows of each language are learned from, and ``total`` of all languages, whole texts each."""

    rows: int = 1200
    total: int = 40_000
    dim: int = 8
    epochs: int = 4
    rate: float = 0.05
    rejected: float = 0.001


@dataclass(frozen=True)
class Model:
    names: list[str]
    logits: np.ndarray = field(repr=False)
    seen: np.ndarray = field(repr=False)
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    least_seen: float = 0.0


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(text: str | None) -> np.ndarray:
    """The buckets of the subwords of a text; none without letters."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    # one mark between words: of what is not a letter, only the first after a word, or the very first
    extra = keep & ~letter
    extra[1:] &= letter[:-1] | (np.cumsum(letter)[1:] == 0)
    marks = np.where(letter, points, 0)[letter | extra].astype(np.uint32)
    found = []
    for n in ORDERS:
        size = len(marks) - n + 1
        if size < 1:
            continue
        h = np.full(size, n, np.uint32)
        inner = np.ones(size, bool)
        for j in range(n):
            part = marks[j : j + size]
            h = (h ^ part) * _ODD[j]
            h ^= h >> np.uint32(15)
            if 0 < j < n - 1:
                inner &= part != 0
        if n == 2:
            inner = (marks[:size] != 0) | (marks[1 : 1 + size] != 0)
        found.append(h[inner])
    return (np.concatenate(found) % np.uint32(BUCKETS)).astype(np.int64) if found else np.empty(0, np.int64)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of the subwords of a whole text, and how often each comes."""
    ids, counts = np.unique(subwords(text), return_counts=True)
    return ids.astype(np.int32), counts.astype(np.int32)


def shares(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets with their shares of all subwords of the text."""
    return ids, (counts / max(counts.sum(), 1)).astype(np.float32)


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Both arrays as few bytes: steps between sorted buckets and counts are small."""
    return zlib.compress(np.concatenate([np.diff(ids, prepend=np.int32(0)), counts]).astype(np.int32).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = np.split(np.frombuffer(zlib.decompress(data), np.int32), 2)
    return np.cumsum(steps, dtype=np.int32), counts


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], settings: Settings = Settings(), seed: int = 7) -> Model:
    """A model from (buckets, shares, language) of texts; without rows, one that names nothing."""
    rows = [r for r in rows if len(r[0])]
    names = sorted({r[2] for r in rows})
    if not names:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(BUCKETS, bool), np.zeros(1))
    rng = np.random.default_rng(seed)
    train = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 50]
    check = [r for i, r in enumerate(rows) if not i % 5 and len(rows) >= 50] or train
    place, seen = {x: i for i, x in enumerate(names)}, np.zeros(BUCKETS, bool)
    embed = rng.normal(0, 0.01, (BUCKETS, settings.dim)).astype(np.float32)
    soft = rng.normal(0, 0.1, (settings.dim, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, step = settings.epochs * len(train), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(train)):
            ids, share, y = train[i]
            seen[ids] = True
            mean = share @ embed[ids]
            wrong = _softmax(mean @ soft + bias)
            wrong[place[y]] -= 1
            rate = settings.rate * (1 - step / steps)
            back = soft @ wrong
            soft -= 8 * rate * np.outer(mean, wrong)
            bias -= 0.2 * rate * wrong
            # a step moves the mean by the same length, whether a text has few subwords or many
            embed[ids] -= np.outer(rate * share / (share @ share), back)
            step += 1
    logits = (embed @ soft).astype(np.float32)
    raw = np.array([share @ logits[ids] + bias for ids, share, _ in check], dtype=np.float64)
    truth = np.array([place[y] for _, _, y in check])
    loss = lambda t: -np.log(_softmax(raw / t)[np.arange(len(truth)), truth] + 1e-9).mean()
    temperature = min(np.geomspace(0.05, 5, 40), key=loss)
    scores = _softmax(raw / temperature).max(axis=1)
    known = np.array([share @ seen[ids] for ids, share, _ in check])
    low = lambda x: float(np.quantile(x, settings.rejected))
    return Model(names, logits, seen, bias, float(temperature), min(0.5, low(scores)), 0.9 * low(known))


def predict(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, score and whether the prediction stands."""
    ids = subwords(text)
    if not len(ids) or not model.names:
        return UNKNOWN, 0.0, False
    chances = _softmax((model.logits[ids].mean(axis=0, dtype=np.float64) + model.bias) / model.temperature)
    best = int(chances.argmax())
    stands = chances[best] >= model.least_score and model.seen[ids].mean() >= model.least_seen
    return model.names[best], float(chances[best]), bool(stands)


def _train_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.drop(columns="text").assign(subwords=[packed(*counted(t)) for t in batch["text"]])


def learn(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on rows of ``docs`` (doc_id, text, lang) that are not held out: a sample by a hash of id and text.

    All languages are learned, from about as many rows of each; texts are read whole, in tasks. Rows
    without doc_id are not learned from. Ties of the hash go by lang and the text's own hash.
    """
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return fit([], settings)
    each = min(settings.rows, settings.total // len(counts))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    draw = F.crc32(F.concat(F.lit("langid-"), F.col("doc_id").cast("string"))) / 2.0**32 / F.element_at(share, F.col("lang"))
    rows = usable.select(draw.alias("draw"), F.xxhash64("text").alias("tie"), "lang", "text").where("draw < 1")
    small_batches(docs.sparkSession)
    rows = rows.mapInPandas(_train_rows, "draw double, tie long, lang string, subwords binary")
    # the sample has that many rows but for chance; the bound holds rows that repeat one id
    rows = rows.orderBy("draw", "lang", "tie").limit(2 * each * len(counts) + 1000).toPandas()
    return fit([(*shares(*unpacked(r.subwords)), r.lang) for r in rows.itertuples()], settings)


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry``, lang_pred, score and accepted for each row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if the
    model knows no language; ``und`` is not accepted. Repeated rows have equal results. Texts of
    any length are read whole. An empty table gives an empty result. Only doc_id, text and the
    columns of ``carry`` are read, and only text decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> list:
        return list(zip(*[predict(shared.value, t) for t in texts], strict=True)) or [(), (), ()]

    return beside(docs, ("text",), ("doc_id", *carry), work, {"lang_pred": "string", "score": "double", "accepted": "boolean"})


def language_digests(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of each row of ``docs``; see ``learn`` and ``identify``.

    A row without doc_id is not held out. Of languages with equal scores the first by name is named.
    """
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
