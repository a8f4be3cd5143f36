"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the words of a text and their first four and five letters, a light stemmer. A sample of
labelled texts gives the vocabulary (the terms that tell the classes apart by chi-square), the
inverse document frequencies and the examples. Examples are ordered by their heaviest term and cut
into blocks; for each term the index holds its postings and its largest weight in each block. A
query adds these into an upper bound for each block, scores the blocks from the highest bound on,
and stops where no bound reaches the k-th best cosine: no neighbour is missed. The neighbours vote
with weights that fall with their distance, and a logistic curve fitted on the examples, each
without itself, turns votes into probabilities. The neighbours are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import discard, in_pandas, materialize, small_batches

_WORD = re.compile(r"[^\W_]+")
#: Terms that a task counts before it hands them on.
HELD = 400_000


@dataclass(frozen=True)
class Settings:
    """About ``rows`` labelled texts of each class are examples, and ``terms`` terms the vocabulary.

    A term must be ``least_ratio`` times as common in one class as in the other, or it tells little
    but stands in most texts. Of ``shrinks``, by which votes of distant neighbours are drawn to the
    prior, the one stands whose curve tells the examples best, each without itself.
    """

    rows: int = 4000
    terms: int = 6000
    least_texts: int = 4
    least_chi: float = 12.0
    least_ratio: float = 3.0
    neighbours: int = 15
    block: int = 32
    shrinks: tuple[float, ...] = (0.1, 0.3, 1.0, 3.0)


@dataclass(frozen=True)
class Index:
    """Postings by term and, within a term, by block: ``starts[t * blocks + b]`` to the next."""

    vocabulary: dict[str, int] = field(repr=False)
    idf: np.ndarray = field(repr=False)
    starts: np.ndarray = field(repr=False)
    places: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    tops: np.ndarray = field(repr=False)
    ids: np.ndarray = field(repr=False)
    toxic: np.ndarray = field(repr=False)
    block: int
    prior: float
    shrink: float = 1.0
    slope: float = 0.0
    offset: float = 0.0


def text_terms(text: str | None) -> Counter:
    """How often each term stands in a text: words in lower case, and the first four and five letters of longer ones."""
    out = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items() if text else ():
        out[word] += n
        if len(word) > 4:
            out[word[:4] + "-"] += n
        if len(word) > 5:
            out[word[:5] + "-"] += n
    return out


def vector(index: Index, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text that the vocabulary has, in order, and their weights, of length 1 as a vector."""
    known = index.vocabulary
    found = sorted((known[t], n) for t, n in text_terms(text).items() if t in known)
    terms = np.array([t for t, _ in found], np.int64)
    weights = (1 + np.log(np.array([n for _, n in found], float))) * index.idf[terms]
    return terms, weights / (np.sqrt(weights @ weights) or 1.0)


def by_heaviest(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(id, label, terms, weights) rows in the order of their heaviest term, so that a block's examples are alike."""
    heaviest = [(int(t[np.argmax(w)]) if len(t) else -1, -float(w.max(initial=0.0)), i) for i, (_, _, t, w) in enumerate(rows)]
    return [rows[i] for *_, i in sorted(heaviest)]


def build(vocabulary: list[str], idf: np.ndarray, rows: list[tuple[int, int, np.ndarray, np.ndarray]], prior: float, block: int) -> Index:
    """An index of (id, label, terms, weights) rows."""
    blocks = max(-(-len(rows) // block), 1)
    size = len(vocabulary) * blocks
    terms = np.concatenate([np.empty(0, np.int64), *[t for _, _, t, _ in rows]])
    places = np.repeat(np.arange(len(rows)), [len(t) for _, _, t, _ in rows])
    weights = np.concatenate([np.empty(0), *[w for *_, w in rows]])
    cell = terms * blocks + places // block
    order = np.lexsort((places, cell))
    tops = np.zeros(size)
    np.maximum.at(tops, cell, weights)
    starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=size))]).astype(np.int64)
    ids, toxic = np.array([i for i, *_ in rows], np.int64), np.array([y for _, y, *_ in rows], np.int64)
    return Index({t: i for i, t in enumerate(vocabulary)}, idf, starts, places[order], weights[order], tops.reshape(len(vocabulary), blocks), ids, toxic, block, prior)


def nearest(index: Index, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the ``k`` nearest examples that share a term, ties by place; ``but`` is left out."""
    none = np.empty(0, np.int64), np.empty(0)
    if not len(terms):
        return none
    bounds = weights @ index.tops[terms]
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 0]
    blocks = index.tops.shape[1]
    best, cosines, at, step = *none, 0, 2
    while at < len(order):
        # rounding may part a bound from the sum that it bounds
        if len(best) == k and cosines[-1] > bounds[order[at]] + 1e-9:
            break
        taken = order[at : at + step]
        cells = (terms[:, None] * blocks + taken).ravel()
        sizes = index.starts[cells + 1] - index.starts[cells]
        posts = np.repeat(index.starts[cells] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        found, back = np.unique(index.places[posts], return_inverse=True)
        sums = np.bincount(back, np.repeat(np.repeat(weights, len(taken)), sizes) * index.weights[posts], len(found))
        kept = found != but
        best, cosines = np.concatenate([best, found[kept]]), np.concatenate([cosines, sums[kept]])
        first = np.lexsort((best, -cosines))[:k]
        best, cosines = best[first], cosines[first]
        at, step = at + step, step * 2
    return best, cosines


def vote(index: Index, places: np.ndarray, cosines: np.ndarray, shrink: float | None = None) -> float:
    """The share of toxic neighbours, weighted by their cosines squared and drawn to the prior by ``shrink``."""
    w, shrink = cosines**2, index.shrink if shrink is None else shrink
    return float((w @ index.toxic[places] + shrink * index.prior) / (w.sum() + shrink))


def _curve(votes: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits the labels best; targets off 0 and 1 keep it finite."""
    x = np.column_stack([votes, np.ones(len(votes))])
    ones, noughts = weights[toxic == 1].sum(), weights[toxic == 0].sum()
    y = np.where(toxic == 1, (ones + 1) / (ones + 2), 1 / (noughts + 2))
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weights * (p - y)) + [1e-3 * theta[0], 0.0]
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(bend, slope)
        theta = theta - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(vocabulary: list[str], texts: np.ndarray, rows: list[tuple[int, int, dict[int, int]]], counts: tuple[int, int], settings: Settings = Settings()) -> Index:
    """An index with its curve, from the vocabulary, the number of examples that hold each term, examples
    (id, label, count by term) and the numbers of labelled texts of both classes."""
    idf = np.log((len(rows) + 1) / (np.asarray(texts, float) + 1)) + 1
    vectors = []
    for i, y, found in rows:
        terms = np.array(sorted(found), np.int64)
        w = (1 + np.log(np.array([found[t] for t in terms], float))) * idf[terms] if len(terms) else np.empty(0)
        vectors.append((i, y, terms, w / (np.sqrt(w @ w) or 1.0)))
    vectors, total = by_heaviest(vectors), max(sum(counts), 1)
    index = build(vocabulary, idf, vectors, (counts[1] + 0.5) / (total + 1), settings.block)
    if not rows:
        return index
    near = [nearest(index, t, w, settings.neighbours, place) for place, (_, _, t, w) in enumerate(vectors)]
    held = np.bincount(index.toxic, minlength=2)
    weights = np.where(index.toxic == 1, counts[1] / max(held[1], 1), counts[0] / max(held[0], 1)) * len(rows) / total
    best = None
    for shrink in settings.shrinks:
        votes = np.array([vote(index, *n, shrink) for n in near])
        slope, offset = _curve(votes, index.toxic, weights)
        p = 1 / (1 + np.exp(-np.clip(slope * votes + offset, -30, 30)))
        loss = -(weights * np.log(np.where(index.toxic == 1, p, 1 - p) + 1e-12)).sum()
        if best is None or loss < best[0]:
            best = loss, {"shrink": shrink, "slope": slope, "offset": offset}
    return Index(**{**index.__dict__, **best[1]})


def score_text(index: Index, text: str | None, settings: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """Score, places of the neighbours and their cosines."""
    places, cosines = nearest(index, *vector(index, text), settings.neighbours)
    z = index.slope * vote(index, places, cosines) + index.offset
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), places, cosines


def toxic_held_out(doc_id: Column) -> Column:
    """True for the third of the documents whose labels are not learned from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many texts of each class hold a term, summed as far as memory allows."""
    held: tuple[Counter, Counter] = Counter(), Counter()

    def out() -> pd.DataFrame:
        terms = sorted(held[0].keys() | held[1].keys())
        return pd.DataFrame({"term": terms, "clean": [held[0][t] for t in terms], "toxic": [held[1][t] for t in terms]})

    for batch in batches:
        for text, y in zip(batch["text"], batch["toxic"], strict=True):
            held[y].update(text_terms(text).keys())
            if len(held[0]) + len(held[1]) > HELD:
                yield out()
                held[0].clear()
                held[1].clear()
    if held[0] or held[1]:
        yield out()


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Index:
    """An index of labelled rows of ``docs`` that are not held out, a sample of each class by a hash of the id.

    Labels without doc_id or toxic say nothing; if labels repeat an id, toxic counts if any of them
    says so. Equal texts of one label are one example. Texts are read whole, in tasks; the driver
    gets the vocabulary and the examples' counts of its terms, both bounded by ``settings``.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~toxic_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = materialize(known.withColumn("draw", F.crc32(F.concat(F.lit("toxicity-"), F.col("doc_id").cast("string"))) / 2.0**32))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    counts = sizes.get(0, 0), sizes.get(1, 0)
    some = [known.where(f"toxic = {y}").where(F.col("draw") < 1.2 * settings.rows / max(counts[y], 1)).orderBy("draw", "doc_id").limit(settings.rows) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id").where("text is not null")
    rows = materialize(rows.groupBy(F.sha2("text", 256).alias("_name"), "toxic").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "toxic", "text"))
    discard(known)

    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    terms = rows.select("text", "toxic").mapInPandas(_count_terms, "term string, clean long, toxic long")
    terms = terms.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= settings.least_texts)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    lacking = (n * (a * (n - ones - b) - b * (ones - a)) * (a * (n - ones - b) - b * (ones - a)), (a + b) * (n - a - b) * float(max(ones * (n - ones), 1)))
    terms = terms.withColumn("chi", F.when(lacking[1] > 0, lacking[0] / lacking[1]).otherwise(F.lit(0.0))).where(F.col("chi") >= settings.least_chi)
    rates = (a + 1) / float(ones + 2), (b + 1) / float(n - ones + 2)
    terms = terms.where(F.greatest(rates[0] / rates[1], rates[1] / rates[0]) >= settings.least_ratio)
    terms = sorted(terms.orderBy(F.desc("chi"), "term").limit(settings.terms).collect(), key=lambda r: r["term"])
    vocabulary = [r["term"] for r in terms]
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted((shared.value[t], c) for t, c in text_terms(text).items() if t in shared.value) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "terms": [[t for t, _ in f] for f in found], "counts": [[c for _, c in f] for f in found]})

    held = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInPandas(vectors, "doc_id long, toxic int, terms array<int>, counts array<int>").collect()
    discard(rows)
    held = sorted(held, key=lambda r: (r["doc_id"], r["toxic"], r["terms"], r["counts"]))
    examples = [(r["doc_id"], r["toxic"], dict(zip(r["terms"], r["counts"], strict=True))) for r in held]
    return fit(vocabulary, np.array([r["clean"] + r["toxic"] for r in terms], float), examples, counts, settings)


def score_toxicity(docs: DataFrame, index: Index, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, neighbours (ids of the nearest examples) and cosines for each row of ``docs`` (doc_id, text).

    Null and empty texts, and texts without a term of the vocabulary, have no neighbours and get
    the score of that. Repeated rows have equal results; neighbours that tie go by their place in
    the index. Texts are read whole. An empty table gives an empty result; other columns of
    ``docs`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            found = [score_text(index, text, settings) for text in batch["text"]]
            out = batch[["doc_id"]].copy()
            out["score"] = np.array([s for s, *_ in found], float)
            out["neighbours"] = [index.ids[p] for _, p, _ in found]
            out["cosines"] = [c for *_, c in found]
            yield out

    return in_pandas(docs.select("doc_id", "text"), run, "doc_id", "score double, neighbours array<long>, cosines array<double>")


def toxicity_digests(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours and cosines of each row of ``docs``; see ``learn`` and ``score_toxicity``.

    A row without doc_id is not held out. Without labels every score is 0.5.
    """
    scored = score_toxicity(docs, learn(docs, labels, settings), settings)
    return scored.select("doc_id", toxic_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "neighbours", "cosines")
