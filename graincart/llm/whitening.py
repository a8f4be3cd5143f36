"""Whitening of embeddings by an incremental eigendecomposition.

A scatter matrix is kept as eigenvalues and eigenvectors only. A row, centred on the mean so far,
is a rank-one update: the new eigenvalues are the roots of a secular equation, the new eigenvectors
follow from them, and poles that a row does not move are deflated. Each partition turns its rows
into one spectrum (count, mean, eigenvalues, eigenvectors). Spectra are combined by further rank-one
updates, one for each eigenpair and one for the distance of the means, in rounds of a few at a
time. A distributed Rayleigh-Ritz step then measures the covariance in the basis so found, with
means that come from exact sums, and turns the basis to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import discard, in_pandas, materialize, small_batches

#: The whole number of an entry c is floor(SCALE * c) + SHIFT; entries of LIMIT and more have none.
SCALE, SHIFT, LIMIT = 64.0, 1_000_000, 2.0**46
COMPONENTS = 32
#: Spectra that one task combines in a round, and rows that are turned into a triangle at a time.
TOGETHER, BLOCK = 8, 512
EPS = np.finfo(float).eps
SPECTRUM = "at long, n long, mean array<double>, eigenvalues array<double>, vectors array<double>"


def secular_roots(poles: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(w / (poles - x)) as the places of their nearer poles and their offsets from these.

    ``poles`` rise strictly and every w is above 0, so that each root lies between a pole and the
    next, the last within sum(w) of the last pole. An offset keeps the digits that a root lacks.
    """
    n = len(poles)
    gap = np.append(np.diff(poles), w.sum() * (1 + 4 * EPS))
    upper = 1 + (w / (poles - (poles + gap / 2)[:, None])).sum(axis=1) < 0
    above = upper & (np.arange(n) < n - 1)
    near = np.arange(n) + above
    low = np.where(above, -gap / 2, np.where(upper, gap / 2, 0.0))
    high = np.where(above, 0.0, np.where(upper, gap, gap / 2))
    apart, own = poles - poles[near][:, None], w[near]
    x = (low + high) / 2
    for _ in range(120):
        terms = w / (apart - x[:, None])
        value = 1 + terms.sum(axis=1)
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        # the term of the nearer pole stays, the rest becomes a line: a x^2 + b x = own
        a = np.maximum((terms * terms / w).sum(axis=1) - own / (x * x), 0.0)
        b = value + own / x - a * x
        s = np.sqrt(b * b + 4 * a * own)
        with np.errstate(all="ignore"):
            new = np.where(above, np.where(b < 0, -2 * own / (s - b), -(b + s) / (2 * a)), np.where(b > 0, 2 * own / (b + s), (s - b) / (2 * a)))
        # a root is found when the sum is 0 but for the rounding of its terms
        found = (np.abs(value) <= 2 * EPS * (1 + np.abs(terms).sum(axis=1))) | (high - low <= 2 * EPS * np.abs(x))
        if found.all():
            break
        x = np.where(found, x, np.where((new > low) & (new < high), new, (low + high) / 2))
    return near, x


@dataclass
class Spectrum:
    """The rows seen so far: how many, their mean, and their scatter as vectors @ diag(values) @ vectors.T."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, np.zeros(size), np.empty(0), np.empty((size, 0)))

    def update(self, v: np.ndarray, rho: float) -> None:
        """Add rho * v v^T to the scatter."""
        length = np.sqrt(v @ v)
        if not length > 0 or not rho > 0:
            return
        z = self.vectors.T @ v
        rest = v - self.vectors @ z
        more = self.vectors.T @ rest
        z, rest = z + more, rest - self.vectors @ more
        values, vectors = self.values, self.vectors
        outside = np.sqrt(rest @ rest)
        if outside > 1e-9 * length and len(values) < len(v):
            values, vectors, z = np.append(values, 0.0), np.column_stack([vectors, rest / outside]), np.append(z, outside)
        order = np.argsort(values, kind="stable")
        values, vectors, z = values[order], vectors[:, order], z[order]
        self.values, self.vectors = _moved(values, vectors, z, rho)

    def add_rows(self, rows: np.ndarray) -> None:
        """Add rows, centred: a block of more rows than columns is first turned into a triangle of equal scatter."""
        for at in range(0, len(rows), BLOCK):
            block = rows[at : at + BLOCK]
            mean = block.mean(axis=0)
            centred = block - mean
            self._shift(len(block), mean)
            for v in np.linalg.qr(centred, mode="r") if len(block) > block.shape[1] else centred:
                self.update(v, 1.0)

    def add(self, other: Spectrum) -> None:
        """Add the rows of another spectrum, eigenpair by eigenpair."""
        if not other.n:
            return
        self._shift(other.n, other.mean)
        for value, v in zip(other.values, other.vectors.T, strict=True):
            self.update(v, float(value))

    def _shift(self, n: int, mean: np.ndarray) -> None:
        total = self.n + n
        apart = mean - self.mean
        self.update(apart, self.n * (n / total))
        self.n, self.mean = total, self.mean + apart * (n / total)


def _moved(poles: np.ndarray, vectors: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(poles) + rho z z^T in the basis ``vectors``; ``poles`` must rise."""
    size = z @ z
    tiny = 8 * EPS * max(float(np.abs(poles).max(initial=0.0)), rho * size)
    z, poles, vectors = z.copy(), poles.copy(), vectors.copy()
    moved = np.flatnonzero(rho * np.abs(z) * np.sqrt(size) > tiny)
    # poles that are equal up to rounding: turn their plane, so that one of them has no part in z
    p, q = moved[:-1], moved[1:]
    for k in np.flatnonzero((poles[q] - poles[p]) * np.abs(z[p] * z[q]) <= tiny * (z[p] ** 2 + z[q] ** 2)):
        i, j = moved[k], moved[k + 1]
        both = np.hypot(z[i], z[j])
        c, s = z[j] / both, z[i] / both
        if abs((poles[j] - poles[i]) * c * s) <= tiny:
            vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
            poles[i], poles[j] = c * c * poles[i] + s * s * poles[j], s * s * poles[i] + c * c * poles[j]
            z[i], z[j] = 0.0, both
    moved = moved[z[moved] != 0]
    if not len(moved):
        return poles, vectors
    d, u = poles[moved], z[moved]
    near, x = secular_roots(d, rho * u * u)
    apart = d[near][:, None] - d + x[:, None]
    n = np.arange(len(d))
    # the z for which these roots are exact: its vectors are orthogonal to the last digits
    under = np.where(n[:, None] < n, d[:, None] - d, np.append(d[1:], 0.0)[:, None] - d)
    under[-1] = rho
    exact = np.sqrt(np.abs(np.prod(apart / under, axis=0)))
    turn = np.where(u < 0, -exact, exact)[:, None] / -apart.T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    poles[moved], vectors[:, moved] = d[near] + x, vectors[:, moved] @ turn
    return poles, vectors


def whole(rows: np.ndarray) -> np.ndarray:
    return np.floor(rows * SCALE).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Whitening:
    """n rows, whose means are base + rest / n for each dimension; components as columns, by falling eigenvalue."""

    n: int
    base: np.ndarray = field(repr=False)
    rest: np.ndarray = field(repr=False)
    components: np.ndarray = field(repr=False)
    eigenvalues: np.ndarray = field(repr=False)
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; a component without variance gives NaN."""
        with np.errstate(all="ignore"):
            return self.centred(x) @ self.components / np.where(self.eigenvalues > 0, np.sqrt(self.eigenvalues), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2 of each row, exact; None beyond a long."""
        from_base = x - self.base
        if len(x) and (float(np.abs(from_base).max(initial=0)) + 1) ** 2 * float(self.n) ** 2 * max(x.shape[1], 1) < 2.0**62:
            return ((from_base * self.n - self.rest) ** 2).sum(axis=1).tolist()
        out = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.rest.tolist(), strict=True)) for row in from_base.tolist()]
        return [v if v < 2**63 else None for v in out]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for batch in batches:
        if len(batch):
            yield whole(np.stack(batch["v"].to_numpy()).astype(float))


def _summed(rows: DataFrame, of: Callable[[Iterator[np.ndarray]], np.ndarray], kind: str) -> list:
    """The sum over all partitions of the vector that ``of`` makes of each one's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"sums": [of(_rows(batches))]})

    each = rows.mapInPandas(run, f"sums array<{kind}>").select(F.posexplode("sums").alias("at", "part"))
    exact = F.sum(F.col("part").cast("decimal(38,0)")) if kind == "long" else F.sum("part")
    return [r[1] for r in each.groupBy("at").agg(exact).orderBy("at").collect()]


def spectrum(rows: DataFrame, base: np.ndarray, together: int = TOGETHER) -> Spectrum:
    """One spectrum of all ``rows`` (v), their whole numbers less ``base``."""
    size = len(base)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        found = Spectrum.empty(size)
        for x in _rows(batches):
            found.add_rows((x - base).astype(float))
        if found.n:
            yield _row(TaskContext.get().partitionId(), found)

    def combined(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        out = Spectrum.empty(size)
        for r in found.sort_values("at").itertuples():
            out.add(Spectrum(r.n, np.array(r.mean), np.array(r.eigenvalues), np.array(r.vectors).reshape(size, -1)))
        return _row(key[0], out)

    parts = materialize(rows.mapInPandas(own, SPECTRUM))
    while parts.select(F.max("at")).first()[0]:
        fewer = materialize(parts.groupBy(F.floor(F.col("at") / together).alias("group")).applyInPandas(combined, SPECTRUM))
        discard(parts)
        parts = fewer
    r = parts.first()
    discard(parts)
    return Spectrum(r["n"], np.array(r["mean"]), np.array(r["eigenvalues"]), np.array(r["vectors"]).reshape(size, -1))


def _row(at: int, found: Spectrum) -> pd.DataFrame:
    return pd.DataFrame({"at": [at], "n": [found.n], "mean": [found.mean], "eigenvalues": [found.values], "vectors": [found.vectors.ravel()]})


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) * SCALE < LIMIT), F.lit(False)))


def fit_rows(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """(key, v) of the rows that have a vector of finite entries, and the length of v.

    A null vector, one with a null or non-finite entry and one with an entry of 2**40 and more are
    dropped. Vectors must have one length: of several, that of most rows counts (the larger of
    those that tie), and rows of another are dropped.
    """
    rows = vectors.select(key, F.col(column).cast("array<double>").alias("v")).where(_finite(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["size"] if sizes else 0)), sizes[0]["size"] if sizes else 0


def learn(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (v), vectors of ``size`` entries; None without rows or entries."""
    small_batches(rows.sparkSession)
    rows = rows.select("v")
    if not size:
        return None

    def sums(found: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros(size + 1, np.int64)
        for x in found:
            out += np.append(x.sum(axis=0), len(x))
        return out

    *total, n = map(int, _summed(rows, sums, "long"))
    base, rest = np.array([s // n for s in total], np.int64), np.array([s % n for s in total], np.int64)
    basis, _ = np.linalg.qr(spectrum(rows, base).vectors)
    rough = Whitening(n, base, rest, basis, np.ones(basis.shape[1]), 0.0)

    def scatter(found: Iterator[np.ndarray]) -> np.ndarray:
        out, trace = np.zeros((basis.shape[1],) * 2), 0.0
        for x in found:
            y = rough.centred(x)
            trace += float((y * y).sum())
            y = y @ basis
            out += y.T @ y
        return np.append(out.ravel(), trace)

    # Rayleigh-Ritz: the covariance within the basis, whose own eigenvectors turn the basis
    *held, trace = _summed(rows, scatter, "double")
    held = np.array(held).reshape((basis.shape[1],) * 2) / n
    values, turn = np.linalg.eigh((held + held.T) / 2)
    values, found = values[::-1], (basis @ turn[:, ::-1])
    lead = np.take_along_axis(found, np.abs(found).argmax(axis=0)[None], axis=0) if found.size else np.ones((1, 0))
    found = found * np.where(lead < 0, -1.0, 1.0)
    most = min(components, size)
    values, found = np.append(values, np.zeros(size))[:most], np.column_stack([found, np.zeros((size, size))])[:, :most]
    values = np.where(values > 64 * EPS * values.max(initial=0.0), values, 0.0)
    return Whitening(n, base, rest, found, values, trace / n)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance less the identity, over components that have variance."""
    some = model.eigenvalues > 0
    k = int(some.sum())

    def moments(found: Iterator[np.ndarray]) -> np.ndarray:
        out, total = np.zeros((k, k)), np.zeros(k)
        for x in found:
            y = model.apply(x)[:, some]
            out, total = out + y.T @ y, total + y.sum(axis=0)
        return np.append(out.ravel(), total)

    held = np.array(_summed(rows.select("v"), moments, "double")) / model.n
    mean = held[k * k :]
    return float(np.abs(held[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error for each fitted row and component.

    See ``fit_rows`` for the rows that are dropped, null vectors among them; a null key stays null.
    Repeated rows count and are returned as often as they come. Of equal eigenvalues any basis may
    come. A component without variance (all rows equal, or fewer of them than dimensions) has a
    null in whitened and 0 in explained; explained is 0 too if nothing varies. deviation is null
    where it does not fit a long. An empty table gives an empty result; other columns are ignored.
    """
    rows, size = fit_rows(vectors, key, column)
    schema = "deviation long, w array<double>"
    model = learn(rows, size, components)
    if model is None:
        found, n, parts, error = in_pandas(rows.limit(0), lambda batches: iter(()), key, schema), 0, [0.0], 0.0
    else:
        n, error = model.n, identity_error(rows, model)
        parts = [float(e / model.trace) if model.trace > 0 else 0.0 for e in model.eigenvalues]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = whole(np.stack(batch["v"].to_numpy()).astype(float))
                    yield pd.DataFrame({key: batch[key], "deviation": pd.array(model.deviation(x), "Int64"), "w": list(model.apply(x))})

        found = in_pandas(rows, run, key, schema)
    out = found.select(key, "deviation", F.posexplode("w").alias("at", "w"))
    share = F.element_at(F.array(*map(F.lit, parts)), F.col("at") + 1)
    return out.select(
        key,
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("w"), F.col("w")).alias("whitened"),
        share.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
