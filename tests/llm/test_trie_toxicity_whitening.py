"""The prefix trie, toxicity and whitening against plain Python and numpy, and on odd tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graincart.llm import oracle, toxicity, trie, whitening

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def trie_of(rows):
    """The nodes by dictionaries of whole prefixes."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [v[1:] for v in sorted(turns, key=lambda v: v[0])] for c, turns in own.items()}
    told = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        told[c] = own.get(first, [])[:h] + turns[h:]
    members, kids, totals, out = {}, {}, {}, []
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = totals.get(p, (0, 0))
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        totals[p] = leaves + (p not in kids), saved + (len(members[p]) - 1) * words
        if p:
            above = totals.get(p[:-1], (0, 0))
            totals[p[:-1]] = above[0] + totals[p][0], above[1] + totals[p][1]
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(told[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_dictionaries(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(np.arange(-45, 90), 70, replace=False).tolist():
        turns = rng.permutation(np.arange(-3, int(rng.integers(-2, 9)))).tolist()
        rows += [(c, t, str(rng.choice(["user", "bot"])), str(rng.choice(["a", "a b", " x\ty ", ""]))) for t in turns]
    rows += [(7, None, None, None), (13, None, "user", "a"), (None, 1, "user", "lost"), (2000, 0, None, "a" * 5000)]
    assert told(trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS).withColumn("key", F.lit(1)).withColumn("depth", F.lit("x")))) == trie_of(rows)


def test_trie_of_long_chains_and_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "BIN", 16)
    monkeypatch.setattr(trie, "CHUNK_BITS", 3)
    rows = [(c, t, "user", f"turn {t}") for c in (0, 20, 40) for t in range(130 - c)]
    rows += [(60 + c, t, "user", f"copy {t}") for c in range(40) for t in range(6)]
    # a comb: at each turn one conversation leaves the others
    rows += [(1000 + 20 * c, t, "user", "same" if t < c else f"other {c}") for c in range(30) for t in range(c + 1)]
    assert told(trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS))) == trie_of(rows)


def test_trie_turns_that_tie_have_an_order(spark):
    rows = [(0, 1, "user", x) for x in "abc"] + [(20, 1, "user", x) for x in "cab"] + [(0, 5, "u", "z"), (0, 5, "u", "z")]
    out = trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    again = trie.prefix_trie(spark.createDataFrame(rows[::-1], CONVERSATIONS)).collect()
    assert sorted(out, key=str) == sorted(again, key=str) and max(r["depth"] for r in out) == 5


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], CONVERSATIONS)).count() == 0


def test_contraction_takes_few_rounds(spark, monkeypatch):
    """A chain of 2,000 nodes is gone after a number of rounds like its logarithm, and no total is lost."""
    rows = [(0, d, 0 if d else None, d - 1 if d else None, int(d < 1999), int(d == 1999), d) for d in range(2000)]
    tree = spark.createDataFrame(rows, "conv_id long, depth long, parent_conv_id long, parent_depth long, n_children long, n_leaves long, saved long")
    written = []
    monkeypatch.setattr(trie, "materialize", lambda df, own=trie.materialize: written.append(1) or own(df))
    out = {r["depth"]: (r["n_leaves"], r["saved"]) for r in trie.subtree_totals(tree, ("n_leaves", "saved")).collect()}
    assert out == {d: (1, sum(range(d, 2000))) for d in range(2000)} and len(written) < 6 * 16


def test_trie_sql(spark):
    rows = [(c, t, "user" if t % 2 else None, f"t{t} {c % 3 if t > 2 else ''}") for c in range(50) for t in range(c % 7)] + [(3, None, "u", "x")]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"turn": "Int64"}))
    found = con.sql(oracle.TRIE)
    assert sorted(found.fetchall(), key=str) == told(trie.prefix_trie(df).select(*found.columns))


def random_index(rng, n, terms, block=8):
    rows = []
    for i in range(n):
        t = np.sort(rng.choice(terms, rng.integers(0, min(terms, 9)), replace=False))
        w = rng.random(len(t)).round(1) + 0.1
        rows.append((i, int(rng.integers(2)), t.astype(np.int64), w / (np.sqrt(w @ w) or 1)))
    rows = toxicity.by_heaviest(rows)
    return toxicity.build([str(t) for t in range(terms)], np.ones(terms), rows, 0.3, block), rows


@pytest.mark.parametrize("seed", range(30))
def test_nearest_equals_all_cosines(seed):
    rng = np.random.default_rng(seed)
    index, rows = random_index(rng, int(rng.integers(0, 200)), int(rng.integers(1, 40)))
    dense = np.zeros((len(rows), len(index.vocabulary)))
    for i, (_, _, t, w) in enumerate(rows):
        dense[i, t] = w
    for but in (-1, 0, len(rows) // 2):
        t = np.sort(rng.choice(len(index.vocabulary), rng.integers(0, len(index.vocabulary) + 1), replace=False)).astype(np.int64)
        q = np.zeros(len(index.vocabulary))
        q[t] = rng.random(len(t)) + 0.1
        cosines = dense @ q
        wanted = sorted((-round(c, 12), i) for i, c in enumerate(cosines) if c > 0 and i != but)[:7]
        places, found = toxicity.nearest(index, t, q[t], 7, but)
        assert np.allclose(found, [-c for c, _ in wanted])
        # ties within rounding may change places
        assert {p for p, c in zip(places, found, strict=True) if c > found[-1] + 1e-9} <= {i for _, i in wanted}


def test_blocks_are_left_out(monkeypatch):
    """The bounds spare most postings: a query for one rare term reads few blocks."""
    rng = np.random.default_rng(5)
    rows = toxicity.by_heaviest([(i, 0, np.array([0, 1 + i % 50]), np.array([0.3, 0.95])) for i in range(2000)])
    index = toxicity.build([str(t) for t in range(51)], np.ones(51), rows, 0.1, 16)
    reads = []
    unique = np.unique
    monkeypatch.setattr(toxicity.np, "unique", lambda x, **k: reads.append(len(x)) or unique(x, **k))
    places, _ = toxicity.nearest(index, np.array([0, 7]), np.array([0.3, 0.95]), 15)
    assert len(places) == 15 and sum(reads) < 400 and rng is not None


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_learns(spark):
    rng = np.random.default_rng(0)
    clean = ["river", "stone", "meadow", "window", "bread", "music", "garden", "paper", "seven", "cloud"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = list(rng.choice(clean, 25)) + (list(rng.choice(["vilest", "viler", "rottens", "rottenly"], 2)) if toxic else [])
        rows.append((i, " ".join(rng.permutation(words)), "en", "s", 0))
        labels.append((i, 0, int(toxic)))
    # one of no known ending, and texts without any term
    rows += [(10_000, "bread rottenish music", "en", "s", 0), (10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, "river " * 4000, "en", "s", 0)]
    labels += [(None, 1, 1), (3, 1, None), (3, None, 0), (77_777, 1, 1)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    out = {r["doc_id"]: r for r in toxicity.toxicity_digests(docs, marks).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(out[i]["held_out"] and out[i]["predicted"] == (i % 6 == 0) for i in held)
    assert out[10_000]["predicted"] == 1 and all(out[i]["predicted"] == 0 for i in (10_001, 10_002, 10_003))
    assert all(i % 6 == 0 for i in out[10_000]["neighbours"]) and not out[10_001]["neighbours"]


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (None, 1, 1), (99, 1, 1)]])
def test_toxicity_without_labels(spark, rows):
    docs = spark.createDataFrame([(0, "some text", "en", "s", 1), (0, "some text", "en", "s", 1), (None, None, None, None, None)], DOCS).withColumn("score", F.lit("mine"))
    out = toxicity.toxicity_digests(docs, spark.createDataFrame(rows, LABELS)).collect()
    assert len(out) == 3 and all(r["score"] == 0.5 and r["predicted"] == 0 for r in out)
    assert toxicity.toxicity_digests(docs.limit(0), spark.createDataFrame(rows, LABELS)).count() == 0


SCATTERS = {
    "rows of all sizes": lambda rng: np.floor(rng.normal(size=(900, 12)) * rng.uniform(0.5, 300, 12)),
    "fewer rows than columns": lambda rng: np.floor(rng.normal(size=(7, 12)) * 20),
    "ties": lambda rng: np.repeat(np.vstack([np.eye(6), -np.eye(6)]) * 5, 9, axis=0),
    "equal rows": lambda rng: np.ones((40, 6)),
    "hot row": lambda rng: np.vstack([np.tile(np.arange(6.0), (500, 1)), np.floor(rng.normal(size=(100, 6)) * 9)]),
    "scales": lambda rng: np.vstack([np.diag([1, 1, 1, 2, 1e7, 0])] * 5),
}


@pytest.mark.parametrize("name", sorted(SCATTERS))
@pytest.mark.parametrize("block", [1, 512])
def test_spectrum_is_the_scatter(name, block, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", block)
    x = SCATTERS[name](np.random.default_rng(1))
    centred = x - x.mean(axis=0)
    wanted = centred.T @ centred
    whole, halves = whitening.Spectrum.empty(x.shape[1]), whitening.Spectrum.empty(x.shape[1])
    whole.add_rows(x)
    for part in np.array_split(x, 3):
        other = whitening.Spectrum.empty(x.shape[1])
        other.add_rows(part)
        halves.add(other)
    for found in (whole, halves):
        assert found.n == len(x) and np.allclose(found.mean, x.mean(axis=0))
        assert np.abs(found.vectors @ np.diag(found.values) @ found.vectors.T - wanted).max() <= 1e-12 * max(np.abs(wanted).max(), 1)
        assert np.abs(found.vectors.T @ found.vectors - np.eye(len(found.values))).max(initial=0) < 1e-12


@pytest.mark.parametrize("seed", range(20))
def test_secular_roots_are_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 20))
    poles = np.sort(rng.random(n) * 10.0 ** rng.integers(-3, 4, n))
    poles = np.unique(poles)
    w = 10.0 ** rng.uniform(-8, 3, len(poles))
    near, x = whitening.secular_roots(poles, w)
    u = np.sqrt(w)
    assert np.allclose(np.sort(poles[near] + x), np.linalg.eigvalsh(np.diag(poles) + np.outer(u, u)), rtol=1e-10, atol=1e-10 * max(poles.max(), w.sum()))


def brute(vectors):
    x = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    return ((n * x - s) ** 2).sum(axis=1), y, e[::-1], q[:, ::-1]


def test_whitening_equals_eigh(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TOGETHER", 2)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(700, 40)) * rng.uniform(0.2, 3, 40)).astype(np.float32)
    vectors[:200] = vectors[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [1.0] * 39 + [None], 1), (902, [float("nan")] * 40, 1), (903, [float("inf")] + [0.0] * 39, 1), (904, [1.0, 2.0], 1), (905, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(9).withColumn("component", F.lit("x"))
    out = whitening.whiten(df).collect()
    deviation, y, e, q = brute(vectors)
    assert len(out) == 700 * 32 and {r["n"] for r in out} == {700} and all(r["deviation"] == deviation[r["vec_id"]] for r in out)
    found = np.zeros((700, 32))
    for r in out:
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
    wanted = y @ q[:, :32] / np.sqrt(e[:32])
    assert np.allclose(found * np.sign((found * wanted).sum(axis=0)), wanted, atol=1e-9)
    assert all(abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-10 and r["identity_error"] < 1e-9 for r in out)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    out = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, 1.0])], schema)).collect()
    assert len(out) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["n"] == 3 for r in out)
    out = whitening.whiten(spark.createDataFrame([(2**53 + 1, [0.5, 1.0, 3.0]), (None, [1.5, 1.0, 3.0])], schema)).collect()
    by = {(r["vec_id"], r["component"]): r["whitened"] for r in out}
    assert len(by) == 6 and abs(by[2**53 + 1, 1]) == pytest.approx(1) and by[None, 2] is None and by[None, 1] == -by[2**53 + 1, 1]


def test_deviation_is_exact_beyond_floats():
    model = whitening.Whitening(10**9, np.array([0]), np.array([7]), np.eye(1), np.ones(1), 1.0)
    assert model.deviation(np.array([[1], [5]])) == [(10**9 - 7) ** 2, (5 * 10**9 - 7) ** 2 if (5 * 10**9 - 7) ** 2 < 2**63 else None]
