"""Vector codes and whitening against plain numpy, on tables with every odd case."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, `x` string, code string, component int, n long, `__label` string, error long"


def row(vec_id, vector, label):
    return (vec_id, vector, label, "x", "ff", 3, 9, "=1", 7)


def made_vectors(n=600, width=8, kinds=6, seed=3):
    """Vectors around a few points, many equal, some odd: null, short, non-finite, of huge and negative components."""
    r = random.Random(seed)
    around = [[r.gauss(0, 1) for _ in range(width)] for _ in range(kinds)]
    rows = [(i * 7 % 1009, [x + r.gauss(0, 0.01 + 0.2 * (i % 3)) for x in around[i % kinds]], None if i % 11 == 0 else i % 5) for i in range(n)]
    rows += [(2000 + i, list(around[0]), 1) for i in range(80)]  # a hot vector
    rows += [(None, around[1], 2), (None, around[1], None), (5, around[2], 0), (5, around[2], 0), (5, around[3], 0), (-3, around[0], 4)]
    return rows, [(3001, None, 1), (3002, [1.0, None] * (width // 2), 1), (3003, [float("nan")] * width, 2), (3004, [float("-inf")] * width, 2)]


def whole(rows, width):
    return np.array([np.floor(np.float32(v).astype(np.float64) * 1024) for _, v, _ in rows]).astype(np.int64).reshape(-1, width)


def lloyd(rows, width, rounds=4, entries=256):
    """Plain rounds: every distance measured, in integers."""
    x = whole(rows, width).reshape(len(rows), 4, width // 4)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [float(np.float32(c)) for c in rows[i][1]]))
    books = np.stack([x[i] for i in order[:entries]]).transpose(1, 0, 2).copy()
    near = lambda p: ((x[:, p][:, None] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        own = [near(p).argmin(1) for p in range(4)]
        for p in range(4):
            for j in set(own[p].tolist()):
                books[p][j] = x[own[p] == j, p].sum(0) // (own[p] == j).sum()
    own, d = np.stack([near(p).argmin(1) for p in range(4)], 1), sum(near(p).min(1) for p in range(4))
    return [bytes(c.tolist()).hex() for c in own], d.tolist(), hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


@pytest.mark.parametrize("n", [600, 90])
def test_codes_are_those_of_plain_rounds(spark, n):
    rows, dropped = made_vectors(n)
    codes, errors, digest = lloyd(rows, 8)
    sums = {}
    for (_, _, label), e in zip(rows, errors):
        sums[label] = sums.get(label, 0) + e
    got = vector_codes.compress(spark.createDataFrame([row(*r) for r in rows + dropped], SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = sorted(((i, c, e, sums[label], digest) for (i, _, label), c, e in zip(rows, codes, errors)), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_bounds_hold_and_prune(monkeypatch):
    """Every bound is one, ties go to the lower index, and most distances aren't measured."""
    r = np.random.default_rng(5)
    x = (r.normal(size=(3000, 6)) * 40 + r.integers(0, 12, 3000)[:, None] * 400).astype(np.int64)
    entries = np.concatenate([x[:60], x[:3]])  # equal entries tie
    own, d, lower = vector_codes.first_round(x, entries)
    for _ in range(3):
        after = np.stack([x[own == j].sum(0) // max((own == j).sum(), 1) if (own == j).any() else e for j, e in enumerate(entries)])
        moved = np.sqrt(((after - entries) ** 2).sum(1))
        measured, plain = [], vector_codes._measured
        monkeypatch.setattr(vector_codes, "_measured", lambda a, b: measured.append(len(a)) or plain(a, b))
        own, found, upper, lower = vector_codes.next_round(x, after, own, np.sqrt(d) + moved[own], np.maximum(lower - moved, 0), False)
        monkeypatch.setattr(vector_codes, "_measured", plain)
        d = ((x[:, None] - after[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all() and (lower <= np.sqrt(d) + 1e-9).all() and (upper >= np.sqrt(d.min(1)) - 1e-9).all()
        assert ((found == -1) | (found == d.min(1))).all() and sum(measured) < 0.5 * d.size
        step = vector_codes._floored(lower)
        assert (step[0] * step[1].astype(float)[:, None] <= lower).all()
        entries, d = after, d.min(1)


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    one = vector_codes.compress(spark.createDataFrame([row(1, [0.5, -0.5], None), row(2, [], None), row(3, [3e38, 1.0, 2.0], None)], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["error"], r["label_error"]) for r in one) == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]


def test_whitening(spark):
    rows, dropped = made_vectors(500, 12)
    x = whole(rows, 12) + 100_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    want = np.abs(y @ v[:, :8] / np.sqrt(e[:8]))
    got = whitening.whiten(spark.createDataFrame([row(*r) for r in rows + dropped], SCHEMA).repartition(4)).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    told = {}
    for (i, _, _), w, far in zip(rows, want, ((n * x - s) ** 2).sum(1).tolist()):
        told.setdefault(i, []).append((far, w))
    for r in got:
        assert any(r["deviation"] == far and abs(abs(r["whitened"]) - w[r["component"] - 1]) < 1e-8 for far, w in told[r["vec_id"]])
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12
    one = {r["component"]: r["whitened"] > 0 for r in got if r["vec_id"] == -3}
    assert set(one) == set(range(1, 9))


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    same = whitening.whiten(spark.createDataFrame([row(i, [1.0, 2.0], None) for i in range(3)], SCHEMA)).collect()
    assert len(same) == 6 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(None, 0.0, None, 0)}
    line = whitening.whiten(spark.createDataFrame([row(i, [float(i), 2.0 * i][: 1 + (i != 3)], None) for i in range(5)], SCHEMA).where(F.col("vec_id") != 3)).collect()
    assert {r["component"] for r in line if r["whitened"] is not None} == {1} and max(r["identity_error"] for r in line) < 1e-9
