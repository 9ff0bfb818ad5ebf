from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from farepath.llm import whitening
from farepath.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x long, component int, `v.w` string, Vec string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 0, -1, -1, -1, "clash", "clash") for i, v in vectors], SCHEMA)


def whole(vector):
    if not vector or any(e is None or not math.isfinite(e) for e in vector):
        return None
    return tuple(math.floor(64 * float(np.float32(e))) + 1_000_000 for e in vector)


def brute(vectors, components=16):
    """The covariance itself, summed in whole numbers, decomposed."""
    rows = [(i, x) for i, v in vectors if (x := whole(v))]
    fit = sorted({x for _, x in rows})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = [[n * x[d] - sums[d] for d in range(dims)] for x in fit]
    columns = np.array(centred, dtype=object)
    covariance = np.array([[float(Fraction(int(c), n ** 3)) for c in row] for row in columns.T @ columns])
    values, of = np.linalg.eigh(covariance)
    values, of = values[::-1], of[:, ::-1]
    k = min(components, int((values > values[0] * 1e-10).sum()))
    out = {}
    for i, x in rows:
        exact = [n * x[d] - sums[d] for d in range(dims)]
        white = (np.array(exact, dtype=float) / n) @ of[:, :k] / np.sqrt(values[:k])
        out.setdefault(i, []).append((n, sum(e * e for e in exact), white, values[:k] / values.sum()))
    return out, k


def assert_equal(got, vectors, tolerance=1e-7):
    want, k = brute(vectors)
    assert len(got) == sum(len(v) for v in want.values()) * k
    signs = {}
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert set(by_row) == set(want)
    for i, rows in by_row.items():
        n, deviation, white, explained = want[i][0]
        assert sorted(rows) == list(range(1, k + 1))
        for c, some in rows.items():
            assert len(some) == len(want[i])
            for r in some:
                assert (r["n"], r["deviation"]) == (n, deviation)
                assert math.isclose(r["explained"], explained[c - 1], rel_tol=1e-6)
                sign = signs.setdefault(c, 1 if r["whitened"] * white[c - 1] >= 0 else -1) if abs(white[c - 1]) > 0.01 else signs.get(c, 0)
                assert abs(r["whitened"] * sign - white[c - 1]) <= tolerance if sign else abs(r["whitened"]) < 0.02
                assert r["identity_error"] <= 1e-8


def test_query_equals_the_decomposed_covariance(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert_equal(QUERIES["op12_whitening"](spark, sf).collect(), vectors)


def test_scales_far_apart(spark):
    """Standard deviations from 3e4 down to 0.3 in x, mixed by a rotation."""
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(400, 6)) * [500, 40, 8, 1, 0.1, 0.05] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    vectors = list(enumerate(mixed.tolist()))
    assert_equal(whitening.whiten(frame(spark, vectors)).collect(), vectors, tolerance=1e-6)


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-200, 200, size=(300, 3)) / 64
    vectors = list(enumerate(np.column_stack([base, base[:, 0], np.full(300, 0.5), -base[:, 1]]).tolist()))
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    assert_equal(got, vectors)


def test_fewer_rows_than_dimensions(spark):
    rng = np.random.default_rng(3)
    vectors = list(enumerate(rng.normal(size=(5, 12)).tolist()))
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert {r["component"] for r in got} == {1, 2, 3, 4}
    assert_equal(got, vectors)


def test_left_out_repeated_and_null_ids(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(40, 3)).tolist()
    vectors = [*enumerate(good), (None, good[0]), (3, good[3]), (3, good[5]), (50, None), (51, []), (52, [1.0, None, 2.0]), (53, [float("nan"), 0, 0]),
               (54, [float("inf"), 0, 0]), (55, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert {r["vec_id"] for r in got} == {*range(40), None}
    assert sum(r["vec_id"] == 3 for r in got) == 9
    assert sum(r["vec_id"] is None for r in got) == 3
    assert {r["n"] for r in got} == {40}


@pytest.mark.parametrize("vectors", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(frame(spark, vectors)).collect() == []


def test_triangular_solves():
    rng = np.random.default_rng(5)
    rows, r = rng.normal(size=(20, 6)), np.triu(rng.normal(size=(6, 6))) + 4 * np.eye(6)
    assert np.allclose(whitening._solved(rows, [r, r]) @ r @ r, rows)


def test_whole_numbers_beyond_64_bits():
    x = np.array([[2 ** 50, 3]], dtype=np.int64)
    assert whitening._exactly(2 ** 20, np.array([5, 7]), x).tolist() == [[2 ** 70 - 5, 3 * 2 ** 20 - 7]]
