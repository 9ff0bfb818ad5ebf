"""Whitening of embeddings by shifted CholeskyQR.

The entries become whole numbers, ``floor(64 * c) + 1000000``, and each
different vector of them counts once in the fit list. Its rows, centred, are
a tall matrix A whose right singular vectors are the components: no
covariance is decomposed, whose small eigenvalues would drown in rounding.

*CholeskyQR.* The Gram matrix of A is summed over all rows, a part per task.
Its Cholesky factor R1, with a small shift that keeps it positive definite,
gives Q1 = A / R1, nearly orthogonal. Rows of Q1 come by triangular solves
from those of A within the tasks; their Gram matrix gives R2, and so on, until
the Gram matrix of Q is the identity to rounding. A shift is added only while
it is needed. Then A = Q R with R = Rk ... R1, a matrix of dimensions only,
and the singular values and right singular vectors of R are those of A. What
the last Gram matrix differs from the identity goes into R by its square root,
so dimensions that depend on others only leave R a lower rank.

Every pass reads the written fit list; sums go through a grouped aggregate,
and the driver receives one row per entry of a matrix of dimensions.

Centring is exact up to one rounding: ``(n*x - S) / n`` with whole numbers n,
x and S.

Edge cases: a vector is left out if it is NULL or empty, holds a NULL or
non-finite entry or one beyond ``LARGEST``, or has another length than most
(of equally frequent lengths, the least counts); repeated rows each get their
own result; components without variance are left out, so a fit list of one
vector, or an empty table, gives no rows; of a component's two signs the one
is taken whose greatest weight (the first of equal ones) is positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farepath.llm.common import columns_of, record_batch, written

SCALE, OFFSET = 64, 1_000_000
#: Greatest magnitude of an entry.
LARGEST = 2.0 ** 40
#: Components, unless fewer have variance.
COMPONENTS = 16
#: Rows that a task multiplies at once.
ROWS = 8192
#: Most passes that orthogonalise.
PASSES = 8


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` (whole numbers) of the vectors that count, written
    to the scratch folder."""
    kind = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int64()))])

    def convert(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = columns_of(batch, "id", "v")
            some = pc.greater(pc.fill_null(pc.list_value_length(vectors), 0), 0)
            ids, vectors = ids.filter(some), vectors.filter(some)
            entries = vectors.flatten().cast(pa.float64())
            values = pc.fill_null(entries, np.nan).to_numpy()
            ends = np.append(0, np.cumsum(pc.list_value_length(vectors).to_numpy()))
            with np.errstate(invalid="ignore"):
                fails = np.append(0, np.cumsum(~(np.abs(values) <= LARGEST)))
            good = fails[ends[1:]] == fails[ends[:-1]]
            inside = np.repeat(good, np.diff(ends))
            x = np.floor(values[inside] * SCALE).astype(np.int64) + OFFSET
            yield record_batch(kind, [ids.filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.diff(ends)[good])), pa.int32()), pa.array(x))])

    vectors = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return written(vectors.mapInArrow(convert, "vec_id long, x array<long>"), "whole-vectors")


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _summed(fit: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum over all rows of what ``part`` gives for a block of them, as a flat
    array: a partial sum per task, then a grouped aggregate by place."""
    of = {"double": (pa.float64(), np.float64), "long": (pa.int64(), np.int64)}[kind]
    schema = pa.schema([("place", pa.int32()), ("value", of[0])])

    def add(batches) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(columns_of(batch, "x")[0], dims)
            for lo in range(0, len(x), ROWS):
                found = part(x[lo:lo + ROWS]).reshape(-1)
                total = found if total is None else total + found
        if total is not None:
            yield record_batch(schema, [np.arange(len(total), dtype=np.int32), total.astype(of[1])])

    sums = fit.select("x").mapInArrow(add, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value"))
    found = sums.collect()  # an entry of a matrix of dimensions each
    out = np.zeros(len(found), dtype=of[1])
    for row in found:
        out[row["place"]] = row["value"]
    return out


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` divided by each upper triangular factor from the right, by
    forward substitution over the columns."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(rows.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


@dataclass
class Whitening:
    """What is learnt: row counts and sums of the fit list, and components."""

    n: int
    sums: np.ndarray
    #: One column each: unit eigenvectors, by falling eigenvalue.
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _exactly(self.n, self.sums, x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))


def _exactly(n: int, sums: np.ndarray, x: np.ndarray) -> np.ndarray:
    """n*x - S, in Python's whole numbers where 64 bits could overflow."""
    most = int(np.abs(x).max(initial=0))
    if n * most >= 2 ** 62:
        return x.astype(object) * n - sums.astype(object)
    return x * n - sums


def _factors(fit: DataFrame, n: int, dims: int, sums: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Upper triangular factors, first to last, and the Gram matrix that is
    left when the rows are divided by all of them."""
    factors: list[np.ndarray] = []
    unit = np.finfo(np.float64).eps / 2
    gram = None
    for _ in range(PASSES):
        def part(x: np.ndarray, known=tuple(factors)) -> np.ndarray:
            rows = _solved(_exactly(n, sums, x).astype(np.float64) / n, known)
            return rows.T @ rows

        gram = _summed(fit, dims, part).reshape(dims, dims)
        gram = (gram + gram.T) / 2
        off = np.abs(gram - np.eye(dims)).max()
        if factors and off <= 64 * dims * unit:
            break
        # The first step is shifted, later ones where the factor needs it.
        shift = 11 * (n * dims + dims * (dims + 1)) * unit * np.linalg.norm(gram, 2)
        rank = np.linalg.eigvalsh(gram)
        if factors and rank[0] <= shift:
            if len(factors) > 2:
                break  # dimensions depend on one another: the rest goes into the square root
        elif factors:
            shift = 0.0
        if not gram.any():
            break
        factors.append(np.linalg.cholesky(gram + shift * np.eye(dims)).T)
    return factors, gram


def learn(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors of :func:`whole_vectors` of one length;
    None if they have no variance."""
    fit = written(vectors.select("x").distinct(), "fit-list")
    first = fit.select(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    n, dims = first["n"], first["dims"]
    if not n:
        return None
    # Sums about the offset stay small; the offset is added in whole numbers.
    sums = _summed(fit, dims, lambda x: (x - OFFSET).sum(axis=0), "long") + n * OFFSET
    factors, gram = _factors(fit, n, dims, sums)
    values, vectors_of = np.linalg.eigh(gram)
    r = (vectors_of * np.sqrt(np.maximum(values, 0.0))) @ vectors_of.T
    for factor in reversed(factors):
        r = r @ factor
    _, singular, right = np.linalg.svd(r)
    eigenvalues = singular ** 2 / n
    total = float(eigenvalues.sum())
    # What rounding alone leaves of a dependent dimension isn't variance.
    real = int((singular > singular[0] * max(n, dims) ** 0.5 * dims * np.finfo(np.float64).eps).sum()) if total > 0 else 0
    k = min(components, real)
    if not k:
        return None
    weights = right[:k].T
    weights = weights * np.sign(weights[np.abs(weights).argmax(axis=0), np.arange(k)])
    model = Whitening(n, sums, weights, eigenvalues[:k], eigenvalues[:k] / total, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        rows = model.whitened(x)
        return np.append(rows.sum(axis=0), rows.T @ rows)

    found = _summed(fit, dims, moments)
    mean = found[:k] / n
    model.identity_error = float(np.abs(found[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def of_one_length(vectors: DataFrame) -> DataFrame:
    """The vectors of the most frequent length."""
    length = vectors.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return vectors.filter(F.size("x") == (length["length"] if length else 0))


_RESULT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
                     ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector that counts and component: ``vec_id``,
    ``component`` (from 1), ``n`` (length of the fit list), ``deviation`` (sum
    of (n*x-S)^2, exact; an error beyond 64 bits), ``whitened``,
    ``explained`` (share of the variance), ``identity_error``."""
    vectors = of_one_length(whole_vectors(rows, id_column, vector_column))
    model = learn(vectors, components)

    def project(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                continue
            ids, column = columns_of(batch, "vec_id", "x")
            x = _matrix(column, model.dims)
            k = len(model.eigenvalues)
            for lo in range(0, len(x), ROWS):
                some = x[lo:lo + ROWS]
                exact = _exactly(model.n, model.sums, some)
                if int(np.abs(exact).max(initial=0)) ** 2 * model.dims >= 2 ** 63:
                    exact = exact.astype(object)
                deviation = (exact * exact).sum(axis=1)
                each = len(some)
                yield record_batch(_RESULT, [
                    ids.slice(lo, each).take(pa.array(np.repeat(np.arange(each), k))), np.tile(np.arange(1, k + 1, dtype=np.int32), each), np.full(each * k, model.n),
                    pa.array(np.repeat(deviation, k).tolist(), pa.int64()), model.whitened(some).reshape(-1), np.tile(model.explained, each), np.full(each * k, model.identity_error)])

    return vectors.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
