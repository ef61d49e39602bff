"""Whitening of embeddings by contour integration.

The covariance is summed over all vectors in Spark; only this matrix, whose size is the dimension and not the data, reaches the driver.  Its
leading eigenpairs come from FEAST: the spectrum is cut into intervals, each interval is circled by a contour, and a quadrature of shifted solves
``(z I - V) Y = Q`` over the points z of the contour projects a block Q onto the eigenvectors inside.  Rayleigh-Ritz extracts the pairs from
the projected block, which is the next Q.  The solves of all intervals and points are independent rows of one Spark job.

Inertia decides how many pairs there are: the signs of the pivots of ``T - s I``, with T a tridiagonal matrix similar to V, count the eigenvalues
below a shift s.  The counts place the intervals, size their blocks, and at the end verify that no pair is missed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read
from tidemark.session import materialize

COMPONENTS = 8
# Fixed values of the contract: entries become integers.
SCALE, SHIFT = 1024, 100_000
# Integers saturate here, far beyond any embedding; up to it they are exact as doubles.
LARGEST = 1 << 53
# The matrix is held by the driver and every solving task: 134 MB at the limit.
MAX_DIMENSION = 4096
# Eigenvalues of an interval, points on a half circle, rounds of refinement.
PER_INTERVAL = 4
POINTS = 8
ROUNDS = 40
EPS = float(np.finfo(float).eps)


def fit_list(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the rows whose vector is complete, written.

    Null vectors and vectors with null or non-finite entries go.  So do vectors whose length is not the most frequent one (the larger of
    equally frequent ones), as they share no covariance with the others.
    """
    whole = f"{embedding} IS NOT NULL AND NOT exists({embedding}, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))"
    kept = vectors.filter(whole).select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    kept = materialize(kept)
    length = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length and length["d"] > MAX_DIMENSION:
        raise ValueError(f"vectors of {length['d']} entries; the limit is {MAX_DIMENSION}")
    return kept.filter(F.size("v") == (length["d"] if length else 0)).filter("size(v) > 0")


def _integers(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of the column ``v`` as integers, vectors by row."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    x = np.clip(np.floor(SCALE * flat) + SHIFT, -LARGEST, LARGEST).astype(np.int64)
    return x.reshape(batch.num_rows, -1)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                total = [sum(map(int, column)) if abs(column).max() > LARGEST // 1024 else int(column.sum()) for column in _integers(batch).T]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total]), pa.array([batch.num_rows] * len(total), pa.int64())],
                    ["i", "total", "n"],
                )

    rows = map_arrow(fit.select("v"), run, "i int, total string, n long").groupBy("i").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    ).orderBy("i").collect()
    return (rows[0]["n"] if rows else 0), [int(r["total"]) for r in rows]


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance with divisor n.  Every vector is centred before it is multiplied; a task sends its upper triangle once."""
    d, mean = len(total), _mean(n, total)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((d, d))
        for batch in batches:
            y = _centred(_integers(batch), mean)
            product += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([row[i:] for i, row in enumerate(product)])], ["i", "row"])

    parts = map_arrow(fit.select("v"), run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "value"))
    rows = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).groupBy("i").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda s: s["value"]).alias("row")
    )
    v = np.zeros((d, d))
    for r in rows.collect():
        v[r["i"], r["i"] :] = r["row"]
    return (np.triu(v) + np.triu(v, 1).T) / n


def _mean(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S / n as an integer and a rest, so that centring loses nothing."""
    whole = [t // n for t in total]
    return np.array(whole, dtype=np.int64), np.array([(t - w * n) / n for t, w in zip(total, whole)])


def _centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - mean[0]).astype(float) - mean[1]


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to ``v``, by Householder reflections."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        if scale == 0 or not np.any(x[1:]):
            continue
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        u = x / np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ u
        w = 2 * (p - (u @ p) * u)
        a[k + 1 :, k + 1 :] -= np.outer(u, w) + np.outer(w, u)
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy()


def below(t: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Number of eigenvalues below ``shift``: negative pivots of the factored ``T - shift I``."""
    diagonal, beside = t
    least = EPS * max(np.abs(diagonal).max(), np.abs(beside).max(initial=0.0), np.finfo(float).tiny / EPS)
    count, pivot = 0, 1.0
    for i, a in enumerate(diagonal):
        pivot = a - shift - (beside[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < least:
            pivot = -least
        count += pivot < 0
    return int(count)


def intervals(t: tuple[np.ndarray, np.ndarray], wanted: int, norm: float, per_interval: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """Disjoint ``low, high, count`` from the top down that hold the ``wanted`` largest eigenvalues, by bisection on inertia counts.

    An interval is halved until it holds at most ``per_interval`` eigenvalues or is too narrow for them to differ.  Every border lies
    apart from the eigenvalues next to it, as far as bisection can tell.
    """
    d = len(t[0])
    top, bottom = norm * 1.01 + np.finfo(float).tiny, -norm * 0.01 - np.finfo(float).tiny
    narrow = 64 * d * EPS * norm

    def border(low: float, high: float) -> float:
        """A point near the middle of the gap around the middle of (low, high)."""
        at = (low + high) / 2
        count = below(t, at)
        ends = []
        for side in (low, high):
            inner, outer = at, side
            if below(t, outer) == count:
                ends.append(outer)
                continue
            for _ in range(12):
                probe = (inner + outer) / 2
                inner, outer = (probe, outer) if below(t, probe) == count else (inner, probe)
            ends.append(inner)
        return (ends[0] + ends[1]) / 2

    found: list[tuple[float, float, int]] = []
    stack = [(bottom, top)]
    while stack and sum(c for *_, c in found) < wanted:
        low, high = stack.pop()
        count = below(t, high) - below(t, low)
        if count == 0:
            continue
        if count <= per_interval or high - low <= narrow:
            found.append((low, high, count))
            continue
        cut = border(low, high)
        stack += [(low, cut), (cut, high)]
    return found


def _project(v: np.ndarray, z: complex, weight: complex, q: np.ndarray) -> np.ndarray:
    """One point of the quadrature: the real part stands for the conjugate point as well."""
    return (weight * np.linalg.solve(z * np.eye(len(v)) - v, q.astype(complex))).real


def _ritz(v: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values and vectors of ``v`` in the space of ``y``."""
    q, _ = np.linalg.qr(y)
    values, small = np.linalg.eigh(q.T @ v @ q)
    return values, q @ small


def feast(spark: SparkSession, v: np.ndarray, wanted: int, points: int = POINTS, rounds: int = ROUNDS, per_interval: int = PER_INTERVAL) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of the symmetric ``v``, falling, and their orthonormal eigenvectors as columns.

    Raises if a pair does not converge or if the number of pairs differs from the inertia count of its interval.
    """
    d, norm = len(v), float(np.abs(v).sum(axis=1).max())
    wanted = min(wanted, d)
    if norm == 0:
        return np.zeros(wanted), np.eye(d)[:, :wanted]
    t = tridiagonal(v)
    areas = intervals(t, wanted, norm, per_interval)
    nodes, weights = np.polynomial.legendre.leggauss(points)
    rng = np.random.default_rng(1)
    # Half as many columns again as pairs, and some more, so that near neighbours of the interval do not slow it down.
    blocks = [rng.standard_normal((d, min(d, 2 * count + 4))) for *_, count in areas]
    shared = spark.sparkContext.broadcast(v)
    goal, done = 16 * np.sqrt(d) * EPS * norm, [None] * len(areas)
    best = [np.inf] * len(areas)
    for _ in range(rounds):
        tasks = []
        for i, (low, high, _) in enumerate(areas):
            if done[i] is None:
                radius, centre = (high - low) / 2, (high + low) / 2
                for node, weight in zip(nodes, weights):
                    turn = np.exp(1j * np.pi * (1 + node) / 2)
                    tasks.append((i, pickle.dumps((centre + radius * turn, weight * radius * turn / 2, blocks[i]))))
        for i, y in _solved(spark, shared, tasks).items():
            low, high, count = areas[i]
            values, vectors = _ritz(v, y)
            inside = (values > low) & (values < high)
            errors = np.linalg.norm(v @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            worst = errors.max(initial=0.0) if inside.sum() == count else np.inf
            # Rounding sets the last digits: a block that no longer improves is as good as it gets.
            if worst <= goal or (worst <= 1e4 * goal and worst >= best[i] / 2):
                done[i] = (values[inside], vectors[:, inside])
            best[i], blocks[i] = min(best[i], worst), vectors
        if all(x is not None for x in done):
            break
    else:
        raise ArithmeticError(f"contours did not converge in {rounds} rounds")
    shared.destroy()
    # Intervals are independent; one more extraction makes all vectors orthogonal to each other.
    values, vectors = _ritz(v, np.hstack([x[1] for x in done]))
    values, vectors = values[::-1], vectors[:, ::-1]
    if len(values) != len(t[0]) - below(t, min(low for low, *_ in areas)):
        raise ArithmeticError("the pairs found differ from the inertia count")
    return values[:wanted], vectors[:, :wanted]


def _solved(spark: SparkSession, shared, tasks: list[tuple[int, bytes]]) -> dict[int, np.ndarray]:
    """Projected blocks by interval: every task solves for one point, the points of an interval are added up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, task in zip(*(batch.column(c).to_pylist() for c in ("i", "task"))):
                y = _project(shared.value, *pickle.loads(task))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([y.tobytes()]), pa.array([y.shape[1]], pa.int32())], ["i", "y", "m"])

    parts = min(len(tasks), max(1, spark.sparkContext.defaultParallelism))
    frame = spark.createDataFrame(tasks, "i int, task binary").repartition(parts)
    found: dict[int, np.ndarray] = {}
    for r in map_arrow(frame, run, "i int, y binary, m int").collect():
        y = np.frombuffer(r["y"]).reshape(-1, r["m"])
        found[r["i"]] = found[r["i"]] + y if r["i"] in found else y
    return found


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n, deviation, deviation_exact, w, values, explained, identity_error``: a row for each vector of the fit list, see :func:`fit_list`.

    ``w`` holds the whitened coordinates, null for components without variance (their eigenvalue is zero up to rounding); these don't enter
    ``identity_error``.  There are as many components as dimensions if that is less.  ``deviation`` is null where it exceeds a long and
    ``deviation_exact`` where it exceeds 38 digits.  Rows with equal or missing ids are rows like any other; no vectors give no rows.
    """
    spark = vectors.sparkSession
    fit = fit_list(vectors, vec_id, embedding)
    n, total = sums(fit)
    # Without vectors there is nothing to fit, and no row to project either.
    v = covariance(fit, n, total) if n else np.zeros((1, 1))
    values, basis = feast(spark, v, components)
    trace, d = float(np.trace(v)), len(v)
    real = values > 16 * d * EPS * trace
    scaled = basis / np.sqrt(np.where(real, values, 1.0))
    mean, sums_ = _mean(max(n, 1), total or [0]), [int(t) for t in total]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch)
            w = _centred(x, mean) @ scaled
            rows = [[float(c) if ok else None for c, ok in zip(row, real)] for row in w]
            exact = [str(e) for e in _deviations(x, n, sums_)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(exact), pa.array(rows, pa.list_(pa.float64()))], ["vec_id", "exact", "w"])

    kind = fit.schema["vec_id"].dataType.simpleString()
    placed = materialize(map_arrow(fit, run, f"vec_id {kind}, exact string, w array<double>"))
    pairs = [(i, j) for i in range(len(values)) for j in range(i + 1) if real[i] and real[j]]
    errors = [F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - (1.0 if i == j else 0.0)).alias(f"e{i}_{j}") for i, j in pairs]
    error = max((e for e in placed.agg(*errors).first() if e is not None), default=None) if errors else None
    number = lambda x: F.lit(None if x is None else float(x)).cast("double")
    return placed.select(
        "vec_id",
        F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(exact AS BIGINT)").alias("deviation"),
        F.expr("try_cast(exact AS DECIMAL(38,0))").alias("deviation_exact"),
        "w",
        F.array(*[number(e) for e in values]).alias("values"),
        F.array(*[number(e / trace if trace else None) for e in values]).alias("explained"),
        number(error).alias("identity_error"),
    )


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Exact sums of (n x - S)^2 by row; long arithmetic where it holds them, Python's integers elsewhere."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 61:
        apart = n * x - np.array(total, dtype=np.int64)
        if apart.size and int(np.abs(apart).max()) ** 2 * x.shape[1] < 1 << 62:
            return (apart * apart).sum(axis=1).tolist()
    return [sum((n * int(c) - t) ** 2 for c, t in zip(row, total)) for row in x]


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; see :func:`whiten` for nulls, ties and repeated rows."""
    every = whiten(read(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip(F.col("w"), F.col("explained"))).alias("at", "z")
    return every.select("vec_id", "n", "deviation", "deviation_exact", "identity_error", each).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("z.w").alias("whitened"),
        F.col("z.explained").alias("explained"),
        "identity_error",
        "deviation_exact",
    )
