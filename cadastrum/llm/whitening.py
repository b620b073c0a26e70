"""Whitening of embeddings on exact integers.

Entries become integers, ``floor(64 * entry) + 1000000``. The scatter of the distinct vectors,
``n * sum(x x') - S S'``, is a matrix of exact integers. Its characteristic polynomial comes
from one Hessenberg reduction for each of many 31-bit primes, put together by Chinese
remaindering up to a proven bound of the coefficients. All its roots are real, so the sign
variations of the polynomial moved to a point count the roots above the point exactly;
halving isolates the largest roots. Each root is then refined and its null space found by
inverse iteration in fixed-point integers, with more digits the closer its neighbours lie.

Spark sums the scatter in partials of exact limbs, reduces the primes and solves the components
in parallel. The driver sees numbers that depend on the dimension alone: the scatter, a
polynomial per prime, a vector per component.

Rows whose vector is null or holds a null, NaN or infinite entry are left out, and so are vectors
of another length than most have (of equally frequent lengths the greater one counts). Repeated
vectors count once in every sum, each row has its own result. 64 times an entry is held within
2^62. Eigenvalues of zero have no component, so a table of fewer than two distinct vectors has no
result rows. Null ids stay null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import comb, isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructField, StructType

from cadastrum.session import materialise

SCALE, OFFSET, MOST = 64.0, 1_000_000, 16
_LIMB = 30
_FAST_ENTRY, _FAST_ROWS = 1 << 20, 1 << 12  # products of such rows sum to less than 2^53
_LARGEST_DECIMAL = 10**38
_CLUSTER_BITS = 256  # roots closer than this part of the largest count as one multiple root
_FINEST = 1024


# --- exact sums ---------------------------------------------------------------------------------


def integer_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, y): the integers less ``OFFSET``, which no covariance sees."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-(2.0**62))), F.lit(2.0**62))))
    return df.where(F.col(vector).isNotNull() & usable).select(F.col(key).alias("key"), whole.cast("array<long>").alias("y"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _products(rows: np.ndarray) -> np.ndarray:
    """Exact sum of the rows' outer products, as Python integers where 64 bits could overflow."""
    if not len(rows) or max(-int(rows.min()), int(rows.max())) >= _FAST_ENTRY:
        exact = rows.astype(object)
        return exact.T @ exact if len(rows) else np.zeros((rows.shape[1],) * 2, dtype=object)
    total = np.zeros((rows.shape[1],) * 2, dtype=object)
    for at in range(0, len(rows), _FAST_ROWS):
        part = rows[at : at + _FAST_ROWS].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _limbs(value: int) -> list[int]:
    sign, rest, found = (-1 if value < 0 else 1), abs(value), []
    while rest:
        found.append(sign * (rest & ((1 << _LIMB) - 1)))
        rest >>= _LIMB
    return found


@dataclass(frozen=True)
class Scatter:
    n: int
    sums: list[int]  # of y
    matrix: list[list[int]]  # n * sum(y y') - sums sums', which is n^2 times the covariance


def scatter(fit: DataFrame, width: int) -> Scatter:
    """Exact sums over the column ``y``; partial sums combine limb by limb."""
    upper = np.triu_indices(width)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, n = np.zeros((width, width), dtype=object), np.zeros(width, dtype=object), 0
        for batch in batches:
            rows = _matrix(batch.column("y"), width)
            products, sums, n = products + _products(rows), sums + rows.astype(object).sum(axis=0), n + len(rows)
        if n:
            found = [(i, k, part) for i, v in enumerate([n, *sums, *products[upper]]) for k, part in enumerate(_limbs(int(v)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*found)], names=["cell", "limb", "part"])

    rows = fit.select("y").mapInArrow(partials, "cell long, limb long, part long").groupBy("cell", "limb").agg(F.sum("part")).collect()
    values = [0] * (1 + width + len(upper[0]))
    for cell, limb, part in rows:
        values[cell] += part << (_LIMB * limb)
    n, sums = values[0], values[1 : width + 1]
    matrix = [[0] * width for _ in range(width)]
    for i, j, value in zip(*upper, values[width + 1 :], strict=True):
        matrix[i][j] = matrix[j][i] = n * value - sums[i] * sums[j]
    return Scatter(n, sums, matrix)


# --- characteristic polynomial ------------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all 32-bit numbers."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def enough_primes(matrix: list[list[int]]) -> list[int]:
    """Primes below 2^31 whose product exceeds twice every coefficient.

    The matrix has no negative eigenvalue, so a symmetric function of degree k of its eigenvalues
    is at most C(d, k) * (trace / k)^k with d for k among d of them (Maclaurin).
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    found, product, candidate = [], 1, (1 << 31) - 1
    while product <= 2 * bound + 1:
        if _is_prime(candidate):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def _inverses(values: np.ndarray, primes: np.ndarray) -> np.ndarray:
    return np.array([pow(int(v), -1, int(p)) if v else 0 for v, p in zip(values, primes, strict=True)], dtype=np.int64)


def modular_polynomials(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients, from the constant up, of the characteristic polynomial modulo each prime.

    Elimination brings the matrix to Hessenberg form by similarity, all primes at once; the polynomial
    of its leading blocks follows by recurrence. Products of two remainders stay below 2^62.
    """
    p = np.array(primes, dtype=np.int64)
    p2, p3 = p[:, None], p[:, None, None]
    d, count, each = len(matrix), len(primes), np.arange(len(primes))
    a = np.array([[[v % q for v in row] for row in matrix] for q in primes], dtype=np.int64)
    for j in range(d - 2):
        pivot = j + 1 + np.argmax(a[:, j + 1 :, j] != 0, axis=1)
        row = a[each, j + 1].copy()
        a[each, j + 1] = a[each, pivot]
        a[each, pivot] = row
        column = a[each, :, j + 1].copy()
        a[each, :, j + 1] = a[each, :, pivot]
        a[each, :, pivot] = column
        factors = a[:, j + 2 :, j] * _inverses(a[:, j + 1, j], p)[:, None] % p2
        a[:, j + 2 :, j:] = (a[:, j + 2 :, j:] - factors[:, :, None] * a[:, j + 1, None, j:] % p3) % p3
        a[:, :, j + 1] = (a[:, :, j + 1] + (a[:, :, j + 2 :] * factors[:, None, :] % p3).sum(axis=2)) % p2
    polynomials = np.zeros((d + 1, count, d + 1), dtype=np.int64)
    polynomials[0, :, 0] = 1
    for k in range(1, d + 1):
        now = np.zeros((count, d + 1), dtype=np.int64)
        now[:, 1:] = polynomials[k - 1, :, :-1]
        now = (now - polynomials[k - 1] * a[:, k - 1, k - 1, None] % p2) % p2
        below = np.ones(count, dtype=np.int64)
        for i in range(k - 1, 0, -1):
            below = below * a[:, i, i - 1] % p
            now = (now - polynomials[i - 1] * (a[:, i - 1, k - 1] * below % p)[:, None] % p2) % p2
        polynomials[k] = now
    return polynomials[d]


def characteristic_polynomial(fit: DataFrame, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, from the constant up. The primes are dealt to tasks."""
    primes, d = enough_primes(matrix), len(matrix)
    together = max(1, min(16, (1 << 22) // (d * d)))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("id").to_pylist()
            for at in range(0, len(numbers), together):
                part = numbers[at : at + together]
                rows = modular_polynomials(matrix, [primes[i] for i in part])
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(rows.tolist(), type=pa.list_(pa.int64()))], names=["id", "rest"])

    parts = max(1, min(32, len(primes) // together))
    rows = dict(fit.sparkSession.range(0, len(primes), 1, parts).mapInArrow(reduced, "id long, rest array<long>").collect())
    values, modulus = [0] * (d + 1), 1
    for i, prime in enumerate(primes):
        step = pow(modulus % prime, -1, prime)
        values = [v + modulus * ((r - v) * step % prime) for v, r in zip(values, rows[i], strict=True)]
        modulus *= prime
    return [v - modulus if 2 * v > modulus else v for v in values]


# --- roots --------------------------------------------------------------------------------------


def roots_above(polynomial: list[int], at: int, shift: int) -> int:
    """Number of roots above ``at / 2^shift``, with multiplicity; exact because all roots are real (Descartes)."""
    d = len(polynomial) - 1
    moved = [c << (shift * (d - k)) for k, c in enumerate(polynomial)]
    for first in range(d):
        for k in range(d - 1, first - 1, -1):
            moved[k] += at * moved[k + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


@dataclass(frozen=True)
class Root:
    """``count`` roots in (low, high] / 2^shift, ``above`` greater ones; ``bits`` halvings set them apart."""

    low: int
    high: int
    shift: int
    count: int
    above: int
    bits: int


def largest_roots(polynomial: list[int], most: int) -> list[Root]:
    """Intervals of the largest positive roots, in falling order, each with one root or a cluster that counts as one."""
    zero = next(k for k, c in enumerate(polynomial) if c)
    polynomial = polynomial[zero:]
    if len(polynomial) == 1:
        return []
    top = 1 << max(1, (-polynomial[-2]).bit_length())  # the sum of all roots is less
    work, found = [(0, top, 0, roots_above(polynomial, 0, 0), 0, 0)], []
    while work and sum(root.count for root in found) < most:
        low, high, shift, below, above, bits = work.pop()
        if below - above == 1 or bits >= _CLUSTER_BITS:
            found.append(Root(low, high, shift, below - above, above, bits))
            continue
        if high - low == 1:
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        upper = roots_above(polynomial, middle, shift)
        if below > upper:
            work.append((low, middle, shift, below, upper, bits + 1))
        if upper > above:
            work.append((middle, high, shift, upper, above, bits + 1))
    return found


def refined(polynomial: list[int], root: Root) -> tuple[int, int]:
    """(at, shift): the root, so close that no other lies within 2^100 times the error (unless beyond ``_FINEST`` halvings)."""
    zero = next(k for k, c in enumerate(polynomial) if c)
    polynomial = polynomial[zero:]
    d, low, high, shift, bits = len(polynomial) - 1, root.low, root.high, root.shift, root.bits
    wanted = 192
    while True:
        while bits < wanted and root.count == 1 and high > low:
            bits += 1
            if high - low == 1:
                low, high, shift = 2 * low, 2 * high, shift + 1
            middle, value = (low + high) // 2, 0
            for k in range(d, -1, -1):
                value = value * middle + (polynomial[k] << (shift * (d - k)))
            if value == 0:
                low = high = middle
            # The sign tells whether the number of roots above is odd.
            elif (value < 0) == bool(root.above % 2):
                high = middle
            else:
                low = middle
        at, wide = low + high, max(1, high - low) << 101
        around = roots_above(polynomial, at - wide, shift + 1) - roots_above(polynomial, at + wide, shift + 1)
        if around <= root.count or root.count > 1 or wanted >= _FINEST:
            return at, shift + 1
        wanted *= 2


# --- components ---------------------------------------------------------------------------------


def null_space(matrix: list[list[int]], at: int, shift: int, count: int) -> list[list[float]]:
    """``count`` orthonormal eigenvectors of the eigenvalue ``at / 2^shift``, in double precision.

    Inverse iteration in fixed point: elimination with full pivoting, whose last ``count`` pivots vanish
    and are replaced by a tiny one; the first step starts from the tails, the second from its result.
    """
    d = len(matrix)
    size = max(max(abs(v) for v in row) for row in matrix).bit_length() + shift
    point = 2 * size + 128  # bits after the point; one is about the matrix's norm
    a = np.array([[((v << shift) - (at if i == j else 0)) << (point - size) for j, v in enumerate(row)] for i, row in enumerate(matrix)], dtype=object)
    rows, columns = list(range(d)), list(range(d))
    for k in range(d - count):
        i, j = divmod(int(np.argmax(np.abs(a[k:, k:]))), d - k)
        rows[k], rows[k + i] = rows[k + i], rows[k]
        a[[k, k + i]] = a[[k + i, k]]
        columns[k], columns[k + j] = columns[k + j], columns[k]
        a[:, [k, k + j]] = a[:, [k + j, k]]
        a[k + 1 :, k] = (a[k + 1 :, k] << point) // a[k, k]
        a[k + 1 :, k + 1 :] -= (a[k + 1 :, k : k + 1] * a[k : k + 1, k + 1 :]) >> point
    tiny, one, head = 1 << (point - size), 1 << point, d - count

    def solved(right: np.ndarray, forward: bool) -> np.ndarray:
        """Solves for the pivots' order; the tail's block counts as ``tiny`` times one."""
        x = right.copy()
        for k in range(head if forward else 0):
            x[k + 1 :] -= (a[k + 1 :, k] * x[k]) >> point
        x[head:] = [(int(v) << point) // tiny for v in x[head:]]
        for k in range(head - 1, -1, -1):
            x[k] = ((int(x[k]) << point) - int((a[k, k + 1 :] * x[k + 1 :]).sum())) // int(a[k, k])
        longest = max(abs(int(v)) for v in x)
        return np.array([(int(v) << point) // longest for v in x], dtype=object)

    unit: list[np.ndarray] = []
    for number in range(count):
        start = np.zeros(d, dtype=object)
        start[head + number] = tiny
        vector = np.zeros(d, dtype=object)
        vector[columns] = solved(start, forward=False)
        again = np.zeros(d, dtype=object)
        again[columns] = solved(vector[rows], forward=True)
        if count == 1:
            vector = again
        for _ in range(2):
            for other in unit:
                vector = vector - other * int((vector * other).sum()) // int((other * other).sum())
        unit.append(vector * one // max(1, max(abs(int(v)) for v in vector)))
    found = []
    for vector in unit:
        length = isqrt(int((vector * vector).sum()))
        sign = 1 if int(vector[int(np.argmax(np.abs(vector)))]) > 0 else -1
        found.append([sign * int(v) / length for v in vector])
    return found


@dataclass(frozen=True)
class Components:
    vectors: np.ndarray  # one per column
    values: np.ndarray  # of the covariance, falling
    explained: np.ndarray


def components(fit: DataFrame, found: Scatter, most: int = MOST) -> Components:
    """Eigenvectors of the covariance for its largest eigenvalues; each root is a task of its own."""
    matrix, width = found.matrix, len(found.sums)
    polynomial = characteristic_polynomial(fit, matrix)
    roots = largest_roots(polynomial, most)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                at, shift = refined(polynomial, roots[i])
                vectors = null_space(matrix, at, shift, roots[i].count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([str(at)]), pa.array([shift]), pa.array([vectors], type=pa.list_(pa.list_(pa.float64())))],
                    names=["id", "at", "shift", "vectors"],
                )

    rows = []
    if roots:
        solving = fit.sparkSession.range(0, len(roots), 1, len(roots))
        rows = sorted(solving.mapInArrow(solved, "id long, at string, shift long, vectors array<array<double>>").collect())
    trace = sum(matrix[i][i] for i in range(width))
    listed = [(vector, int(at), 1 << shift) for _, at, shift, vectors in rows for vector in vectors][:most]
    return Components(
        np.array([vector for vector, _, _ in listed]).reshape(-1, width).T,
        np.array([at / (one * found.n**2) for _, at, one in listed]),
        np.array([at / (one * trace) for _, at, one in listed]),
    )


# --- whitening ----------------------------------------------------------------------------------


def _centred(rows: np.ndarray, found: Scatter) -> np.ndarray:
    largest = max(-int(rows.min()), int(rows.max())) if rows.size else 0
    if largest * found.n + max(map(abs, found.sums)) < 1 << 62:
        return (rows * found.n - np.array(found.sums, dtype=np.int64)) / found.n
    return rows - np.array([s / found.n for s in found.sums])


def _deviations(rows: np.ndarray, found: Scatter) -> list[int]:
    """Sums of (n * x - S)^2, exact: n^2 y.y - 2 n y.S + S.S."""
    largest = max(-int(rows.min()), int(rows.max())) if rows.size else 0
    most = max(largest, *map(abs, found.sums), 1)
    exact = rows if largest * most * rows.shape[1] < 1 << 62 else rows.astype(object)
    sums = np.array(found.sums, dtype=exact.dtype)
    of_sums = sum(s * s for s in found.sums)
    return [
        found.n * found.n * int(a) - 2 * found.n * int(b) + of_sums
        for a, b in zip((exact * exact).sum(axis=1), (exact * sums).sum(axis=1), strict=True)
    ]


def _identity_error(fit: DataFrame, found: Scatter, whitener: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    width, k = whitener.shape

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            rows = _centred(_matrix(batch.column("y"), width), found) @ whitener
            total += np.vstack([rows.T @ rows, rows.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "part"])

    rows = dict(fit.mapInArrow(partials, "cell long, part double").groupBy("cell").agg(F.sum("part")).collect())
    total = np.array([rows[i] for i in range((k + 1) * k)]).reshape(k + 1, k) / found.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """A row per usable row and component: (key, component, n, deviation, whitened, explained, identity_error).

    ``deviation`` is a decimal, null beyond 38 digits.
    """
    rows = materialise(integer_rows(df, key, vector), "vectors")
    schema = StructType([
        rows.schema["key"], StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType())),
    ])
    lengths = rows.groupBy(F.size("y").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = lengths["width"] if lengths else 0
    rows = rows.where(F.size("y") == width)
    part = Components(np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    if width:
        fit = materialise(rows.select("y").distinct(), "fit-list")
        found = scatter(fit, width)
        part = components(fit, found, most)
    if not len(part.values):
        rows, found, identity = rows.limit(0), Scatter(0, [0] * width, []), 0.0
    else:
        whitener = part.vectors / np.sqrt(part.values)
        identity = _identity_error(fit, found, whitener)
    kept = Scatter(found.n, found.sums, [])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column("y"), width)
            whitened = _centred(own, kept) @ whitener
            deviations = [Decimal(v) if v < _LARGEST_DECIMAL else None for v in _deviations(own, kept)]
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array(deviations, type=pa.decimal128(38, 0)),
                pa.array(list(whitened), type=pa.list_(pa.float64())),
            ], names=["key", "deviation", "whitened"])

    placed = rows.mapInArrow(projected, schema) if len(part.values) else rows.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(v)) for v in part.explained]).cast("array<double>")
    return placed.select("key", "deviation", F.posexplode("whitened").alias("number", "whitened")).select(
        F.col("key").alias(key), (F.col("number") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("number")).alias("explained"), F.lit(identity).alias("identity_error"),
    )
