"""Whitening of embeddings by shifted Cholesky QR.

The centred vectors are the rows of a tall matrix A. Its Gram matrix, added up over the
partitions, has a Cholesky factor R that would orthogonalise A in exact arithmetic; A R^-1 is
only nearly orthogonal, so its Gram matrix is formed in a further pass over the data, and so on.
The first factor is taken of a slightly shifted matrix, which exists for any A. The factors are
composed to one R with A = QR, and the singular values and right vectors of this small matrix
are those of A: without ever squaring A's condition.

Nothing is shuffled but one d x d matrix per task and pass; every pass reads the vectors anew.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import column, map_arrow

SCALE, OFFSET = 1024, 100_000
#: Passes of orthogonalisation at most, and the departure from orthogonality that ends them.
ROUNDS, CLOSE = 6, 1e-12
#: A component whose singular value is below this share of the largest is rounding noise.
NOISE = 1e-10
#: Vectors handled at once in a task, columns solved for at once.
ROWS, COLUMNS = 4096, 32
#: Scaled components beyond this size are cut to it.
LARGEST = 2.0 ** 62
UNIT = np.finfo(float).eps / 2


def _valid(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components of a batch (NaN for nulls), the length of each vector, and which vectors
    take part."""
    held = column(batch, "embedding")
    flat = held.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.nan_to_num(held.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    ends = np.cumsum(lengths)
    return values, lengths, (lengths > 0) & (bad[ends] == bad[ends - lengths])


def _pieces(batches, width: int):
    """Whole-number vectors of the given length, with the rows they came from."""
    for batch in batches:
        values, lengths, good = _valid(batch)
        chosen = np.flatnonzero(good & (lengths == width))
        first = np.cumsum(lengths) - lengths
        for at in range(0, len(chosen), ROWS):
            rows = chosen[at:at + ROWS]
            c = values[first[rows][:, None] + np.arange(width)]
            x = np.clip(np.floor(c * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET
            yield x, batch, rows


def prepare(vectors: DataFrame) -> DataFrame:
    return vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"),
                          vectors["embedding"].cast("array<double>").alias("embedding"))


def common_width(vectors: DataFrame) -> int:
    """The commonest length of the vectors that take part (ties: the longest); 0 without any."""
    def count(batches):
        for batch in batches:
            _, lengths, good = _valid(batch)
            widths, n = np.unique(lengths[good], return_counts=True)
            yield pa.RecordBatch.from_pydict({"width": widths, "n": n})

    found = map_arrow(vectors, count, "width bigint, n bigint").groupBy("width").agg(
        F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return found.width if found else 0


def sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many vectors there are and the sum of each component, exactly."""
    def add(batches):
        total, rows = [0] * width, 0
        for x, _, _ in _pieces(batches, width):
            rows += len(x)
            # Two halves, so that no sum of a piece leaves 64 bits.
            high, low = (x >> 20).sum(0).tolist(), (x & 0xFFFFF).sum(0).tolist()
            total = [t + (h << 20) + w for t, h, w in zip(total, high, low)]
        if rows:
            yield pa.RecordBatch.from_pydict({
                "place": pa.array(range(width), pa.int32()),
                "n": pa.array([rows] * width, pa.int64()),
                "total": pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))})

    found = map_arrow(vectors, add, "place int, n bigint, total decimal(38,0)").groupBy(
        "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    by_place = {r.place: r for r in found}
    return by_place[0].n, [int(by_place[i].total) for i in range(width)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n, with the subtraction done in whole numbers where they fit."""
    whole = [t // n for t in total]
    part = np.array([(t - w * n) / n for t, w in zip(total, whole)])
    return (x - np.array(whole, np.int64)) - part


def solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a R^-1 for an upper triangular R: forward substitution, for all rows at once."""
    q = np.empty_like(a)
    for begin in range(0, len(r), COLUMNS):
        end = min(begin + COLUMNS, len(r))
        rest = a[:, begin:end] - q[:, :begin] @ r[:begin, begin:end]
        for j in range(begin, end):
            q[:, j] = (rest[:, j - begin] - q[:, begin:j] @ r[begin:j, j]) / r[j, j]
    return q


def gram(vectors: DataFrame, width: int, rows_of, out: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the outer products of all rows with themselves, and of the rows.

    ``rows_of`` turns an array of vectors into rows of length ``out``. The tasks' partial sums
    are added in Spark; only the result, out + 1 times out numbers, comes to the driver.
    """
    def multiply(batches):
        total, seen = np.zeros((out + 1, out)), False
        for x, _, _ in _pieces(batches, width):
            a = rows_of(x)
            total[:out] += a.T @ a
            total[out] += a.sum(0)
            seen = True
        if seen:
            yield pa.RecordBatch.from_pydict(
                {"cell": pa.array(range(total.size), pa.int32()), "value": total.ravel()})

    cells = map_arrow(vectors, multiply, "cell int, value double").groupBy("cell").agg(
        F.sum("value").alias("value")).toPandas()
    whole = np.zeros((out + 1) * out)
    whole[cells.cell] = cells.value
    whole = whole.reshape(out + 1, out)
    return (whole[:out] + whole[:out].T) / 2, whole[out]


def factors(vectors: DataFrame, n: int, total: list[int]) -> tuple[np.ndarray, ...]:
    """The composed triangular factor R of the centred vectors A, the Gram matrix of A R^-1
    as last measured (the identity, up to rounding and directions in which A has no extent),
    and the sum of A's rows (what rounding leaves of it)."""
    width = len(total)
    first, rest = gram(vectors, width, lambda x: centred(x, n, total), width)
    size = float(np.trace(first))
    if size == 0:
        return np.zeros((width, width)), np.eye(width), rest
    shift = min(11 * width * (n + width + 1) * UNIT, 1e-8) * size
    r = np.linalg.cholesky(first + shift * np.eye(width)).T
    last = np.inf
    for done in range(1, ROUNDS + 1):
        now = r
        g, _ = gram(vectors, width, lambda x: solve(centred(x, n, total), now), width)
        extent = np.linalg.eigvalsh(g)
        away = np.abs(extent[extent > 1e-6] - 1).max(initial=0)
        # Small directions get two passes to grow to length one; what stays small has no extent.
        settled = extent[0] > 1e-6 or done > 2
        if done == ROUNDS or settled and (away <= CLOSE or away > last / 2):
            break
        last = away
        floor = 16 * width * UNIT
        r = np.linalg.cholesky(g + max(0.0, floor - extent[0]) * np.eye(width)).T @ r
    return r, g, rest


def principal(vectors: DataFrame, n: int, total: list[int], most: int) -> tuple[np.ndarray, ...]:
    """Unit eigenvectors (columns) of the covariance with the largest eigenvalues, these
    eigenvalues, the sum of all, and the mean of the centred vectors (rounding only)."""
    r, g, rest = factors(vectors, n, total)
    extent, turned = np.linalg.eigh(g)
    corrected = np.sqrt(np.maximum(extent, 0))[:, None] * (turned.T @ r)
    _, singular, right = np.linalg.svd(corrected)
    kept = min(most, int((singular > NOISE * singular[0]).sum()))
    directions = right[:kept].T
    # The same sign on every run: the largest entry is positive.
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(kept)])
    values = singular ** 2 / n
    return directions, values[:kept], float(values.sum()), rest / n


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each
    vector that takes part and each of the first ``components`` components.

    ``vectors`` has vec_id and embedding. A vector that is null, empty, or holds a null or
    non-finite component takes no part; components beyond 2^52 count as that. ``deviation`` is null where it does not fit a bigint.
    Vectors must have one length: others than the commonest (ties: the longest) take no part
    either. There are fewer components where the vectors span fewer dimensions: components of
    no variance cannot be scaled; so one vector, or copies of one, give an empty table, as does
    an empty one. Repeated rows and ids count each for itself, also in the fit; null ids are
    kept. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    schema = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
              "explained double, identity_error double")
    own = prepare(vectors)
    width = common_width(own)
    if not width:
        return spark.createDataFrame([], schema)
    n, total = sums(own, width)
    directions, values, trace, middle = principal(own, n, total, components)
    kept = len(values)
    if not kept:
        return spark.createDataFrame([], schema)
    scaled = directions / np.sqrt(values)
    off = middle @ scaled
    covariance, _ = gram(own, width, lambda x: centred(x, n, total) @ scaled - off, kept)
    error = float(np.abs(covariance / n - np.eye(kept)).max())
    shares = values / trace

    def project(batches):
        for x, batch, rows in _pieces(batches, width):
            white = centred(x, n, total) @ scaled
            many = len(rows) * kept
            away = pa.array(deviations(x, n, total), pa.int64())
            yield pa.RecordBatch.from_arrays([
                column(batch, "vec_id").take(pa.array(np.repeat(rows, kept))),
                pa.array(np.tile(np.arange(1, kept + 1), len(rows)), pa.int32()),
                pa.array(np.full(many, n)),
                away.take(pa.array(np.repeat(np.arange(len(rows)), kept))),
                pa.array(white.ravel()),
                pa.array(np.tile(shares, len(rows))),
                pa.array(np.full(many, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(own, project, schema)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum over the components of (n x - S)^2 for each vector, exactly; None beyond 64 bits."""
    whole = np.array([t // n for t in total], np.int64)
    rest = [t % n for t in total]
    near = x - whole
    most = int(np.abs(near).max(initial=0)) * n + n
    if most ** 2 * x.shape[1] < 2 ** 63:
        return ((near * n - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    exact = ((near.astype(object) * n - np.array(rest, object)) ** 2).sum(1).tolist()
    return [d if d < 2 ** 63 else None for d in exact]
