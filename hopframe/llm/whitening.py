"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers, so sums and centring are exact.  A pass over the
centred rows A gives the Gram matrix; its Cholesky factor R, after a small
shift of the diagonal in the first round or where rounding spoils the factor,
makes A R^-1 nearly orthogonal, by triangular solves inside the tasks.  The
passes repeat on the solved rows until their Gram matrix is the identity; the
factors compose to the R of A, and the singular value decomposition of R gives
the components and their variances.  Working on R halves the exponent range
that a decomposition of the covariance would need.  One more pass measures the
covariance of the whitened rows.

A pass returns one number per cell of the upper triangle of a matrix as wide as
the vectors, summed in the executors; nothing else reaches the driver, whatever
the number of rows.

Nulls: rows whose vector is null or holds null or non-finite entries are left
out.  Rows of another length than the commonest (of the longer, if tied) are
left out too; empty vectors have no components.  Null and repeated ids stay.
Directions without variance are whitened to null, beyond the rank of the table.
Repeated rows count each time.  Very long vectors are read in blocks; their
squared length is what the driver holds.  An empty table gives an empty result.
Kept columns that have the name of a computed one give way.  Entries beyond
2**42 in size count as that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
ROUNDS, NEAR = 8, 1e-12
UNIT = 2.0**-53
LARGEST = 1 << 52  # of an entry after scaling
HALF = 26
BLOCK = 1 << 20  # entries held as one matrix
COMPUTED = ("deviation", "whitened")


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: counts and sums, unit components as columns, their variances, the whole variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    rank: int

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace if self.trace else np.zeros_like(self.variances)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has finite entries only, as doubles."""
    entries = F.col(vector).cast("array<double>")
    bad = F.exists(entries, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~bad)


def common_width(df: DataFrame, vector: str) -> int:
    """The commonest length, 0 without rows."""
    first = df.groupBy(F.size(vector).alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).head()
    return first["width"] if first else 0


def _blocks(column: pa.Array, width: int):
    """Matrices of whole numbers of the rows of a batch."""
    step = max(1, BLOCK // max(1, width))
    for at in range(0, len(column), step):
        flat = column.slice(at, step).flatten().to_numpy(zero_copy_only=False)
        x = np.floor(np.clip(flat * SCALE, -LARGEST, LARGEST)).astype(np.int64) + OFFSET
        yield x.reshape(-1, width)


def _totals(df: DataFrame, vector: str, width: int, kind: str, part: Callable) -> dict:
    """Sums of ``part(matrix)`` over all blocks by cell, added up in tasks, then by cell."""

    def run(batches):
        total = None
        for batch in batches:
            for x in _blocks(batch.column(0), width):
                one = part(x)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "value"])

    cells = df.select(F.col(vector).cast("array<double>")).mapInArrow(run, f"cell long, value {kind}")
    return {r["cell"]: r["value"] for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect()}


def _whole_sums(df: DataFrame, vector: str, width: int) -> tuple[int, list[int]]:
    """Count and exact sums, carried in two halves so that no long overflows."""

    def part(x):
        return np.concatenate([[len(x)], (x >> HALF).sum(axis=0), (x & ((1 << HALF) - 1)).sum(axis=0)])

    cells = _totals(df, vector, width, "long", part)
    if not cells:
        return 0, []
    return cells[0], [(cells[1 + i] << HALF) + cells[1 + width + i] for i in range(width)]


def deviations(x: np.ndarray, n: int, sums: Sequence[int]) -> np.ndarray:
    """n * x - sums, exactly: as longs where they fit, else as Python's integers."""
    most = max(max(map(abs, sums), default=0), n * int(np.abs(x).max(initial=0)))
    if most < 1 << 61:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: Sequence[int]) -> np.ndarray:
    return (deviations(x, n, sums) / n).astype(np.float64)


def solve_right(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The X with X @ factor = rows, for an upper triangular factor."""
    out = np.empty_like(rows)
    for j in range(len(factor)):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _gram(df: DataFrame, vector: str, n: int, sums: Sequence[int], factors: Sequence[np.ndarray]) -> np.ndarray:
    """The Gram matrix of the centred rows after the solves so far."""
    width = len(sums)
    upper = np.triu_indices(width)

    def part(x):
        q = centred(x, n, sums)
        for factor in factors:
            q = solve_right(q, factor)
        return (q.T @ q)[upper]

    cells = _totals(df, vector, width, "double", part)
    gram = np.zeros((width, width))
    gram[upper] = [cells[i] for i in range(len(upper[0]))]
    return gram + np.triu(gram, 1).T


def cholesky(gram: np.ndarray, n: int, shifted: bool) -> tuple[np.ndarray, bool]:
    """The upper factor, shifted if asked or if rounding leaves none; and whether it was."""
    width = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T, False
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (n * width + width * (width + 1)) * UNIT * np.linalg.norm(gram, 2)
    return np.linalg.cholesky(gram + shift * np.eye(width)).T, True


def fit(df: DataFrame, vector: str = "embedding", components: int | None = None) -> Whitening:
    """Components by falling variance, at most ``components``, over all usable rows of the commonest length."""
    found = usable(df, vector)
    width = common_width(found, vector)
    rows = found.where(F.size(vector) == width)
    n, sums = _whole_sums(rows, vector, width) if width else (0, [])
    if not n:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    factors: list[np.ndarray] = []
    whole, gram = np.eye(width), _gram(rows, vector, n, sums, factors)
    trace = float(np.trace(gram)) / n
    for turn in range(ROUNDS):
        if not trace or turn and np.abs(gram - np.eye(width)).max() <= NEAR:
            break
        factor, _ = cholesky(gram, n, shifted=turn == 0)
        factors.append(factor)
        whole, gram = factor @ whole, _gram(rows, vector, n, sums, [*factors])
    # What the last Gram matrix still lacks of the identity goes into the factor; in the null space it is nothing.
    values, vectors = np.linalg.eigh(gram)
    root = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    _, sizes, directions = np.linalg.svd(root @ whole)
    rank = int((sizes > sizes[0] * width * 2.0**-48).sum()) if trace else 0
    most = min(width, components or width)
    chosen = directions[:most].T
    top = chosen[np.abs(chosen).argmax(axis=0), np.arange(most)]
    return Whitening(n, tuple(sums), chosen * np.where(top < 0, -1, 1), sizes[:most] ** 2 / n, trace, min(rank, most))


def _project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Centred rows on the components with variance, over its root."""
    return centred(x, model.n, model.sums) @ model.components[:, : model.rank] / np.sqrt(model.variances[: model.rank])


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", keep: Sequence[str] = ("vec_id",)) -> DataFrame:
    """The usable rows: kept columns, ``whitened`` (an entry per component) and ``deviation``, the exact squared length of n * x - sums."""
    columns = [c for c in keep if c not in COMPUTED]
    width, most = len(model.sums), len(model.variances)
    rows = usable(df, vector).where(F.size(vector) == width).select(F.col(vector).cast("array<double>").alias("__vector"), *columns)
    if not width:
        rows = rows.limit(0)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches):
        for batch in batches:
            squares, values = [], []
            for x in _blocks(batch.column(0), width):
                off = deviations(x, model.n, model.sums)
                if off.dtype == object or width * float(np.abs(off).max(initial=0)) ** 2 >= 2.0**62:
                    squares.append(pa.array([int(s) for s in (off.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0)))
                else:
                    squares.append(pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0)))
                z = np.full((len(x), most), np.nan)
                z[:, : model.rank] = _project(x, model)
                flat = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
                values.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * most), flat))
            if values:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.concat_arrays(squares), pa.concat_arrays(values)], [*batch.schema.names[1:], *COMPUTED]
                )

    return rows.mapInArrow(run, f"{kinds}{', ' * bool(kinds)}deviation decimal(38,0), whitened array<double>")


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest entry, in size, of the whitened rows' covariance minus the identity, measured over all rows."""
    k, width = model.rank, len(model.sums)
    if not k:
        return 0.0
    upper = np.triu_indices(k)

    def part(x):
        z = _project(x, model)
        return np.concatenate([z.sum(axis=0), (z.T @ z)[upper]])

    cells = _totals(usable(df, vector).where(F.size(vector) == width), vector, width, "double", part)
    mean = np.array([cells[i] for i in range(k)]) / model.n
    covariance = np.array([cells[k + i] for i in range(len(upper[0]))]) / model.n - np.outer(mean, mean)[upper]
    return float(np.abs(covariance - np.eye(k)[upper]).max())


def by_component(values: Sequence[float], component: Column) -> Column:
    """The value of a 1-based component as a column."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), component) if len(values) else F.lit(None).cast("double")
