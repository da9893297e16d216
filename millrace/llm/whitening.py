"""Whitening of embeddings along their principal components, exact in what is whole and double in what is not.

Entries become whole numbers, floor(scale * entry). Distinct vectors of these are the fit list: executors sum it up exactly,
then add up the products of its centred vectors. The covariance matrix, of the size of one vector squared, goes to the
driver. Its eigenvectors come from a float32 solver and are corrected by matrix products in higher precision:

    R = I - X'X,  S = X'AX,  value_i = S_ii / (1 - R_ii)
    E_ij = (S_ij + value_j R_ij) / (value_j - value_i), or R_ij / 2 where the values are too close,  X <- X + X E

(the refinement of Ogita and Aishima; each round squares the error). Within a cluster of values too close to tell apart, the
small problem X_J' A X_J, shifted by its mean, is solved by itself and turns these columns. The first rounds work in
double, the last in extended precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tables

SCALE = 256
COMPONENTS = 4
MERGE_GROUPS = 64
MOST_ROUNDS = 24
BLOCK_ROWS = 8192
LARGEST = 2**63 - 1

# -- eigenvectors ---------------------------------------------------------------------------------------------


def _clusters(values: np.ndarray, reach: float) -> list[slice]:
    """Runs of ascending values whose neighbours are within reach."""
    cuts = np.flatnonzero(np.diff(values) > reach) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _correct(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, float, float]:
    """One round of refinement with sub-solves; the largest correction, and how far the columns were from orthonormal."""
    kind = vectors.dtype
    eye = np.eye(len(matrix), dtype=kind)
    rest = eye - vectors.T @ vectors
    turned = vectors.T @ (matrix @ vectors)
    values = np.diag(turned) / (1 - np.diag(rest))
    order = np.argsort(values, kind="stable")
    vectors, values = vectors[:, order], values[order]
    rest, turned = rest[np.ix_(order, order)], turned[np.ix_(order, order)]
    off = turned - np.diag(values)
    size = float(np.abs(values).max(initial=0))
    reach = 2 * (float(np.linalg.norm(off.astype(np.float64))) + size * float(np.linalg.norm(rest.astype(np.float64))))
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= reach
    np.fill_diagonal(close, True)
    step = np.where(close, rest / 2, (turned + values[None, :] * rest) / np.where(close, 1, gap))
    vectors = vectors + vectors @ step
    moved = float(np.abs(step).max(initial=0))
    for part in _clusters(values, reach):
        if part.stop - part.start < 2:
            continue
        block = vectors[:, part]
        small = block.T @ (matrix @ block)
        # In an almost orthonormal basis: the shifted problem keeps its own digits.
        shift = np.trace(small) / len(small)
        gram = block.T @ block
        small = small - shift * gram
        small = (small + small.T) / 2
        scale = float(np.abs(small).max())
        if scale <= np.finfo(kind).eps * size:
            continue
        turn = np.linalg.eigh((small / scale).astype(np.float64))[1].astype(kind)
        vectors[:, part] = block @ turn
    return vectors, moved, float(np.abs(rest).max())


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    scale = float(np.abs(matrix).max(initial=0))
    if not scale:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    exact = matrix.astype(np.longdouble) / scale
    exact = (exact + exact.T) / 2
    vectors = np.linalg.eigh(exact.astype(np.float32))[1].astype(np.float64)
    for kind, enough in ((np.float64, 1e-9), (np.longdouble, 1e-17)):
        vectors = vectors.astype(kind)
        plain = exact.astype(kind)
        before = np.inf
        for _ in range(MOST_ROUNDS):
            vectors, moved, skew = _correct(plain, vectors)
            # Nothing left to correct, or no more than this precision's own rounding.
            if skew <= enough and (moved <= enough or moved >= before / 2):
                break
            before = moved
    # Directions that rounding alone decides are turned a little in every round: make the columns orthonormal at last.
    for _ in range(2):
        vectors = vectors + vectors @ (np.eye(len(matrix), dtype=np.longdouble) - vectors.T @ vectors) / 2
    values = ((exact @ vectors) * vectors).sum(axis=0) * scale
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), vectors[:, order].astype(np.float64)


# -- vectors of whole numbers ---------------------------------------------------------------------------------

_WIDTHS = ("<i2", "<i4", "<i8")


def _packed(whole: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of three widths that holds it, so equal vectors have equal bytes."""
    low, high = whole.min(axis=1), whole.max(axis=1)
    out: list[bytes] = [b""] * len(whole)
    done = np.zeros(len(whole), bool)
    for width in _WIDTHS:
        room = np.iinfo(width)
        fits = ~done & (low >= room.min) & (high <= room.max)
        done |= fits
        rows = np.ascontiguousarray(whole[fits].astype(width))
        for place, row in zip(np.flatnonzero(fits).tolist(), rows):
            out[place] = row.tobytes()
    return out


def _unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of whole numbers."""
    out = np.empty((len(column), dimension), np.int64)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    plain = column.to_pylist()
    for width in _WIDTHS:
        places = np.flatnonzero(sizes == dimension * np.dtype(width).itemsize)
        if len(places):
            out[places] = np.frombuffer(b"".join([plain[p] for p in places]), width).reshape(-1, dimension)
    return out


def whole_vectors(df: DataFrame, vector_column: str, scale: int = SCALE) -> DataFrame:
    """Rows whose vector is whole and finite, with ``dim`` and ``x`` (packed whole numbers) in place of the vector.

    Numbers beyond a long are held at its ends.
    """
    rest = [c for c in df.columns if c != vector_column]
    source = df.select(*rest, F.col(vector_column).cast("array<double>").alias("x"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("x")
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            plain = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            packed: list[bytes | None] = [None] * batch.num_rows
            for dimension in np.unique(lengths[lengths > 0]).tolist():
                places = np.flatnonzero(lengths == dimension)
                rows = plain[starts[places][:, None] + np.arange(dimension)]
                usable = np.isfinite(rows).all(axis=1)
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(rows[usable] * scale), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
                for place, content in zip(places[usable].tolist(), _packed(whole)):
                    packed[place] = content
            kept = pa.array([content is not None for content in packed])
            out = pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array(lengths.astype(np.int32)), pa.array(packed, pa.binary())],
                names=[*rest, "dim", "x"],
            )
            yield out.filter(kept)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema], "dim int", "x binary"])
    return source.mapInArrow(each, schema)


# -- sums over the fit list -----------------------------------------------------------------------------------


def _blocks(batches: Iterable[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            yield _unpacked(batch.column("x").slice(start, BLOCK_ROWS), dimension)


class ExactSums:
    """Number of vectors and the exact sum of each entry."""

    def __init__(self, dimension: int):
        self.n, self.sums = 0, [0] * dimension

    def add(self, rows: np.ndarray) -> None:
        self.n += len(rows)
        largest = max(abs(int(rows.max())), abs(int(rows.min())))
        added = rows.sum(axis=0) if largest * len(rows) <= LARGEST else rows.astype(object).sum(axis=0)
        self.sums = [a + int(b) for a, b in zip(self.sums, added)]

    def merge(self, content: bytes) -> None:
        n, *sums = (int(part) for part in content.decode().split(","))
        self.n += n
        self.sums = [a + b for a, b in zip(self.sums, sums)]

    def content(self) -> bytes:
        return ",".join(map(str, [self.n, *self.sums])).encode()


class Scatter:
    """Products of vectors centred by a given mean, turned into coordinates where asked; sums are merged with their own means."""

    def __init__(self, mean: np.ndarray, turn: np.ndarray | None = None):
        self.center, self.turn = mean, turn
        self.width = len(mean) if turn is None else turn.shape[1]
        self.n, self.mean, self.products = 0, np.zeros(self.width), np.zeros((self.width, self.width))

    def add(self, rows: np.ndarray) -> None:
        points = rows - self.center
        points = points if self.turn is None else points @ self.turn
        middle = points.mean(axis=0)
        points = points - middle
        self._join(len(points), middle, points.T @ points)

    def _join(self, n: int, mean: np.ndarray, products: np.ndarray) -> None:
        if not n:
            return
        total = self.n + n
        apart = mean - self.mean
        self.products = self.products + products + np.outer(apart, apart) * (self.n * (n / total))
        self.mean = self.mean + apart * (n / total)
        self.n = total

    def merge(self, content: bytes) -> None:
        parts = np.frombuffer(content, np.float64, offset=8)
        n = int.from_bytes(content[:8], "little")
        self._join(n, parts[: self.width], parts[self.width :].reshape(self.width, self.width))

    def content(self) -> bytes:
        return self.n.to_bytes(8, "little") + self.mean.tobytes() + self.products.tobytes()


def _summed(fit: DataFrame, dimension: int, empty):
    """All vectors of the fit list added to sums: one of a task, merged in groups of tasks, then by the driver."""
    shared = tables.share(fit.sparkSession, empty)  # of the size of the matrix

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = shared()
        for rows in _blocks(batches, dimension):
            sums.add(rows)
        yield _one(TaskContext.get().partitionId() % MERGE_GROUPS, sums.content())

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = shared(), False
        for batch in batches:
            for content in batch.column("content"):
                sums.merge(content.as_py())
                seen = True
        if seen:
            yield _one(0, sums.content())

    schema = "part int, content binary"
    for row in fit.select("x").mapInArrow(add, schema).repartition("part").mapInArrow(merge, schema).collect():
        empty.merge(bytes(row.content))  # at most MERGE_GROUPS rows
    return empty


def _one(part: int, content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([content], pa.binary())], names=["part", "content"])


# -- whitening ------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What is learned of the fit list; all of the size of one vector, but for the covariance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def turn(self) -> np.ndarray:
        """Coordinates over the root of their variance; none where there is no spread."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.spread, self.components / np.sqrt(self.values), 0.0)

    @property
    def spread(self) -> np.ndarray:
        """Components whose variance is more than what rounding leaves."""
        return self.values > self.trace * len(self.mean) * np.finfo(np.float64).eps


def fit_whitening(fit: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening:
    """Components of the distinct packed vectors in ``x``; reads them three times."""
    sums = _summed(fit, dimension, ExactSums(dimension))
    mean = np.array([float(Fraction(s, max(1, sums.n))) for s in sums.sums])
    scatter = _summed(fit, dimension, Scatter(mean))
    covariance = scatter.products / max(1, sums.n)
    values, vectors = eigen(covariance)
    found = Whitening(
        sums.n, sums.sums, mean, np.maximum(values[:components], 0.0), vectors[:, :components], float(np.trace(covariance))
    )
    if found.spread.any():
        white = _summed(fit, dimension, Scatter(mean, found.turn))
        used = found.spread
        apart = white.products[np.ix_(used, used)] / white.n - np.eye(int(used.sum()))
        found.identity_error = float(np.abs(apart).max())
    return found


def _deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - S) ** 2, exact; null where a long cannot hold it."""
    largest = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))))
    most = n * largest + max(map(abs, sums))
    if most**2 * len(sums) <= LARGEST:
        return ((n * rows - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in rows]
    return [value if value <= LARGEST else None for value in exact]


OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component: id, component (from 1 by falling variance), n, deviation, whitened, explained,
    identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, and rows of another length than the commonest one
    (the longer of two as common): they lie in another space. Repeated rows are returned as often as they come and fitted
    once; a null id is an id. ``deviation`` is null where a long cannot hold it. A component without spread has a null
    ``whitened``, and counts nowhere in ``identity_error``, which is null without any. ``explained`` is 0 where there is no
    spread at all. An empty table gives an empty one. Other columns are left out.
    """
    spark = df.sparkSession
    rows = tables.keep(whole_vectors(df.select(F.col(id_column), F.col(vector_column)), vector_column), "whole-vectors")
    commonest = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    types = f"`{id_column}` {df.schema[id_column].dataType.simpleString()}"
    if commonest is None:
        return spark.createDataFrame([], f"{types}, {OUTPUT}")
    dimension = commonest["dim"]
    rows = rows.filter(F.col("dim") == dimension)
    found = fit_whitening(tables.keep(rows.select("x").distinct(), "fit-list"), dimension, components)
    shared = tables.share(spark, found)  # a few vectors

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared()
        count = len(learned.values)
        turn, spread = learned.turn, learned.spread
        explained = learned.values / learned.trace if learned.trace else np.zeros(count)
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                entries = _unpacked(batch.column("x"), dimension)
                white = (entries - learned.mean) @ turn
                many = batch.num_rows * count
                deviations = pa.array(_deviations(entries, learned.n, learned.sums), pa.int64())
                each_row = pa.array(np.repeat(np.arange(batch.num_rows), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_column).take(each_row),
                        pa.array(np.tile(np.arange(1, count + 1), batch.num_rows), pa.int32()),
                        pa.array(np.full(many, learned.n), pa.int64()),
                        deviations.take(each_row),
                        pa.array(white.ravel(), pa.float64(), mask=np.tile(~spread, batch.num_rows)),
                        pa.array(np.tile(explained, batch.num_rows), pa.float64()),
                        pa.array([learned.identity_error] * many, pa.float64()),
                    ],
                    names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(id_column, "x").mapInArrow(each, f"{types}, {OUTPUT}")
