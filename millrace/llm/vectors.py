"""Near-duplicate vectors with one label, by product quantisation.

Unit vectors are put into coarse inverted lists, one centroid each; what is left of them after the centroid is coded, one
codeword for each subspace. A query looks into every list that can hold a vector within reach: the lists whose border with
its own list is no further than the reach, so no probe is missing. In a list distances come from a table of the query's
distances to all codewords, summed by code; a vector whose coded distance exceeds the reach by more than its own coding
error cannot be within reach. The others are compared exactly, in double precision.

Centroids and codewords are fitted to a bounded sample; every vector is indexed and every vector is a query. Equal vectors
are one class. The lists are cut into blocks of bounded size, and pairs of blocks are the tasks. A block pair gives for
each vector the number of links and one vector that it hangs on, not the links themselves, which in a crowd of near copies
are many more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import graph, tables

SAMPLE = 20_000
SUBSPACE = 4
CODEWORDS = 64
LIST_SIZE = 512
MOST_LISTS = 1024
BLOCK = 1024
SLACK = 1e-6


@dataclass
class Quantiser:
    """Centroids of the lists, and the codewords of each subspace (subspace, codeword, coordinate)."""

    centroids: np.ndarray
    codewords: np.ndarray

    @property
    def width(self) -> int:
        return self.codewords.shape[0] * self.codewords.shape[2]

    def cut(self, points: np.ndarray) -> np.ndarray:
        return points.reshape(len(points), self.codewords.shape[0], self.codewords.shape[2])

    def lists(self, units: np.ndarray) -> np.ndarray:
        return _squares(units, self.centroids).argmin(axis=1)

    def encode(self, units: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the rest after the centroid, and the length that coding loses."""
        rest = self.cut(units - self.centroids[lists])
        codes = np.stack(
            [_squares(rest[:, s], words).argmin(axis=1) for s, words in enumerate(self.codewords)], axis=1
        ).astype(np.uint8)
        coded = np.stack([words[codes[:, s]] for s, words in enumerate(self.codewords)], axis=1)
        return codes, np.sqrt(((rest - coded) ** 2).sum(axis=(1, 2)))

    def probes(self, units: np.ndarray, lists: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each vector all lists that can hold one within reach of it."""
        squares = _squares(units, self.centroids)
        between = np.sqrt(np.maximum(_squares(self.centroids, self.centroids), 0))[lists]
        own = squares[np.arange(len(units)), lists][:, None]
        near = squares - own <= 2 * (reach + SLACK) * between + SLACK
        near[np.arange(len(units)), lists] = True
        return [np.flatnonzero(row) for row in near]

    def distances(self, units: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Distance of each query to each coded vector of a list."""
        rest = self.cut(units - self.centroids[number])
        total = np.zeros((len(units), len(codes)))
        for s, words in enumerate(self.codewords):
            total += _squares(rest[:, s], words)[:, codes[:, s]]
        return np.sqrt(np.maximum(total, 0))


def _squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left**2).sum(axis=1)[:, None] - 2 * left @ right.T + (right**2).sum(axis=1)[None]


def _means(points: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of ``count`` clusters."""
    chance = np.random.default_rng(seed)
    centres = points[chance.choice(len(points), min(count, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _squares(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def fit(sample: np.ndarray, lists: int, seed: int = 1) -> Quantiser:
    """Learn from unit vectors, padded to a whole number of subspaces."""
    centroids = _means(sample, lists, 8, seed)
    rest = sample - centroids[_squares(sample, centroids).argmin(axis=1)]
    parts = rest.reshape(len(rest), -1, SUBSPACE)
    words = [_means(np.ascontiguousarray(parts[:, s]), CODEWORDS, 6, seed + s) for s in range(parts.shape[1])]
    return Quantiser(centroids, np.stack(words))


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of length one in double precision, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    points = np.zeros((len(column), width))
    points[np.arange(width)[None] < lengths[:, None]] = flat
    # Scaled first, so that very large or small components do not overflow.
    points /= np.abs(points).max(axis=1, keepdims=True, initial=1e-300)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def near_vectors(
    df: DataFrame, least: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding",
    label_column: str = "label", sample: int = SAMPLE,
) -> DataFrame:
    """Of every row: id, ``n_links`` (other rows with cosine >= ``least`` and the same label), ``component_id`` (the smallest
    id that links reach, itself included) and ``kept`` (whether that is its own id).

    A vector that is null, empty, zero or holds null or non-finite components, and one without label, links with nothing;
    vectors of unlike lengths do not link. Repeated rows link with each other. A null id is never the smallest unless it is
    alone, and is not kept. Other columns are left out.
    """
    rows = df.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"),
        F.col(label_column).cast("string").alias("label"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    classes = rows.filter(usable).groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = tables.keep(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    counts = classes.agg(
        F.count(F.lit(1)), F.countDistinct("label"), F.max(F.size("vector"))
    ).first()
    if counts[0]:
        linked, labels = _links(classes, least, sample, *counts)
        classes = classes.join(linked, "cls", "left").join(labels.withColumnRenamed("vertex", "cls"), "cls", "left")
        classes = classes.withColumn("label_cls", F.coalesce(F.col("label_cls"), F.col("cls")))
        smallest = classes.groupBy("label_cls").agg(F.min("id").alias("component_id"))
        classes = classes.join(smallest, "label_cls")
    else:
        classes = classes.withColumns({"links": F.lit(0), "component_id": F.col("id")})
    of_class = classes.select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id",
    )
    same = (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")) & usable
    out = rows.join(of_class, same, "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, least: float, sample: int, count: int, labels: int, longest: int):
    """(cls, links) and (vertex, label_cls) of the classes."""
    spark = classes.sparkSession
    width = -(-longest // SUBSPACE) * SUBSPACE
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    lists = int(min(MOST_LISTS, max(1, count // max(1, labels * LIST_SIZE))))
    taken = classes.select("vector").orderBy(F.xxhash64("cls"), "cls").limit(sample).toArrow()["vector"].combine_chunks()
    quantiser = fit(_units(taken, width), lists)
    shared = tables.share(spark, quantiser)  # of fixed size

    def index(batches):
        learned = shared()
        for batch in batches:
            units = _units(batch.column("vector"), width)
            places = learned.lists(units)
            codes, lost = learned.encode(units, places)
            probes = learned.probes(units, places, reach)
            ends = np.cumsum([0, *map(len, probes)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("cls"), batch.column("n"), batch.column("label"), batch.column("vector"),
                    pa.array(places, pa.int32()), pa.array([row.tobytes() for row in codes], pa.binary()),
                    pa.array(lost, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(probes), pa.int32())),
                ],
                names=["cls", "n", "label", "vector", "list", "codes", "lost", "probes"],
            )

    schema = "cls long, n long, label string, vector array<double>, list int, codes binary, lost double, probes array<int>"
    indexed = tables.keep(classes.select("cls", "n", "label", "vector").mapInArrow(index, schema), "vector-index")

    # Members and queries of a list in blocks of bounded size; every pair of blocks is one task's work.
    held = indexed.groupBy("label", "list").agg(F.count(F.lit(1)).alias("members"))
    asked = indexed.select("label", F.explode("probes").alias("list")).groupBy("label", "list")
    sizes = held.join(asked.agg(F.count(F.lit(1)).alias("queries")), ["label", "list"])
    sizes = tables.keep(
        sizes.select(
            "label", "list", F.ceil(F.col("members") / BLOCK).cast("int").alias("member_blocks"),
            F.ceil(F.col("queries") / BLOCK).cast("int").alias("query_blocks"),
        ),
        "vector-lists",
    )
    place = F.xxhash64("cls")
    members = indexed.drop("probes").join(sizes, ["label", "list"]).select(
        "label", "list", "cls", "n", "vector", "codes", "lost",
        F.pmod(place, F.col("member_blocks")).cast("int").alias("mb"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"),
    )
    # Other names for the same columns, as both sides of the pairs come from one table.
    queries = indexed.select(*[F.col(c).alias(c) for c in ("label", "cls", "n", "vector", "probes")])
    queries = queries.select("label", F.explode("probes").alias("list"), "cls", "n", "vector").join(sizes, ["label", "list"]).select(
        "label", "list", "cls", "n", "vector",
        F.pmod(place, F.col("query_blocks")).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)).alias("mb"),
    )

    def meet(asking: pa.Table, there: pa.Table) -> pa.Table:
        empty = pa.table({"cls": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(asking) or not len(there):
            return empty
        learned = shared()
        asking, there = asking.combine_chunks(), there.combine_chunks()
        a, b = asking["cls"].to_numpy(), there["cls"].to_numpy()
        left, right = (_units(side["vector"].chunk(0), width) for side in (asking, there))
        codes = np.frombuffer(b"".join(there["codes"].to_pylist()), np.uint8).reshape(len(b), -1)
        coded = learned.distances(left, there["list"][0].as_py(), codes)
        near = coded <= reach + there["lost"].to_numpy()[None] + SLACK
        near &= a[:, None] < b[None]  # either of a pair finds the other; one of them is enough
        i, j = np.nonzero(near)
        exact = np.einsum("ij,ij->i", left[i], right[j]) >= least
        i, j = i[exact], j[exact]
        if not len(i):
            return empty
        numbers, places = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
        i_at, j_at = places[: len(i)], places[len(i) :]
        found = np.zeros(len(numbers), np.int64)
        np.add.at(found, i_at, there["n"].to_numpy()[j])
        np.add.at(found, j_at, asking["n"].to_numpy()[i])
        return pa.table({"cls": numbers, "links": found, "root": numbers[_roots(len(numbers), i_at, j_at)]})

    keys = ["label", "list", "qb", "mb"]
    met = queries.groupBy(keys).cogroup(members.groupBy(keys)).applyInArrow(meet, "cls long, links long, root long")
    met = tables.keep(met, "vector-links")
    linked = met.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = graph.components(met.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    return linked, parts.withColumnRenamed("label", "label_cls")


def _roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``count`` points the first one that the links reach."""
    roots = np.arange(count)
    while True:
        lowest = roots.copy()
        np.minimum.at(lowest, left, roots[right])
        np.minimum.at(lowest, right, roots[left])
        lowest = lowest[lowest]
        if (lowest == roots).all():
            return roots
        roots = lowest
