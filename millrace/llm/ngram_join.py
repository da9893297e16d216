"""Near duplicates by an exact Jaccard join on word n-grams: a blocked product of the document by n-gram matrix.

A row of the matrix is the set of distinct n-grams of a document, sorted by one global order: n-grams that many documents
share come last. Two sets that are as alike as the limit demands share one of their first columns, as many as their sizes
leave free; only these columns, one block for each n-gram, make pairs, and a pair is dropped when its sizes and the number
of first columns that it shares bound its overlap below the limit. The overlap of the others is counted over whole rows.

Documents with equal sets are one class. In a block of thousands of near copies all pairs would say little more than a
few: every class of a block is compared with its lead, the one that shares most columns with others (what the rest was copied
from, where it is there), then only classes that this left in other components are compared with the rest of their block. No
link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import graph, tables, texts

WORDS = 4
PERCENT = 85
PIECE_BYTES = 2 << 20
# Common n-grams are told by counts in so many buckets.
BUCKET_BITS = 18
# A list of documents to fetch is sent to all tasks up to so many rows, and joined by shuffle beyond.
MOST_BROADCAST_ROWS = 500_000
# A document is compared with so many others by one task; it is sent again for more.
AT_ONCE = 512

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


# -- n-gram sets ----------------------------------------------------------------------------------------------


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    values = values ^ (values >> np.uint64(32))
    values = values * _MIXER
    values = values ^ (values >> np.uint64(29))
    values = values * _MULTIPLIER
    return values ^ (values >> np.uint64(32))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


def _powers(base: int, count: int) -> np.ndarray:
    """Powers 0 to ``count`` of an odd number, modulo 2 ** 64."""
    factors = np.full(count + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the number of words before each text. Words lie between ASCII white space."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    first[bounds] = inside[bounds]
    starts = np.flatnonzero(first)
    after = np.zeros(len(data) + 1, bool)
    after[1:] = inside
    after[1:-1] &= ~inside[1:]
    after[bounds] = inside[bounds - 1]
    after[0] = False
    ends = np.flatnonzero(after)
    multiplier = 0x2545F4914F6CDD1D
    powers = _powers(multiplier, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[_LOWER[data]] * powers[:-1], dtype=np.uint64)])
    # A word's sum is divided by the power of its start: the same word hashes alike wherever it stands.
    inverse = _powers(pow(multiplier, -1, 1 << 64), len(data))
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def ngram_sets(column: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of every text; the whole text is one where it has fewer words, none without words."""
    hashes, bounds = word_hashes(*texts.utf8(column))
    grams = np.zeros(0, np.uint64)
    if len(hashes) >= size:
        grams = hashes[: len(hashes) - size + 1].copy()
        for place in range(1, size):
            grams = grams * _MULTIPLIER + hashes[place : len(hashes) - size + 1 + place]
        grams = mix(grams)
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if last - first >= size:
            yield np.unique(grams[first : last - size + 1])
        elif last > first:
            whole = np.array([last - first], np.uint64)
            for word in hashes[first:last]:
                whole = whole * _MULTIPLIER + word
            yield mix(whole)
        else:
            yield np.zeros(0, np.uint64)


def free_places(size: int, percent: int) -> int:
    """How many columns a set may miss and still be alike, and one more: a partner shares one of the first so many."""
    return size - -(-percent * size // 100) + 1


def least_overlap(left: Column, right: Column, percent: int) -> Column:
    """The overlap that two sizes need to reach the limit."""
    return F.ceil((left + right) * percent / (100 + percent))


# -- matrix ---------------------------------------------------------------------------------------------------


def common_buckets(documents: DataFrame, size: int) -> np.ndarray:
    """A class for each bucket of n-gram hashes: 0 for few documents, else growing with the logarithm of the count."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in texts.in_pieces(batches, "text", PIECE_BYTES):
            for grams in ngram_sets(batch.column("text"), size):
                np.add.at(counts, (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        mean = counts.mean()
        stand_out = np.flatnonzero(counts > mean + 6 * np.sqrt(mean) + 4)
        yield pa.RecordBatch.from_arrays(
            [pa.array(stand_out, pa.int32()), pa.array(counts[stand_out] - int(mean), pa.int64())], names=["bucket", "n"]
        )

    counted = tables.map_batches(documents.select("text"), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    classes = np.zeros(1 << BUCKET_BITS, np.uint8)
    for bucket, n in counted.collect():  # a row for each bucket at most
        classes[bucket] = int(np.log2(n + 1)) + 1
    return classes


def matrix(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """A row per document: ``row``, ``id``, ``tag``, ``n`` (set size), ``digest`` of the set, ``first`` (its first columns)."""
    shared = tables.share(documents.sparkSession, common_buckets(documents, size))  # a byte for each bucket

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared()
        seen: set[bytes] = set()
        for batch in texts.in_pieces(batches, "text", PIECE_BYTES):
            sizes, digests, firsts = [], [], []
            for grams in ngram_sets(batch.column("text"), size):
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                sizes.append(len(grams))
                digests.append(digest)
                if digest in seen or not len(grams):
                    firsts.append(None)  # its class has its columns from another row
                    continue
                seen.add(digest)
                order = np.argsort(classes[(grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")
                firsts.append(grams[order[: free_places(len(grams), percent)]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("tag"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(firsts, pa.list_(pa.int64())),
                ],
                names=["id", "tag", "n", "digest", "first"],
            )

    schema = "id long, tag long, n long, digest binary, first array<long>"
    found = tables.map_batches(documents.select("id", "tag", "text"), rows, schema)
    return tables.keep(found.withColumn("row", F.monotonically_increasing_id()), "ngram-rows")


# -- product --------------------------------------------------------------------------------------------------


def _sizes_fit(left: Column, right: Column, percent: int) -> Column:
    return (100 * left >= percent * right) & (100 * right >= percent * left)


def _may_reach(common: Column, left: Column, right: Column, percent: int) -> Column:
    """Whether two sets with so many common columns among their first ones can reach the limit.

    Up to the nearer end of the two rows of first columns all common ones are counted; beyond it one of the sets has only
    the columns left that it has after its first ones.
    """
    later = [n - _free(n, percent) for n in (left, right)]
    return common + F.greatest(*later) >= least_overlap(left, right, percent)


def _may_meet(left: str, right: str, percent: int) -> Column:
    """Whether two sets that meet at an n-gram can reach the limit, by prefixes of columns ``n``, ``place`` and ``before``.

    What they share before it lies among the first columns of both, so other sets hold it too; after it the shorter rest
    is all that they can share.
    """
    sizes = [F.col(f"{side}n") for side in (left, right)]
    before = F.least(*(F.col(f"{side}before") for side in (left, right)))
    after = F.least(*(F.col(f"{side}n") - F.col(f"{side}place") - 1 for side in (left, right)))
    return _sizes_fit(*sizes, percent) & (before + 1 + after >= least_overlap(*sizes, percent))


def _free(size: Column, percent: int) -> Column:
    """``free_places`` of a column."""
    return size - F.floor((percent * size + 99) / 100) + 1


def overlaps(pairs: DataFrame, rows: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) with ``shared``, the size of their overlap, counted over whole rows."""
    places = Window.partitionBy("a").orderBy("b")
    dealt = pairs.select("a", "b", F.floor((F.row_number().over(places) - 1) / AT_ONCE).alias("part"))
    dealt = tables.keep(dealt, "ngram-pairs")
    # Each text goes straight to the tasks that compare it: the first of a pair once for AT_ONCE others.
    sent = dealt.select("a", "part", F.col("b").alias("row")).unionByName(dealt.select("a", "part", F.col("a").alias("row")).distinct())
    wanted = tables.keep(sent.join(rows.select("row", "id", "tag"), "row"), "ngram-wanted")
    wanted = tables.sent(wanted, MOST_BROADCAST_ROWS).withColumnsRenamed({"id": "_id", "tag": "_tag"})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    fetched = documents.join(wanted, same).select("a", "part", "row", "text")
    fetched = fetched.repartition("a", "part").sortWithinPartitions("a", "part", F.col("row") != F.col("a"), "row")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, before = np.zeros(0, np.uint64), None
        for batch in texts.in_pieces(batches, "text", PIECE_BYTES):
            found: list[tuple[int, int, int]] = []
            keys = zip(*(batch.column(name).to_pylist() for name in ("a", "part", "row")))
            for key, grams in zip(keys, ngram_sets(batch.column("text"), size)):
                if key == before:
                    continue  # the same document once more
                before = key
                if key[2] == key[0]:
                    whole = grams
                else:
                    found.append((key[0], key[2], len(np.intersect1d(whole, grams, assume_unique=True))))
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], names=["a", "b", "shared"])

    return tables.map_batches(fetched, count, "a long, b long, shared long")


def promising(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and first columns leave them a chance."""
    pairs = tables.keep(pairs, "ngram-tried")
    needed = tables.keep(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "ngram-needed")
    firsts = rows.join(tables.sent(needed, MOST_BROADCAST_ROWS), "row", "left_semi").select("row", "n", "first")
    for side in ("a", "b"):
        pairs = pairs.join(firsts.withColumnsRenamed({"row": side, "n": f"n_{side}", "first": f"first_{side}"}), side)
    common = F.size(F.array_intersect("first_a", "first_b"))
    fit = _sizes_fit(F.col("n_a"), F.col("n_b"), percent) & _may_reach(common, F.col("n_a"), F.col("n_b"), percent)
    return pairs.filter(fit).select("a", "b")


def links(pairs: DataFrame, rows: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that reach the limit."""
    counted = overlaps(pairs, rows, documents, size)
    sizes = rows.select("row", "n")
    for side in ("a", "b"):
        counted = counted.join(sizes.withColumnsRenamed({"row": side, "n": f"n_{side}"}), side)
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return tables.keep(counted.filter(100 * F.col("shared") >= percent * union).select("a", "b"), "ngram-links")


def _labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries (gram, row, n, place, before, lead) with the component of the row and of the lead of the block."""
    own = entries.join(labels.withColumnRenamed("vertex", "row"), "row", "left")
    own = own.join(labels.withColumnsRenamed({"vertex": "lead", "label": "lead_label"}), "lead", "left")
    label, lead_label = F.coalesce("label", "row"), F.coalesce("lead_label", "lead")
    return tables.keep(own.select("gram", "row", "n", "place", "before", label.alias("label"), lead_label.alias("lead_label")), "ngram-labels")


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Of every document: its id, ``tag`` (hash of its text), ``n_shingles``, ``component_id`` and ``kept``, which is true for
    one document of each component.

    Two documents link when 100 * intersection >= percent * union of their n-gram sets; ``component_id`` is the smallest id
    that links reach. Null texts and texts without words have empty sets and link with nothing. A null id is not smaller than
    any other. Repeated rows are documents of their own. Other columns are left out.
    """
    documents = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    documents = documents.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = matrix(documents, size, percent)
    full = rows.filter("n > 0")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    classes = tables.keep(full.groupBy("digest").agg(F.min("row").alias("row"), best), "ngram-classes")

    # A row per class and first column; blocks with one class make no pairs.
    listed = full.filter("first IS NOT NULL")
    of_class = classes.select(F.col("digest"), F.col("row").alias("class_row"))
    again = tables.keep(
        listed.select("digest", "row").join(of_class, "digest").filter("row <> class_row").select("row"), "ngram-again"
    )
    leads = listed.join(tables.sent(again, MOST_BROADCAST_ROWS), "row", "left_anti")
    entries = leads.select("row", "n", F.posexplode("first").alias("place", "gram"))
    entries = entries.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("gram"))).filter("members > 1")
    # Columns before this one that other rows have among their first ones too.
    entries = entries.withColumn("before", F.row_number().over(Window.partitionBy("row").orderBy("place")) - 1)
    entries = entries.withColumn("rank", -F.sum("members").over(Window.partitionBy("row"))).drop("members")
    lead = F.min(F.struct("rank", "row", "n", "place", "before")).over(Window.partitionBy("gram"))
    entries = tables.keep(entries.withColumn("lead", lead).drop("rank"), "ngram-blocks")

    # Every class against the lead of its block.
    tried = entries.filter(F.col("row") != F.col("lead.row")).filter(_may_meet("", "lead.", percent))
    tried = tried.select(F.col("lead.row").alias("a"), F.col("row").alias("b")).distinct()
    found = links(promising(tried, rows, percent), rows, documents, size, percent)
    labels = graph.components(found)

    # What is in another component than the lead of its block, against all of the block. A pair of unlike labels
    # comes once from each block that it shares, so the rows of a pair count its common first columns.
    own = _labelled(entries.withColumn("lead", F.col("lead.row")), labels)
    apart, all_of_block = own.filter("label <> lead_label").alias("l"), own.alias("r")
    # Two classes that are both apart meet once.
    once = (F.col("r.label") == F.col("r.lead_label")) | (F.col("l.row") < F.col("r.row"))
    unlike = (F.col("l.gram") == F.col("r.gram")) & (F.col("l.label") != F.col("r.label")) & once
    met = apart.join(all_of_block, unlike & _may_meet("l.", "r.", percent))
    pair = [F.least("l.row", "r.row").alias("a"), F.greatest("l.row", "r.row").alias("b")]
    counted = met.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("common"), F.min(F.least("l.n", "r.n")).alias("small"), F.min(F.greatest("l.n", "r.n")).alias("large")
    )
    rest = counted.filter(_may_reach(F.col("common"), F.col("small"), F.col("large"), percent)).select("a", "b")
    last = links(rest, rows, documents, size, percent)

    # The smallest id of each component, for every document of its classes.
    if not last.isEmpty():
        labels = graph.components(found.unionByName(last))
    labels = labels.withColumnRenamed("vertex", "row")
    labelled = classes.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    smallest = labelled.groupBy("label").agg(F.min("best").alias("best"))
    of_digest = labelled.drop("best").join(smallest, "label").select(F.col("digest").alias("_digest"), "best")
    out = rows.select("row", "id", "tag", "n", "digest").join(of_digest, (F.col("digest") == F.col("_digest")) & (F.col("n") > 0), "left")
    full = F.col("n") > 0
    return out.select(
        F.col("id").alias(id_column),
        "tag",
        F.col("n").alias("n_shingles"),
        F.when(full, F.col("best.id")).otherwise(F.col("id")).alias("component_id"),
        F.when(full, F.col("row") == F.col("best.row")).otherwise(True).alias("kept"),
    )
