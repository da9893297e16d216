"""Benchmark decontamination by winnowing, in Spark expressions alone.

A text is its words. Of every WINDOW consecutive words the lowest hash of GRAM words is kept, so two texts that share
WINDOW words share a kept hash, and about two hashes in ``WINDOW - GRAM + 2`` words are kept. The hashes of the documents
meet those of the benchmark; only around a hit are whole windows compared, word by word. Items with fewer words than a
window are one window each, looked up at every place whose first word begins such an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
GRAM = 6
# Words are what stands between these bytes. Fixed values of the contract.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A table of fingerprints or windows is sent to all tasks up to so many rows; a larger one is joined by shuffle.
MOST_BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null and empty texts have none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # Only A-Z change; ``lower`` does just that where all characters are single bytes.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(lowered, _BETWEEN), lambda word: word != "")


def _places(found: Column, length: int) -> Column:
    """Where runs of ``length`` words begin."""
    none = F.array().cast("array<int>")
    return F.when(F.size(found) >= length, F.sequence(F.lit(0), F.size(found) - length)).otherwise(none)


def _first_word_hash(word: Column) -> Column:
    """Fingerprint of a word that begins a short item; not to be taken for that of a run of words."""
    return F.xxhash64(F.lit("first word"), word)


def with_hashes(df: DataFrame, gram: int = GRAM) -> DataFrame:
    """Rows with ``_words``, with the hash of every run of ``gram`` words in ``_grams``."""
    run = F.transform(_places(F.col("_words"), gram), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(gram)]))
    return df.withColumn("_grams", run)


def with_kept(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows with ``_words``, with the lowest hash of every window of words in ``_kept``, in order of places."""
    lowest = F.transform(
        _places(F.col("_words"), window), lambda i: F.least(*[F.get("_grams", i + k) for k in range(window - gram + 1)])
    )
    return with_hashes(df, gram).withColumn("_kept", lowest).drop("_grams")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST_ROWS else df


def _with(documents: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Documents with what was found under the same id, which may be null, and the same tag."""
    found = found.withColumnsRenamed({"id": "_id", "tag": "_tag"})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    return documents.join(found, same, how).drop("_id", "_tag")


def contaminated_words(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """Of every document: its id, ``tag`` (hash of its text), ``n_words``, ``spans`` (start and length in words, sorted, of
    the benchmark windows in it) and ``items`` (the sorted ids, as text, of the items these windows are of).

    Null texts have no words; items without words are in no document. Rows with one id and one text are judged once and
    returned as often as they come; a null id is an id. Items that repeat, or share windows, are all named; an item with a
    null id is not named but its windows count. Other columns are left out.
    """
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), words(F.col(item_text_column)).alias("_words"))
    items = items.filter(F.size("_words") > 0)
    short = [row[0] for row in items.select(F.size("_words")).filter(F.size("_words") < window).distinct().collect()]

    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    texts = texts.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))

    # Windows of the benchmark: their words, the items they are of, and their fingerprints.
    long_items = with_kept(items.filter(F.size("_words") >= window), window, gram)
    parts = F.transform(
        "_kept", lambda mark, i: F.struct(mark.alias("mark"), F.array_join(F.slice("_words", i + 1, window), " ").alias("part"))
    )
    windows = long_items.select("item", F.explode(parts).alias("_at")).select("item", "_at.mark", "_at.part")
    brief = items.filter(F.size("_words") < window)
    brief = brief.select("item", _first_word_hash(F.get("_words", F.lit(0))).alias("mark"), F.array_join("_words", " ").alias("part"))
    windows = windows.unionByName(brief)
    marks, parts = windows.select("mark").distinct(), windows.select("part").distinct()
    sizes = windows.agg(F.countDistinct("mark"), F.countDistinct("part")).first()

    # Which fingerprints of a document are also in the benchmark.
    marked = with_kept(texts.select("id", "tag", words(F.col("text")).alias("_words")), window, gram)
    own = F.array_distinct("_kept")
    if short:
        own = F.concat(own, F.array_distinct(F.transform("_words", _first_word_hash)))
    met = marked.select("id", "tag", F.explode(own).alias("mark")).join(_sent(marks, sizes[0]), "mark")
    met = met.groupBy("id", "tag").agg(F.collect_set("mark").alias("_met"))

    # Whole windows of these documents around the hits, as words.
    near = _with(texts, met, "inner").select("id", "tag", "_met", words(F.col("text")).alias("_words"))
    near = with_kept(near.dropDuplicates(["id", "tag"]), window, gram)

    def spans(places: Column, length: int, mark) -> Column:
        hit = F.filter(places, lambda i: F.array_contains("_met", mark(i)))
        part = F.transform(
            hit,
            lambda i: F.struct(
                i.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice("_words", i + 1, length), " ").alias("part")
            ),
        )
        return part

    around = [spans(_places(F.col("_words"), window), window, lambda i: F.get("_kept", i))]
    around += [
        spans(_places(F.col("_words"), length), length, lambda i: _first_word_hash(F.get("_words", i))) for length in short
    ]
    tried = near.select("id", "tag", F.explode(F.concat(*around)).alias("_at")).select("id", "tag", "_at.*")
    hits = tried.join(_sent(parts, sizes[1]), "part")
    found = hits.groupBy("id", "tag").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"), F.collect_set("part").alias("_parts")
    )
    named = found.select("id", "tag", F.explode("_parts").alias("part")).join(windows.select("part", "item").distinct(), "part")
    named = named.filter("item IS NOT NULL").groupBy("id", "tag").agg(F.sort_array(F.collect_set("item")).alias("items"))

    # All documents with what was found in them.
    counted = texts.select("id", "tag", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = _with(_with(counted, found.drop("_parts"), "left"), named, "left")
    return out.withColumnsRenamed({"id": id_column}).withColumns(
        {
            "spans": F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")),
            "items": F.coalesce("items", F.array().cast("array<string>")),
        }
    )


def covered(spans: Column) -> Column:
    """Number of words under sorted spans; overlaps count once."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("end"))

    def add(sofar: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        fresh = F.greatest(end - F.greatest(span["start"], sofar["end"]), F.lit(0))
        return F.struct((sofar["words"] + fresh).alias("words"), F.greatest(end, sofar["end"]).alias("end"))

    return F.aggregate(spans, start, add, lambda sofar: sofar["words"])
