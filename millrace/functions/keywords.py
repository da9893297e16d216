"""Keywords of a text: letter and digit runs, with dictionary words inside runs of Han characters; by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
HAN_RUN = r"\p{IsHan}"

# A dictionary of up to so many words goes to every task as a table of hashed buckets; a larger one is joined.
MOST_TABLE_WORDS = 500_000
WORDS_PER_BUCKET = 4
DICTIONARY_VIEW = "ik_dictionary"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


# Words of a token, given its characters and the longest word at each place where one begins, by place: a word that begins
# within the last one taken is passed over, and what lies between words stands alone. They are put together as one text with
# blanks, which a token has none of: a text that grows is cheap to copy, an array is not.
_TAKEN = """
    filter(split(aggregate(
        {found},
        named_struct('next', 1, 'words', ''),
        (sofar, word) -> if(word.at < sofar.next, sofar, named_struct(
            'next', word.at + word.size,
            'words', concat_ws(' ', sofar.words, array_join(slice({chars}, sofar.next, word.at - sofar.next), ' '),
                               array_join(slice({chars}, word.at, word.size), '')))),
        sofar -> concat_ws(' ', sofar.words, array_join(slice({chars}, sofar.next, size({chars}) - sofar.next + 1), ' '))
    ), ' '), word -> word <> '')
"""

# The longest word of a table of buckets at each place of a token.
_LONGEST = """
    filter(
        transform({chars}, (char, i) -> named_struct('at', i + 1, 'size', array_max(filter({table}.sizes, n ->
            i + n <= size({chars}) AND array_contains(
                element_at({table}.buckets, cast(1 + pmod(xxhash64(array_join(slice({chars}, i + 1, n), '')), size({table}.buckets)) AS int)),
                array_join(slice({chars}, i + 1, n), '')))))),
        found -> found.size IS NOT NULL)
"""

_CHARS = "filter(split({token}, ''), char -> char <> '')"


def word_table(dictionary: DataFrame) -> DataFrame:
    """The words (column ``word``) as one row, ``words``: their lengths, and the words in buckets by hash."""
    words = dictionary.select(F.lower("word").alias("word")).filter("word <> ''").distinct()
    n = words.count()
    if n > MOST_TABLE_WORDS:
        raise ValueError(f"{n} words are more than a table for every task should hold ({MOST_TABLE_WORDS})")
    buckets = 1 + n // WORDS_PER_BUCKET
    hashed = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("id")).agg(F.collect_list("word").alias("held"))
    every = words.sparkSession.range(buckets).join(hashed, "id", "left")
    none = F.array().cast("array<string>")
    listed = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("held", none).alias("held")))).alias("all"))
    sizes = words.agg(F.array_sort(F.collect_set(F.length("word"))).alias("sizes"))
    return listed.select(
        F.struct(
            F.lit(sizes.first()[0]).cast("array<int>").alias("sizes"), F.transform("all", lambda bucket: bucket["held"]).alias("buckets")
        ).alias("words")
    )


def keywords(df: DataFrame, text: str, name: str = "keyword", dictionary: DataFrame | None = None) -> DataFrame:
    """One row per keyword of ``text``.

    ``dictionary`` (column ``word``) splits tokens with Han characters into the longest words from left to right;
    characters outside all words stand alone. Each distinct token is split once: its substrings are joined with the
    dictionary, and the words that do not overlap are kept. So the dictionary may be of any size; ``register`` has a form for
    one that fits every task.
    """
    exploded = df.withColumn(name, F.explode(tokens(F.col(text))))
    if dictionary is None:
        return exploded
    han = exploded.filter(F.col(name).rlike(HAN_RUN)).select(F.col(name).alias("_token")).distinct()
    split = exploded.join(segment(han, dictionary), F.col(name) == F.col("_token"), "left")
    return split.withColumn(name, F.explode(F.coalesce("_words", F.array(name)))).drop("_token", "_words")


def segment(distinct: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Words of every token in ``_token``, as the array ``_words``.

    Parts of a token travel with its hash instead of the token, so the work grows with its length alone.
    """
    longest = F.coalesce(dictionary.agg(F.max(F.length("word"))).scalar(), F.lit(1))
    marked = distinct.withColumns(
        {"_key": F.sha2("_token", 256), "_chars": F.expr(_CHARS.format(token="_token")), "_sizes": F.sequence(F.lit(1), longest)}
    )

    def parts(_char: Column, i: Column) -> Column:
        """The words that may begin at a place, as far as the token goes."""
        inside = F.filter("_sizes", lambda size: i + size <= F.size("_chars"))
        return F.transform(
            inside,
            lambda size: F.struct(
                (i + 1).alias("_at"), size.alias("_size"), F.array_join(F.slice("_chars", i + 1, size), "").alias("_part")
            ),
        )

    at = marked.select("_key", F.explode(F.flatten(F.transform("_chars", parts))).alias("_p")).select("_key", "_p.*")
    known = at.join(
        dictionary.select(F.lower("word").alias("_word")).distinct(), F.col("_part") == F.col("_word"), "left_semi"
    )
    best = known.groupBy("_key", "_at").agg(F.max("_size").alias("_size"))
    places = F.struct(F.col("_at").alias("at"), F.col("_size").alias("size"))
    found = best.groupBy("_key").agg(F.array_sort(F.collect_list(places)).alias("_found"))
    kept = marked.join(found, "_key", "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<struct<at:int,size:int>>")))
    return kept.select("_token", F.expr(_TAKEN.format(found="_found", chars="_chars")).alias("_words"))


def register(spark: SparkSession, dictionary: DataFrame | None = None) -> None:
    """``LATERAL ik_analyze(text)`` in SQL: the letter and digit runs of a text, with a dictionary its words inside tokens with
    Han characters, as ``keywords`` gives them.

    The dictionary becomes a table of buckets (see ``word_table``) that every task has; it is read when a query is run.
    """
    runs = f"regexp_extract_all(lower(text), r'{WORD}', 0)"
    if dictionary is None:
        body = f"SELECT explode({runs})"
    else:
        word_table(dictionary).createOrReplaceTempView(DICTIONARY_VIEW)
        chars, table = _CHARS.format(token="token"), "words"
        taken = _TAKEN.format(found=_LONGEST.format(chars="chars", table=table), chars="chars")
        body = f"""
            SELECT explode(if(token RLIKE r'{HAN_RUN}', {taken}, array(token)))
            FROM (SELECT token, {chars} AS chars, (SELECT words FROM {DICTIONARY_VIEW}) AS words FROM (SELECT explode({runs}) AS token))
        """
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ik_analyze(text STRING) RETURNS TABLE (word STRING) RETURN {body}")
