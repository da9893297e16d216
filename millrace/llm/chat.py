"""Conversations as one text with turn marks and a loss mask, by Spark expressions alone.

    <|im_start|>role LINE BREAK text<|im_sep|>text ... <|im_end|> LINE BREAK

A block holds the adjacent turns of one role, a separator between their texts. Inside roles and texts every ``<|`` is
written ``<||``, so that no control string can stand there and reading back is exact; a line break in a role is written
``<|nl|>``. The masks of a block are the parts of it, in code points, that a model is to learn: each text of an assistant turn,
without the separators between them.

A conversation becomes one value, so it is gathered in one row; its turns are sorted there by turn, role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
ROLE_BREAK = "<|nl|>"
LEARNED = "assistant"

_TURN = "array<struct<role:string,texts:array<string>>>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ROLE_BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ROLE_BREAK), F.lit("\n")))


def _merged(turns: Column) -> Column:
    """Blocks of adjacent turns with one role: (role, texts).

    A block begins where the role differs from the turn before; its texts are a slice of the sorted turns.
    """
    count = F.size(turns)
    places = F.filter(
        F.transform(turns, lambda turn, i: F.when((i == 0) | (turn["role"] != F.get(turns, i - 1)["role"]), i)),
        lambda place: place.isNotNull(),
    )
    ends = F.concat(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), F.array(count))
    return F.transform(
        F.arrays_zip(places.alias("first"), ends.alias("last")),
        lambda run: F.struct(
            F.get(turns, run["first"])["role"].alias("role"),
            F.transform(F.slice(turns, run["first"] + 1, run["last"] - run["first"]), lambda turn: turn["text"]).alias("texts"),
        ),
    )


def format_conversations(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: key, ``formatted``, ``masks`` (for each block the start and length of each learned text in it,
    in code points; none where nothing is learned) and ``n_turns``.

    A null text or role is empty. Rows that tie in ``order`` go by role and text; a null order comes first; repeated rows
    are turns of their own. Rows with a null key are one conversation. Other columns are left out.
    """
    row = F.struct(
        F.col(order).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    gathered = turns.groupBy(F.col(key)).agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    blocks = gathered.select(key, F.size("_turns").cast("long").alias("n_turns"), _merged(F.col("_turns")).alias("_blocks"))

    def head(block: Column) -> Column:
        return F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n"))

    def body(block: Column) -> Column:
        return F.array_join(F.transform(block["texts"], escape), SEPARATOR)

    def mask(block: Column) -> Column:
        spans = F.array().cast("array<struct<start:int,length:int>>")
        start = F.struct(F.char_length(head(block)).alias("next"), spans.alias("spans"))

        def add(sofar: Column, text: Column) -> Column:
            length = F.char_length(escape(text))
            span = F.struct(sofar["next"].alias("start"), length.alias("length"))
            return F.struct(
                (sofar["next"] + length + len(SEPARATOR)).alias("next"), F.concat(sofar["spans"], F.array(span)).alias("spans")
            )

        learned = F.when(block["role"] == LEARNED, block["texts"]).otherwise(F.array().cast("array<string>"))
        return F.aggregate(learned, start, add, lambda sofar: sofar["spans"])

    return blocks.select(
        key,
        "n_turns",
        F.array_join(F.transform("_blocks", lambda block: F.concat(head(block), body(block), F.lit(END))), "").alias("formatted"),
        F.transform("_blocks", mask).alias("masks"),
    )


def read_blocks(formatted: Column) -> Column:
    """The blocks of a formatted conversation as they stand in it."""
    return F.filter(F.split(formatted, r"(?=<\|im_start\|>)"), lambda block: block != "")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""

    def turns(block: Column) -> Column:
        inner = F.substring(block, F.lit(len(START) + 1), F.char_length(block) - len(START) - len(END))
        role = F.substring_index(inner, "\n", 1)
        texts = F.split(F.substring(inner, F.char_length(role) + 2, F.char_length(inner)), r"<\|im_sep\|>")
        return F.transform(texts, lambda text: F.struct(unescape_role(role).alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(read_blocks(formatted), turns))


def read_learned(formatted: Column, masks: Column) -> Column:
    """The text under the masks, unescaped, the texts end to end."""

    def learned(pair: Column) -> Column:
        texts = F.transform(pair["mask"], lambda span: unescape(F.substring(pair["block"], span["start"] + 1, span["length"])))
        return F.array_join(texts, "")

    pairs = F.arrays_zip(read_blocks(formatted).alias("block"), masks.alias("mask"))
    return F.array_join(F.transform(pairs, learned), "")
