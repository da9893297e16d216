"""Personal data by weak supervision, in Spark expressions alone.

Patterns propose candidate spans. Five labelers vote on each: the strict rule of its kind, a gazetteer, the words before it,
its edges and its make-up. Votes are gathered by pattern of votes, a small table; expectation-maximisation over that table
estimates how far each labeler is to be trusted and how likely each pattern is personal data. With these chances as soft
labels a naive Bayes classifier is trained on features of the spans, and has the last word. Spans that satisfy the strict
rule of their kind are always kept.

Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import tables

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LABELERS = 5
NO, SILENT, YES = 0, 1, 2
ROUNDS = 30
LEAST_CHANCE = 0.5
BLOCK = 256

# Patterns of the contract. They find the same spans as its text, but never go back over what they took, and an address can
# only begin where its run of characters begins or the last match ended, so their time grows with the text alone.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# More to vote on: addresses in disguise, numbers without a country, tokens of letters and digits.
HIDDEN_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
TOKEN = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{12,}+"

_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# Known endings, country codes, issuers and key prefixes. Fixed values.
_GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0*(?:0|10|127)\.|0*192\.0*168\.)",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65)",
    "phone": r"^\+?\(?(?:1|33|34|39|44|49)",
    "secret": r"^(?:AKIA|ASIA|ghp|xox|eyJ|sk)",
}
_CUES = {
    "email": r"(?i)(?:mail|contact|write|@)[^\p{L}]*$",
    "ip": r"(?i)(?:\bip|address|host|server|from)[^\p{L}]*$",
    "card": r"(?i)(?:card|visa|credit|pay|account)[^\p{L}]*$",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax)[^\p{L}]*$",
    "secret": r"(?i)(?:password|passwd|secret|token|key)[^\p{L}]*$",
}


@dataclass
class Proposal:
    kind: str
    pattern: str
    guard: Column  # a cheap test that no text with a match fails


def _proposals(text: Column) -> list[Proposal]:
    digit = text.rlike("[0-9]")
    return [
        Proposal("email", EMAIL, F.contains(text, F.lit("@"))),
        Proposal("ip", IP, digit),
        Proposal("card", CARD, digit),
        Proposal("phone", PHONE, F.contains(text, F.lit("+"))),
        Proposal("email", HIDDEN_EMAIL, text.rlike(r"[\[(]at[\])]")),
        Proposal("phone", LOCAL_PHONE, digit),
        Proposal("secret", TOKEN, digit),
    ]


# -- places ---------------------------------------------------------------------------------------------------


def with_matches(df: DataFrame, text: str, pattern: str, guard: Column, name: str) -> DataFrame:
    """Add all matches of a pattern as an array of (start, end, part).

    The text is split at the matches, so a match starts after the lengths of all parts and matches before it. These are
    summed in blocks. Every helper column is used twice in the next step, which keeps Spark from putting its expression
    in place of it, inside a lambda.
    """
    parts, found, lengths, sums = (f"_{name}_{c}" for c in ("parts", "found", "lengths", "sums"))
    none = F.array().cast("array<string>")
    df = df.withColumn("_guard", guard).withColumns(
        {
            found: F.when(F.col("_guard"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            parts: F.when(F.col("_guard"), F.split(text, pattern, -1)).otherwise(none),
        }
    )
    df = df.drop("_guard").withColumns(
        {
            found: F.when(F.size(found) > 0, F.col(found)).otherwise(none),
            parts: F.when(F.size(parts) > 1, F.transform(parts, F.char_length)).otherwise(F.array().cast("array<int>")),
        }
    )
    both = F.zip_with(found, F.slice(parts, 1, F.greatest(F.size(found), F.lit(0))), lambda m, p: F.char_length(m) + p)
    df = df.withColumn(lengths, F.when(F.size(found) > 0, both).otherwise(F.array().cast("array<int>")))
    block = F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int"))
    add = lambda total, length: total + length
    in_block = F.transform(block, lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), F.lit(0), add))
    df = df.withColumn(sums, F.when(F.size(lengths) > 0, in_block).otherwise(F.array().cast("array<int>")))

    def place(match: Column, i: Column) -> Column:
        b = F.floor(i / BLOCK).cast("int")
        before = F.aggregate(F.slice(sums, 1, b), F.lit(0), add)
        within = F.aggregate(F.slice(lengths, b * BLOCK + 1, i - b * BLOCK), F.lit(0), add)
        start = before + within + F.get(parts, i)
        return F.struct(start.alias("start"), (start + F.char_length(match)).alias("end"), match.alias("part"))

    spans = F.when((F.size(sums) > 0) & (F.size(parts) > 0), F.transform(found, place))
    empty = F.array().cast("array<struct<start:int,end:int,part:string>>")
    return df.withColumn(name, F.coalesce(spans, empty)).drop(parts, found, lengths, sums)


def _luhn(part: Column) -> Column:
    digits = F.reverse(F.regexp_replace(part, "[^0-9]", ""))
    places = F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1)))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.coalesce(F.when(digit > 9, digit - 9).otherwise(digit), F.lit(0))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def strict(kind: str, part: Column) -> Column:
    """The rule of the contract for a match of the kind's own pattern."""
    digits = F.char_length(F.regexp_replace(part, "[^0-9]", ""))
    if kind == "ip":
        return part.rlike(rf"^0*{_BYTE}(?:\.0*{_BYTE}){{3}}$")
    if kind == "card":
        return digits.between(13, 19) & _luhn(part)
    if kind == "phone":
        return digits.between(9, 15)
    return F.lit(kind == "email")


# -- votes ----------------------------------------------------------------------------------------------------


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, YES).when(no, NO).otherwise(SILENT)


def candidates(documents: DataFrame) -> DataFrame:
    """Spans to be judged: (id, tag, kind, start, end, base, votes, features), from rows (id, tag, text)."""
    def entries(name: str, kind: str, own: bool) -> Column:
        def entry(span: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["part"].alias("part"),
                (strict(kind, span["part"]) if own else F.lit(False)).alias("base"), F.lit(own).alias("own"),
                # What stands around it, a few characters.
                F.substring("text", F.greatest(span["start"] - 23, F.lit(1)), F.least(span["start"], F.lit(24))).alias("before"),
                F.substring("text", span["end"] + 1, F.lit(1)).alias("after"),
            )

        return F.transform(name, entry)

    df = documents
    listed = []
    for number, proposal in enumerate(_proposals(F.col("text"))):
        name = f"_spans{number}"
        df = with_matches(df, "text", proposal.pattern, proposal.guard, name)
        listed.append(entries(name, proposal.kind, number < len(BASE_KINDS)))
    spans = df.select("id", "tag", F.explode(F.concat(*listed)).alias("s")).select("id", "tag", "s.*")
    def by_kind(patterns: dict[str, str], column: str) -> Column:
        return F.coalesce(*[F.when(F.col("kind") == kind, F.col(column).rlike(p)) for kind, p in patterns.items()])

    # What the strict rule of its kind throws out is looked at again only where a word before it speaks for it.
    spans = spans.filter(F.col("base") | ~F.col("own") | by_kind(_CUES, "before"))
    digits = F.char_length(F.regexp_replace("part", "[^0-9]", ""))
    share = digits / F.char_length("part")
    edges = ~F.col("before").rlike(r"[\p{L}\p{N}]$") & ~F.col("after").rlike(r"[\p{L}\p{N}]")
    made = F.when(F.col("kind") == "email", F.col("part").rlike("[A-Za-z]")).when(
        F.col("kind") == "secret", F.col("part").rlike("[A-Za-z]") & (digits >= 3)
    ).otherwise(share >= 0.6)
    known = by_kind(_GAZETTEER, "part")
    votes = F.array(
        _vote(F.col("base"), F.col("own")),
        _vote(known, F.col("kind").isin("card", "ip") & ~known),
        _vote(by_kind(_CUES, "before"), F.lit(False)),
        _vote(edges, ~edges),
        _vote(made, ~made),
    )
    size = F.least(F.floor(F.char_length("part") / 4), F.lit(10))
    features = F.array(
        F.concat(F.lit("size "), size), F.concat(F.lit("digits "), F.floor(share * 5)),
        F.concat(F.lit("strict "), F.col("base")), F.concat(F.lit("own "), F.col("own")),
        F.concat(F.lit("known "), known), F.concat(F.lit("edges "), edges),
        F.concat(F.lit("cue "), by_kind(_CUES, "before")),
        F.concat(F.lit("mark "), F.col("part").rlike("[^A-Za-z0-9]")),
    )
    return spans.select("id", "tag", "kind", "start", "end", "base", votes.alias("votes"), features.alias("features"))


# -- learning -------------------------------------------------------------------------------------------------


def reliabilities(voted: DataFrame) -> DataFrame:
    """(kind, votes, chance): how likely a pattern of votes is personal data, by expectation-maximisation for each kind.

    A kind has 3 ** LABELERS patterns at most, so they are one small array, and the rounds are a fold over it.
    """
    counted = voted.groupBy("kind", "votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    gathered = counted.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    places = F.sequence(F.lit(0), F.lit(3 * LABELERS - 1))

    def chance(state: Column, votes: Column) -> Column:
        def total(prior: Column, table: str) -> Column:
            return F.aggregate(
                F.sequence(F.lit(0), F.lit(LABELERS - 1)), F.log(prior),
                lambda sofar, i: sofar + F.log(F.get(state[table], i * 3 + F.get(votes, i))),
            )

        return 1 / (1 + F.exp(total(1 - state["prior"], "no") - total(state["prior"], "yes")))

    def step(state: Column, _round: Column) -> Column:
        weighed = F.transform(
            "patterns",
            lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), chance(state, p["votes"]).alias("q")),
        )
        return F.struct(weighed.alias("w"))

    def share(weighed: Column, weight) -> Column:
        """Smoothed part of each vote of each labeler in the rows, weighed."""
        whole = F.aggregate(weighed, F.lit(0.0), lambda sofar, w: sofar + weight(w))

        def part(i: Column) -> Column:
            votes = F.aggregate(
                weighed, F.lit(0.0),
                lambda sofar, w: sofar + F.when(F.get(w["votes"], F.floor(i / 3).cast("int")) == i % 3, weight(w)).otherwise(0.0),
            )
            return (votes + 1.0) / (whole + 3.0)

        return F.transform(places, part)

    def maximise(weighed: Column) -> Column:
        n = F.aggregate(weighed, F.lit(0.0), lambda sofar, w: sofar + w["n"])
        yes = F.aggregate(weighed, F.lit(0.0), lambda sofar, w: sofar + w["n"] * w["q"])
        return F.struct(
            ((yes + 1.0) / (n + 2.0)).alias("prior"),
            share(weighed, lambda w: w["n"] * w["q"]).alias("yes"),
            share(weighed, lambda w: w["n"] * (1 - w["q"])).alias("no"),
        )

    # At first labelers are taken to be right more often than not.
    like = F.transform(places, lambda i: F.when(i % 3 == YES, 0.6).when(i % 3 == SILENT, 0.25).otherwise(0.15))
    unlike = F.transform(places, lambda i: F.when(i % 3 == YES, 0.2).when(i % 3 == SILENT, 0.4).otherwise(0.4))
    start = F.struct(F.lit(0.5).alias("prior"), like.alias("yes"), unlike.alias("no"))
    # One element holds the weighed patterns, so that both parts of the maximisation use what was computed once.
    fold = lambda state, i: F.get(F.transform(F.array(step(state, i)), lambda s: maximise(s["w"])), 0)
    learned = gathered.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, fold))
    told = F.transform(
        "patterns", lambda p: F.struct(p["votes"].alias("votes"), chance(F.col("state"), p["votes"]).alias("chance"))
    )
    return learned.filter(F.size("patterns") > 0).select("kind", F.explode(told).alias("p")).select("kind", "p.*")


def classifier(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Naive Bayes from rows (kind, features, chance): (kind, feature, weight) and (kind, constant)."""
    yes, no = F.sum("chance"), F.sum(1 - F.col("chance"))
    totals = labelled.groupBy("kind").agg(yes.alias("yes"), no.alias("no"))
    shares = labelled.select("kind", F.explode("features").alias("feature"), "chance").groupBy("kind", "feature")
    shares = shares.agg(yes.alias("f_yes"), no.alias("f_no")).join(totals, "kind")
    weight = F.log((F.col("f_yes") + 1) / (F.col("yes") + 2)) - F.log((F.col("f_no") + 1) / (F.col("no") + 2))
    constant = F.log((F.col("yes") + 1) / (F.col("no") + 1))
    return shares.select("kind", "feature", weight.alias("weight")), totals.select("kind", constant.alias("constant"))


def find(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chance: float = LEAST_CHANCE
) -> DataFrame:
    """Of every document: its id, ``tag`` (hash of its text) and ``spans``: (kind, start, end, base, chance), by kind as in
    KINDS and then by start.

    A null text is empty. Rows equal in id and text are judged once and returned as often as they come; a null id is an id.
    Spans of different kinds may overlap; added ones never overlap a base span of their own kind. Other columns are left out.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    documents = documents.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    found = tables.keep(candidates(documents).dropDuplicates(["id", "tag", "kind", "start", "end"]), "pii-spans")
    chances = tables.keep(reliabilities(found), "pii-chances")  # at most 3 ** LABELERS rows a kind
    weights, constants = classifier(found.join(F.broadcast(chances), ["kind", "votes"]))
    # A few dozen features a kind: bounded by how ``candidates`` cuts them.
    weights, constants = tables.keep(weights, "pii-weights"), tables.keep(constants, "pii-constants")
    key = ["id", "tag", "kind", "start", "end", "base"]
    scored = found.select(*key, F.explode("features").alias("feature")).join(F.broadcast(weights), ["kind", "feature"])
    scored = scored.groupBy(*key).agg(F.sum("weight").alias("sum")).join(F.broadcast(constants), "kind")
    chance = 1 / (1 + F.exp(-(F.col("sum") + F.col("constant"))))
    judged = scored.withColumn("chance", chance).filter(F.col("base") | (F.col("chance") >= least_chance))

    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(order.alias("order"), "start", "end", "kind", "base", "chance")
    of_text = judged.groupBy("id", "tag").agg(F.sort_array(F.collect_list(span)).alias("_spans"))
    of_text = of_text.withColumnsRenamed({"id": "_id", "tag": "_tag"})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))

    def apart(s: Column) -> Column:
        clash = F.exists("_spans", lambda b: b["base"] & (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return s["base"] | ~clash

    fields = ("kind", "start", "end", "base", "chance")
    kept = F.transform(F.filter("_spans", apart), lambda s: F.struct(*[s[field].alias(field) for field in fields]))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,chance:double>>")
    out = documents.select("id", "tag").join(of_text, same, "left")
    return out.select(F.col("id").alias(id_column), "tag", F.coalesce(kept, empty).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first one stands for all."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))

    def add(sofar: Column, s: Column) -> Column:
        between = F.substring(text, sofar["end"] + 1, F.greatest(s["start"] - sofar["end"], F.lit(0)))
        written = F.concat(sofar["text"], between, F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(
            F.when(s["start"] < sofar["end"], sofar["text"]).otherwise(written).alias("text"),
            F.greatest(sofar["end"], s["end"]).alias("end"),
        )

    whole = F.aggregate(by_start, start, add, lambda sofar: F.concat(sofar["text"], F.substring(text, sofar["end"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
