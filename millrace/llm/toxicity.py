"""Toxic texts by support vector machines over a subsequence string kernel, with Nyström landmarks.

A unit is a word with whatever is glued to it, the same without marks, or a run of single characters read as one word. The kernel of two units
counts the three-character subsequences that they share; one that spans s characters weighs DECAY ** (s - 3), up to
MOST_SPAN, so inserted characters and gaps cost little. Values are divided by the norms of both units.

A span is a sentence, or SPAN_WORDS words of a long one. The kernel of two spans is the sum over all pairs of their words,
divided by their numbers of words.

Learning, spans: spans of labelled texts, each with the label of its row, teach a machine; spans of toxic texts that it finds
no worse than clean ones are left out, and it learns again. Words that are harmless alone count by what stands around them.

Learning, units: which words occur in more different surroundings of toxic texts than chance allows is counted by Spark over a
bounded sample of labelled rows; surroundings instead of occurrences, as copies of a text repeat its words but not new
neighbours. These words with gapped and filled-in variants stand against words of clean texts; the clean words that look worst to the
machine join them, and it learns again. Landmarks turn the kernel
into a linear machine, whose weights are folded back into one weight per subsequence: scoring a unit is a sparse sum.

Every unit and every span of a text is scored. Its three worst units and two worst spans, put into a logistic regression,
make the score of the text: one unit that merely looks like an insult does not condemn a text, several do. The regression
learns from rows that the machine of spans has not seen.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import tables, texts

DECAY = 0.6
MOST_SPAN = 6
UNIT_CHARS = 24
SYMBOLS = 64
TOXIC_ROWS = 4000
CLEAN_ROWS = 12000
MOST_INSULTS = 400
CLEAN_WORDS = 6000
TOXIC_WEIGHT = 2.0
HARD_WORDS = 2000
HARD_ROUNDS = 3
LANDMARKS = 300
WORST = 3
SPAN_WORDS = 32
LEAST_SPAN_WORDS = 8
WORST_SPANS = 2
TOXIC_SPANS = 6000
CLEAN_SPANS = 12000
BIAS = -1.0
EVIDENCE = 10.0
LEAST_INSULTS = 8
READ_BYTES = 2 << 20
SCORE_BYTES = 1 << 20
BLOCK_WORDS = 1024
SPANS_AT_ONCE = 512
LANDMARKS_AT_ONCE = 48
MOST_KNOWN = 100_000


@dataclass
class ToxicityModel:
    """Weight of each subsequence in units and in spans, and the logistic weights (the last one the constant) of the worst."""

    weights: np.ndarray
    of_spans: np.ndarray
    of_worst: list[float]


_MARKS = re.compile(r"[\W_]+")

# -- units ----------------------------------------------------------------------------------------------------


def units(text: str) -> set[str]:
    """Distinct units of a text: words as they stand and without the marks in them; a long one as overlapping parts."""
    words = text.lower().split()
    found = set(words)
    found.update([_MARKS.sub("", word) for word in found if not word.isalnum()])
    found.discard("")
    if any(len(word) > UNIT_CHARS for word in found):
        for word in [word for word in found if len(word) > UNIT_CHARS]:
            found.discard(word)
            step = UNIT_CHARS // 2
            found.update(word[start : start + UNIT_CHARS] for start in range(0, len(word) - step, step))
    if sum(len(word) == 1 for word in words) > 2:
        run: list[str] = []
        for word in [*words, ""]:
            if len(word) == 1:
                run.append(word)
                continue
            if len(run) > 2:
                joined = "".join(run)
                found.update(joined[start : start + UNIT_CHARS] for start in range(0, len(joined), UNIT_CHARS // 2))
            run = []
    return found


def spans(text: str) -> list[list[str]]:
    """Words without marks of every span of a text; a long word as overlapping parts. All of them are units of the text.

    A span has at most SPAN_WORDS words; what is more begins the next one.
    """
    found: list[list[str]] = []
    held: list[str] = []
    step = UNIT_CHARS // 2
    for word in text.lower().split():
        bare = word if word.isalnum() else _MARKS.sub("", word)
        if len(bare) > UNIT_CHARS:
            held.extend(bare[start : start + UNIT_CHARS] for start in range(0, len(bare) - step, step))
        elif bare:
            held.append(bare)
        while len(held) >= SPAN_WORDS:
            found.append(held[:SPAN_WORDS])
            held = held[SPAN_WORDS:]
        if held and word[-1] in ".!?":
            found.append(held)
            held = []
    if held:
        found.append(held)
    return found


def _symbol(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    if char.isalpha():
        return 27 + ord(char) % 33
    return 60 if char.isdigit() else 61


class _Symbols(dict):
    def __missing__(self, char: str) -> int:
        self[char] = value = _symbol(char)
        return value


_SYMBOL = _Symbols()


def _triples(length: int) -> np.ndarray:
    """Places of the subsequences of a unit of this length."""
    places = [
        (first, first + second, first + third)
        for first in range(length)
        for second, third in combinations(range(1, MOST_SPAN), 2)
        if first + third < length
    ]
    return np.array(places, np.int64).reshape(-1, 3)


_TRIPLES: dict[int, np.ndarray] = {}
# Weight of a subsequence by the distance from its first to its last place; 7 is the most that three bits hold.
_DECAYED = DECAY ** (np.arange(8) - 2.0)


def _subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (places in ``words``, a row of subsequence codes for each, the distance that each column spans)."""
    by_length: dict[int, list[int]] = {}
    for place, word in enumerate(words):
        by_length.setdefault(len(word), []).append(place)
    symbol = _SYMBOL.__getitem__
    for length, all_places in by_length.items():
        if length + 2 not in _TRIPLES:
            _TRIPLES[length + 2] = _triples(length + 2)
        triples = _TRIPLES[length + 2]
        for start in range(0, len(all_places), BLOCK_WORDS):
            places = all_places[start : start + BLOCK_WORDS]
            chars = np.zeros((len(places), length + 2), np.int32)
            joined = "".join([words[place] for place in places])
            chars[:, 1:-1] = np.fromiter(map(symbol, joined), np.int32, len(joined)).reshape(len(places), length)
            codes = (chars[:, triples[:, 0]] << 12) | (chars[:, triples[:, 1]] << 6) | chars[:, triples[:, 2]]
            yield np.array(places), codes, (triples[:, 2] - triples[:, 0]).astype(np.int32)


def _sorted_codes(codes: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of every row in order, their weights, and which of them are the last of a run of equal codes."""
    # A code and its distance in one number, so that sorting moves both.
    held = np.sort((codes << 3) | spread, axis=1)
    codes = held >> 3
    last = np.ones(codes.shape, bool)
    last[:, :-1] = codes[:, 1:] != codes[:, :-1]
    return codes, _DECAYED[held & 7], last


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (places in ``words``, subsequence codes, weights divided by the norm); equal codes of a unit are summed.

    A code that repeats has its whole weight at its last place and 0 elsewhere.
    """
    for places, codes, spread in _subsequences(words):
        codes, weights, last = _sorted_codes(codes, spread)
        total = np.cumsum(weights, axis=1)
        # The sum up to the end of a run of equal codes, less the sum up to the end of the run before.
        ends = np.where(last, total, 0.0)
        before = np.zeros_like(ends)
        before[:, 1:] = np.maximum.accumulate(ends, axis=1)[:, :-1]
        weights = np.where(last, total - before, 0.0)
        norm = np.sqrt((weights**2).sum(axis=1, keepdims=True))
        yield places, codes, weights / np.maximum(norm, 1e-12)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of every word with every landmark; a few landmarks at a time, as each has a weight for every code."""
    values = np.zeros((len(words), len(landmarks)))
    for start in range(0, len(landmarks), LANDMARKS_AT_ONCE):
        part = landmarks[start : start + LANDMARKS_AT_ONCE]
        table = np.zeros((SYMBOLS**3, len(part)), np.float32)
        for places, codes, weights in features(part):
            np.add.at(table, (codes, places[:, None]), weights)
        for places, codes, weights in features(words):
            sums = np.zeros((len(places), len(part)))
            for column in range(codes.shape[1]):
                sums += weights[:, column, None] * table[codes[:, column]]
            values[places, start : start + len(part)] = sums
    return values


def margins(model: ToxicityModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Margin of every word as a unit, and what it adds to a span."""
    values, added = np.full(len(words), BIAS), np.zeros(len(words))
    for places, codes, spread in _subsequences(words):
        if not codes.size:
            continue
        # Only the norm needs equal codes summed: the rest is a sum over all of them.
        _, weights, last = _sorted_codes(codes, spread)
        ends = np.flatnonzero(last)
        sums = np.add.reduceat(weights.ravel(), np.append(0, ends[:-1] + 1))
        norm = np.sqrt(np.bincount(ends // codes.shape[1], weights=sums**2, minlength=len(places)))
        norm = np.maximum(norm, 1e-12)
        values[places] += model.weights[codes] @ _DECAYED[spread] / norm
        added[places] += model.of_spans[codes] @ _DECAYED[spread] / norm
    return values, added


# -- learning -------------------------------------------------------------------------------------------------


def _parts(word: Column) -> Column:
    """The word, a long one as overlapping parts."""
    step = UNIT_CHARS // 2
    starts = F.sequence(F.lit(0), F.char_length(word) - step - 1, F.lit(step))
    long = F.transform(F.when(F.char_length(word) > UNIT_CHARS, starts), lambda start: F.substring(word, start + 1, F.lit(UNIT_CHARS)))
    return F.when(F.char_length(word) > UNIT_CHARS, long).otherwise(F.array(word))


def labelled_words(sample: DataFrame) -> DataFrame:
    """(word, toxic surroundings, clean surroundings) of labelled texts (toxic, text): words as scoring takes them for units.

    The words around it stand for themselves as hashes.
    """
    words = F.filter(F.split(F.lower("text"), "\\s+"), lambda word: word != "")
    at = sample.select("toxic", words.alias("words")).select(
        "toxic",
        F.explode(
            F.transform(
                "words",
                lambda word, i: F.struct(
                    word.alias("word"),
                    F.xxhash64(F.when(i > 0, F.get("words", i - 1)), F.get("words", i + 1)).alias("around"),
                ),
            )
        ).alias("at"),
    ).select("toxic", "at.*")
    surroundings = at.groupBy("word", "around", "toxic").agg(F.lit(1).alias("n"))
    toxic = F.col("toxic") == 1
    counted = surroundings.groupBy("word").agg(F.count_if(toxic).alias("in_toxic"), F.count_if(~toxic).alias("in_clean"))
    # Each distinct word is taken apart once; what several words have in common adds up.
    bare = F.regexp_replace("word", r"[^\p{L}\p{N}]+", "")
    forms = F.when(bare == F.col("word"), _parts(F.col("word"))).otherwise(F.array_union(_parts(F.col("word")), _parts(bare)))
    units_ = counted.select("in_toxic", "in_clean", F.explode(forms).alias("word")).filter("word <> ''")
    return units_.groupBy("word").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_clean").alias("in_clean"))


def variants(word: str, seed: int) -> list[str]:
    """The word with characters inserted between some or all of its own."""
    chance = random.Random(f"{word}/{seed}")
    every, some, foreign = ".-*_~", "·.'", "xqzh"
    mark = chance.choice(every)
    gapped = mark.join(word)
    cut = chance.randrange(1, max(2, len(word)))
    return [
        gapped[:UNIT_CHARS],
        word[:cut] + chance.choice(some) + word[cut:],
        word[:cut] + chance.choice(foreign) + word[cut:],
        word + chance.choice("!?.,"),
    ]


def _machine(points: np.ndarray, signs: np.ndarray, sizes: np.ndarray, ridge: float) -> np.ndarray:
    """Weights that minimise squared hinge loss, by Newton steps whose matrices are summed block by block.

    The bias is fixed at BIAS: a unit that shares nothing with any landmark is clean, whatever script it is in.
    """
    weights = np.zeros(points.shape[1])
    wanted = signs - BIAS
    for _ in range(30):
        matrix, right = ridge * np.eye(len(weights)), np.zeros(len(weights))
        for start in range(0, len(points), BLOCK_WORDS):
            part = slice(start, start + BLOCK_WORDS)
            held = points[part].astype(np.float64)
            inside = signs[part] * (held @ weights + BIAS) < 1
            held, scaled = held[inside], sizes[part][inside]
            matrix += (held * scaled[:, None]).T @ held
            right += held.T @ (scaled * wanted[part][inside])
        fresh = np.linalg.solve(matrix, right)
        if np.abs(fresh - weights).max() < 1e-8:
            break
        weights = fresh
    return weights


def _fit(insults: list[str], clean: list[str], landmarks: int) -> np.ndarray:
    positive = list(dict.fromkeys([*insults, *(v for word in insults for v in variants(word, 7))]))
    known = set(positive)
    negative = [word for word in dict.fromkeys(clean) if word not in known]
    words = positive + negative
    signs = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    # One clean word too many hurts more than a variant that is missed: a text has hundreds of clean words.
    sizes = np.where(signs > 0, 1.0 / max(1, len(positive)), 3.0 / max(1, len(negative)))
    most = 2 * landmarks // 3
    chosen = insults[:: -(-len(insults) // most)]
    chosen = chosen + negative[:: max(1, len(negative) // max(1, landmarks - len(chosen)))]
    values, vectors = np.linalg.eigh(kernel(chosen, chosen))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    solved = _machine(kernel(words, chosen) @ root, signs, sizes * len(words), ridge=0.05)
    of_landmark = root @ solved
    weights = np.zeros(SYMBOLS**3)
    for places, codes, shares in features(chosen):
        np.add.at(weights, codes, shares * of_landmark[places][:, None])
    return weights


def _hardest(harmless: DataFrame, of_units: np.ndarray, most: int) -> list[str]:
    """The words of clean texts that look most like insults to a machine: what it should learn next."""
    shared = tables.share(harmless.sparkSession, ToxicityModel(of_units, np.zeros(SYMBOLS**3), []))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared()
        for batch in batches:
            told = margins(learned, batch.column("word").to_pylist())[0]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(told)], names=["word", "margin"])

    scored = tables.map_batches(harmless.select("word"), each, "word string, margin double")
    return [row.word for row in scored.orderBy(F.desc("margin"), "word").limit(most).collect()]


def labelled_spans(sample: DataFrame, toxic_spans: int, clean_spans: int) -> DataFrame:
    """(toxic: label of the row, span: its words) of the first spans by hash, written; those of more than one row or place are
    one."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.in_pieces(batches, "text", READ_BYTES):
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts.strings(batch.column("text"))):
                found = [" ".join(words) for words in spans(text)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([toxic] * len(found), pa.int32()), pa.array(found, pa.string())], names=["toxic", "span"]
                )

    found = tables.map_batches(sample.select("toxic", "text"), each, "toxic int, span string").distinct()
    first = [
        found.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("span"), "span").limit(most)
        for toxic, most in ((1, toxic_spans), (0, clean_spans))
    ]
    return tables.keep(first[0].unionByName(first[1]), "toxicity-spans")


def _telling_words(found: DataFrame, landmarks: int) -> list[str]:
    """Landmarks: words of the spans that tell the labels apart best, and some of all others, evenly by the alphabet."""
    words = found.select("toxic", F.explode(F.split("span", " ")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("seen"), F.sum("toxic").alias("bad"))
    base = words.agg(F.avg("toxic")).first()[0]
    told = F.abs(F.col("bad") - base * F.col("seen")) / F.sqrt(F.col("seen") + 4.0)
    counted = tables.keep(counted.withColumn("told", told), "toxicity-span-words")
    most = 2 * landmarks // 3
    best = [row.word for row in counted.orderBy(F.desc("told"), "word").limit(most).select("word").collect()]
    others = counted.filter(~F.col("word").isin(best))
    # The lowest hashes of words are an even choice of them.
    rest = others.orderBy(F.xxhash64("word"), "word").limit(landmarks - len(best)).select("word").collect()
    return [*best, *(row.word for row in rest)]


def _pooled(found: DataFrame, chosen: list[str], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kernel values of every span with the landmarks, one row each, and its label; computed by the tasks of the spans.

    The driver holds ``len(chosen)`` floats for each of a bounded number of spans.
    """
    shared = tables.share(found.sparkSession, (chosen, root))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks, turn = shared()
        for whole in batches:
            for start in range(0, whole.num_rows, SPANS_AT_ONCE):
                batch = whole.slice(start, SPANS_AT_ONCE)
                many = [span.split(" ") for span in batch.column("span").to_pylist()]
                place = {word: i for i, word in enumerate(sorted({word for words in many for word in words}))}
                of_word = kernel(list(place), landmarks)
                sums = np.array([of_word[[place[word] for word in words]].sum(axis=0) for words in many])
                sizes = np.maximum([len(words) for words in many], LEAST_SPAN_WORDS)
                points = ((sums / sizes[:, None]) @ turn).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic"), pa.array([row.tobytes() for row in points], pa.binary())], names=["toxic", "point"]
                )

    parts = tables.shuffle_partitions(found.sparkSession)
    rows = tables.map_batches(found.repartition(parts), each, "toxic int, point binary").toArrow()
    plain = b"".join(rows["point"].to_pylist())
    return np.frombuffer(plain, np.float32).reshape(-1, len(chosen)), rows["toxic"].to_numpy() == 1


def _fit_spans(found: DataFrame, landmarks: int) -> np.ndarray:
    """One weight per subsequence of a machine that has learned spans with the labels of their rows."""
    weights = np.zeros(SYMBOLS**3)
    if found.select("toxic").distinct().count() < 2:
        return weights
    chosen = _telling_words(found, landmarks)
    values, vectors = np.linalg.eigh(kernel(chosen, chosen))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    points, toxic = _pooled(found, chosen, root)
    signs = np.where(toxic, 1.0, -1.0)

    def learn(kept: np.ndarray) -> np.ndarray:
        share = np.where(signs > 0, 0.5 / max(1, (toxic & kept).sum()), 0.5 / max(1, (~toxic & kept).sum()))
        return _machine(points, signs, np.where(kept, share * kept.sum(), 0.0), ridge=0.5)

    solved = learn(np.ones(len(points), bool))
    told_by = points @ solved
    # Not every span of a toxic text is toxic.
    worse = told_by > np.quantile(told_by[~toxic], 0.95)
    if (worse & toxic).sum() >= LEAST_INSULTS:
        solved = learn(~toxic | worse)
    of_landmark = root @ solved
    for places, codes, shares in features(chosen):
        np.add.at(weights, codes, shares * of_landmark[places][:, None])
    return weights


def _logistic(points: np.ndarray, labels: np.ndarray, ridge: float = 0.05, toxic_weight: float = TOXIC_WEIGHT) -> list[float]:
    """Weights and constant (last) of a logistic regression in which a toxic row counts ``toxic_weight`` times.

    No weight is negative, as a worse unit or span never makes a text better: what would be is left out, and the rest is
    fitted again.
    """
    used = np.ones(points.shape[1], bool)
    while True:
        fitted = _newton(points[:, used], labels, ridge, toxic_weight)
        if not used.any() or (fitted[:-1] >= 0).all():
            break
        used[np.flatnonzero(used)[np.argmin(fitted[:-1])]] = False
    weights = np.zeros(points.shape[1] + 1)
    weights[:-1][used], weights[-1] = fitted[:-1], fitted[-1]
    return weights.tolist()


def _newton(points: np.ndarray, labels: np.ndarray, ridge: float, toxic_weight: float) -> np.ndarray:
    """The regression itself, by damped Newton steps."""
    points = np.hstack([points, np.ones((len(points), 1))])
    sizes = np.where(labels == 1, toxic_weight, 1.0)
    weights = np.zeros(points.shape[1])
    for _ in range(100):
        chance = 1 / (1 + np.exp(-np.clip(points @ weights, -30, 30)))
        slope = points.T @ (sizes * (labels - chance)) - ridge * weights
        bend = (points * (sizes * chance * (1 - chance))[:, None]).T @ points + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights = weights + step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def train(
    labelled: DataFrame, order: Column | None = None, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS,
    insults: int = MOST_INSULTS, clean_words: int = CLEAN_WORDS, landmarks: int = LANDMARKS, hard_words: int = HARD_WORDS,
) -> ToxicityModel | None:
    """Learn from rows (text, toxic 0 or 1): at most ``toxic_rows`` and ``clean_rows`` of them, the first by ``order``.

    Rows with a null are left out. None without rows of both kinds.
    """
    order = F.xxhash64("text") if order is None else order
    usable = labelled.select("text", F.col("toxic").cast("int").alias("toxic"), order.alias("place"))
    usable = usable.filter("text IS NOT NULL AND toxic IN (0, 1)")
    sample = tables.first_rows(usable, "toxic", "place", {1: toxic_rows, 0: clean_rows})
    # The sample comes from a task for each kind of row; its words are counted by all.
    sample = sample.select("text", "toxic").repartition(tables.shuffle_partitions(labelled.sparkSession))
    sample = tables.keep(sample, "toxicity-sample")
    counted = tables.keep(labelled_words(sample), "toxicity-words")
    sums = counted.agg(F.sum("in_toxic"), F.sum("in_clean")).first()
    if not sums[0] or not sums[1]:
        return None
    base = sums[0] / (sums[0] + sums[1])
    share = F.col("in_toxic") / (F.col("in_toxic") + F.col("in_clean"))
    clean_part = F.when(share < 1, F.col("in_clean") * F.log((1 - share) / (1 - base))).otherwise(0)
    evidence = F.when(share > base, F.col("in_toxic") * F.log(share / base) + clean_part).otherwise(0)
    # Bounded by the two parameters.
    found = (
        counted.filter("in_toxic > 1").withColumn("evidence", evidence).filter(share > (1 + base) / 2)
        .orderBy(F.desc("evidence"), "word").limit(insults).collect()
    )
    strong = [row.word for place, row in enumerate(found) if row.evidence >= EVIDENCE or place < LEAST_INSULTS]
    common = counted.filter("in_clean > 0").orderBy(F.desc("in_clean"), "word").limit(clean_words // 3).collect()
    any_word = counted.filter("in_clean > 0 AND in_toxic = 0").orderBy(F.xxhash64("word"), "word").limit(clean_words).collect()
    clean = [row.word for row in [*common, *any_word] if row.in_clean]
    if not clean:
        return None
    second = F.pmod(F.xxhash64("text"), F.lit(2)) == 1
    of_spans = _fit_spans(labelled_spans(sample.filter(~second), TOXIC_SPANS, CLEAN_SPANS), landmarks)
    of_units = np.zeros(SYMBOLS**3)
    if strong:
        of_units = _fit(strong, clean, landmarks)
        harmless = counted.filter("in_clean > 0").filter(share <= (1 + base) / 2)
        for _ in range(HARD_ROUNDS):
            clean = [*clean, *_hardest(harmless, of_units, hard_words)]
            of_units = _fit(strong, clean, landmarks)
    model = ToxicityModel(of_units, of_spans, [])
    told = text_margins(sample.withColumn("second", second), model, "text").select("toxic", "second", "margins")
    told = told.collect()  # five numbers per row of the sample
    if len({row.toxic for row in told if row.second}) == 2:
        told = [row for row in told if row.second]
    model.of_worst = _logistic(np.array([row.margins for row in told]), np.array([row.toxic for row in told]))
    return model


# -- scoring --------------------------------------------------------------------------------------------------


class _Numbers(dict):
    """A number for each key, in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _places(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of these rows of a ragged table, and how many each row has."""
    starts, sizes = ends[rows], ends[rows + 1] - ends[rows]
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes), sizes


def _largest(values: np.ndarray, owners: np.ndarray, n: int, most: int) -> np.ndarray:
    """The largest values of each owner, falling, of ``n`` owners by whom the values are sorted; BIAS where there is none."""
    found = np.full((n, most), BIAS)
    if not len(values):
        return found
    values = values.copy()
    begins = np.flatnonzero(np.diff(owners, prepend=-1))
    for column in range(most):
        top = np.maximum.reduceat(values, begins)
        found[owners[begins], column] = np.where(np.isneginf(top), BIAS, top)
        # One value of each owner is used up, even if others equal it.
        at = np.flatnonzero(values == np.repeat(top, np.diff(begins, append=len(values))))
        values[at[np.diff(owners[at], prepend=-1) > 0]] = -np.inf
    return found


class TextScorer:
    """The worst units and spans of texts. A word is taken apart once, a unit is scored once, until there are MOST_KNOWN."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.words, self.units = _Numbers(), _Numbers()
        self.of_unit, self.added = np.zeros(0), np.zeros(0)
        # Of every word: its units, its parts in a span, whether it is one character or ends a sentence, how often it was seen.
        self.unit_ends, self.unit_list = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.part_ends, self.part_list = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.single, self.closing = np.zeros(0, bool), np.zeros(0, bool)
        self.seen = np.zeros(0, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        step, number = UNIT_CHARS // 2, self.units.__getitem__
        of_words: list[int] = []
        of_parts: list[int] = []
        unit_ends, part_ends = [], []
        for word in fresh:
            if len(word) <= UNIT_CHARS:
                of_words.append(unit := number(word))
                if word.isalnum():
                    of_parts.append(unit)
                elif bare := _MARKS.sub("", word):
                    of_parts.append(unit := number(bare))
                    of_words.append(unit)
            else:
                bare = _MARKS.sub("", word)
                of_words.extend(number(word[start : start + UNIT_CHARS]) for start in range(0, len(word) - step, step))
                if len(bare) <= UNIT_CHARS:
                    parts = [number(bare)] if bare else []
                else:
                    parts = [number(bare[start : start + UNIT_CHARS]) for start in range(0, len(bare) - step, step)]
                of_words.extend(parts)
                of_parts.extend(parts)
            unit_ends.append(len(of_words))
            part_ends.append(len(of_parts))
        self.unit_ends = np.append(self.unit_ends, np.array(unit_ends, np.int64) + len(self.unit_list))
        self.part_ends = np.append(self.part_ends, np.array(part_ends, np.int64) + len(self.part_list))
        self.unit_list = np.append(self.unit_list, np.array(of_words, np.int64))
        self.part_list = np.append(self.part_list, np.array(of_parts, np.int64))
        self.single = np.append(self.single, np.array([len(word) == 1 for word in fresh], bool))
        self.closing = np.append(self.closing, np.array([word[-1] in ".!?" for word in fresh], bool))

    def _trim(self) -> None:
        """Forget all but the short words that were seen most, if more than once."""
        words, units, told, added = list(self.words), self.units, self.of_unit, self.added
        often = np.argsort(-self.seen, kind="stable")[: MOST_KNOWN // 4]
        kept = [words[i] for i in often[self.seen[often] > 1].tolist() if len(words[i]) <= UNIT_CHARS]
        self._forget()
        self.words.update(zip(kept, range(len(kept))))
        self._learn(kept)
        at = np.fromiter(map(units.__getitem__, self.units), np.int64, len(self.units))
        self.of_unit, self.added, self.seen = told[at], added[at], np.zeros(len(kept), np.int64)

    def _runs(self, flat: list[str], single: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, unit) of the runs of single characters in a text."""
        at = np.flatnonzero(single)
        if not len(at):
            return
        begins = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(text_of[at], prepend=-1) > 0))
        sizes = np.diff(begins, append=len(at))
        for place, size in zip(at[begins[sizes > 2]].tolist(), sizes[sizes > 2].tolist()):
            joined = "".join(flat[place : place + size])
            for start in range(0, size, UNIT_CHARS // 2):
                yield int(text_of[place]), self.units[joined[start : start + UNIT_CHARS]]

    def worst(self, many: list[str]) -> np.ndarray:
        """A row per text: margins of its worst units, then of its worst spans; those of ``units`` and ``spans``."""
        if len(self.units) > MOST_KNOWN:
            self._trim()
        cut = [text.lower().split() for text in many]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = list(chain.from_iterable(cut))
        del cut
        known = len(self.words)
        words = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        self._learn(list(islice(self.words, known, None)))
        self.seen = np.append(self.seen, np.zeros(len(self.words) - known, np.int64)) + np.bincount(words, minlength=len(self.words))
        text_of = np.repeat(np.arange(len(many)), sizes)
        at, each = _places(self.unit_ends, words)
        owners, held = np.repeat(text_of, each), self.unit_list[at]
        runs = list(self._runs(flat, self.single[words], text_of))
        del flat
        if runs:
            more = np.array(runs, np.int64)
            owners, held = np.append(owners, more[:, 0]), np.append(held, more[:, 1])
        scored = len(self.of_unit)
        if len(self.units) > scored:
            told, added = margins(self.model, list(islice(self.units, scored, None)))
            self.of_unit, self.added = np.append(self.of_unit, told), np.append(self.added, added)
        # A unit counts once in a text.
        distinct = np.unique(owners * len(self.units) + held)
        of_units = _largest(self.of_unit[distinct % max(1, len(self.units))], distinct // max(1, len(self.units)), len(many), WORST)
        # A sentence ends with its text or with a mark; every SPAN_WORDS words of it are a span.
        at, each = _places(self.part_ends, words)
        if not len(at):
            return np.hstack([of_units, np.full((len(many), WORST_SPANS), BIAS)])
        ended = np.cumsum(self.closing[words]) - self.closing[words]
        sentence = np.repeat(ended + text_of, each)
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        within = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        begins = np.flatnonzero(within % SPAN_WORDS == 0)
        sums = np.bincount(np.cumsum(within % SPAN_WORDS == 0) - 1, weights=self.added[self.part_list[at]])
        margin = BIAS + sums / np.maximum(np.diff(begins, append=len(at)), LEAST_SPAN_WORDS)
        of_spans = _largest(margin, np.repeat(text_of, each)[begins], len(many), WORST_SPANS)
        return np.hstack([of_units, of_spans])


def text_margins(df: DataFrame, model: ToxicityModel, text_column: str = "text") -> DataFrame:
    """Add ``margins``: those of the worst units of a text, falling, then those of the worst spans; a unit or span that is
    missing has that of no subsequences."""
    shared = tables.share(df.sparkSession, model)  # one weight per subsequence: of fixed size

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        scorer = TextScorer(shared())
        for batch in texts.in_pieces(batches, text_column, SCORE_BYTES):
            worst = scorer.worst(texts.strings(batch.column(text_column)))
            ends = pa.array(np.arange(0, worst.size + 1, worst.shape[1], dtype=np.int32))
            yield batch, [pa.ListArray.from_arrays(ends, pa.array(worst.ravel()))]

    return tables.append(df, "margins array<double>", each)


def score(df: DataFrame, model: ToxicityModel | None, text_column: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 where the score reaches 0.5); columns of these names are replaced.

    Without a model every score is 0. A null or empty text has no units, so it scores as clean.
    """
    rest = df.drop("score", "predicted", "margins")
    if model is None:
        return rest.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    *weights, constant = model.of_worst
    sums = sum((F.get("margins", i) * weight for i, weight in enumerate(weights)), F.lit(constant))
    scored = text_margins(rest, model, text_column).withColumn("score", 1 / (1 + F.exp(-sums))).drop("margins")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
