"""Toxicity of texts, read through disguises: a noisy channel undoes leetspeak, spacing and repetition, then restored words are scored.

1. A character trigram model is counted over the words of all documents (a table of 64**3 cells at most reaches the driver).
2. A token that looks disguised (marks or digits among letters, runs of one letter, letters set apart by spaces) becomes a lattice: each
   sign may stand for what it looks like, a run for one or two letters, a mark for nothing. Viterbi decoding over states of the last
   two letters finds the likeliest word under the character model and the channel's costs.
3. Words and their beginnings are features, with the share of toxic texts among the labelled texts that hold them, shrunk towards
   the overall share. A text's score is a logistic function of its two most toxic words, fitted on scores that halves of the
   labelled texts gave each other.

Labels are taken from a documented sample: MOST_LABELLED labelled documents at most, by a hash of the id, of those with
crc32(id) % 3 != 1; equal texts count once, and of the texts that these ids bring MOST_LABELLED at most, by a hash of the text. Every feature of them that
occurs in _LEAST_SUPPORT texts and tells toxic ones apart is kept: their number is bounded by the sample. Neither labels nor language, source or id are inputs of a score.

Defined results: a null or empty text has no words and gets the model's base score. Repeated rows are scored one by one; ids labelled twice count as two
labels. A null id is not held out. Without labels of both kinds every score is 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import give_back, let_workers_import
from pagewright.llm.pieces import slices, text_buffer

MOST_LABELLED = 20_000
THRESHOLD = 0.7
#: Lengths of beginnings of words that are features beside the words.
BEGINNINGS = (4, 5, 6)
_SHRINK = 8.0
_LEAST_SUPPORT = 3

# Letters of the model: 0 is the edge of a word, 1..26 are a..z, 27..58 are U+00E0..U+00FF, 59 is U+00DF, 60 any other letter.
LETTERS = 64
_OTHER = 60


def letter(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if "\xe0" <= c <= "\xff":
        return ord(c) - 0xE0 + 27
    return 59 if c == "\xdf" else _OTHER if c.isalpha() else 0


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Letters of ASCII bytes, and of the second byte behind 0xC3, upper case like lower."""
    one = np.array([letter(chr(b).lower()) if b < 128 else 0 for b in range(256)], np.int32)
    two = np.array([letter(chr(0xC0 + b - 0x80).lower()) if 0x80 <= b < 0xC0 else 0 for b in range(256)], np.int32)
    return one, two


_ONE, _TWO = _byte_tables()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        for part in slices(batch.column(0)):
            data, _ = text_buffer(part)
            codes = np.where(data[:-1] == 0xC3, _TWO[data[1:]], _ONE[data[:-1]])
            codes[(data[:-1] >= 0xC2) & (data[:-1] != 0xC3)] = _OTHER
            codes = np.concatenate([[0, 0], codes[(data[:-1] & 0xC0) != 0x80][:-3]])  # without the bytes behind the texts
            total += np.bincount(codes[:-2] * LETTERS**2 + codes[1:-1] * LETTERS + codes[2:], minlength=LETTERS**3)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])


def letter_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(c | a, b) as LETTERS**3 floats, from all texts; trigrams are mixed with bigrams and single letters."""
    let_workers_import(docs.sparkSession)
    # two edges behind each text, so that the counts are the same however texts are batched
    parts = docs.filter(F.col(text_col).isNotNull()).select(F.concat(F.col(text_col), F.lit("\n\n")).alias("text")).mapInArrow(_count_batches, "cell int, n long")
    counts = np.zeros(LETTERS**3)
    for cell, n in parts.groupBy("cell").agg(F.sum("n")).toLocalIterator():  # LETTERS ** 3 rows at most
        counts[cell] = n
    three = counts.reshape(LETTERS, LETTERS, LETTERS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + LETTERS)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (three + 20 * p2) / (three.sum(axis=2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32).ravel()


# What a sign may stand for, with the channel's cost of each reading.
_LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "¥": "y", "µ": "u"}
_FILLERS = set(".-_*'’`~^ ,:;/\\=\"#%&)>[]{}·​‌‍﻿­")
_LOOK_COST, _DROP_COST, _ODD_COST, _LOST_COST = 1.0, 0.7, 3.0, 14.0


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character of the token: the readings and their costs."""
    out = []
    for m in re.finditer(r"(.)\1*", token.lower(), re.S):
        c, n = m.group(1), len(m.group(0))
        if c in _LEET:
            reads = [(x, _LOOK_COST + (4.0 if n > 1 else 0.0)) for x in _LEET[c]]
            reads += [(x * 2, _LOOK_COST) for x in _LEET[c]] if n > 1 else []
            reads.append(("", _LOST_COST))
        elif c in _FILLERS:
            reads = [("", _DROP_COST)]
        elif c.isalpha():
            reads = [(c, 0.0)] if n == 1 else [(c * 2, 0.0 if n == 2 else 0.7), (c, 4.0 if n == 2 else 0.5)]
        else:
            reads = [("", _ODD_COST)]
        out.append(reads)
    return out


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest word behind the token: Viterbi over the last two letters read."""
    paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for reads in lattice(token):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in paths.items():
            for text, cost in reads:
                x, y, s = a, b, score - cost
                for c in text:
                    k = letter(c)
                    s += float(model[(x * LETTERS + y) * LETTERS + k])
                    x, y = y, k
                held = after.get((x, y))
                if held is None or s > held[0]:
                    after[x, y] = (s, (path, text))
        paths = after
    best = max(paths.items(), key=lambda p: p[1][0] + float(model[(p[0][0] * LETTERS + p[0][1]) * LETTERS]))[1][1]
    out = []
    while best:
        best, text = best
        out.append(text)
    return "".join(reversed(out))


_TRIM = " .,;:?!\"'()[]{}<>«»„“”‚‘’…¿¡-"
_TRIM_FRONT = " .,;:?\"'[]{}<>«»„“”‚‘’…¿-"
_LETTER_RUN = re.compile(r"(.)\1\1")
#: Three or more single characters, each set apart by one white-space character.
_APART = re.compile(r"(?:(?<=\s)|\A)(?:\S[ \t]){2,}\S(?=\s|\Z)")


def readings(token: str, model: np.ndarray) -> list[str]:
    """The words that a token may stand for: itself and, if it looks disguised, what it is restored to."""
    low = token.lower()
    plain = low.strip(_TRIM)
    out = [plain] if plain else []
    if plain.isalpha():
        if _LETTER_RUN.search(plain):
            out.append(restore(plain, model))
        return out
    rest = low.lstrip(_TRIM_FRONT).rstrip(_TRIM)
    if any(map(str.isalpha, rest)):
        out.append(restore(rest, model))
    return out


def features(words: list[str]) -> set[str]:
    """Words as they are, beginnings with a mark."""
    return {x for w in words for x in (w, *(f"{w[:k]}~" for k in BEGINNINGS if len(w) >= k))}


#: What a token that isn't in the table gives.
_NOTHING = (0.0, "")


class Scorer:
    """Toxicity of tokens by a table of features, with the words that they are restored to; what it knows of tokens is bounded, in numbers and in characters."""

    def __init__(self, table: dict[str, float], model: np.ndarray, most: int = 1_000_000, most_chars: int = 32 << 20) -> None:
        self.table, self.model, self.most, self.most_chars, self.known, self.chars = table, model, most, most_chars, {}, 0
        self.longest = max(map(len, table), default=0)
        #: How words that the table may know begin.
        self.heads = {x[: BEGINNINGS[0]] for feature in table for x in (feature, feature.removesuffix("~"))}

    def token(self, token: str) -> tuple[float, str]:
        got = self.known.get(token)
        if got is None:
            self.chars += len(token)
            if len(self.known) >= self.most or self.chars > self.most_chars:
                self.known.clear()
                self.chars = len(token)
            table, words = self.table, readings(token, self.model)
            words = [w for w in words if w[: BEGINNINGS[0]] in self.heads]
            score = max((table.get(x, 0.0) for x in features(words)), default=0.0) if words else 0.0
            got = self.known[token] = (score, words[-1]) if score else _NOTHING
        return got

    def apart(self, run: str) -> tuple[float, str]:
        """A run of single characters: what it is restored to, from each of its places on; of equal scores a whole word's, then the longest word's."""
        signs = run.split()
        if not sum(map(str.isalpha, signs)) * 2 >= len(signs):
            return _NOTHING
        word = restore("".join(signs), self.model)
        table, found = self.table, []
        for i in range(len(word) - 2):
            rest = word[i : i + self.longest + 12]  # beyond it, no word of the table can be what is left
            found += [(x, True, len(w), w) for w in (rest, *(rest[:k] for k in range(4, 13) if k < len(word) - i)) if (x := table.get(w))]
            found += [(x, False, len(rest), rest) for k in (5, 6) if len(rest) >= k and (x := table.get(f"{rest[:k]}~"))]
        score, _, _, best = max(found, default=(0.0, False, 0, ""))
        return (score, best) if score else _NOTHING

    def top_two(self, text: str) -> tuple[float, float]:
        """The scores of the two most toxic words; a word counts once, however it is written."""
        found = set(map(self.token, set(text.split())))
        if _APART.search(text):
            found |= {self.apart(m.group(0)) for m in _APART.finditer(text)}
        found.discard(_NOTHING)
        words: dict[str, float] = {}
        for score, word in found:
            words[word] = max(score, words.get(word, 0.0))
        best = sorted(words.values(), reverse=True)[:2]
        return (*best, 0.0, 0.0)[:2]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights with the intercept first, by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    penalty = np.diag([1e-3, *[ridge] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _feature_batches(model: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic, half -> a row for each feature of each text"""
    for batch in batches:
        texts, toxic, half = (batch.column(i).to_pylist() for i in range(3))
        for at in range(0, len(texts), 50):
            rows = []
            for text, t, h in zip(texts[at : at + 50], toxic[at : at + 50], half[at : at + 50], strict=True):
                words = [w for x in set(text.split()) for w in readings(x, model)]
                rows += [(f, t, h) for f in features(words)]
            columns = [*zip(*rows, strict=True)] or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["feature", "toxic", "half"])


def _score_batches(table: dict[str, float], weights: list[float], model: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(table, model)
    for batch in batches:
        tops = np.array([scorer.top_two(x.as_py()) for x in batch.column(1)]).reshape(-1, 2)
        scores = 1 / (1 + np.exp(-(weights[0] + _logit(tops) @ np.array(weights[1:])))) if weights else np.zeros(len(tops))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
    del scorer
    give_back()


def least_rows(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows by order, whose first column is a hash. A bound for the hash, from the number of rows, leaves about as many in all partitions together; only these are sorted."""
    n = rows.count()
    if n <= most:
        return rows
    share = 1.1 * most / n
    while share < 1:
        few = rows.filter(F.col(order[0]) <= int(share * 2**64) - 2**63)
        if few.count() >= most:
            return few.orderBy(*order).limit(most)
        share *= 2
    return rows.orderBy(*order).limit(most)


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], list[float]]:
    """(toxicity of features, weights of the score)."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = least_rows(usable.distinct().withColumn("hash", F.xxhash64("doc_id")), ["hash", "doc_id", "toxic"], MOST_LABELLED).drop("hash")
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the sample has MOST_LABELLED rows of two numbers at most
    joined = texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["text", "toxic"]).select("text", "toxic", F.xxhash64("text").alias("hash"))
    drawn = joined.withColumn("half", F.pmod("hash", F.lit(2)).cast("int")).persist()
    try:
        known = drawn
        if drawn.count() > MOST_LABELLED:  # ids may repeat in docs: the sample's bound holds for texts, too
            last = least_rows(drawn.select("hash"), ["hash"], MOST_LABELLED).agg(F.max("hash")).first()[0]
            known = drawn.filter(F.col("hash") <= last)
        n, positive = known.agg(F.count("*"), F.sum("toxic")).first()
        if not n or positive in (0, n):
            return {}, []
        prior = positive / n
        known = known.select("text", "toxic", "half")
        each = known.mapInArrow(lambda batches: _feature_batches(model, batches), "feature string, toxic int, half int")
        sums = [F.sum(F.when(F.col("half") == h, v).otherwise(0)).alias(f"{k}{h}") for h in (0, 1) for k, v in (("t", F.col("toxic")), ("n", F.lit(1)))]
        summed = each.groupBy("feature").agg(*sums)
        share = (F.col("t0") + F.col("t1") + _SHRINK * prior) / (F.col("n0") + F.col("n1") + _SHRINK)
        kept = summed.filter((F.col("n0") + F.col("n1") >= _LEAST_SUPPORT) & (share > min(0.5, 2 * prior))).collect()  # bounded by the sample


        def shares(halves: tuple[int, ...]) -> dict[str, float]:
            counted = ((r.feature, sum(r[f"t{h}"] for h in halves), sum(r[f"n{h}"] for h in halves)) for r in kept)
            return {feature: (t + _SHRINK * prior) / (n + _SHRINK) for feature, t, n in counted if n}

        tables = [shares(halves) for halves in ((1,), (0,), (0, 1))]

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorers = [Scorer(x, model) for x in tables[:2]]
            for batch in batches:
                halves = batch.column(2).to_pylist()
                found = [scorers[h].top_two(x) for x, h in zip(batch.column(0).to_pylist(), halves, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64()), batch.column(1)], names=["a", "b", "toxic"])

        pairs = np.array(known.mapInArrow(tops, "a double, b double, toxic int").collect(), float)  # a row for each labelled text of the sample
    finally:
        drawn.unpersist()
    weights = fit_logistic(_logit(pairs[:, :2]), pairs[:, 2])
    return tables[2], weights.tolist()


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    let_workers_import(docs.sparkSession)
    model = letter_model(docs, text_col)
    table, weights = train(docs, labels, model, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(id_col).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _score_batches(table, weights, model, batches), f"doc_id {kind}, held_out boolean, score double, predicted int")
