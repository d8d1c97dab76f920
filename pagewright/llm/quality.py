"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Words are maximal runs of characters other than space and U+0009..U+000D. Each rule's cost and rejection rate are measured on a sample of documents:
its seconds over the sample, several times over and with compiled code, less those of a plan without a rule, the least of some runs. The rules
then run in the order of rejections per cost; a document leaves the cascade at the first rule that rejects it. The order changes the time, never
the verdict. ``judge`` has to give all counts of every document, so there rules read the counts and only what is left of their cost is measured.

The sample is drawn from all documents up to SAMPLED_ROWS; beyond that, files that a hash of their path chooses are sampled, so that
ordering the rules of a large table doesn't read it all a second time. (A frame that isn't a scan of files is sampled as a whole.)

Defined results: a null text counts as empty (0 words, so a base rule fails). Repeated rows are judged one by one. Rules of equal worth keep their
order. An empty table gives an empty result. Extra columns are kept by ``keep_good``, whatever their names, and ignored by ``judge``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import hidden, number_of, numbered, text_or_empty

_SPACES = " \t\n\x0b\f\r"
_TEXT, _TRIMMED, _WORDS, _N, _MASK, _LINES, _KEEP = (hidden(x) for x in ("text", "trimmed", "words", "n", "mask", "lines", "keep"))
#: About so many rows are looked at to draw the sample; of larger tables, some files.
SAMPLED_ROWS = 20_000_000
#: The sample is judged so many times over in a run, and the least of so many runs counts, behind one that compiles the code.
_TIMES, _RUNS = 4, 1


class Counts:
    """What rules are made of, as expressions over the frame that ``with_words`` makes; never null."""

    def n_words(self) -> Column:
        return F.col(_N)

    def word_chars(self) -> Column:
        return word_chars()

    def n_symbols(self) -> Column:
        return n_symbols()

    def lines(self) -> Column:
        return lines()

    def n_repeat_words(self) -> Column:
        return n_repeat_words()

    def letters(self) -> Column:
        return F.length(F.regexp_replace(_TEXT, r"\P{L}+", ""))


class Counted(Counts):
    """The same where the frame has the counts as columns."""

    def word_chars(self) -> Column:
        return F.col("word_chars")

    def n_symbols(self) -> Column:
        return F.col("n_symbols")

    def lines(self) -> Column:
        return F.col(_LINES)

    def n_repeat_words(self) -> Column:
        return F.col("n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects: gives a boolean column, never null, from the counts."""

    name: str
    rejects: Callable[[Counts], Column]


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the text, its words, their number, and a mask of the bits above those that a word's place takes, as helper columns."""
    trimmed = docs.withColumn(_TEXT, text_or_empty(text_col)).withColumn(_TRIMMED, F.btrim(_TEXT, F.lit(_SPACES)))
    words = trimmed.withColumn(_WORDS, F.split(F.col(_TRIMMED), r"[\x20\x09-\x0D]+"))
    n = F.when(F.col(_TRIMMED) == "", F.lit(0)).otherwise(F.size(_WORDS))
    numbered_ = words.withColumn(_N, F.coalesce(n, F.lit(0)).cast("long"))
    above = -F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.col(_N))))
    return numbered_.withColumn(_MASK, F.coalesce(above, F.lit(-1).cast("long")))


def word_chars() -> Column:
    return F.length(F.array_join(_WORDS, "")).cast("long")


def n_symbols() -> Column:
    return (F.length(_TEXT) - F.length(F.regexp_replace(_TEXT, r"[#*$%&|<>]", ""))).cast("long")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def lines() -> Column:
    """n: the lines with a word; dup: those equal to an earlier one."""
    worded = F.filter(F.split(F.col(_TEXT), "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    return _bound(worded, lambda own: F.struct(F.size(own).cast("long").alias("n"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("dup")))


def _sorted_windows() -> Column:
    """3-word windows as longs, sorted: a hash in the high bits, the window's position in the low bits.

    The array sort is one of primitives, so a document of n words costs n log n and no shuffle."""

    def windows(hashes: Column) -> Column:
        def packed(h: Column, i: Column) -> Column:
            return F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)).bitwiseAND(F.col(_MASK)).bitwiseOR(i.cast("long"))

        return F.sort_array(F.slice(F.transform(hashes, packed), F.lit(1), F.col(_N).cast("int") - 2))

    made = _bound(F.transform(_WORDS, lambda w: F.xxhash64(w)), windows)
    return F.when(F.col(_N) >= 3, made).otherwise(F.array().cast("array<bigint>"))


def n_repeat_words() -> Column:
    """Words in 3-word windows that occur at least twice in the text. Equal hashes are confirmed on the words."""
    return _bound(_sorted_windows(), _repeat_words)


def _repeat_words(windows: Column) -> Column:
    low = F.bitwise_not(F.col(_MASK))

    def same(x: Column, y: Column) -> Column:
        equal = x.bitwiseXOR(y).between(0, low)  # the high bits are equal
        for k in range(3):
            a, b = (F.get(_WORDS, (z.bitwiseAND(low) + k).cast("int")) for z in (x, y))
            equal = equal & (a == b)
        return equal

    twice = F.filter(windows, lambda x, i: same(x, F.get(windows, i - 1)) | same(x, F.get(windows, i + 1)))
    starts = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low)))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), x - acc["last"])).alias("n"), x.alias("last"))
    return F.aggregate(starts, start, step, lambda acc: acc["n"])


MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _too_short(c: Counts) -> Column:
    return c.n_words() < MIN_WORDS


def _repetitive(c: Counts) -> Column:
    return c.n_repeat_words() * 100 > c.n_words() * MAX_REPEAT_PERCENT


def _mean_word_length(c: Counts) -> Column:
    return _bound(c.word_chars(), lambda chars: (chars < c.n_words() * 2) | (chars > c.n_words() * 20))


def _many_symbols(c: Counts) -> Column:
    return c.n_symbols() * 10 > c.n_words()


def _many_dup_lines(c: Counts) -> Column:
    return _bound(c.lines(), lambda own: own["dup"] * 2 > own["n"])


def _few_letters(c: Counts) -> Column:
    return c.letters() * 2 < c.word_chars()


#: The base rules, whose verdict ``judge`` gives apart.
BASE_RULES: tuple[Rule, ...] = (Rule("too_short", _too_short), Rule("repetitive", _repetitive))
#: The production rules behind the base rules. All are about the text alone.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", _mean_word_length),
    Rule("symbols", _many_symbols),
    Rule("dup_lines", _many_dup_lines),
    Rule("few_letters", _few_letters),
)


def _sample(docs: DataFrame, sample_rows: int, text_col: str) -> DataFrame:
    rows = docs.count()
    some = docs.select(F.col(text_col).alias("text"))
    if rows > SAMPLED_ROWS:
        try:
            files = docs.filter(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(rows // SAMPLED_ROWS + 1)) == 0).select(F.col(text_col).alias("text"))
            if here := files.count():  # the filter leaves files unread, and the count reads no column
                some, rows = files, here
        except AnalysisException:  # not a scan of files
            pass
    # a little more than asked for, as the number drawn varies; the sample only decides the order
    return some.sample(fraction=min(1.0, 1.2 * sample_rows / max(1, rows)), seed=7)


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 300, text_col: str = "text", counted: bool = False, sample: DataFrame | None = None) -> list[Rule]:
    """Measures cost and rejections of each rule on a sample of about sample_rows rows; most rejections per second first."""
    if len(rules) < 2:
        return list(rules)
    drawn = sample if sample is not None else _sample(docs, sample_rows, text_col)
    counts = Counted() if counted else Counts()
    worded = with_words(drawn, "text")
    known = (_with_counts(worded) if counted else worded).persist()
    try:
        n = known.count()
        if not n:
            return list(rules)
        many = known.withColumn(_KEEP, F.explode(F.sequence(F.lit(1), F.lit(_TIMES))))

        def timed(rejects: Column) -> tuple[float, int]:
            """(the least seconds of some runs behind one that compiles the code, rejections)"""
            seconds = []
            for _ in range(_RUNS + 1):
                began = time.perf_counter()
                rejected = many.agg(F.count_if(rejects)).first()[0]
                seconds.append(time.perf_counter() - began)
            return min(seconds[1:]), rejected

        idle, _ = timed(F.col(_N) < 0)
        found = []
        for place, rule in enumerate(rules):
            cost, rejected = timed(rule.rejects(counts))
            # what is under a fiftieth of the idle plan can't be told from nothing
            found.append((-(rejected / _TIMES + 0.5) / n / max(cost - idle, idle / 50), place, rule))
    finally:
        known.unpersist()
    return [rule for _, _, rule in sorted(found, key=lambda x: x[:2])]


def _verdict(rules: Sequence[Rule], counts: Counts, base_failed: Column | None = None) -> Column:
    """CASE evaluates a condition only where all those before it were false."""
    kept = F.when(F.lit(False) if base_failed is None else base_failed, F.lit(False))
    for rule in rules:
        kept = kept.when(rule.rejects(counts), F.lit(False))
    return kept.otherwise(F.lit(True))


def _with_counts(worded: DataFrame) -> DataFrame:
    made = worded.withColumns({"n_words": F.col(_N), "word_chars": word_chars(), "n_symbols": n_symbols(), _LINES: lines(), "n_repeat_words": n_repeat_words()})
    return made.withColumn("n_dup_lines", F.col(_LINES)["dup"])


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, base_failed and kept."""
    ordered = order_rules(docs, rules, sample_rows, text_col, counted=True)
    counted = _with_counts(with_words(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    counts = Counted()
    failed = _too_short(counts) | _repetitive(counts)
    out = counted.withColumn("base_failed", failed).withColumn("kept", _verdict(ordered, counts, F.col("base_failed")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = (*BASE_RULES, *RULES), sample_rows: int = 300, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their columns. All rules, base rules too, are in the measured order."""
    ordered = order_rules(docs, rules, sample_rows, text_col)
    rows = with_words(numbered(docs), number_of(docs, text_col))
    return _only(rows, _verdict(ordered, Counts())).select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def _only(frame: DataFrame, condition: Column) -> DataFrame:
    """A filter that stays where it is. Pushed below the words' projection, it would hold their expressions many times over."""
    return frame.withColumn(_KEEP, F.explode(F.array(condition))).filter(_KEEP).drop(_KEEP)
