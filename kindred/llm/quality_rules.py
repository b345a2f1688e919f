"""Quality rules: a table of thresholds compiled into one Spark projection, no user functions.

Every document is one row of one projection without a shuffle, so neither hot sources nor copies
matter. Windows are compared by 64-bit hash inside the row. Hashes without a repetition end the
work at once; a few repeated ones are looked up in a list, many by sorting (hash, position). The
covered words are summed over the start positions. Work per document is n log n in its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.words import SPACES, word_list

WINDOW = 5
SYMBOLS = "#*$%&|<>"
# Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it not of on or that the this to was with "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec ce dans de des du en est et il la le les par pas pour que qui sur un une "
    "con el en es la las lo los no para por que se su una y"
).split()


@dataclass(frozen=True)
class Threshold:
    """A document passes while ``low <= ratio <= high``; an undefined ratio (over 0) passes."""

    name: str
    over: str
    per: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0  # shorter texts pass

    def passes(self) -> Column:
        ratio = F.col(self.over) / F.nullif(F.col(self.per), F.lit(0))
        checks = [ratio >= F.lit(self.low)] if self.low is not None else []
        checks += [ratio <= F.lit(self.high)] if self.high is not None else []
        both = checks[0] if len(checks) == 1 else checks[0] & checks[1]
        return F.coalesce(both, F.lit(True)) | (F.col("n_words") < self.from_words)


# Wide on purpose: clean text of any of the four languages must stay.
THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", 2.0, 15.0),
    Threshold("symbols", "n_symbols", "n_words", None, 0.2),
    Threshold("stop_words", "n_stop_words", "n_words", 0.01, None, 100),
    Threshold("repeated_lines", "n_dup_lines", "n_lines", None, 0.6),
    Threshold("line_length", "n_words", "n_lines", 1.5, None, 100),
)


FEW = 64  # so many repeated windows are looked up in a list, more by sorting


def _heads(values: Column) -> Column:
    return F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))


def _tails(values: Column) -> Column:
    return F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))


def _repeated(hashes: Column) -> Column:
    """Values that occur at least twice."""
    equal = lambda left, right: F.when(left == right, left)
    return F.transform(
        F.array(F.sort_array(hashes)),
        lambda ordered: F.array_distinct(
            F.array_compact(F.zip_with(_heads(ordered), _tails(ordered), equal))
        ),
    )[0]


def _starts(hashes: Column, repeated: Column) -> Column:
    """Positions, in order, of windows that occur at least twice."""
    looked_up = F.array_compact(
        F.transform(
            hashes, lambda value, at: F.when(F.array_contains(repeated, value), at)
        )
    )
    equal = lambda left, right: F.when(
        left["value"] == right["value"], F.array(left["at"], right["at"])
    )
    by_sorting = F.transform(
        F.array(
            F.sort_array(
                F.transform(hashes, lambda value, at: F.struct(value.alias("value"), at.alias("at")))
            )
        ),
        lambda ordered: F.sort_array(
            F.array_distinct(
                F.flatten(F.array_compact(F.zip_with(_heads(ordered), _tails(ordered), equal)))
            )
        ),
    )[0]
    return (
        F.when(F.size(repeated) == 0, F.array().cast("array<int>"))
        .when(F.size(repeated) <= FEW, looked_up)
        .otherwise(by_sorting)
    )


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at the given sorted positions."""
    gaps = F.zip_with(
        _heads(starts), _tails(starts), lambda left, right: F.least(right - left, F.lit(WINDOW))
    )
    total = F.aggregate(gaps, F.lit(0), lambda acc, gap: acc + gap)
    return F.when(F.size(starts) > 0, total + WINDOW).otherwise(0)


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Lengths, symbols, lines, stop words and repeated words of each document."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(
        F.split(text, "\n", -1), lambda line: F.length(F.translate(line, SPACES, "")) > 0
    )
    split = docs.select(
        F.col(id_column).alias("doc_id"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        word_list(F.col(text_column)).alias("words"),
        lines.alias("lines"),
    )
    words = F.col("words")
    windows = F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda at: F.xxhash64(*[F.get(words, at + step) for step in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        "words",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("hashes"),
    )
    hashes = F.col("hashes")
    repeated = F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes), _repeated(hashes)
    ).otherwise(F.array().cast("array<bigint>"))
    stops = F.filter(words, lambda word: F.lower(word).isin(*sorted(set(STOP_WORDS))))
    found = hashed.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.size(words).cast("long").alias("n_words"),
        F.size(stops).cast("long").alias("n_stop_words"),
        "hashes",
        repeated.alias("repeated"),
    )
    placed = found.withColumn("starts", _starts(F.col("hashes"), F.col("repeated")))
    covered = placed.withColumn("n_repeat_words", _covered(F.col("starts")).cast("long"))
    return covered.drop("hashes", "repeated", "starts")


def apply_rules(
    docs: DataFrame,
    thresholds: tuple[Threshold, ...] = THRESHOLDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_words: int = 10,
    max_repeated_percent: int = 20,
) -> DataFrame:
    """One row per row of ``docs`` with its measures, the rules it breaks and the verdict.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeated_percent`` of the
    words lie in repeated windows. ``kept``: neither that nor a broken threshold. NULL and empty
    texts have no words and fail the base rule. Repeated rows are judged alike, an empty table
    gives an empty result, other columns are not read.
    """
    measured = measures(docs, id_column, text_column)
    broken = F.array_compact(
        F.array(*[F.when(~rule.passes(), F.lit(rule.name)) for rule in thresholds])
    )
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words")
    )
    return measured.select(
        "*", failed.alias("base_failed"), broken.alias("broken_rules")
    ).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
