"""Quality rules: a threshold table compiled into one native projection.

Every metric of a text is computed by built-in expressions in a single pass
over the row. The verdict is a conjunction of the table's bounds, so adding a
rule adds a row to the table and a term to the projection, no stage.

Defined results: a null text counts as empty; texts without words have
n_words 0 and fail the base rule; ties and repeated rows are judged alike, row
by row, and texts of any length whole; an empty table gives no rows; extra
columns of the input are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import SPACE_CLASS, WORD_CLASS, let, words_of

#: Words in a window that must not recur.
WINDOW = 8

#: Frequent function words of English, French, German, Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are at from or an have not they "
    "de la le les et des en un une du que qui dans est pour par sur au ne pas avec ce il ou "
    "der die und den von zu das mit sich auf im dem nicht ein eine als auch es "
    "el los las con no su para al lo como se del una y o"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text whose ``metric`` lies within the bounds, ends included."""

    name: str
    metric: Callable[[Column], Column]
    low: float | None = None
    high: float | None = None

    def holds(self, m: Column) -> Column:
        value, kept = self.metric(m), F.lit(True)
        if self.low is not None:
            kept = kept & (value >= F.lit(self.low))
        if self.high is not None:
            kept = kept & (value <= F.lit(self.high))
        return kept


def _per(numerator: str, denominator: str) -> Callable[[Column], Column]:
    return lambda m: F.coalesce(F.try_divide(m[numerator].cast("double"), m[denominator]), F.lit(0.0))


#: The production table.
RULES: Sequence[Rule] = (
    Rule("mean_word_length", _per("word_chars", "n_words"), 2.5, 12.0),
    Rule("symbols_per_word", _per("n_symbols", "n_words"), None, 0.2),
    Rule("stop_word_ratio", _per("n_stop_words", "n_words"), 0.06, 0.8),
    Rule("duplicate_line_ratio", _per("n_dup_lines", "n_lines"), None, 0.35),
    Rule("ended_line_ratio", _per("n_ended_lines", "n_lines"), 0.2, None),
)


def _covered_by_repeats(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur at least twice.

    A window is known by its 64-bit hash. Only texts with a recurring hash pay
    for the sort that finds where the copies start.
    """
    n = F.size(words)
    hashes = F.when(n <= WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), n - F.lit(WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(words, i, WINDOW)),
        )
    )

    def starts(placed: Column) -> Column:
        def recurs(x: Column, k: Column) -> Column:
            before, after = F.get(placed, k - 1)["h"], F.get(placed, k + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(placed, recurs), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(let(placed, starts), covered)
        )

    return let(hashes, count)


def measures(text: Column) -> Column:
    """A struct of the counts that the rules use."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.regexp_like(line, F.lit(WORD_CLASS)))
    of_lines = let(
        lines,
        lambda ls: F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(ls, lambda x: F.regexp_like(x, F.lit(f"[.!?:;\"')\\]]{SPACE_CLASS}*$"))))
            .cast("long")
            .alias("n_ended_lines"),
        ),
    )
    of_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(list(STOP_WORDS)))).cast("long").alias("n_stop_words"),
            _covered_by_repeats(w).alias("n_repeat_words"),
        ),
    )
    symbols = F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long")
    return F.struct(of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Counts, base rule and verdict for every document, without a shuffle."""
    raw = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(measures(F.col(text_col)))))
    flat = raw.select("doc_id", "w.*", "l.*", "n_symbols")
    m = F.struct(*[c for c in flat.columns if c != "doc_id"])
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.holds(m)
    return flat.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & verdict).alias("kept"),
        "n_lines",
        "n_stop_words",
        "n_ended_lines",
    )
