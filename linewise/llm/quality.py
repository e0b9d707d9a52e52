"""Quality rules: one Spark projection compiled from a table of thresholds.

``features`` measures a whole text with built-in functions only (lengths, symbols, stop
words, lines, repeated five-word windows); ``compile_rules`` turns the threshold table
into one boolean column over those measures. No shuffle, no Python, no per-word rows:
everything about a document happens inside its row, in O(n log n) of its words.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import documents, let, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = ("the of and to in is that for it with as was be by on are this or from at an have not "
              "der die das und ist von den mit zu ein eine nicht auf als auch im sich des "
              "le la les de des et un une est que qui pour dans en du sur par au pas "
              "el los las y un una es que por para con del se no en lo").split()

#: (rule, measure, least, most): a text passes if least <= measure <= most (None: no bound).
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word_length", "mean_word_length", 2.0, 14.0),
    ("symbol_ratio", "symbol_ratio", None, 0.05),
    ("stop_word_ratio", "stop_word_ratio", 0.04, None),
    ("duplicate_line_ratio", "duplicate_line_ratio", None, 0.5),
    ("longest_word", "longest_word", None, 1000),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words in ``window``-word windows that occur twice or more in the text.

    The windows' hashes are sorted with their positions, so equal windows are neighbours;
    the words covered by the repeated ones are counted from their sorted positions.
    """
    def marked(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            n = F.size(s)
            at = F.filter(F.sequence(F.lit(1), n), lambda j: (
                ((j > 1) & (F.get(s, j - 2)["h"] == F.get(s, j - 1)["h"]))
                | ((j < n) & (F.get(s, j)["h"] == F.get(s, j - 1)["h"]))))
            return F.sort_array(F.transform(at, lambda j: F.get(s, j - 1)["i"]))
        return let(order, twice)

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        return F.aggregate(
            F.transform(starts, lambda p, j: F.when(
                j + 1 < n, F.least(F.lit(window), F.get(starts, j + 1) - p)).otherwise(window)),
            F.lit(0).cast("bigint"), lambda a, b: a + b)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - window),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    none = F.lit(0).cast("bigint")
    return F.when(F.size(words) > window, let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(marked(h), covered)))).otherwise(none)


def features(text: Column, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """A struct of the measures of a whole text (null counts as empty)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    symbols = F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))
    lines = F.filter(F.split(text, "\n"), lambda ln: ln.rlike(r"[^\x20\x09-\x0D]"))
    # a long literal list becomes a hash set
    stop = [f for w in stop_words for f in (w, w.capitalize(), w.upper())]

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            symbols.cast("bigint").alias("n_symbols"),
            let(lines, lambda ls: F.struct(
                F.size(ls).cast("bigint").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"))).alias("lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(stop))).cast("bigint").alias("n_stop_words"),
            F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("bigint").alias("longest_word"))
    return let(words_of(text), of)


def compile_rules(measures: dict[str, Column], rules=RULES) -> Column:
    """One boolean column: true if every rule of the table holds."""
    def holds(name, least, most):
        m = measures[name]
        parts = ([m >= F.lit(least)] if least is not None else []) + \
                ([m <= F.lit(most)] if most is not None else [])
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    return reduce(lambda a, b: a & b, [holds(m, lo, hi) for _, m, lo, hi in rules], F.lit(True))


def quality(docs: DataFrame, rules=RULES, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """Measures and verdict per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and the rule table's measures.

    A null or empty text has no words and fails. Repeated rows give repeated rows; columns
    other than doc_id and text are ignored.
    """
    f = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), features(F.col("text"), stop_words).alias("f"))
    c = lambda n: F.col(f"f.{n}")
    words = F.greatest(c("n_words"), F.lit(1))
    measures = {
        "mean_word_length": c("word_chars") / words,
        "symbol_ratio": c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)),
        "stop_word_ratio": c("n_stop_words") / words,
        "duplicate_line_ratio": c("lines.n_dup_lines") / F.greatest(c("lines.n_lines"), F.lit(1)),
        "longest_word": c("longest_word"),
    }
    base = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    return f.select(
        "doc_id", c("n_words").alias("n_words"), c("word_chars").alias("word_chars"),
        c("n_symbols").alias("n_symbols"), c("lines.n_dup_lines").alias("n_dup_lines"),
        c("n_repeat_words").alias("n_repeat_words"), base.alias("base_failed"),
        (~base & compile_rules(measures, rules)).alias("kept"),
        c("lines.n_lines").alias("n_lines"), c("n_stop_words").alias("n_stop_words"),
        c("longest_word").alias("longest_word"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
