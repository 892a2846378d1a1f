"""Quality rules: a table of thresholds compiled into one projection of text ratios.

Everything is a Column expression; a text is measured within its row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import BLANKS, WORD, word_array

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it with as was on are be this by from or an at not but have "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de des et en un une que qui du dans il elle pour pas sur par au ou est "
    "el los las y que se del un una por con no su para es al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie within [least, most]; an open end is None."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are per word or per line as their names say.
RULES = (
    Rule("mean_word_length", least=2.0, most=14.0),
    Rule("symbols_per_word", most=0.3),
    Rule("dup_line_ratio", most=0.5),
    Rule("letter_word_ratio", least=0.7),
    Rule("stop_word_ratio", least=0.02),
    Rule("shouted_word_ratio", most=0.5),
)
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50

#: The ratios, over the columns of ``measured``.
RATIOS: dict[str, Callable[[], Column]] = {
    "mean_word_length": lambda: F.col("word_chars") / F.col("n_words"),
    "symbols_per_word": lambda: F.col("n_symbols") / F.col("n_words"),
    "dup_line_ratio": lambda: F.col("n_dup_lines") / F.col("n_lines"),
    "letter_word_ratio": lambda: F.col("n_letter_words") / F.col("n_words"),
    "stop_word_ratio": lambda: F.col("n_stop_words") / F.col("n_words"),
    "shouted_word_ratio": lambda: F.col("n_shouted_words") / F.col("n_words"),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more among ``words``, the first one included.

    Window hashes are sorted with their positions in one long each (high hash bits, then the
    position), which leaves only the windows whose high bits meet another's; those few are sorted
    by their full 64-bit hash. The repeated windows' positions then give the words they cover.
    """

    def covered(hashes: Column) -> Column:
        bits = F.ceil(F.log2(F.size(hashes) + F.lit(1))).cast("int")

        def neighbours(packed: Column, bits: Column) -> Column:
            high = lambda at: F.call_function("shiftright", F.get(packed, at), bits)
            kept = F.filter(packed, lambda x, j: (F.coalesce(high(j - 1) == high(j), F.lit(False)) | F.coalesce(high(j + 1) == high(j), F.lit(False))))
            return F.transform(kept, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int"))

        def packed(bits: Column) -> Column:
            cut = lambda h: F.call_function("shiftleft", F.call_function("shiftright", h, bits), bits)
            return F.sort_array(F.transform(hashes, lambda h, i: cut(h).bitwiseOR(i.cast("long"))))

        met = _let(bits, lambda b: _let(packed(b), lambda p: neighbours(p, b)))
        by_hash = F.sort_array(F.transform(met, lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i"))))

        def twice(pairs: Column) -> Column:
            h = lambda at: F.get(pairs, at)["h"]
            return F.sort_array(
                F.transform(
                    F.filter(pairs, lambda x, j: F.coalesce(h(j - 1) == x["h"], F.lit(False)) | F.coalesce(h(j + 1) == x["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            )

        gap = lambda at: F.aggregate(
            F.transform(at, lambda p, j: F.coalesce(F.least(F.get(at, j + 1) - p, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x
        )
        return _let(by_hash, lambda pairs: _let(twice(pairs), gap))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    distinct = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(hashes, distinct))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts that the ratios are made of."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", word_array(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    listed = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    count = lambda keep: F.size(F.filter("words", keep)).cast("long")
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        count(lambda w: w.rlike(r"\p{L}")).alias("n_letter_words"),
        count(lambda w: w.rlike(r"^\p{Lu}{2,}\W*!+$|^\p{Lu}{4,}\W*$")).alias("n_shouted_words"),
        count(lambda w: w.isin(*dict.fromkeys(STOP_WORDS))).alias("n_stop_words"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds; a ratio without a denominator passes none."""

    def holds(rule: Rule) -> Column:
        ratio = F.when(F.col("n_words") > 0, RATIOS[rule.measure]())
        bounds = [ratio >= rule.least] * (rule.least is not None) + [ratio <= rule.most] * (rule.most is not None)
        return F.coalesce(reduce(lambda a, b: a & b, bounds, ratio.isNotNull()), F.lit(False))

    return reduce(lambda a, b: a & b, [holds(rule) for rule in rules], F.lit(True))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the counts, ``base_failed`` and ``kept``.

    Null and empty texts have zero counts and are not kept; a null id stays null; repeated rows are
    answered each; other columns are not read.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return measured(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
