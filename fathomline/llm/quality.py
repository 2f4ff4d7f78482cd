"""Quality rules: a threshold table compiled into one projection.

Every measure and every verdict is a built-in expression, so the whole operator is a
map over the scan: no shuffle, no Python, and memory bounded by one document.

Defined cases: a null or empty text has zero in every measure and fails (too few words);
repeated rows and ties are judged row by row; extra columns pass through unless they bear
the name of a column made here, which then wins; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table, words_of

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and as at be by for from has have in is it not of on or that the this to was were with "
    "au avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "das dem den der des die ein eine es für ist im mit nicht sich sie und von zu "
    "al como con del el en es las lo los más no para por se su una y "
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails the rule when its measure lies outside [low, high]."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table.  Ratios are taken over words unless the name says lines.
DEFAULT_RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("repeated_windows", "repeat_ratio", high=0.30),
    Rule("mean_word_length", "mean_word_length", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("shouting", "upper_ratio", high=0.5),
    Rule("stop_words", "stop_ratio", low=0.01),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("list_lines", "bullet_line_ratio", high=0.9),
    Rule("cut_lines", "ellipsis_line_ratio", high=0.5),
)

WINDOW = 8


def _repeat_words(df: DataFrame, window: int) -> DataFrame:
    """Add n_repeat_words: words inside windows that occur at least twice in the text.

    Only texts where two windows are equal pay for the sort that finds the places.
    """
    n = F.size("_words")
    df = df.withColumn(
        "_h",
        F.when(
            n >= window,
            F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, window))),
        ),
    )
    df = df.withColumn("_h", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")))
    df = df.withColumn("_s", F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    same = lambda s, i: (s["h"] == F.get("_s", i - 1)["h"]) | (s["h"] == F.get("_s", i + 1)["h"])
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", same), lambda s: s["i"])))
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("_p", i + 1) - p, F.lit(window)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_s", "_p")


def measures(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add the measures that rules can name."""
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = (
        df.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.size(F.split("_text", r"[#*$%&|<>]", -1)) - 1).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_stops", F.size(F.filter("_words", lambda w: F.translate(w, UPPER, LOWER).isin(STOP_WORDS))))
        .withColumn("_letters", F.size(F.split("_text", r"\p{L}", -1)) - 1)
        .withColumn("_capitals", F.size(F.split("_text", r"\p{Lu}", -1)) - 1)
        .withColumn("_bullets", F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•·]"))))
        .withColumn("_cut", F.size(F.filter("_lines", lambda x: x.rlike(r"(…|\.\.\.)[\x20\x09\x0D]*$"))))
    )
    df = _repeat_words(df, window)

    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return (
        df.withColumn("mean_word_length", per("word_chars", "n_words"))
        .withColumn("symbol_ratio", per("n_symbols", "n_words"))
        .withColumn("repeat_ratio", per("n_repeat_words", "n_words"))
        .withColumn("stop_ratio", per("_stops", "n_words"))
        .withColumn("upper_ratio", per("_capitals", "_letters"))
        .withColumn("dup_line_ratio", per("n_dup_lines", "n_lines"))
        .withColumn("bullet_line_ratio", per("_bullets", "n_lines"))
        .withColumn("ellipsis_line_ratio", per("_cut", "n_lines"))
        .drop("_text", "_words", "_lines", "_stops", "_letters", "_capitals", "_bullets", "_cut")
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One expression: the names of the rules a row breaks."""
    found = []
    for r in rules:
        out = F.lit(False)
        if r.low is not None:
            out = out | (F.col(r.measure) < r.low)
        if r.high is not None:
            out = out | (F.col(r.measure) > r.high)
        found.append(F.when(out, F.lit(r.name)))
    return F.array_compact(F.array(*found))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, text: str = "text") -> DataFrame:
    """Measures, ``failed_rules`` and ``passes`` for each row."""
    return measures(docs, text).withColumn("failed_rules", compile_rules(rules)).withColumn("passes", F.size("failed_rules") == 0)


def passing(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, text: str = "text") -> DataFrame:
    """The rows that break no rule.

    The verdict goes through an outer explode, below which Spark does not move the filter: moved, it
    would repeat the measures' expressions, inner functions included.
    """
    judged = measures(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("text")))
    kept = judged.select(F.explode_outer(F.when(F.size(compile_rules(rules)) == 0, F.array("_doc"))).alias("_doc"))
    return kept.filter("_doc is not null").select("_doc.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.col("passes")).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"),
    )
