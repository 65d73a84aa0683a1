"""Quality rules: a threshold table compiled into one Spark projection.

Every feature is a built-in expression, so a scan needs no shuffle and no
Python worker, whatever the size of the corpus.

Defined cases: a null text has no words and fails on length; an empty table
gives no rows; repeated rows and ties are judged one by one; extra columns pass
through unless they bear a feature's name, in which case the feature wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACES, SPACES_RE, unused

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this at are an from"
    " der die und den das ist nicht mit von ein"
    " de la le les et des un que qui en une est"
    " el los y se del las con por"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only while ``low <= numerator / denominator <= high``."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None


#: The production table.  Ratios are per word or per line with a word.
RULES = (
    Rule("length", "n_words", None, low=50),
    Rule("word_length", "word_chars", "n_words", low=2, high=15),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.25),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=0.03),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", high=0.4),
    Rule("repeat_ratio", "n_repeat_words", "n_words", high=0.5),
)

FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def compile_rules(rules: Sequence[Rule] = RULES) -> Column:
    """One boolean expression over the feature columns: true if all rules hold."""
    verdict = F.lit(True)
    for rule in rules:
        top = F.col(rule.numerator).cast("double")
        bottom = F.lit(1.0) if rule.denominator is None else F.greatest(F.col(rule.denominator), F.lit(1)).cast("double")
        if rule.low is not None:
            verdict = verdict & (top >= F.lit(float(rule.low)) * bottom)
        if rule.high is not None:
            verdict = verdict & (top <= F.lit(float(rule.high)) * bottom)
    return verdict


def _repeat_words(hashes: str) -> Column:
    """Words covered by three-word windows that occur twice or more, from window hashes."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    met = F.transform(
        F.array(ordered),
        lambda s: F.sort_array(F.array_distinct(F.flatten(F.zip_with(
            s, F.slice(s, F.lit(2), F.size(s)),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )))),
    )[0]
    return F.transform(
        F.array(met),
        lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
            F.lit(0), lambda total, n: total + n,
        ),
    )[0]


def features(docs: DataFrame, text_col: str = "text", stop_words: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """The documents with the columns of FEATURES, all long.

    ``n_repeat_words`` compares windows by a 64-bit hash of the three words.
    """
    passed = [c for c in docs.columns if c.lower() not in FEATURES]
    w_, l_, h_ = unused(docs.columns, "__w", "__l", "__h")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    stops = sorted({w for s in stop_words for w in (s, s.capitalize())})
    nonblank = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    split = docs.select(
        *passed,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES_RE)).alias(w_),
        nonblank.alias(l_),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    words = F.col(w_)
    n = F.size(words)
    hashed = split.select(
        *passed, "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size(l_).cast("long").alias("n_lines"),
        (F.size(l_) - F.size(F.array_distinct(l_))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
        F.when(n >= 3, F.transform(
            F.arrays_zip(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))).alias("a"), F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0))).alias("b"), F.slice(words, F.lit(3), F.greatest(n - 2, F.lit(0))).alias("c")),
            lambda z: F.xxhash64(z["a"], z["b"], z["c"]),
        )).otherwise(F.array().cast("array<bigint>")).alias(h_),
    )
    return hashed.select(
        *passed, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.size(F.array_distinct(h_)) == F.size(h_), F.lit(0)).otherwise(_repeat_words(h_)).cast("long").alias("n_repeat_words"),
        "n_stop_words",
    )


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The documents with features, ``base_failed`` and ``kept``.

    A null or empty text fails on length; an empty table gives no rows; equal rows are
    judged alike; columns named like the new ones are replaced, all others pass.
    """
    return (
        features(docs, text_col)
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    )


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows, with their own columns of any name and type, that every rule keeps.

    Null and empty texts go, equal rows stay or go together, an empty table gives none.
    Rows leave through a generator: a filter would be pushed below the features
    and evaluate each of them again for every rule that reads it.
    """
    (own,) = unused(docs.columns, "__own")
    judged = judge(docs.withColumn(own, F.struct(*docs.columns)), rules, text_col)
    return judged.select(F.explode(F.when(F.col("kept"), F.array(own))).alias(own)).select(f"{own}.*")
