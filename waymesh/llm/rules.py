"""Quality rules with risk-controlled thresholds.

Every rule measures a badness of a text in whole numbers and rejects what lies above its cutoff. The
cutoffs of a rule form a fixed grid, chosen before any label is seen. Labelled documents are the holdout:
per stratum (language) and rule, a cutoff is certified if the exact binomial test says that it rejects
less than its share of good documents,

    P(Binomial(n_good, share) <= rejected_good) <= error / (strata * rules),

where ``share`` is the allowed false rejection divided by the number of rules. Within a rule the cutoffs
are tested from the laxest on; the p-value only grows, so this fixed sequence needs no further correction, and
Bonferroni's correction covers strata and rules. With probability 1 - ``error`` all certified cutoffs
hold at once; of these the one is taken that rejects most bad documents, each good one weighing
``GOOD_WEIGHT`` times. A rule without such a cutoff rejects nothing: too few labels keep documents.

Native throughout: words, windows and lines are arrays inside the row (no shuffle of words), the holdout is
counted as a histogram per stratum and rule (folded before it moves), and the binomial sums are built-in
aggregates over at most ``share * n_good`` terms. Only the cutoffs are broadcast, after counting them.

Defined results: a null text has no words, a null language is the stratum ``und``. Texts with fewer than
50 words fail the base rule. A null id takes part as a document but never as a labelled one. Of several label
rows for an id the smallest quality counts, null labels do not. Repeated rows are measured, counted and
returned one by one. Other columns play no part. Empty documents give an empty table, empty labels no cutoff.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.llm.common import text_of
from waymesh.runtime import small, store

#: Texts with fewer words, or with a larger share (in hundredths) of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Allowed false rejection per stratum, over all rules together, and the probability that it is exceeded anywhere.
FALSE_REJECTION, ERROR = 0.02, 0.05
#: Cutoffs per rule, and what a rejected good document weighs against rejected bad ones.
GRID, GOOD_WEIGHT = 64, 20

_BLANK = r"[ \t-\r]+"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects texts whose ``badness`` is above ``step * j`` for the chosen j."""

    name: str
    badness: Callable[[], Column]
    step: int


def _per_thousand(column: str) -> Column:
    return F.expr(f"1000 * {column} div n_words")


def _mean_length() -> Column:
    return F.expr("10 * word_chars div n_words")


RULES = [
    Rule("symbols", lambda: _per_thousand("n_symbols"), 10),
    Rule("repeated_lines", lambda: _per_thousand("n_dup_lines"), 4),
    Rule("repeated_words", lambda: _per_thousand("n_repeat_words"), 8),
    Rule("long_words", _mean_length, 4),
    Rule("short_words", lambda: F.greatest(F.lit(0).cast("bigint"), 128 - _mean_length()), 2),
    Rule("few_words", lambda: F.greatest(F.lit(0).cast("bigint"), 640 - F.col("n_words")), 10),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words which the text holds twice or more.

    Windows are compared as text. They are only sorted if some window repeats at all; the places of the
    repeated ones, in order, then tell how many words they cover.
    """

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.when(k + 1 < F.size(places), F.least(F.lit(3), F.get(places, k + 1) - p)).otherwise(3))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, g: total + g)

    def places(order: Column) -> Column:
        def same(e: Column, k: Column) -> Column:
            return F.coalesce(F.get(order, k)["gram"] == e["gram"], F.lit(False))

        again = F.filter(order, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return F.sort_array(F.transform(again, lambda e: e["place"]))

    def counted(grams: Column) -> Column:
        order = F.sort_array(F.transform(grams, lambda g, k: F.struct(g.alias("gram"), k.alias("place"))))
        none = F.size(F.array_distinct(grams)) == F.size(grams)
        return F.when(none, F.lit(0).cast("bigint")).otherwise(let(let(order, places), covered))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda k: F.concat_ws(" ", words[k], words[k + 1], words[k + 2]))
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(let(grams, counted))


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every row, inside the row."""
    rows = docs.select(
        F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("stratum"),
        text_of(text).alias("body"),
    )

    def in_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"), repeated_words(words).alias("n_repeat_words"))

    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    length = F.char_length("body")
    return rows.select(
        "id", "stratum",
        let(F.array_remove(F.split("body", _BLANK), ""), in_words).alias("w"),
        F.char_length(F.translate("body", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (length - F.char_length(F.translate("body", _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda l: F.size(l) - F.size(F.array_distinct(l))).cast("bigint").alias("n_dup_lines"),
    ).select("id", "stratum", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def binomial_at_most(n: Column, k: Column, share: float) -> Column:
    """P(Binomial(n, share) <= k), summed term by term; 1 where k is above the mean (a certificate is out of reach there)."""
    first = n * F.lit(log(1 - share))
    start = F.struct(first.alias("term"), F.exp(first).alias("total"))

    def step(at: Column, j: Column) -> Column:
        term = at["term"] + F.log((n - j + 1) / j) + F.lit(log(share / (1 - share)))
        return F.struct(term.alias("term"), (at["total"] + F.exp(term)).alias("total"))

    places = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * F.lit(share), F.lit(1.0)).otherwise(F.aggregate(places, start, step, lambda at: at["total"]))


def holdout_counts(rows: DataFrame, labels: DataFrame, id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """``stratum, rule, above, good, bad``: labelled documents that the base rule passes, by the number of cutoffs they exceed.

    Rows that agree in id and in all they exceed are counted before they meet their label, so an id that holds a
    large share of all rows moves as a few.
    """
    marks = labels.filter(F.col(f"`{quality}`").isNotNull()).groupBy(F.col(f"`{id}`").alias("id")).agg(
        F.min(f"`{quality}`").alias("quality")
    )
    exceeded = [
        F.least(F.lit(GRID), F.floor((rule.badness() + rule.step - 1) / rule.step)).cast("int").alias(rule.name) for rule in RULES
    ]
    folded = rows.filter(~_base_failed()).select("id", "stratum", *exceeded).groupBy("id", "stratum", *[r.name for r in RULES]).agg(
        F.count(F.lit(1)).alias("rows")
    )
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("above")) for r in RULES])
    return (
        folded.join(marks, "id").select("stratum", "rows", "quality", F.explode(each).alias("e"))
        .groupBy("stratum", "e.rule", "e.above")
        .agg(F.sum(F.when(F.col("quality") == 1, F.col("rows")).otherwise(0)).alias("good"),
             F.sum(F.when(F.col("quality") != 1, F.col("rows")).otherwise(0)).alias("bad"))
    )


def certified_cutoffs(
    counts: DataFrame, false_rejection: float = FALSE_REJECTION, error: float = ERROR, good_weight: int = GOOD_WEIGHT
) -> DataFrame:
    """``stratum, rule, cutoff, n_good, lost, caught, p_value``: the cutoffs that may be used (index into the grid), the best of each rule.

    ``lost`` and ``caught`` are the good and bad documents of the holdout above the cutoff.
    """
    share = false_rejection / len(RULES)
    totals = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"))
    strata = counts.select("stratum").distinct().count()
    # each document lies above the cutoffs 0 to above - 1; at most GRID of them per rule, whatever the data
    per_cutoff = (
        counts.filter("above > 0").select("stratum", "rule", "good", "bad", F.explode(F.sequence(F.lit(0), F.col("above") - 1)).alias("cutoff"))
        .groupBy("stratum", "rule", "cutoff").agg(F.sum("good").alias("lost"), F.sum("bad").alias("caught"))
    )
    tested = per_cutoff.join(totals, ["stratum", "rule"]).withColumn(
        "p_value", binomial_at_most(F.col("n_good"), F.col("lost"), share)
    )
    useful = tested.filter(F.col("p_value") <= error / (max(strata, 1) * len(RULES))).withColumn(
        "gain", F.col("caught") - good_weight * F.col("lost")
    ).filter("gain > 0")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), F.desc("cutoff"))
    return useful.withColumn("place", F.row_number().over(best)).filter("place = 1").select(
        "stratum", "rule", "cutoff", "n_good", "lost", "caught", "p_value"
    )


def apply_rules(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``rows`` of :func:`measured` with ``base_failed``, ``kept`` and ``failed_rules``, the rules that reject them."""
    chosen = small(cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")))
    rejects = [
        F.when(rule.badness() > F.col("cutoffs")[rule.name] * rule.step, F.lit(rule.name)) for rule in RULES
    ]
    failed = F.when(F.col("n_words") > 0, F.array_compact(F.array(*rejects))).otherwise(F.array().cast("array<string>"))
    judged = rows.join(chosen, "stratum", "left").withColumns({"base_failed": _base_failed(), "failed_rules": failed})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("cutoffs")


def judge_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", **risk) -> DataFrame:
    """Base figures and verdict of every row: ``id, n_words, …, base_failed, kept, failed_rules``; texts are read once."""
    rows = store(measured(docs, id, text, lang)).df
    cutoffs = certified_cutoffs(store(holdout_counts(rows, labels, id)).df, **risk)
    return apply_rules(rows, cutoffs).select(
        F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )
