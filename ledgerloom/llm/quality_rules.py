"""Learned decision lists on statistics of a text.

Sequential covering: a rule is a conjunction of thresholds that grows literal
by literal on one part of the labelled rows, is pruned on the other, and then
takes away the rows it covers before the next rule grows. Every step is one
histogram of the labelled rows over the bins of all statistics, so what reaches
the driver is a few hundred counts at any input size. The rules become one
ordered conditional expression over columns.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.labels import learnable
from ledgerloom.llm.storage import saved
from ledgerloom.llm.words import let, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

# Statistics that rules may test, as expressions over the columns of `text_statistics`.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / nullif(n_words, 0)",
    "symbol_share": "n_symbols / nullif(word_chars, 0)",
    "dup_lines": "CAST(n_dup_lines AS DOUBLE)",
    "repeat_share": "n_repeat_words / nullif(n_words, 0)",
    "distinct_share": "n_distinct_words / nullif(n_words, 0)",
}


def _covered(positions: Column) -> Column:
    """The number of words in the windows that begin at the ascending positions."""
    steps = F.transform(
        positions,
        lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, j + 1) - p, F.lit(WINDOW))),
    )
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _repeated(windows: Column) -> Column:
    """The number of words in windows whose hash occurs twice or more, the first time included."""
    found = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(
        found,
        lambda s: F.transform(
            F.filter(
                s,
                lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
            ),
            lambda x: x["i"],
        ),
    )
    return let(F.array_sort(twice), _covered)


def _n_repeat_words(word_list: Column) -> Column:
    """Words in windows of five that occur twice or more; windows are compared by 64-bit hashes."""
    hashes = F.transform(word_list, lambda w: F.xxhash64(w))
    windows = let(
        hashes,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))),
        ),
    )
    # Most texts repeat nothing; only the others pay for the sort.
    counted = let(
        windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(_repeated(x))
    )
    return F.when(F.size(word_list) < WINDOW, F.lit(0)).otherwise(counted)


def text_statistics(text: Column) -> Column:
    """A struct of counts (bigint): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct_words.

    A null text counts as empty and has only zeros. Each count is linear in the
    length of the text, but for the sort of texts that repeat themselves.
    """
    whole = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return let(
            F.array_join(w, ""),
            lambda joined: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(joined).cast("bigint").alias("word_chars"),
                (F.length(joined) - F.length(F.regexp_replace(joined, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
                _n_repeat_words(w).cast("bigint").alias("n_repeat_words"),
                F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct_words"),
            ),
        )

    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")
    return let(
        let(words(text), of_words),
        lambda s: F.struct(
            *(s[name].alias(name) for name in ("n_words", "word_chars", "n_symbols")),
            dup_lines.alias("n_dup_lines"),
            *(s[name].alias(name) for name in ("n_repeat_words", "n_distinct_words")),
        ),
    )


def base_failed() -> Column:
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | repeated


@dataclasses.dataclass(frozen=True)
class Literal:
    """A test of one statistic: above the threshold, or up to and with it."""

    feature: str
    above: bool
    bin: int
    threshold: float

    def on_values(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def on_bins(self, features: Sequence[str]) -> Column:
        found = F.get("bins", F.lit(list(features).index(self.feature)))
        return found > self.bin if self.above else found <= self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Literal, ...]


@dataclasses.dataclass(frozen=True)
class DecisionList:
    """Rules in order; a row that one of them covers is rejected, others are kept."""

    rules: tuple[Rule, ...]

    def kept(self) -> Column:
        """The ordered conditional over the columns of `text_statistics`; a null test does not match."""
        if not self.rules:
            return F.lit(True)
        chain = F
        for rule in self.rules:
            chain = chain.when(_all(x.on_values() for x in rule), F.lit(False))
        return chain.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "; ".join(f"reject if {' and '.join(map(str, rule))}" for rule in self.rules) + "; else keep"


def _all(tests) -> Column:
    found = F.lit(True)
    for test in tests:
        found = found & F.coalesce(test, F.lit(False))
    return found


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Per statistic the distinct quantiles of either label."""
    at = F.lit([i / bins for i in range(bins + 1)])
    wanted = [F.percentile_approx(F.expr(e), at).alias(name) for name, e in FEATURES.items()]
    found = rows.groupBy("label").agg(*wanted).collect()
    return {name: sorted({v for row in found for v in row[name] or []}) for name in FEATURES}


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    """The number of cuts below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < value)) if cuts else F.lit(0)


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """What a literal adds to a rule, in bits over the rejected rows it keeps covered."""
    bits = lambda bad, good: math.log2((bad + 1) / (bad + good + 2))
    return after[0] * (bits(*after) - bits(*before))


def _best_literal(rows: DataFrame, thresholds: dict[str, list[float]]) -> tuple[float, Literal, tuple[int, int]] | None:
    names = list(thresholds)
    cells = rows.select("label", F.posexplode("bins").alias("feature", "bin"))
    counts = cells.groupBy("feature", "bin").agg(
        F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good")
    )
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for row in counts.collect():
        found.setdefault(row["feature"], {})[row["bin"]] = (row["bad"], row["good"])
    best = None
    for feature, by_bin in sorted(found.items()):
        total = tuple(map(sum, zip(*by_bin.values(), strict=True)))
        below = (0, 0)
        for b, threshold in enumerate(thresholds[names[feature]]):
            below = tuple(map(sum, zip(below, by_bin.get(b, (0, 0)), strict=True)))
            for above in (True, False):
                after = (total[0] - below[0], total[1] - below[1]) if above else below
                choice = (_gain(total, after), Literal(names[feature], above, b, threshold), after)
                if best is None or choice[0] > best[0]:
                    best = choice
    return best


def learn_rules(
    rows: DataFrame, max_rules: int = 8, max_literals: int = 4, bins: int = 32, precision: float = 0.9, support: int = 5
) -> DecisionList:
    """A list that rejects label 0. `rows`: the columns of `text_statistics`, label, prune (boolean).

    A rule grows on the rows without `prune` by the literal of the largest gain
    and is cut on the others to the start with the best precision there. It is
    kept if it covers `support` rejected rows and has the precision; the first
    that does not ends the list. No labels or one label only give no rules.
    All labelled rows are used; the bins are quantiles of each label.
    """
    thresholds = _thresholds(rows, bins)
    bin_of = [_bin(F.expr(e), thresholds[name]) for name, e in FEATURES.items()]
    left = saved(rows.select("label", "prune", F.array(*bin_of).alias("bins")), "rule-bins")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule: list[Literal] = []
        grow = left.where(~F.col("prune"))
        while len(rule) < max_literals:
            found = _best_literal(grow, thresholds)
            if found is None or found[0] <= 1e-9:
                break
            rule.append(found[1])
            grow = grow.where(found[1].on_bins(list(thresholds)))
            if found[2][1] == 0:
                break
        if not rule:
            break
        starts = [rule[: i + 1] for i in range(len(rule))]
        tests = [_all(x.on_bins(list(thresholds)) for x in start) for start in starts]
        sums = []
        for i, test in enumerate(tests):
            for label in (0, 1):
                for part in (True, False):
                    match = test & (F.col("label") == label) & (F.col("prune") == part)
                    sums.append(F.count_if(match).alias(f"{i}_{label}_{part}"))
        counts = left.agg(*sums).first()
        rate = lambda i, part: counts[f"{i}_0_{part}"] / max(1, counts[f"{i}_0_{part}"] + counts[f"{i}_1_{part}"])
        best = max(range(len(starts)), key=lambda i: (round(rate(i, True), 3), -i))
        bad = counts[f"{best}_0_True"] + counts[f"{best}_0_False"]
        good = counts[f"{best}_1_True"] + counts[f"{best}_1_False"]
        if bad < support or bad / (bad + good) < precision:
            break
        rules.append(tuple(starts[best]))
        left = left.where(~tests[best])
    return DecisionList(tuple(rules))


def apply_rules(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """`statistics` (doc_id, the columns of `text_statistics`) with base_failed and kept.

    The list is learnt from the labelled documents that pass the base rules;
    `labels` has doc_id and quality. Rows of one doc_id are judged one by one.
    """
    judged = statistics.withColumn("base_failed", base_failed())
    known = learnable(labels, "quality")
    prune = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    rows = judged.where(~F.col("base_failed")).join(known, "doc_id").withColumn("prune", prune)
    rules = learn_rules(rows)
    return judged.withColumn("kept", ~F.col("base_failed") & rules.kept())


def quality_rules(spark, folder) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    counted = saved(docs.select("doc_id", text_statistics(F.col("text")).alias("s")).select("doc_id", "s.*"), "statistics")
    return apply_rules(counted, labels).drop("n_distinct_words")
