"""Quality rules: text statistics and a learned decision list, all in built-in functions.

Sequential covering: a rule "statistic >= or <= threshold and ..." is grown on two thirds of the labelled sample, one condition at a time by
information gain, then pruned from its end on the other third; it is accepted if it is precise there, the rows that it covers are
taken away, and the next rule is grown on the rest. The rules stay readable, keep their order, and become one conditional expression of
Spark (``verdict``). Only the statistics of at most ``sample_rows`` labelled rows reach the driver.

Defined cases: null texts count as empty; without words all statistics are 0 and the base check fails; without usable labels the list is
empty and only the base check rejects; equal rows get equal results; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import labelled_sample
from fieldloom.llm.pii import let, total

SAMPLE_ROWS = 20_000
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 3


def words_of(text: Column) -> Column:
    return let(F.btrim(text, F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+", -1)))


def removed(text: Column, letters: str) -> Column:
    """How many characters of ``letters`` the text has."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def repeated_places(keys: Column) -> Column:
    """Of array<struct<key, at>> the entries whose key occurs again; sorted, so in time n log n."""
    def pick(s):
        return F.filter(s, lambda x, k: (F.get(s, k - 1)["key"] == x["key"]).eqNullSafe(True) | (F.get(s, k + 1)["key"] == x["key"]).eqNullSafe(True))

    return let(F.sort_array(keys), pick)


def repeat_words(words: Column) -> Column:
    """How many words lie in a window of three that the text has at least twice.

    Windows are matched by a 64-bit hash first; only those that seem to repeat are compared as text.
    """
    last = F.size(words) - WINDOW

    def keys(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).alias("key"), i.alias("at")))

    def exact(seeming):
        texts = F.transform(seeming, lambda s: F.struct(F.concat_ws(" ", *[F.get(words, s["at"] + k) for k in range(WINDOW)]).alias("key"), s["at"].alias("at")))
        return F.when(F.size(seeming) == 0, F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(repeated_places(texts), lambda s: s["at"])), covered))

    def covered(at):
        return total(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))).cast("long")))

    return F.when(last < 0, F.lit(0).cast("long")).otherwise(let(repeated_places(keys(words)), exact))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# The statistics that rules may test: counts, and ratios of counts (0 where the divisor is 0).
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "capital_share": ("n_capitals", "word_chars"), "marks_per_word": ("n_marks", "n_words"),
    "distinct_share": ("n_distinct", "n_words"), "words_per_line": ("n_words", "n_lines"),
}
TESTED = ("n_words", *RATIOS)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, all other columns but the text, and the statistics of the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))

    def measure(words):
        return F.struct(F.size(words).cast("long").alias("n_words"), repeat_words(words).alias("n_repeat_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))

    measured = docs.select(
        *[c for c in docs.columns if c != text_col], let(words_of(text), measure).alias("_words"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_lines"),
        (F.length(text) - removed(text, SPACES)).cast("long").alias("word_chars"), removed(text, SYMBOLS).cast("long").alias("n_symbols"),
        removed(text, CAPITALS).cast("long").alias("n_capitals"), removed(text, "!?").cast("long").alias("n_marks"))
    counted = measured.select(*[c for c in measured.columns if c not in ("_words", "_lines")], "_words.*", "_lines.*")
    return counted.withColumns({name: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) for name, (a, b) in RATIOS.items()})


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value >= self.threshold if self.at_least else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def covers(self, rows: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for c in self.conditions:
            value = rows[:, names.index(c.statistic)]
            out &= value >= c.threshold if c.at_least else value <= c.threshold
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def grow(rows: np.ndarray, bad: np.ndarray, names: tuple[str, ...], steps: int = 64, most: int = 4) -> Rule | None:
    """Add the condition with the highest information gain until no good row is covered."""
    inside, conditions = np.ones(len(rows), bool), []
    while len(conditions) < most:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if p == 0 or n == 0:
            break
        best, now = (1e-9, None, None), math.log2(p / (p + n))
        for j, name in enumerate(names):
            values = rows[inside, j]
            cuts = np.unique(np.concatenate([np.quantile(values, np.linspace(0, 1, steps)), np.quantile(values[bad[inside]], np.linspace(0, 1, 9))]))
            order = np.sort(values[bad[inside]]), np.sort(values[~bad[inside]])
            for at_least in (True, False):
                side = "left" if at_least else "right"
                under = [np.searchsorted(o, cuts, side=side) for o in order]
                p1, n1 = (len(o) - u if at_least else u for o, u in zip(order, under))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p1 > 0, p1 * (np.log2(p1 / (p1 + n1)) - now), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, at_least, float(cuts[k])), None)
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= Rule((best[1],)).covers(rows, names)
    return Rule(tuple(conditions)) if conditions else None


def prune(rule: Rule, rows: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> Rule:
    """The head of the rule that is best at telling bad from good on rows it was not grown on."""
    def worth(r):
        hit = r.covers(rows, names)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return ((p - n) / (p + n) if p + n else -1.0, p)

    return max((Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)), key=lambda r: (*worth(r), -len(r.conditions)))


def learn(rows: np.ndarray, bad: np.ndarray, names: tuple[str, ...] = TESTED, most_rules: int = 16, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """The decision list; a row that no rule covers is good."""
    rules: list[Rule] = []
    third = np.arange(len(rows)) % 3 == 2
    alive = np.ones(len(rows), bool)
    while len(rules) < most_rules:
        a, b = alive & ~third, alive & third
        if (a & bad).sum() < least:
            break
        rule = grow(rows[a], bad[a], names)
        if rule is None:
            break
        if (b & bad).any():
            rule = prune(rule, rows[b], bad[b], names)
        hit = rule.covers(rows, names) & alive
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < least or p / (p + n) < precision:
            break
        rules.append(rule)
        alive &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, or null."""
    out = None
    for k, rule in enumerate(rules):
        out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label: str = "quality") -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled documents; their id list bounds the broadcast, their statistics what is gathered."""
    sample = labelled_sample(labels, label, sample_rows).withColumnRenamed("label", "_label")
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id", *TESTED).limit(sample_rows)
    got = rows.select("_label", *TESTED).collect()
    if not got:
        return []
    values = np.array([tuple(r) for r in got], float)
    return learn(values[:, 1:], values[:, 0] == 0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the number of the rule that rejects, for every row of ``docs``."""
    measured = with_statistics(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.withColumn("rule", verdict(rules)).withColumn("base_failed", failed)
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
