"""Quality rules: learned decision lists over text statistics (DataFrame functions only).

``text_statistics`` adds the statistics, ``learn_rules`` grows and prunes threshold conjunctions by sequential
covering on labelled statistics, and ``DecisionList.verdict`` emits them as one ordered Spark conditional.

Defined results: a null text counts as having no words; an empty text has zero statistics and fails the base rule;
null labels, null ids and labels without a document are not learned from; repeated rows are scored one by one;
no labels, or labels of one class, give an empty list that keeps everything the base rule keeps. Columns besides the
id and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, and the characters that count as symbols (fixed by the contract).
SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
#: The base rule: fewest words, and the highest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Labelled rows that the rules are learned from, at most; taken by the order of a hash of the id.
MAX_TRAINING_ROWS = 20_000

FEATURES = (
    "n_words",
    "mean_word_chars",
    "symbols_per_word",
    "dup_line_share",
    "repeat_word_share",
    "distinct_word_share",
    "upper_share",
    "digit_share",
    "bangs_per_word",
    "pipes_per_word",
)


def _fence(value: Column) -> Column:
    """``value``, as an expression that the optimizer does not copy into later filters, projections or lambdas."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and helper counts."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = docs.withColumns({"_words": _fence(F.array_remove(F.split(t, SPACE), "")), "_lines": _fence(F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))})
    n = F.size("_words")
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    joined = F.array_join("_words", "")
    counted = words.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("_n_distinct"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("_n_upper"),
        F.length(F.regexp_replace(t, "[^0-9]+", "")).cast("long").alias("_n_digits"),
        F.length(F.regexp_replace(t, "[^!]+", "")).cast("long").alias("_n_bangs"),
        F.length(F.regexp_replace(t, r"[^|]+", "")).cast("long").alias("_n_pipes"),
        _fence(hashes).alias("_hashes"),
    )
    # Only a text in which some window hash occurs twice pays for the sort.
    has_repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    in_order = counted.withColumn("_sorted", _fence(F.when(has_repeats, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    repeated = F.filter(
        F.transform("_sorted", lambda e, k: F.when((e.h == F.get("_sorted", k - 1).h) | (e.h == F.get("_sorted", k + 1).h), e.i)),
        lambda i: i.isNotNull(),
    )
    starts = in_order.withColumn("_starts", _fence(F.array_sort(repeated))).drop("_sorted", "_hashes")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    covered = F.aggregate("_starts", start, lambda a, i: F.struct(i.alias("last"), (a.total + F.least(F.lit(WINDOW), i - a.last)).alias("total")), lambda a: a.total)
    return starts.withColumn("n_repeat_words", _fence(F.coalesce(covered, F.lit(0)).cast("long"))).drop("_starts")


def features() -> dict[str, Column]:
    """The rule features as expressions over the columns of ``text_statistics``."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "_n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "distinct_word_share": per("_n_distinct", "n_words"),
        "upper_share": per("_n_upper", "word_chars"),
        "digit_share": per("_n_digits", "word_chars"),
        "bangs_per_word": per("_n_bangs", "n_words"),
        "pipes_per_word": per("_n_pipes", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column > self.threshold if self.above else column <= self.threshold

    def expression(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rejecting rules; what no rule takes is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rule_number(self) -> Column:
        """The number of the first rule that takes the row (from 1), 0 for none."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            both = rule[0].expression()
            for condition in rule[1:]:
                both = both & condition.expression()
            out = F.when(both, F.lit(k)) if out is None else out.when(both, F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def rejects(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(x) for c in rule])
        return out

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if " + " and ".join(map(str, rule)) for k, rule in enumerate(self.rules, 1)) or "keep all"


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_rows`` labelled documents; that bound also bounds the broadcast."""
    picked = labels.select(F.col("doc_id").alias("_label_id"), F.col("quality").cast("int").alias("_quality")).dropna().orderBy(F.xxhash64("_label_id"), "_label_id", "_quality").limit(max_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_label_id"))
    stats = text_statistics(joined).where(~base_failed()).select(F.xxhash64("doc_id").alias("h"), "_quality", *[e.alias(f"f{k}") for k, e in enumerate(features().values())])
    # Of rows that share an id, and so the hash, the order is that of their labels and features: never chance.
    rows = stats.orderBy(*stats.columns).limit(max_rows).collect()
    if not rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0, bool)
    table = np.array([tuple(r) for r in rows], dtype=float)
    return table[:, 2:], table[:, 1] == 0


def _grow(x: np.ndarray, bad: np.ndarray, max_conditions: int) -> list[Condition]:
    """Add the condition with the highest information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < max_conditions and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        before, best, pick = np.log2(p0 / (p0 + n0)), 0.0, None
        for j, name in enumerate(FEATURES):
            order = np.argsort(x[inside, j], kind="stable")
            values, y = x[inside, j][order], bad[inside][order]
            cuts = np.flatnonzero(values[1:] > values[:-1])
            if not len(cuts):
                continue
            below = np.cumsum(y)[cuts]
            total = cuts + 1
            for above in (True, False):
                p, n = (p0 - below, (p0 + n0 - total) - (p0 - below)) if above else (below, total - below)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best + 1e-9:
                    best, pick = gain[k], Condition(name, above, float((values[cuts[k]] + values[cuts[k] + 1]) / 2))
        if pick is None:
            break
        rule.append(pick)
        inside &= pick.holds(x)
    return rule


def _covered(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(len(x), bool)


def learn_rules(x: np.ndarray, bad: np.ndarray, min_precision: float = 0.97, min_covered: int = 8, max_rules: int = 12, max_conditions: int = 3, seed: int = 7) -> DecisionList:
    """Sequential covering: grow a rule on two thirds of the rows left, prune it on the rest, keep it if it is precise.

    A rule joins the list only with a precision of ``min_precision`` on all rows left and on the pruning rows, over at
    least ``min_covered`` rows: rejected documents are lost, so doubtful ones stay.
    """
    found = DecisionList()
    split = np.random.default_rng(seed).permutation(len(x)) % 3 != 0
    left = np.ones(len(x), bool)
    while len(found.rules) < max_rules and (left & bad & split).sum() >= min_covered:
        rule = _grow(x[left & split], bad[left & split], max_conditions)
        if not rule:
            break
        test_x, test_y = x[left & ~split], bad[left & ~split]

        def worth(r: list[Condition], test_x: np.ndarray = test_x, test_y: np.ndarray = test_y) -> float:
            inside = _covered(r, test_x)
            return (test_y[inside].sum() - (~test_y[inside]).sum()) / inside.sum() if inside.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        inside, tested = _covered(rule, x) & left, _covered(rule, test_x)
        if inside.sum() < min_covered or bad[inside].mean() < min_precision or (tested.any() and test_y[tested].mean() < min_precision):
            break
        found.rules.append(tuple(rule))
        left &= ~inside
    return found


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``rule`` (0: none) and ``kept``."""
    stats = text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rules.rule_number())
    return stats.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Learn a decision list from ``labels`` (doc_id, quality) and apply it to ``docs`` (doc_id, text)."""
    rules = learn_rules(*training_rows(docs, labels, max_training_rows))
    return apply_rules(docs.select("doc_id", "text"), rules)
