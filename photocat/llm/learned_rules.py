"""Quality rules as a decision list learnt from labelled statistics.

Every text becomes a row of statistics, in one pass over its bytes.  Sequential covering
learns from labelled rows: a rule starts empty and grows by the threshold that
gains the most information, on two thirds of the rows; it is pruned on the last third to
the leading conditions that separate best there; the rows that it covers are set aside,
and the next rule is grown.  Rules are learnt for the rarest label first, the most frequent
label is what remains.  A rule that is not precise enough on the pruning rows ends its label.

The list becomes one ordered Spark expression, ``when(a and b, label).when(...).otherwise(...)``,
over the statistics, so applying it needs no Python and anyone can read it.

At most ``per_label`` different rows of statistics of each label reach the driver, those with the
smallest hash, a few numbers each; everything else covers all rows.

Words are runs of characters other than U+0020 and U+0009 to U+000D, as they stand.

Nulls, ties and the like
    A null or empty text has only zeros; a share of nothing is 0.  Labels without an id or a
    value teach nothing; of several labels of one id the smallest counts.  Rows of one id
    with different texts all teach.  Equal gains go to the first feature in ``FEATURES``,
    then to the smaller threshold.  With one label, or none, the list has no rule;
    without any label everything is kept.  An empty table gives an empty result, and
    repeated rows are each returned.
"""

from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photocat.llm.common import Scratch, in_sample

# Words a repeated window has.
WINDOW = 5
PER_LABEL = 10_000
# Share of pruning rows with the rule's label among those that it covers, below which it is dropped.
LEAST_PRECISION = 0.8
MOST_CONDITIONS = 4
SLICE_BYTES = 1 << 20
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_different", "n_capitals", "n_small", "n_digits", "n_stops",
)


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))


# What rules may test, in the order in which ties are settled.
FEATURES = {
    "symbols_per_word": lambda: _share("n_symbols", "n_words"),
    "dup_line_share": lambda: _share("n_dup_lines", "n_lines"),
    "repeat_word_share": lambda: _share("n_repeat_words", "n_words"),
    "capital_share": lambda: F.coalesce(
        F.try_divide(F.col("n_capitals").cast("double"), F.col("n_capitals") + F.col("n_small")), F.lit(0.0)
    ),
    "digit_share": lambda: _share("n_digits", "word_chars"),
    "chars_per_word": lambda: _share("word_chars", "n_words"),
    "words_per_line": lambda: _share("n_words", "n_lines"),
    "stops_per_word": lambda: _share("n_stops", "n_words"),
    "different_share": lambda: _share("n_different", "n_words"),
    "n_words": lambda: F.col("n_words").cast("double"),
}


def _mask(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


WHITE = _mask(b" \t\n\x0b\x0c\r")
SYMBOL = _mask(b"#*$%&|<>")
CAPITAL = _mask(bytes(range(ord("A"), ord("Z") + 1)))
SMALL = _mask(bytes(range(ord("a"), ord("z") + 1)))
DIGIT = _mask(b"0123456789")
STOP = _mask(b".,;:!?")
INNER = _mask(bytes(range(0x80, 0xC0)))  # all bytes of a character but its first


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many of ``ids`` lie in a run of ``window`` that occurs twice or more.

    Runs are named exactly: a run of two by its two numbers, a longer one by the names of two
    overlapping shorter ones.
    """
    if len(ids) <= window:
        return 0
    _, names, counts = np.unique(ids, return_inverse=True, return_counts=True)
    width = 1
    while width < window:
        step = min(width, window - width)
        pairs = names[:-step] * (int(names.max()) + 1) + names[step:]
        found, names, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        width += step
        if len(found) == len(names):
            return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    again = np.flatnonzero(counts[names] > 1)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts_of(text: str | None) -> tuple:
    """``COUNTS`` of one text."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode()
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in data.split()], np.int64)  # splits at WHITE
    lines = [line for line in data.split(b"\n") if line.strip()]
    tally = np.zeros(256, np.int64)
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw), SLICE_BYTES):
        tally += np.bincount(raw[at : at + SLICE_BYTES], minlength=256)
    return (
        len(ids),
        len(data) - int(tally[WHITE | INNER].sum()),
        int(tally[SYMBOL].sum()),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        len(seen),
        int(tally[CAPITAL].sum()),
        int(tally[SMALL].sum()),
        int(tally[DIGIT].sum()),
        int(tally[STOP].sum()),
    )


def statistics(docs: DataFrame, columns: list, text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with ``COUNTS`` of each whole text and ``base_failed``."""
    kept = docs.select(F.struct(*columns).alias("_kept"), F.col(text_col).alias("_text"))

    def rows(batches):
        for batch in batches:
            found = np.array([counts_of(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(found[:, i]) for i in range(len(COUNTS))]], names=["_kept", *COUNTS]
            )

    schema = T.StructType([kept.schema["_kept"]])
    for name in COUNTS:
        schema = schema.add(name, "long")
    return kept.mapInArrow(rows, schema).select("_kept.*", *COUNTS, base_failed().alias("base_failed"))


def base_failed() -> Column:
    """Too short, or more than a fifth of all words in repeated runs."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, list(FEATURES).index(self.feature)]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple
    label: object

    def column(self) -> Column:
        out = self.conditions[0].column()
        for more in self.conditions[1:]:
            out = out & more.column()
        return out

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def __str__(self) -> str:
        return f"if {' and '.join(map(str, self.conditions))} then {self.label}"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple
    default: object

    def column(self) -> Column:
        """The label as an ordered conditional expression over ``COUNTS``."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(), F.lit(rule.label)) if out is None else out.when(rule.column(), F.lit(rule.label))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))

    def predict(self, x: np.ndarray) -> list:
        """The same in plain numpy, rule by rule."""
        out, open_ = np.full(len(x), self.default, object), np.ones(len(x), bool)
        for rule in self.rules:
            here = open_ & rule.holds(x)
            out[here] = rule.label
            open_ &= ~here
        return list(out)

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), f"else {self.default}"])


def between(low: float, high: float) -> float:
    """The number with the fewest decimals in the middle half of [low, high].

    It reads well and stays clear of the rows on both sides.
    """
    quarter = (high - low) / 4
    for digits in range(16):
        found = round(np.ceil((low + quarter) * 10.0**digits) / 10.0**digits, digits)
        if found <= high - quarter:
            return float(found)
    return float(low)


def _best_condition(x: np.ndarray, y: np.ndarray):
    """The threshold that gains the most over the rows ``x``, by first-order information gain."""
    p, n = int(y.sum()), int((~y).sum())
    base, best, found = log2(p / (p + n)), 1e-9, None
    for at, name in enumerate(FEATURES):
        order = np.argsort(x[:, at], kind="stable")
        value, here = x[order, at], y[order]
        ends = np.flatnonzero(value[1:] > value[:-1])
        if not len(ends):
            continue
        below_p = np.cumsum(here)[ends].astype(float)
        below_n = (ends + 1) - below_p
        for above, pos, neg in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - base), 0)
            top = int(np.argmax(gain))
            if gain[top] > best:
                best = float(gain[top])
                found = Condition(name, above, between(value[ends[top]], value[ends[top] + 1]))
    return found


def grow_rule(x: np.ndarray, y: np.ndarray, most: int = MOST_CONDITIONS) -> list:
    """Conditions added one by one until no row of another label is covered."""
    rule: list = []
    while len(rule) < most and y.any() and not y.all():
        found = _best_condition(x, y)
        if found is None:
            break
        rule.append(found)
        here = found.holds(x)
        x, y = x[here], y[here]
    return rule


def prune_rule(rule: list, x: np.ndarray, y: np.ndarray) -> list:
    """The leading conditions with the best (p - n) / (p + n) on rows that did not grow them."""
    best, kept = -2.0, []
    covered = np.ones(len(y), bool)
    for size, condition in enumerate(rule, 1):
        covered = covered & condition.holds(x)
        p, n = int((covered & y).sum()), int((covered & ~y).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best:
            best, kept = worth, rule[:size]
    return kept


def learn(x: np.ndarray, labels: list, prunes: np.ndarray, least: float = LEAST_PRECISION) -> DecisionList:
    """A list from feature rows; ``prunes`` marks the rows kept for pruning."""
    y = np.array(labels, object)
    values, counts = np.unique(y, return_counts=True)
    order = [v for _, v in sorted(zip(counts.tolist(), values.tolist(), strict=True))]
    rules = []
    open_ = np.ones(len(y), bool)
    for label in order[:-1]:
        mine = y == label
        while True:
            grow, prune = open_ & ~prunes, open_ & prunes
            if not (grow & mine).any():
                break
            rule = prune_rule(grow_rule(x[grow], mine[grow]), x[prune], mine[prune])
            if not rule:
                break
            found = Rule(tuple(rule), label)
            hit = found.holds(x) & prune
            if not hit.any() or (hit & mine).sum() < least * hit.sum():
                break
            rules.append(found)
            open_ &= ~found.holds(x)
    return DecisionList(tuple(rules), order[-1] if order else None)


def fit(
    counted: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    per_label: int = PER_LABEL,
    least: float = LEAST_PRECISION,
) -> DecisionList:
    """A list from the rows of ``statistics`` that pass the base rules and have a label."""
    spark = counted.sparkSession
    scratch = Scratch(spark, "rules")
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).dropna()
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"))
    able = counted.where(~F.col("base_failed")).select(F.col(id_col).alias("_id"), *COUNTS)
    # Equal statistics teach once, so copies neither weigh more nor fill the sample.
    rows = able.join(known, "_id").groupBy("_label", *COUNTS).agg(F.count("*").alias("_rows"))
    rows = scratch.save(rows.withColumn("_order", F.xxhash64(*COUNTS)).drop("_rows"), "taught")
    found: list = []
    for value, n in sorted(rows.groupBy("_label").count().collect()):
        mine = rows.where((F.col("_label") == value) & in_sample(F.col("_order"), per_label, n))
        features = [make().alias(name) for name, make in FEATURES.items()]
        found += mine.select("_label", "_order", *features).orderBy("_order", *FEATURES).limit(per_label).collect()
    scratch.drop("taught")
    x = np.array([r[2:] for r in found], float).reshape(-1, len(FEATURES))
    prunes = np.array([r["_order"] % 3 == 0 for r in found], bool)
    return learn(x, [r["_label"] for r in found], prunes, least)


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    good=1, **how,
) -> DataFrame:
    """Statistics of every row of ``docs``, ``base_failed``, ``verdict`` and ``kept``.

    ``verdict`` is the label of the first rule that holds, null where nothing was learnt.
    A text is kept if it passes the base rules and its verdict is ``good`` or null.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    counted = scratch.save(statistics(docs, [id_col], text_col), "counted")
    verdict = fit(counted, labels, id_col, label_col, **how).column()
    good_or_open = F.coalesce(F.col("verdict") == good, F.lit(True))
    return counted.withColumn("verdict", verdict.cast(labels.schema[label_col].dataType)).withColumn(
        "kept", ~F.col("base_failed") & good_or_open
    )
