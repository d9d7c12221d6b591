"""Hierarchical language identification.

First the family of a text is predicted, then linear support vector machines, one for
each pair of languages of that family, vote on the language.  Family and languages
use the same features: frequencies of letter n-grams (n = 1 to 3, words padded by
one space) over the whole text, hashed to ``BUCKETS`` numbers and scaled by how
much they vary.  Every score is linear, so a text costs one pass over its letters.

The models are fitted on at most ``per_language`` different labelled texts of each
language, those with the smallest hash of their text.  Tasks turn these texts, which are
whole, into frequencies, so the driver gets ``BUCKETS`` numbers for each at most, however long
it is.  Prediction reads whole texts too and nothing but texts.

Families follow ``FAMILIES``; a language that is not listed is a family of its own.

Nulls, ties and the like
    A text that is null or holds no letter is ``und`` with score 0.  Texts without a
    label teach nothing.  Ties of votes go to the larger sum of margins, then to
    the alphabetically first language.  With one learned language every text with
    a letter is that language; with none, all are ``und``.  An empty table gives an
    empty result; repeated rows get equal predictions.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photocat.llm.common import in_sample

BITS = 13
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
PER_LANGUAGE = 500
SLICE_CHARS = 1 << 18
UNDETERMINED = "und"
# Every text with a letter matches; code points that Java does not know may be letters to Python.
MAY_HOLD_LETTER = "[\\p{L}\\p{Cn}]"
# ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no is af",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk pl cs sk bg sr hr sl",
    "uralic": "fi et hu",
    "turkic": "tr az kk",
    "indic": "hi bn ur mr gu pa",
    "sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> np.ndarray:
    """Code points in lower case, every run of other characters being one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    known, at = np.unique(points, return_inverse=True)
    alphabetic = np.array([chr(p).isalpha() for p in known], bool)[at]
    points = np.where(alphabetic, points, np.uint32(32))
    keep = alphabetic | np.concatenate(([True], alphabetic[:-1]))
    points = points[keep]
    return np.concatenate(([32], points, [32])).astype(np.uint64)


def ngram_buckets(text: str):
    """Bucket numbers of all n-grams of ``text``, slice by slice; each slice begins where words do."""
    at = 0
    while at < len(text):
        end = at + SLICE_CHARS
        if end < len(text):
            space = text.rfind(" ", at, end)
            end = space if space > at else end
        points = letters(text[at:end])
        at = end
        if not (points != 32).any():
            continue
        run = np.zeros(len(points), np.uint64)
        for n in ORDERS:
            run = run[: len(points) - n + 1] * np.uint64(0x10FFFF + 1) + points[n - 1 :]
            used = run[(points[: len(run)] != 32) | (n > 1)]
            yield ((used + np.uint64(n)) * _MULTIPLIER >> np.uint64(64 - BITS)).astype(np.int64)


def frequencies(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS)
    for found in ngram_buckets(text):
        total += np.bincount(found, minlength=BUCKETS)
    return total / max(total.sum(), 1)


class Model:
    """Weights of all linear scores side by side, so a text is scored in one product."""

    def __init__(self, samples: list, labels: list, seed: int = 5):
        """``samples`` are texts, or a matrix of their frequencies, which is used up."""
        self.languages = sorted(set(labels))
        x = samples
        if not isinstance(samples, np.ndarray):
            x = np.zeros((len(samples), BUCKETS), np.float32)
            for i, sample in enumerate(samples):
                x[i] = frequencies(sample)
        self.spread = x.std(0) + 1e-4 if len(x) else np.ones(BUCKETS)
        self.center = x.mean(0) if len(x) else np.zeros(BUCKETS)
        x -= self.center
        x /= self.spread
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
        y = np.array(labels)
        family = np.array([FAMILY_OF.get(v, v) for v in labels])
        self.families = sorted(set(family.tolist()))
        self.members = {f: sorted(set(y[family == f].tolist())) for f in self.families}
        weights, self.family_at, self.pair_at = [], {}, {}
        if len(self.families) > 1:
            for f in self.families:
                self.family_at[f] = len(weights)
                weights.append(svm(x, np.where(family == f, 1.0, -1.0), seed))
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                here = (y == a) | (y == b)
                self.pair_at[a, b] = len(weights)
                weights.append(svm(x[here], np.where(y[here] == a, 1.0, -1.0), seed))
        self.weights = np.stack(weights, 1) if weights else np.zeros((BUCKETS + 1, 0))

    def predict(self, text: str | None) -> tuple:
        if not text or not self.languages:
            return UNDETERMINED, 0.0
        found = frequencies(text)
        if not found.any():
            return UNDETERMINED, 0.0
        x = (found - self.center) / self.spread
        x /= max(np.linalg.norm(x), 1e-12)
        margin = x @ self.weights[:-1] + self.weights[-1]
        family, sure = self.families[0], 1.0
        if self.family_at:
            scores = {f: margin[at] for f, at in self.family_at.items()}
            family = max(self.families, key=lambda f: (scores[f], f))
            rest = max(s for f, s in scores.items() if f != family)
            sure = _logistic(scores[family] - rest)
        members = self.members[family]
        votes = dict.fromkeys(members, 0)
        sums = dict.fromkeys(members, 0.0)
        closest = {m: np.inf for m in members}
        for a, b in combinations(members, 2):
            m = margin[self.pair_at[a, b]]
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            closest[a], closest[b] = min(closest[a], m), min(closest[b], -m)
        best = min(members, key=lambda v: (-votes[v], -sums[v], v))
        if len(members) > 1:
            sure *= _logistic(2 * closest[best])
        return best, float(sure)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(3 * x, -30, 30))))


def svm(x: np.ndarray, y: np.ndarray, seed: int, cost: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Linear SVM with hinge loss by dual coordinate descent; classes weigh the same.

    The last weight is the bias.
    """
    rng = np.random.default_rng(seed)
    n = len(y)
    share = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1)))
    bound = cost * share
    alpha, w = np.zeros(n), np.zeros(x.shape[1] + 1)
    norm = np.einsum("ij,ij->i", x, x) + 1.0
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            gradient = y[i] * (x[i] @ w[:-1] + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), bound[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[:-1] += step * x[i]
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    teach: Column | None = None,
    per_language: int = PER_LANGUAGE,
) -> Model:
    """A model from labelled rows for which ``teach`` holds.

    The frequencies of at most ``per_language`` different texts of each language reach the driver.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    rows = docs.where(text.rlike(MAY_HOLD_LETTER) & lang.isNotNull())
    if teach is not None:
        rows = rows.where(F.coalesce(teach, F.lit(True)))
    rows = rows.select(lang.alias("_lang"), text.alias("_text"), F.xxhash64(text).alias("_order"))
    # Copies count once: a share of all rows would leave few different texts, or none.
    different = rows.groupBy("_lang", "_order").count().groupBy("_lang").agg(F.count("*"))
    total = dict(sorted(tuple(r) for r in different.collect()))
    found: dict = {}
    wanted = dict.fromkeys(total, per_language)
    # One scan serves all languages; another one those of which equal hashes left too few.
    while wanted:
        first = W.partitionBy("_lang").orderBy("_order", "_tie")
        sampled = F.lit(False)
        for code, share in wanted.items():
            sampled = sampled | ((F.col("_lang") == code) & in_sample(F.col("_order"), share, total[code]))
        mine = rows.where(sampled).select("_lang", "_order", F.sha2("_text", 256).alias("_tie"), "_text").distinct()
        mine = mine.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= per_language)
        taken = _with_frequencies(mine.select("_lang", "_place", "_text")).collect()
        for code in wanted:
            found[code] = [r for r in taken if r["_lang"] == code]
        wanted = {
            code: 4 * share
            for code, share in wanted.items()
            if len(found[code]) < min(per_language, total[code]) and 2 * share < total[code]
        }
    kept = [r for code in total for r in sorted(found[code], key=lambda r: r["_place"]) if r["_at"]]
    vectors = np.zeros((len(kept), BUCKETS), np.float32)
    for vector, r in zip(vectors, kept, strict=True):
        vector[np.frombuffer(r["_at"], np.uint16)] = np.frombuffer(r["_found"], np.float32)
    labels = [r["_lang"] for r in kept]
    return Model(vectors, labels) if labels else Model([], [])


def _with_frequencies(texts: DataFrame) -> DataFrame:
    """``(_lang, _place, _at, _found)`` of ``(_lang, _place, _text)``: buckets that are not 0, as 16-bit numbers, and
    their frequencies as 32-bit floats."""

    def rows(batches):
        for batch in batches:
            at, found = [], []
            for text in batch.column(2):
                vector = frequencies(text.as_py()).astype(np.float32)
                used = np.flatnonzero(vector)
                at.append(used.astype(np.uint16).tobytes())
                found.append(vector[used].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(found, pa.binary())],
                names=["_lang", "_place", "_at", "_found"],
            )

    return texts.mapInArrow(rows, "_lang string, _place int, _at binary, _found binary")


def predict(docs: DataFrame, model: Model, columns: list, text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with ``lang_pred`` and ``score`` of the text."""
    kept = docs.select(F.struct(*columns).alias("_kept"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        model = shared.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([v for v, _ in found], pa.string()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                names=["_kept", "_lang", "_score"],
            )

    schema = T.StructType([kept.schema["_kept"]]).add("_lang", "string").add("_score", "double")
    out = kept.mapInArrow(rows, schema)
    return out.select("_kept.*", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def keep_known(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is predicted with a score of at least ``least``."""
    packed = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text"))
    scored = predict(packed, model, ["_doc"], "_text")
    return scored.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("_doc.*")
