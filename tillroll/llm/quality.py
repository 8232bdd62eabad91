"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features: its words, their first 4 and 6 bytes
(compounds share a stem), marks of shape, and banded shares (distinct words,
symbols, bars, capitals, length of words, short words). Grades 0 < 1 < 2 share one
weight a feature, and ordered thresholds cut the score:
P(grade <= k) = sigmoid(threshold[k] - score). The fit takes a bounded sample
of labelled rows by hash of their id; its features are checkpointed and every
gradient is one Spark job that returns a vector a partition. Scoring reads
every whole text once, with the weights broadcast (4 bytes a hash slot).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import cut_lineage
from .common import worker_kept

HASH_BITS = 17
#: Most labelled rows the fit reads.
SAMPLE = 20_000
STEPS = 40
RIDGE = 1.0
STRIP = b".,;:!?\"'()[]{}"
#: Strings whose slots a task keeps.
CACHE = 1 << 18
#: Leading bytes of a word that count as its stems.
STEMS = (4, 6)
#: Slots a mark takes; more make the ridge bear less on it.
MARK_COPIES = 4


@dataclass
class Model:
    """Weights by hash slot and ordered thresholds (one fewer than grades)."""
    weights: np.ndarray
    thresholds: np.ndarray


class Slots(dict):
    """Word to the hash slots of the word and its stems, kept."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        names = {word, *(b"\r" + word[:n] for n in STEMS if len(word) > n)}
        slots = self[word] = tuple(xxhash.xxh32_intdigest(x) & self.mask for x in names)
        return slots


def features(text: str | None, slots: Slots) -> np.ndarray:
    """The sorted distinct hash slots of a text."""
    raw = (text or "").encode()
    words = raw.split()
    distinct = set(words)
    low = {w.lower().strip(STRIP) for w in distinct}
    low.discard(b"")
    n = max(1, len(words))
    odd = sum(1 for w in distinct if w[-1:] in b"*#%&$|@~^+=<>_\\/")
    bands = (len(distinct) / n, odd / max(1, len(distinct)), words.count(b"|") / n,
             sum(1 for w in distinct if w.isupper()) / max(1, len(distinct)),
             sum(map(len, distinct)) / max(1, len(distinct)) / 20, sum(1 for w in words if len(w) < 4) / n)
    marks = [b"\n%d%d%d" % (copy, i, min(9, int(10 * share))) for i, share in enumerate(bands)
             for copy in range(MARK_COPIES)]
    found: set[int] = set()
    found.update(*map(slots.__getitem__, low), *map(slots.__getitem__, marks))
    return np.sort(np.fromiter(found, np.int32, len(found)))


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def grade_probabilities(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade) by row; columns are grades."""
    below = _sigmoid(thresholds[None, :] - score[:, None])
    return np.diff(below, axis=1, prepend=0.0, append=1.0)


def _gradient(rows, weights, thresholds):
    """Loss and gradients of the cumulative link over (grade, slots) rows."""
    g_w, g_t, loss = np.zeros_like(weights), np.zeros_like(thresholds), 0.0
    top = len(thresholds)
    for grade, slots in rows:
        s = float(weights[slots].sum())
        hi = _sigmoid(thresholds[grade] - s) if grade < top else 1.0
        lo = _sigmoid(thresholds[grade - 1] - s) if grade else 0.0
        p = max(hi - lo, 1e-12)
        loss -= np.log(p)
        d_hi = hi * (1 - hi) if grade < top else 0.0
        d_lo = lo * (1 - lo) if grade else 0.0
        g_w[slots] += (d_hi - d_lo) / p
        if grade < top:
            g_t[grade] -= d_hi / p
        if grade:
            g_t[grade - 1] += d_lo / p
    return loss, g_w, g_t


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        grade_col: str = "grade", grades: int = 3, sample: int = SAMPLE, bits: int = HASH_BITS,
        steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Fit on the ``sample`` rated documents whose ids hash lowest. Ratings that
    are null, out of range or of unknown documents are left out before that; a
    document rated more than once counts each time. Without ratings all weights are
    zero and the thresholds make all grades equally likely."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = (ratings.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("grade"))
              .where(F.col("id").isNotNull() & F.col("grade").between(0, grades - 1))
              .join(texts.select("id").distinct(), "id", "left_semi")
              .orderBy(F.md5(F.col("id").cast("string")), "id", "grade").limit(sample))

    def make(batches):
        slots = Slots(bits)
        for b in batches:
            sets = [features(t, slots) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["grade", "slots"])

    # at most `sample` rows of two numbers are broadcast
    rows = cut_lineage(texts.join(F.broadcast(chosen), "id").select("grade", "text")
                       .mapInArrow(make, "grade int, slots binary")).coalesce(6)
    counts = dict(rows.groupBy("grade").count().collect())
    total = sum(counts.values())
    share = np.cumsum([counts.get(g, 0) + 1 for g in range(grades)])[:-1] / (total + grades)
    thresholds = np.log(share / (1 - share))
    weights = np.zeros(1 << bits)
    if len(counts) < 2:
        return Model(weights.astype(np.float32), thresholds)

    def evaluate(w, t):
        shared = rows.sparkSession.sparkContext.broadcast((w, t))

        def part(batches):
            w, t = shared.value
            loss, g_w, g_t = 0.0, np.zeros_like(w), np.zeros_like(t)
            for b in batches:
                data = [(g, np.frombuffer(s, np.int32)) for g, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                one = _gradient(data, w, t)
                loss, g_w, g_t = loss + one[0], g_w + one[1], g_t + one[2]
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([g_w.tobytes()], pa.binary()),
                                              pa.array([g_t.tobytes()], pa.binary())], ["loss", "w", "t"])
        loss, g_w, g_t = 0.0, ridge * w, np.zeros_like(t)
        for r in rows.mapInArrow(part, "loss double, w binary, t binary").collect():  # a vector a partition
            loss += r["loss"]
            g_w, g_t = g_w + np.frombuffer(r["w"]), g_t + np.frombuffer(r["t"])
        shared.unpersist()
        return loss + 0.5 * ridge * float(w @ w), np.concatenate([g_w, g_t])

    # limited-memory quasi-Newton steps; a step that does not lower the loss is halved
    x, k = np.concatenate([weights, thresholds]), 1 << bits
    loss, g = evaluate(x[:k], x[k:])
    memory, left = [], steps
    while left > 0 and np.abs(g).max() > 1e-4 * max(1.0, total):
        q, alphas = g.copy(), []
        for s, y, r in reversed(memory):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * y
        q *= (memory[-1][0] @ memory[-1][1]) / (memory[-1][1] @ memory[-1][1]) if memory else 1.0 / np.abs(g).max()
        for (s, y, r), a in zip(memory, reversed(alphas)):
            q += s * (a - r * (y @ q))
        rate = 1.0
        while left > 0:
            new = x - rate * q
            left -= 1
            ordered = bool(np.all(np.diff(new[k:]) > 0))
            new_loss, new_g = evaluate(new[:k], new[k:]) if ordered else (np.inf, g)
            if new_loss < loss:
                break
            rate *= 0.5
        else:
            break
        s, y = new - x, new_g - g
        if s @ y > 1e-10:
            memory = [*memory[-7:], (s, y, 1.0 / (s @ y))]
        done = loss - new_loss < 1e-5 * loss
        x, loss, g = new, new_loss, new_g
        if done:
            break
    return Model(x[:k].astype(np.float32), x[k:])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade (0 to the top grade) and tail_probability
    (of the top grade): columns of ``docs`` of the same names are replaced.
    Null and empty texts are scored as texts without words; repeated rows alike;
    an empty table gives an empty result."""
    bits = len(model.weights).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    keep = [c for c in docs.columns if c not in ("expected_grade", "tail_probability")]
    at = keep.index(text_col)
    slim = docs.select(*[docs[c] for c in keep])

    def rate(batches):
        slots = worker_kept(f"quality {bits}", lambda: Slots(bits))
        weights, thresholds = shared.value
        for b in batches:
            s = np.array([float(weights[features(None if t is None else str(t), slots)].sum())
                          for t in b.column(at).to_pylist()])
            p = grade_probabilities(s, thresholds)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, -1])],
                [*keep, "expected_grade", "tail_probability"])

    schema = StructType([*slim.schema.fields, StructField("expected_grade", DoubleType()),
                         StructField("tail_probability", DoubleType())])
    return slim.mapInArrow(rate, schema)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for toxic, 1 for poor, 2 for good documents. A label
    without either mark has no grade."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1)
                         .when(F.col("quality") == 1, 2).alias("grade"))


def select_good(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose top grade has a probability of ``threshold`` or
    more, with both scores. A model without a fit (all weights zero: ratings of
    fewer than two grades) cannot tell documents apart, so all rows stay."""
    scored = score(docs, model, id_col, text_col)
    return scored.where(F.col("tail_probability") >= threshold) if model.weights.any() else scored
