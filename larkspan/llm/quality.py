"""Quality by ordinal regression: cumulative links over hashed text features, one weight vector, ordered thresholds.

P(grade <= k | x) = sigmoid(t_k - w.x) with t_0 < t_1 < ...; the expected grade
is the sum of P(grade > k), and a document is selected by P(grade >= wanted).
"""

from __future__ import annotations

import operator
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import as_bytes, doc_id, doc_key, text_key

#: Hashed features: words (present or not) in the first half, shapes of words (share of the text's words) in the second.
FEATURES = 1 << 18
#: Labelled documents that the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 8000
#: A feature counts if so many documents of the sample have it, and one grade has it this many standard deviations more or less often than its share.
LEAST_DOCS, LEAST_Z = 4, 5.0
GRADES = 3
#: How far rare grades weigh more: 0 not at all, 1 as much as common ones.
EVEN = 0.5
#: Weight of a word's presence and of a shape's share among the inputs.
WORD_SCALE, SHAPE_SCALE = 1.0, 20.0
#: Words added to the count that shares are taken of: a few words say little.
EXTRA = 10
SHAPES = ((re.compile(rb"[\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]{2,}"), b"A"), (re.compile(rb"[a-z]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^A-Za-z0-9])\1+"), rb"\1\1"), (re.compile(rb"a+"), b"a"))
#: Share of words that equal the word before them.
ECHO = FEATURES - 1
#: Words whose features a worker keeps, at most.
KEPT = 200_000


def word_features(word: bytes) -> tuple[int, int]:
    """The feature of a word without case and outer punctuation, and that of its shape."""
    shape = word
    for pattern, to in SHAPES:
        shape = pattern.sub(to, shape)
    core = word.lower().strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    half = FEATURES // 2
    return xxhash.xxh64_intdigest(core) % half, half + xxhash.xxh64_intdigest(shape) % (half - 1)


def features(text: bytes, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; known: word to features."""
    words = text.split()
    found = np.empty((len(words), 2), np.int64)
    for i, w in enumerate(words):
        f = known.get(w)
        if f is None:
            f = word_features(w)
            if len(known) < KEPT:
                known[w] = f
        found[i] = f
    core = np.unique(found[:, 0])
    shape, times = np.unique(found[:, 1], return_counts=True)
    n = len(words) + EXTRA
    return np.concatenate((core, shape, [ECHO])), np.concatenate((np.full(len(core), WORD_SCALE), SHAPE_SCALE * times / n, [SHAPE_SCALE * echo(words) / n]))


def echo(words: list[bytes]) -> int:
    return sum(map(operator.eq, words, words[1:]))


def _gather(batches):
    known: dict = {}
    for b in batches:
        rows = [features(t or b"", known) for t in as_bytes(b.column(0))]
        packed = [(at.astype("<i4").tobytes(), value.astype("<f4").tobytes()) for at, value in rows]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary()), *(b.column(k) for k in (1, 2, 3))], names=["at", "value", "grade", "did", "tk"])


def grades(labels: DataFrame) -> DataFrame:
    """did, grade of each labelled document: 0 toxic, 1 poor, 2 good; the lowest of several, none where a label is missing."""
    grade = F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2)
    return labels.select(F.col("doc_id").cast("long").alias("did"), grade.alias("grade")).where("did IS NOT NULL AND grade IS NOT NULL").groupBy("did").agg(F.min("grade").alias("grade"))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[tuple]:
    """(indices, values, grade) of at most `most` labelled documents, on the driver: those with the smallest hash of their id, then of their text.

    Texts become features where they are read, so what is ordered and sent is
    a few packed features a document, however long it is.
    """
    chosen = grades(labels).orderBy(F.xxhash64("did"), "did").limit(most)
    joined = docs.select(doc_key().alias("did"), "text").join(F.broadcast(chosen), "did")
    rows = joined.select(F.coalesce("text", F.lit("")).alias("text"), "grade", "did", text_key().alias("tk"))
    packed = rows.mapInArrow(_gather, "at binary, value binary, grade int, did long, tk long")
    packed = packed.orderBy(F.xxhash64("did"), "did", "tk").limit(most).select("at", "value", "grade").toLocalIterator()
    return [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["value"], "<f4"), r["grade"]) for r in packed]


class Model:
    """w, and the thresholds t. Without documents of at least two grades it selects everything that has words."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    def tails(self, x: np.ndarray) -> np.ndarray:
        """[i, k]: P(grade > k) at score x[i]."""
        return 1 / (1 + np.exp(np.clip(self.t[None, :] - x[:, None], -50, 50)))


def fit(rows: list[tuple], ridge: float = 1e-4, steps: int = 150) -> Model:
    """Maximum likelihood with a ridge penalty, by limited-memory BFGS on the sparse sample."""
    y = np.array([r[2] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(FEATURES), np.full(GRADES - 1, -50.0))
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    del rows
    n, share = len(y), np.bincount(y, minlength=GRADES) / len(y)
    docs_with = np.bincount(at, minlength=FEATURES)
    telling = np.zeros(FEATURES, bool)
    for k in np.flatnonzero(share):
        seen = np.bincount(at[y[owner] == k], minlength=FEATURES)
        telling |= np.abs(seen - docs_with * share[k]) >= LEAST_Z * np.sqrt(np.maximum(docs_with, 1) * share[k] * (1 - share[k]))
    telling &= docs_with >= LEAST_DOCS
    at, value, owner = at[telling[at]], value[telling[at]], owner[telling[at]]
    used, at = np.unique(at, return_inverse=True)
    at, value, m = at.astype(np.int32), value.astype(np.float32), len(used)
    weight = (1 / share[y]) ** EVEN
    weight /= weight.mean()

    def loss(p):
        w, t = p[:m], np.append(p[m], p[m] + np.cumsum(np.exp(p[m + 1 :])))
        x = np.bincount(owner, value * w[at], n)
        edge = np.concatenate(([-np.inf], t, [np.inf]))
        hi, lo = 1 / (1 + np.exp(-np.clip(edge[y + 1] - x, -40, 40))), 1 / (1 + np.exp(-np.clip(edge[y] - x, -40, 40)))
        chance = np.maximum(hi - lo, 1e-12)
        value_ = -(weight * np.log(chance)).sum() / n + ridge / 2 * (w @ w)
        dh, dl = hi * (1 - hi) * weight / chance / n, lo * (1 - lo) * weight / chance / n
        gw = np.bincount(at, value * (dh - dl)[owner], m) + ridge * w
        gt = np.array([-dh[y == k].sum() + dl[y == k + 1].sum() for k in range(GRADES - 1)])
        gp = np.append(gt.sum(), [np.exp(p[m + 1 + k]) * gt[k + 1 :].sum() for k in range(GRADES - 2)])
        return value_, np.append(gw, gp)

    p = np.zeros(m + GRADES - 1)
    f, g = loss(p)
    past: list = []
    for _ in range(steps):
        d, alphas = g.copy(), []
        for s, q in reversed(past):
            a = s @ d / (s @ q)
            alphas.append(a)
            d -= a * q
        d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1.0
        for (s, q), a in zip(past, reversed(alphas)):
            d += (a - q @ d / (s @ q)) * s
        step, slope = 1.0, g @ d
        while step > 1e-10:
            new = p - step * d
            f2, g2 = loss(new)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (new - p) @ (g2 - g) > 1e-12:
            past = [*past[-9:], (new - p, g2 - g)]
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        p, f, g = new, f2, g2
        if done:
            break
    w = np.zeros(FEATURES)
    w[used] = p[:m]
    return Model(w, np.append(p[m], p[m] + np.cumsum(np.exp(p[m + 1 :]))))


def _grader(model: Model):
    """[i, k]: P(grade > k) of each text of an Arrow column; without words 0."""
    w, t = model.w.astype(np.float32), model.t

    def start():
        known: dict = {}

        def grade(column) -> np.ndarray:
            texts = as_bytes(column)
            score, empty = np.zeros(len(texts)), np.zeros(len(texts), bool)
            for i, text in enumerate(texts):
                words = (text or b"").split()
                if not words:
                    empty[i] = True
                    continue
                core, shape = set(), 0.0
                for x in words:
                    f = known.get(x)
                    if f is None:
                        c, s = word_features(x)
                        f = (c if w[c] else -1, float(w[s]))
                        if len(known) < KEPT:
                            known[x] = f
                    if f[0] >= 0:
                        core.add(f[0])
                    shape += f[1]
                score[i] = WORD_SCALE * float(sum(w[c] for c in sorted(core))) + SHAPE_SCALE * (shape + echo(words) * float(w[ECHO])) / (len(words) + EXTRA)
            tails = Model(w, t).tails(score)
            tails[empty] = 0.0
            return tails

        return grade

    return start


def _apply(model: Model, wanted: int, least: float):
    start = _grader(model)

    def run(batches):
        grade = start()
        for b in batches:
            tails = grade(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(1)), pa.array(tails[:, wanted - 1]), pa.array(tails[:, wanted - 1] >= least)], names=["did", "expected_grade", "tail_probability", "kept"])

    return run


def classify(docs: DataFrame, labels: DataFrame, wanted: int = 2, least: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept of every row of docs.

    Fitted on at most `most` labelled documents; all rows are graded over their
    whole texts. tail_probability is P(grade >= wanted), kept where it is at
    least `least`. Texts without words, null ones too, have grade 0 and are not
    selected. Labels without a document, and with a null in them, do not count;
    repeated rows get the same grade; no rows give no rows.
    """
    model = fit(sample(docs, labels, most))
    out = spread(docs.select(doc_key().alias("did"), "text")).mapInArrow(_apply(model, wanted, least), "did long, expected_grade double, tail_probability double, kept boolean")
    return out.select(doc_id("did").alias("doc_id"), "expected_grade", "tail_probability", "kept")


def select(docs: DataFrame, labels: DataFrame, wanted: int = 2, least: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, that classify() keeps; null, empty and repeated rows are graded as there, no rows give no rows."""
    start, at = _grader(fit(sample(docs, labels, most))), docs.columns.index("text")

    def run(batches):
        grade = start()
        for b in batches:
            yield b.filter(pa.array(grade(b.column(at))[:, wanted - 1] >= least))

    return spread(docs).mapInArrow(run, docs.schema)
