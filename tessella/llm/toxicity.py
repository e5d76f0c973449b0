"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased and cut into words at ASCII characters that are no letters. Each different word of a text counts once; its
n-grams (lengths ``SIZES``, one boundary mark on either side) are hashed to ``2**BITS`` features. A feature's value is the number
of different words that have it times its log-count ratio r = log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2)), where p of P toxic
and q of Q other training texts have it. Logistic regression with an L2 penalty is fitted on these values.

Only fitting uses a sample: at most ``max_rows`` labelled texts of each class, those with the smallest hash of their id, none
longer than ``max_chars``. They are featurised on the executors and fitted on the driver, whose memory the two bounds bound.
Scoring is one pass over all texts, without a shuffle.

Defined results: null and empty texts have no features and get the score of the intercept. Repeated rows get equal scores. With
no labelled text, or one class only, the score is the share of label 1, 0.0 without any label. Rows with a null label are not
learned from. Extra columns pass through ``score()``; one named score or predicted is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm.scratch import arrow_map

SIZES = (2, 3, 4, 5)
BITS = 20
_TEXTS = 100  # fitted at a time
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = _LETTER[128:] = 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALT = [np.uint64(n * 0x9E3779B97F4A7C15 % 2**64) for n in range(max(SIZES) + 1)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class Grams:
    """The hashed n-grams of some texts, in flat arrays: one entry for each byte, word and text."""

    def __init__(self, texts: list[str | None]):
        parts = [b" " + (t or "").lower().encode("utf-8", "replace") + b" " for t in texts]
        data = np.frombuffer(b"".join(parts) + b" " * 8, np.uint8)
        self.n_texts, letter = len(texts), _LETTER[data]
        self.codes = np.where(letter, data, np.uint8(32)).astype(np.uint64)
        edge = np.diff(letter.astype(np.int8))
        self.letter, self.starts, self.ends = letter, np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        self.text_of = np.searchsorted(np.cumsum([len(p) for p in parts]), self.starts, "right")
        self.first = self._first()

    def _first(self) -> np.ndarray:
        """Of each word, whether it is the first such word of its text."""
        if not len(self.starts):
            return np.zeros(0, bool)
        offset = np.arange(len(self.codes)) - np.repeat(np.concatenate([[0], self.starts]), np.diff(np.concatenate([[0], self.starts, [len(self.codes)]])))
        value = np.where(self.letter, _mix(self.codes | offset.astype(np.uint64) << np.uint64(8)), np.uint64(0))
        words = _mix(np.add.reduceat(value, self.starts) ^ _mix(self.text_of.astype(np.uint64)))
        out = np.zeros(len(words), bool)
        out[np.unique(words, return_index=True)[1]] = True
        return out

    def orders(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n: a feature for each start, and whether the n-gram lies within one word and its boundaries."""
        n_starts, hashed = len(self.codes) - max(SIZES), np.zeros(len(self.codes), np.uint64)
        inner = np.ones(n_starts, bool)
        for n in range(1, max(SIZES) + 1):
            hashed[:n_starts] = hashed[:n_starts] * np.uint64(257) + self.codes[n - 1 : n - 1 + n_starts]
            if n > 2:
                inner &= self.letter[n - 2 : n - 2 + n_starts] == 1
            if n in SIZES:
                some = inner if n > 2 else (self.letter[:n_starts] | self.letter[1 : 1 + n_starts]) == 1
                yield (_mix(hashed[:n_starts] + _SALT[n]) >> np.uint64(64 - BITS)).astype(np.int32), some

    def counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its features and the number of different words with each."""
        n_starts = len(self.codes) - max(SIZES)
        word_of = np.cumsum(np.bincount(self.starts - 1, minlength=len(self.codes)))[:n_starts] - 1
        keep = (word_of >= 0) & np.append(self.first, False)[word_of]
        found = []
        for feature, valid in self.orders():
            at = np.flatnonzero(valid & keep)
            found.append(np.unique(word_of[at].astype(np.int64) << BITS | feature[at]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        texts = self.text_of[pairs >> BITS].astype(np.int64) if len(pairs) else pairs
        keys, n = np.unique(texts << BITS | (pairs & ((1 << BITS) - 1)), return_counts=True)
        bounds = np.searchsorted(keys >> BITS, np.arange(self.n_texts + 1))
        return [((keys[a:b] & ((1 << BITS) - 1)).astype(np.int32), n[a:b].astype(np.float32)) for a, b in zip(bounds[:-1], bounds[1:])]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each text the sum of weights over the n-grams of its different words."""
        if not len(self.starts):
            return np.zeros(self.n_texts)
        value = np.zeros(len(self.codes), np.float32)
        for feature, valid in self.orders():
            value[: len(feature)] += np.where(valid, weights[feature], np.float32(0))
        by_word = np.add.reduceat(value, self.starts - 1)
        return np.bincount(self.text_of[self.first], by_word[self.first], self.n_texts)


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, penalty: float = 3.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights (log-count ratios folded in) and intercept. Features in fewer than three texts get no weight."""
    n, dims = len(rows), 1 << BITS
    toxic = labels == 1
    share = float(toxic.mean()) if n else 0.0
    if not n or share in (0.0, 1.0):
        return np.zeros(dims, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    # the driver holds 12 bytes for each feature of a text; what is made of them is made a slice of texts at a time
    feature = np.concatenate([f for f, _ in rows])
    lens = np.array([len(f) for f, _ in rows])
    row = np.repeat(np.arange(n, dtype=np.int32), lens)
    seen = [np.zeros(dims, np.int64), np.zeros(dims, np.int64)]
    for (f, _), mark in zip(rows, toxic):
        seen[int(mark)][f] += 1  # a text's features are different ones
    q, p = seen
    ratio = (np.log((p + 1) / (toxic.sum() + 2)) - np.log((q + 1) / ((~toxic).sum() + 2))).astype(np.float32)
    ratio[p + q < 3] = 0
    del p, q, seen
    ids, place = np.flatnonzero(ratio), np.zeros(dims, np.int32)
    place[ids] = np.arange(len(ids), dtype=np.int32)
    used = ratio[feature] != 0
    feature, row, value = feature[used], row[used], np.concatenate([c for _, c in rows])[used]
    value *= ratio[feature]
    feature = place[feature]
    del place, used
    # slices end where a text does, so a text's sum is the same as in one piece
    ends = np.searchsorted(row, np.arange(0, n + _TEXTS, _TEXTS))
    y = toxic.astype(np.float64)
    w, b = np.zeros(len(ids)), float(np.log(share / (1 - share)))

    def loss(w, b):
        z = np.full(n, b)
        for i, j in zip(ends[:-1], ends[1:]):
            z += np.bincount(row[i:j], value[i:j] * w[feature[i:j]], n)
        g = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
        grad = penalty * w
        for i, j in zip(ends[:-1], ends[1:]):
            grad += np.bincount(feature[i:j], value[i:j] * g[row[i:j]], len(ids))
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + penalty / 2 * (w @ w)), np.append(grad, g.sum())

    x = _minimise(lambda x: loss(x[:-1], x[-1]), np.append(w, b), rounds)
    out = np.zeros(dims, np.float32)
    out[ids] = x[:-1] * ratio[ids]
    return out, float(x[-1])


def _minimise(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, alphas = -grad, []
        for s, y, rho in reversed(steps):
            alphas.append(rho * (s @ d))
            d = d - alphas[-1] * y
        if steps:
            s, y, rho = steps[-1]
            d = d / (rho * (y @ y))
        for (s, y, rho), alpha in zip(steps, reversed(alphas)):
            d = d + (alpha - rho * (y @ d)) * s
        slope, size = grad @ d, 1.0 if steps else 1.0 / max(1.0, float(np.abs(grad).max()))
        for _ in range(25):
            new_value, new_grad = f(x + size * d)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x
        s, y = size * d, new_grad - grad
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        x, value, grad = x + s, new_value, new_grad
        if done:
            return x
        if s @ y > 1e-10:
            steps = [*steps, (s, y, 1 / (s @ y))][-memory:]
    return x


def _slices(texts: list, limit: int = 1_000_000) -> Iterator[list]:
    """Consecutive runs of texts of bounded size together (a text over the limit comes alone)."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
        """df without its text (unless kept), with score and predicted (1 if score >= 0.5). One pass, no shuffle."""
        kept = [c for c in df.columns if c not in (text, "score", "predicted")]
        made = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
        schema = T.StructType([*[df.schema[c] for c in kept], *([df.schema[text]] if keep_text else []), *made])
        shared = df.sparkSession.sparkContext.broadcast((self.weights, self.intercept))  # 4 MB whatever the input

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, intercept = shared.value
            for whole in batches:
                step = max(1, min(whole.num_rows, int(whole.num_rows * 4_000_000 / max(whole.nbytes, 1))))
                for i in range(0, whole.num_rows, step):
                    batch = whole.slice(i, step)
                    texts = batch.column(batch.num_columns - 1).to_pylist()
                    z = np.concatenate([Grams(run).sums(weights) for run in _slices(texts)] or [np.zeros(0)]) + intercept
                    score = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                    columns = batch.columns if keep_text else batch.columns[:-1]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

        return arrow_map(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text__")), work, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 1_000, max_chars: int = 200_000) -> Model:
    """A model of the labelled texts: at most max_rows of each label are fitted, see the module's text.

    The sample holds both labels alike; the intercept is moved to the labels' true odds. An id with several texts stands for the
    smallest of them that is not too long.
    """
    y = F.col(label).cast("int")
    known = labels.select(F.col(id_col).alias("__id__"), y.alias("__y__")).where(y.isin(0, 1))
    counts = {r["__y__"]: r["count"] for r in known.groupBy("__y__").count().collect()}
    sample = None
    for value in (0, 1):
        part = known.where(F.col("__y__") == value).orderBy(F.xxhash64(F.col("__id__").cast("string")), "__id__").limit(max_rows)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col(id_col).alias("__id__"), F.col(text).alias("__t__")).where(F.coalesce(F.length("__t__"), F.lit(0)) <= max_chars)
    rows = texts.join(F.broadcast(sample), "__id__").groupBy("__id__", "__y__").agg(F.min("__t__").alias("__t__")).select("__t__", "__y__")  # 2 * max_rows ids at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1)
            found = [x for run in _slices(texts) for x in Grams(run).counts()]
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f, _ in found], pa.binary()), pa.array([c.tobytes() for _, c in found], pa.binary()), y], names=["f", "c", "y"])

    got = arrow_map(rows, work, "f binary, c binary, y int").collect()
    got.sort(key=lambda r: (r.y, r.f, r.c))  # the same sums whatever the order of the tasks
    marks = np.array([r.y for r in got])
    found = [(np.frombuffer(r.f, np.int32), np.frombuffer(r.c, np.float32)) for r in got]
    del got
    weights, intercept = fit_weights(found, marks)
    if len(counts) == 2 and 0 < marks.sum() < len(marks):
        intercept += float(np.log(counts[1] / counts[0]) - np.log(marks.sum() / (len(marks) - marks.sum())))
    return Model(weights, intercept)
