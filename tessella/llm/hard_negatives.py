"""Hard negatives by rotated one-bit codes: popcount estimates with Cauchy-Schwarz bounds choose what is scored in integers.

A vector v of integers is turned by a fixed random isometry into ``WIDEN`` times as many directions; the signs are its code c, one
bit each. Stored beside the code are the length of the code vector p within the space of the vectors, and v's alignment with it:
x = <v, p/|p|>, and e, the length of what is left of v. For an anchor a, <a, v> = x * t + r with t = <a, p/|p|>, and by
Cauchy-Schwarz |r| <= e * sqrt(|a|^2 - t^2). t is popcounts of the code under the anchor's bit planes (its turned vector in steps of
``PLANES`` bits; the rounding is bounded in the same way and added). So each row has an interval that holds its score, without its
vector. Rows whose interval can't reach what is already certain are left out; all others are scored exactly. Nothing is lost, and
the result doesn't depend on codes, shards or blocks.

Anchors are a stated query set that meets all rows in blocks: rows are dealt to shards and anchors to blocks of bounded bytes, by
hash, and each (shard, block) is one group of a cogrouped job. A first job finds each anchor's positives, a second one its
negatives under the scores of these; both send a few rows for each anchor and shard to the final ranking.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Each other row counts, repeated rows
too: a second row of an anchor's id is another row, and anchors of one id each have their results. Shorter vectors are filled up
with zeros. Components beyond +-2**24 after scaling count as +-2**24. No rows give no result. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.llm.scratch import drop, written

WIDEN, PLANES = 16, 6
#: Bytes of rows in a shard and of anchors in a block; at least so many shards, so that small tables use all cores.
SHARD, BLOCK, LEAST_SHARDS = 16 << 20, 16 << 20, 24
LIMIT = 1 << 24
ALL = (-(1 << 62), 1 << 62)
_PAIRS = 1 << 19  # anchors times rows whose intervals are held at once


def integers(vector: str, scale: float) -> Column:
    """floor(scale * x) of each component, as double; null for a vector that takes no part."""
    good = F.forall(vector, lambda x: F.coalesce((x < float("inf")) & (x > float("-inf")), F.lit(False)))
    scaled = F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return F.when(good, scaled)


@functools.cache
def isometry(dims: int, bits: int) -> np.ndarray:
    """bits x dims with orthonormal columns, the same each time."""
    return np.linalg.qr(np.random.default_rng(11_000 + dims).standard_normal((bits, dims)))[0]


def _bits(dims: int) -> int:
    return -(-WIDEN * dims // 64) * 64


def encoded(rows: DataFrame, dims: int) -> DataFrame:
    """(id, label, vector, code, reach, along, rest) of rows(id, label, q): the stored form described above; reach is |p|."""
    bits = _bits(dims)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = isometry(dims, bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = np.zeros((part.num_rows, dims), np.int32)
                for k, q in enumerate(part.column("q").to_pylist()):
                    vectors[k, : len(q)] = q
                v = vectors.astype(np.float64)
                ones = v @ turn.T > 0
                inside = (2.0 * ones - 1) @ turn / np.sqrt(bits)
                reach = np.maximum(np.sqrt((inside**2).sum(1)), 1e-9)
                along = (v * inside).sum(1) / reach
                rest = np.sqrt(np.maximum((v**2).sum(1) - along**2, 0))
                made = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (vectors, np.packbits(ones, axis=1, bitorder="little"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), *made, *[pa.array(x) for x in (reach, along, rest)]], names=["id", "label", "vector", "code", "reach", "along", "rest"])

    return rows.mapInArrow(work, f"id long, label {rows.schema['label'].dataType.simpleString()}, vector binary, code binary, reach double, along double, rest double")


class Codes:
    """A shard's rows, and the intervals of their scores against anchors."""

    def __init__(self, table: pa.Table, dims: int) -> None:
        binary = {c: b"".join(table.column(c).to_pylist()) for c in ("vector", "code")}
        self.vectors = np.frombuffer(binary["vector"], np.int32).reshape(-1, dims).astype(np.int64)
        self.code = np.frombuffer(binary["code"], np.uint64).reshape(len(self.vectors), -1)
        self.row, self.id, self.reach, self.along, self.rest = (table.column(c).to_numpy() for c in ("row", "id", "reach", "along", "rest"))
        self.label = np.array(table.column("label").to_pylist(), object)
        self.ones = np.bitwise_count(self.code).sum(1, dtype=np.int64)
        self.size = np.sqrt(self.along**2 + self.rest**2)
        self.longest = float(self.size.max(initial=0)) * (1 + 1e-9)
        self.exact = self.vectors.astype(np.float32) if self.longest < 2**23 else None

    def intervals(self, anchors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible scores, anchors x rows."""
        bits, a = len(turn), anchors.astype(np.float64)
        turned, norm = a @ turn.T, np.sqrt((a**2).sum(1))
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / (2**PLANES - 1), 1e-9)
        units = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        error = np.sqrt(((low[:, None] + step[:, None] * units - turned) ** 2).sum(1))
        counted = np.zeros((len(a), len(self.code)), np.int32)
        for p in range(PLANES):
            plane = np.packbits(units >> p & 1, axis=1, bitorder="little").view(np.uint64)
            found = np.zeros(counted.shape, np.uint16)
            for w in range(plane.shape[1]):
                found += np.bitwise_count(plane[:, w, None] & self.code[None, :, w])
            counted += found.astype(np.int32) << p
        product = step[:, None] * (2 * counted - units.sum(1, dtype=np.int64)[:, None]) + low[:, None] * (2 * self.ones - bits)
        t, slip = product / np.sqrt(bits) / self.reach, error[:, None] / self.reach
        open_ = np.sqrt(np.maximum(norm[:, None] ** 2 - np.maximum(np.abs(t) - slip, 0) ** 2, 0)) * self.rest + np.abs(self.along) * slip
        open_ += 1e-7 * (1 + norm[:, None] * self.size)  # rounding of doubles
        return t * self.along - open_, t * self.along + open_

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact scores of the rows at, as integers. No partial sum exceeds the product of the lengths, so below 2**23 single and
        below 2**52 double precision add integers exactly."""
        bound = np.sqrt((anchor.astype(np.float64) ** 2).sum()) * self.longest
        if bound > 2**52:
            return self.vectors[at] @ anchor
        if self.exact is None or bound > 2**23:
            return (self.vectors[at].astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
        return (self.exact[at] @ anchor.astype(np.float32)).astype(np.int64)


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first: higher scores, then smaller ids."""
    return np.lexsort((ids, -score))[:n]


def highest(codes: Codes, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, n: int, windows: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least, most) the (rows, scores) of the n first of the rows at whose score lies in it.

    Some promising rows are scored first. The n-th of them inside a window bounds what others must reach; rows whose intervals stay
    below for all windows are left out, and the rest is scored once.
    """
    lo, hi = low[at], high[at]
    least, most = min(x for x, _ in windows), max(x for _, x in windows)
    if len(at) > 8 * n:
        guess = lo + hi
        guess = np.where(guess <= 2 * most, guess, 4 * most - guess)
        probe = at[np.argpartition(-guess, 8 * n)[: 8 * n]]
        sure = np.sort(codes.scores(anchor, probe))
        floors = []
        for x, y in windows:
            inside = sure[(sure >= x) & (sure <= y)]
            floors.append(inside[-n] if len(inside) >= n else x)
        least = min(floors)
    at = at[(hi >= least) & (lo <= most)]
    score, out = codes.scores(anchor, at), []
    for x, y in windows:
        inside = np.flatnonzero((score >= x) & (score <= y))
        first = inside[_first(score[inside], codes.id[at[inside]], n)]
        out.append((at[first], score[first]))
    return out


def _chunks(codes: Codes, anchors: np.ndarray, turn: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the anchor, lowest, highest scores of all rows)."""
    step = max(1, _PAIRS // max(1, len(codes.row)))
    for i in range(0, len(anchors), step):
        low, high = codes.intervals(anchors[i : i + step], turn)
        for k in range(len(low)):
            yield i + k, low[k], high[k]


def _cells(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, work: Callable, schema: str) -> DataFrame:
    """work(rows of a shard, anchors of a block) for all pairs of these, each as one group."""
    of_rows = rows.select("*", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    of_anchors = anchors.select("*", F.pmod(F.xxhash64("anchor_row", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"))
    of_anchors = of_anchors.withColumnsRenamed({"shard": "to_shard", "block": "of_block"})
    return of_rows.groupBy("shard", "block").cogroup(of_anchors.groupBy("to_shard", "of_block")).applyInArrow(work, schema)


def _vectors(table: pa.Table, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("anchor_vector").to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)


def mine(df: DataFrame, id_col: str, label: str, vector: str, every: int = 100, scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, the rows of df whose id is
    divisible by every: of each of an anchor's first positives of its label, the first negatives of other labels whose score lies
    between low and high percent of the positive's score. Scores are integer inner products of floor(scale * component)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), integers(vector, scale).alias("q")).where("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "integers")
    n, asked, dims = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    dims = max(1, dims)
    coded = written(_with_rows(rows, dims), "codes")
    drop(rows)
    width = 4 * dims + _bits(dims) // 8 + 48
    shards, blocks = max(LEAST_SHARDS, -(-n * width // SHARD)), max(1, -(-asked * width // BLOCK))
    anchors = coded.where(F.col("id") % every == 0).select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("vector").alias("anchor_vector"))

    def near(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(left) and len(right):
            codes, turn, wanted = Codes(left, dims), isometry(dims, _bits(dims)), _vectors(right, dims)
            own, ids, labels = (right.column(c).to_pylist() for c in ("anchor_row", "anchor_id", "anchor_label"))
            for k, lowest, most in _chunks(codes, wanted, turn):
                at = np.flatnonzero((codes.label == labels[k]) & (codes.row != own[k]))
                [(found, score)] = highest(codes, wanted[k], lowest, most, at, positives, [ALL])
                for x, y in zip(out, (np.full(len(found), own[k]), np.full(len(found), ids[k]), codes.id[found], score)):
                    x.extend(y.tolist())
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("anchor_row", "anchor_id", "positive_id", "positive_score"), out)})

    best = _cells(coded, anchors, shards, blocks, near, "anchor_row long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id")
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    wanted = best.groupBy("anchor_row").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("targets"))
    wanted = written(anchors.join(wanted, "anchor_row"), "targets")

    def against(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(7)]
        if len(left) and len(right):
            codes, turn, vectors = Codes(left, dims), isometry(dims, _bits(dims)), _vectors(right, dims)
            own, ids, labels, targets = (right.column(c).to_pylist() for c in ("anchor_row", "anchor_id", "anchor_label", "targets"))
            for k, lowest, most in _chunks(codes, vectors, turn):
                others = np.flatnonzero(codes.label != labels[k])
                windows = [(-(-low * t["positive_score"] // 100), high * t["positive_score"] // 100) for t in targets[k]]
                for t, (found, scores) in zip(targets[k], highest(codes, vectors[k], lowest, most, others, negatives, windows)):
                    score = t["positive_score"]
                    for x, y in zip(out, ([own[k]] * len(found), [ids[k]] * len(found), [t["place"]] * len(found), [t["positive_id"]] * len(found), [score] * len(found), codes.id[found].tolist(), scores.tolist())):
                        x.extend(y)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("anchor_row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"), out)})

    hard = _cells(coded, wanted, shards, blocks, against, "anchor_row long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = written(hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    drop(coded, wanted)
    return out


def _with_rows(rows: DataFrame, dims: int) -> DataFrame:
    """encoded() rows with their row numbers."""
    numbered = rows.select(F.col("row").alias("id"), F.struct(F.col("id"), F.col("label")).alias("label"), "q")
    return encoded(numbered, dims).select(F.col("id").alias("row"), "label.id", "label.label", "vector", "code", "reach", "along", "rest")


ORACLE = """
WITH r AS (
  SELECT vec_id, row_number() OVER () AS row_no, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.row_no, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.row_no <> b.row_no),
f AS (
  SELECT row_no, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS place
  FROM p WHERE alike QUALIFY place <= 5)
SELECT f.anchor_id, f.positive_id, row_number() OVER (PARTITION BY f.row_no, f.place ORDER BY p.score DESC, p.vec_id)::INT AS rank,
  p.vec_id AS negative_id, f.positive_score, p.score AS negative_score
FROM f JOIN p ON f.row_no = p.row_no AND NOT p.alike AND 30 * f.positive_score <= 100 * p.score AND 100 * p.score <= 90 * f.positive_score
QUALIFY rank <= 10
"""
