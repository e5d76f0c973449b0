"""Near-duplicate documents by SetSketch registers, with every link confirmed on full shingle sets.

A document's registers are truncated minima: of each of ``REGISTERS`` hash functions the smallest value over the shingle set,
rounded up to the grid base**-k. Registers of a union are the larger of two, so sketches merge, and two sets agree in a register
with a probability close to their similarity. The join keys are ``BANDS`` bands of ``ROWS`` registers, each a fixed random choice
of them. A pair of similarity J agrees in K registers, K binomial, and misses all bands with a chance near (1 - (K/288)**8)**80:
2.8 of 100,000 pairs at exactly 0.8, 0.3 of 100,000 at 0.82. At 0.5 a quarter of the pairs share a band, at 0.3 one in 200.

Equal shingle sets are one class from the start, so copies never pair up. Confirmed links merge classes to components in three
steps, each of a fixed number of joins:

1. each class meets the smallest leader of its buckets (a bucket is one key of one band): one pair a class;
2. each class meets all other leaders of its buckets that are still in another component: at most ``BANDS`` pairs a class;
3. classes that share a bucket with one of another component, leaders left out, meet by an exact prefix filter. Each set is ordered
   from rare to frequent shingles (counts among these classes). Two sets that reach the threshold share a shingle among the first
   n - ceil(n * percent / 100) + 1 of either, and at the first one that they share both still have enough shingles left. A passage
   that thousands of classes share is frequent, so it stays at the end, and classes that share nothing else do not meet. Bounds
   of whole components are compared first, so pairs inside a component are never made.

Before sets are fetched in steps 1 and 2, the joint maximum-likelihood estimate from registers and exact set sizes drops pairs far
below the threshold (by 0.12, five standard errors); step 3 compares the full sets at once.

Defined results: null, empty and blank texts have an empty set and stay alone. Texts with fewer words than a shingle are one
shingle. Each input row gives one row. Rows of one id belong to one component, whatever their texts; without a text they are that
id's too. A null id is no id: its rows link by text only, and component_id is the smallest id that is not null, or null. Ties take
the smallest id. An empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm.components import connected
from tessella.llm.scratch import arrow_map, drop, written
from tessella.llm.words import mix, shingles, slices

REGISTERS, BANDS, ROWS = 288, 80, 8
BASE, RATE, TOP = 1.001, 20.0, 65_534  # of the grid of register values; RATE places the smallest set's values inside it
SLACK = 0.12
_CHOICE = np.stack([np.random.default_rng(7_000 + i).choice(REGISTERS, ROWS, replace=False) for i in range(BANDS)])
_FACTORS = np.random.default_rng(20_260_101).integers(0, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)


def registers(items: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes, as unsigned 16-bit registers; all 0 for the empty set."""
    if not len(items):
        return np.zeros(REGISTERS, "<u2")
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for i in range(0, len(items), 4_096):
        least = np.minimum(least, (_FACTORS[:, None] * items[None, i : i + 4_096]).min(axis=1))
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """For rows of registers the keys of their bands; the band's number is part of the key."""
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(regs), 1))
    for i in range(ROWS):
        key = mix(key * np.uint64(65_537) + regs[:, _CHOICE[:, i]].astype(np.uint64))
    return key.view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 40) -> np.ndarray:
    """The similarity that makes the registers likeliest, for rows of registers and their sets' sizes (golden-section search)."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j):
        # a is larger where its minimum is smaller: an item of a alone
        p, q = chance(u - v * j), chance(v - u * j)
        return more * np.log(p + 1e-12) + less * np.log(q + 1e-12) + same * np.log(np.maximum(1 - p - q, 1e-12))

    low, high, golden = np.zeros(len(u)), np.minimum(u / v, v / u), (5**0.5 - 1) / 2
    for _ in range(steps):
        x, y = high - golden * (high - low), low + golden * (high - low)
        left = value(x) > value(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def sketches(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(row, id, n, digest, registers) for each row; digest names the shingle set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, regs = [], [], []
            for run in slices(batch.column(1).to_pylist()):
                for items in shingles(run, size):
                    n.append(len(items))
                    digest.append(_digest(items) if len(items) else None)
                    regs.append(registers(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], names=["id", "n", "digest", "registers"])

    made = arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("t")), work, "id long, n long, digest binary, registers binary")
    return made.select(F.monotonically_increasing_id().alias("row"), "*")


def _digest(items: np.ndarray) -> bytes:
    return hashlib.sha256(items.tobytes()).digest()[:16]


def _sets(df: DataFrame, id_col: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """(row, items) for wanted(row, id, digest): the different 64-bit hashes of the shingles, sorted.

    An id can have several texts; the digest tells which of them is meant.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [x for run in slices(part.column(2).to_pylist()) for x in shingles(run, size)]
                same = [_digest(x) == d for x, d in zip(found, part.column(1).to_pylist())]
                items = [x.view(np.int64) for x, ok in zip(found, same) if ok]
                ends = pa.array(np.cumsum([0, *map(len, items)]), pa.int32())
                values = pa.array(np.concatenate(items) if items else np.zeros(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(same, pa.bool_())), pa.ListArray.from_arrays(ends, values)], names=["row", "items"])

    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text).cast("binary").alias("t"))
    found = rows.join(wanted, F.col("__id").eqNullSafe(F.col("id"))).select("row", "digest", "t")
    return arrow_map(found, work, "row long, items array<long>").dropDuplicates(["row"])


def _both(pairs: DataFrame, facts: DataFrame, *cols: str) -> DataFrame:
    """pairs with cols of facts for a and for b."""
    for side in "ab":
        pairs = pairs.join(facts.select(F.col("row").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols]), side)
    return pairs


def _near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and the likelihood estimate leave."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("registers_a", "registers_b"))
            guess = likely(a, b, *(batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")))
            yield batch.filter(pa.array(guess >= percent / 100 - SLACK)).select(["a", "b"])

    found = _both(pairs, reps, "n", "registers").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return arrow_map(found.select("a", "b", "n_a", "n_b", "registers_a", "registers_b"), work, "a long, b long")


def _linked(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    both = F.size(F.array_intersect("items_a", "items_b"))
    links = _both(pairs, items, "items").where(100 * both >= percent * (F.size("items_a") + F.size("items_b") - both))
    return links.select("a", "b")


def _bands(reps: DataFrame) -> DataFrame:
    """(bucket, row): one row for each band of each class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                part = batch.slice(i, 1_000)
                keys = band_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, REGISTERS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["bucket", "row"])

    return arrow_map(reps.select("row", "registers"), work, "bucket long, row long")


def _labelled(rows: DataFrame, labels: DataFrame, col: str = "row") -> DataFrame:
    """rows with label, the component of col: labels has those of linked classes, any other class is alone."""
    named = labels.select(F.col("id").alias("__class"), "label")
    return rows.join(named, rows[col] == named["__class"], "left").drop("__class").withColumn("label", F.coalesce("label", col))


def _other_leaders(buckets: DataFrame, labels: DataFrame, done: DataFrame) -> DataFrame:
    """(a, b): the leaders a of b's buckets that are in another component, and were not compared with it."""
    pairs = buckets.where("row <> leader").select(F.col("leader").alias("a"), F.col("row").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
    of_a, of_b = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(row): the classes of buckets that, without their leader, hold more than one component."""
    rows = written(_labelled(buckets.where("row <> leader").select("bucket", "row"), labels), "mixed")
    open_ = rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    return rows.join(open_, "bucket", "left_semi").select("row").distinct()


def _prefixes(items: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(s, row, label, n, rest): the first shingles of each set in the order from rare to frequent, and how many of the set's
    shingles come from there on. Shingles of one set alone come first and match nothing, so they are counted, not listed."""
    flat = items.select("row", F.explode("items").alias("s"))
    often = flat.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    order = flat.join(often, "s").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("o"))  # one set's shingles
    sets = _labelled(items.select("row", F.size("items").alias("n")), labels).join(order, "row")
    length = F.expr(f"n - (n * {percent} + 99) DIV 100 + 1 - (n - size(o))")
    cut = sets.where(length > 0).select("row", "label", "n", F.size("o").alias("m"), F.posexplode(F.slice("o", F.lit(1), length.cast("int"))).alias("i", "x"))
    return cut.select(F.col("x.s").alias("s"), "row", "label", "n", (F.col("m") - F.col("i")).alias("rest"))


def _meeting(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that can reach the threshold by their sizes and by what is left of both.

    Sets of one size in one component are bounded together; of two such groups that can meet, the smaller one's rows are fetched first,
    so the members of a large component are fetched only for pairs that the other side's sizes and rests leave."""
    need = lambda n, m: f"({n} + {m}) * {percent} <= (100 + {percent}) * "  # noqa: E731  a common part of so many at least
    parts = prefixes.groupBy("s", "label", "n").agg(F.max("rest").alias("rest"), F.count("*").alias("c"))
    x, y = parts.alias("x"), parts.alias("y")
    near = f"x.s = y.s AND x.label < y.label AND x.n * {percent} <= y.n * 100 AND y.n * {percent} <= x.n * 100 AND {need('x.n', 'y.n')} least(x.rest, y.rest)"
    sides = [F.when(F.expr("x.c <= y.c"), F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(f"{c}{s}") for p, q, s in (("x", "y", "a"), ("y", "x", "b")) for c in ("label", "n")]
    groups_ = x.join(y, F.expr(near)).select("x.s", *sides)
    left, right = (prefixes.select("s", F.col("row").alias(c), F.col("label").alias(f"label{c}"), F.col("n").alias(f"n{c}"), F.col("rest").alias(f"r{c}")) for c in "ab")
    right = right.withColumnsRenamed({"s": "__s", "labelb": "__label", "nb": "__n"})
    one = groups_.join(left, ["s", "labela", "na"])
    fits = f"s = __s AND labelb = __label AND nb = __n AND {need('na', 'nb')} least(ra, rb)"
    return one.join(right, F.expr(fits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of df: components of pairs with 100 * common >= percent * joint items."""
    sketched = written(sketches(df, id_col, text, size), "sketches")
    classes = sketched.where("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("class"))
    rows = written(sketched.select("row", "id", "n", "digest").join(classes, "digest", "left").select("row", "id", "n", "digest", "class"), "rows")
    first = rows.where("row = class").select("row")
    reps = written(sketched.join(first, "row", "left_semi"), "classes")
    drop(sketched)
    bands = _bands(reps)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("members"), F.min("row").alias("leader")).where("members > 1").drop("members")
    buckets = written(bands.join(shared, "bucket"), "buckets")

    def sets(rows: DataFrame) -> DataFrame:
        return written(_sets(df, id_col, text, size, reps.select("row", "id", "digest").join(rows, "row", "left_semi")), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        near = written(_near(pairs, reps, percent), "near")
        items = sets(near.select(F.explode(F.array("a", "b")).alias("row")).distinct())
        out = written(_linked(near, items, percent), "links")
        drop(near, items)
        return out

    once = rows.where("id IS NOT NULL AND class IS NOT NULL").groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z").select("id", "a")
    links = [written(rows.where("class IS NOT NULL").join(once, "id").where("a <> class").select("a", F.col("class").alias("b")).distinct(), "same-id")]
    pairs = written(buckets.where("row <> leader").groupBy(F.col("row").alias("b")).agg(F.min("leader").alias("a")).select("a", "b"), "pairs")
    links.append(linked(pairs))
    labels = connected(links[0].unionByName(links[1]))
    links.append(linked(_other_leaders(buckets, labels, pairs)))
    drop(labels)
    labels = connected(links[0].unionByName(links[1]).unionByName(links[2]))
    items = sets(_mixed(buckets, labels))
    links.append(written(_linked(written(_meeting(written(_prefixes(items, labels, percent), "prefixes"), percent), "meeting"), items, percent), "links"))
    drop(labels, items, buckets, pairs, reps)
    labels = connected(links[0].unionByName(links[1]).unionByName(links[2]).unionByName(links[3]))
    drop(*links)
    named = written(_labelled(rows.select("id", "n", "class"), labels, "class"), "labelled")
    drop(labels, rows)
    # a row without a shingle has no class: its component is that of its id's other rows, or itself
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least"))
    of_id = named.where("label IS NULL AND id IS NOT NULL").select("id").distinct().join(named.where("label IS NOT NULL").groupBy("id").agg(F.min("label").alias("of_id")), "id")
    out = named.join(of_id, "id", "left").withColumn("label", F.coalesce("label", "of_id")).join(least, "label", "left")
    component = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
