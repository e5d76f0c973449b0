"""Joins between what documents contain and tables keyed by n-gram, with the rows of a block of documents packed by hash range.

Consecutive rows of an input partition form a block of bounded size. A block explodes into its different keys, sorted; all keys of
one hash range (a shard) travel as one row. Tables keyed by n-gram are partitioned by the same ranges, so a join by shard finds an
answer for each key, and the answers return to the block as one row a shard, in the order of its keys. A key that all documents
share is asked for once by each block, so no key is hot, and no group is larger than a block or a shard.

Ranges without a key send nothing, so a block never sends more rows than it has keys: at any size the rows moved are at most
those of the same join on single n-grams, and the bytes grow with the input.

Passes over the documents number blocks by input partition and position. File scans repeat that exactly; a checksum of the block
travels with its keys, and where a pass meets other blocks the join ends in an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

BLOCK = 4_000_000
SHARD = 1_000_000
ASKED = "shard long, block long, checksum long, keys binary, extra binary"
TEXTS = "block long, shard long, checksum long, a binary, b binary"


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, list[bytes]]]:
    """(block number, checksum, ids, texts) of consecutive rows; a text over the limit ends its block."""
    part, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

    def done() -> tuple[int, int, list, list[bytes]]:
        head = hashlib.blake2b(digest_size=8)
        for i, t in zip(ids, texts):
            head.update(f"{i} {len(t)} ".encode() + t[:16])
        return part << 32 | k, int.from_bytes(head.digest(), "little", signed=True), ids, texts

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t or b"")
            size += len(t or b"")
            if size >= BLOCK:
                yield done()
                k, ids, texts, size = k + 1, [], [], 0
    if ids:
        yield done()


def shard_bits(rows: DataFrame, text: str, weight: float = 1.0) -> int:
    """So many leading bits of a key name its shard that a shard holds about SHARD bytes of keys, weight being key bytes a text byte."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(3, int(np.ceil(np.log2(max(1.0, total * weight / SHARD)))))


def cut(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard starts in sorted 64-bit keys; one entry more than shards."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the first one and differences of equal width, which the first byte names."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The keys of packed()."""
    width, first = data[0], np.frombuffer(data, "<u8", 1, 1) if len(data) > 1 else np.zeros(0, np.uint64)
    steps = np.zeros(((len(data) - 9) // width if len(data) > 9 else 0, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, len(steps) * width, 9 if len(steps) else 0).reshape(-1, width)
    return np.cumsum(np.concatenate([first, steps.view("<u8").ravel()]), dtype=np.uint64)


def asked(rows: DataFrame, ask: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """What all blocks of rows(id, text) contain, by shard: ask gives a block's sorted distinct keys and a number for each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, checksum, _, texts in grouped(batches):
            keys, extra = ask(texts)
            at = cut(keys, bits)
            shards = np.flatnonzero(np.diff(at))
            found = [packed(keys[at[i] : at[i + 1]]) for i in shards], [extra[at[i] : at[i + 1]].tobytes() for i in shards]
            n = len(shards)
            yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int64)), pa.array(np.full(n, block)), pa.array(np.full(n, checksum)), *[pa.array(x, pa.binary()) for x in found]], names=["shard", "block", "checksum", "keys", "extra"])

    return rows.mapInArrow(work, ASKED)


def texts(rows: DataFrame) -> DataFrame:
    """Each block of rows(id, text) as one row: ids and lengths, compressed texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, checksum, ids, found in grouped(batches):
            data = b"".join(found)
            lengths = np.array([len(t) for t in found], np.int64).tobytes()
            known = np.array([i is not None for i in ids], np.int64).tobytes()
            head = np.array([i or 0 for i in ids], np.int64).tobytes() + known + lengths
            body = len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1]), pa.array([checksum]), pa.array([head], pa.binary()), pa.array([body], pa.binary())], names=["block", "shard", "checksum", "a", "b"])

    return rows.mapInArrow(work, TEXTS)


def answer(asked: pa.Table, a: list[bytes], b: list[bytes]) -> pa.Table:
    """A shard's answers, one row for each block that asked."""
    return pa.table({c: asked.column(c) for c in ("block", "shard", "checksum")} | {"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def gathered(table: pa.Table) -> tuple[pa.Array, list[bytes], list[tuple[bytes, bytes]]]:
    """Ids, texts, and the answers in the order of shards, of one block's rows."""
    if len(set(table.column("checksum").to_pylist())) != 1:
        raise RuntimeError("the passes over the documents met different blocks")
    rows = sorted(zip(table.column("shard").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist()), key=lambda r: r[0])
    if not rows or rows[0][0] != -1:
        raise RuntimeError("the passes over the documents met different blocks")
    ids, known, lengths = np.frombuffer(rows[0][1], np.int64).reshape(3, -1)
    body = rows[0][2]
    data = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    ends = np.cumsum(lengths)
    return pa.array(ids, mask=known == 0), [data[b - n : b] for b, n in zip(ends.tolist(), lengths.tolist())], [(a, b) for _, a, b in rows[1:]]
