"""Benchmark decontamination: approximate occurrences of test items in documents, by pieces and bit-parallel verification.

Texts and items are normalised alike: lower case, runs of ASCII characters that are no letters or digits become one space. An
item of L bytes may differ from a passage by k = L * ``PERCENT`` // 100 edits (bytes inserted, deleted or replaced). It is cut
into k + 1 pieces; an occurrence within k edits has at least one piece unchanged (pigeonhole), and that piece stands at most k
bytes from its place. So one automaton over all pieces finds all candidates, and Myers' bit-parallel dynamic programme gives the
smallest edit distance of the item to any part of the candidate's window. Items too short for an edit (under 13 bytes at 8 %) must
stand as whole words: ``cat`` is not in ``concatenate``.

Items reach the executors in blocks of about ``BLOCK`` bytes, which bounds the automaton (about 100 bytes for each of them), with one
pass over the documents for each block; there is no shuffle. A Python worker keeps the automaton of its last block for its next
tasks. The driver reads one block after the other and holds all of them until the result is made: item sets are taken to be far
smaller than the documents, as benchmarks are.

Defined results: null and empty texts match nothing, nor do items without a letter or digit. Equal items each match. Repeated
rows give repeated matches; items that share an id are one item with several texts, with the smallest distance of any. Ids may be
of any type, null too. Empty tables give an empty result. Columns other than ids and texts are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.scratch import arrow_map

PERCENT = 8
BLOCK = 4_000_000
_KEEP = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def plain(text: str | None) -> str:
    """Normalised bytes, one character each."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_KEEP).split()).decode("latin-1")


class Myers:
    """Smallest edit distance of a pattern to any substring of a text; one big integer holds a column of the table."""

    def __init__(self, pattern: str):
        self.n, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        full, high, get = (1 << self.n) - 1, 1 << self.n - 1, self.masks.get
        plus, minus, score = full, 0, self.n
        best = score
        for c in text:
            eq = get(c, 0)
            diag = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
            up = minus | (full & ~(diag | plus))
            down = plus & diag
            if up & high:
                score += 1
            elif down & high:
                score -= 1
                if score < best:
                    best = score
            up, down = up << 1 & full, down << 1 & full  # a match may start anywhere, so no carry comes in
            plus = (down | (full & ~(diag | up))) & full
            minus = up & diag
        return best


class Items:
    """The automaton over the pieces of (id, text) items."""

    def __init__(self, items: list[tuple], percent: int = PERCENT):
        self.items, pieces = [], {}
        for item_id, text in items:
            p = plain(text)
            if not p:
                continue
            k = len(p) * percent // 100
            cuts = [len(p) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(p[a:b], []).append((len(self.items), a))
            self.items.append((item_id, p, k, Myers(p)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> dict:
        """Item id to the smallest distance, for the items that occur within their budget."""
        data, found, done = plain(text), {}, {}
        if not data or not len(self.automaton):
            return found
        for end, (length, places) in self.automaton.iter(data):
            for at, offset in places:
                item_id, pattern, k, myers = self.items[at]
                if found.get(item_id, k + 1) == 0:
                    continue
                start = end + 1 - length - offset  # where the item would start without edits
                seen = done.setdefault(at, {})
                if start in seen:
                    continue
                seen[start] = True
                if data.startswith(pattern, max(start, 0)) and start >= 0:
                    if not k and not self._whole_words(data, start, start + len(pattern)):
                        continue
                    distance = 0
                elif not self._plausible(data, pattern, k, start):
                    continue
                else:
                    distance = myers.distance(data[max(0, start - k) : start + len(pattern) + k])
                if distance <= k:
                    found[item_id] = min(distance, found.get(item_id, distance))
        return found

    @staticmethod
    def _whole_words(data: str, start: int, end: int) -> bool:
        return (start == 0 or data[start - 1] == " ") and (end == len(data) or data[end] == " ")

    @staticmethod
    def _plausible(data: str, pattern: str, k: int, start: int) -> bool:
        """Whether the window can hold the pattern: each edit changes one letter, so it lacks at most k letters of it."""
        window = data[max(0, start - k) : start + len(pattern) + k]
        if len(window) < len(pattern) - k:
            return False
        lacking = 0
        for c in set(pattern):
            short = pattern.count(c) - window.count(c)
            if short > 0:
                lacking += short
                if lacking > k:
                    return False
        return True


_LAST: dict[bytes, Items] = {}


def _index(name: bytes, items: list[tuple], percent: int) -> Items:
    """The worker's automaton of these items; it holds one at a time."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Items(items, percent)
    return _LAST[name]


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, distance) for each document and item that occurs in it within its budget."""
    stated = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    total = stated.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = int(total) // BLOCK + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("item_id", stated.schema["i"].dataType), T.StructField("distance", T.IntegerType())])

    def scan(items: list[tuple]) -> DataFrame:
        name = hashlib.sha256(pickle.dumps((items, percent))).digest()  # tasks of one query share it
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value, percent)
            for batch in batches:
                found = [index.find(t) for t in batch.column(1).to_pylist()]
                rows = pa.array([at for at, f in enumerate(found) for _ in f], pa.int32())
                pairs = [x for f in found for x in sorted(f.items(), key=repr)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([i for i, _ in pairs], to_arrow_type(schema["item_id"].dataType)), pa.array([k for _, k in pairs], pa.int32())], names=schema.names)

        return arrow_map(rows, work, schema)

    out = None
    for block in range(blocks):
        part = stated if blocks == 1 else stated.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        done = scan(sorted(((r.i, r.t) for r in part.collect()), key=repr))
        out = done if out is None else out.unionByName(done)
    # items that share an id can stand in several blocks
    return out if blocks == 1 else out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))
