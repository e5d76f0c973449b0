"""Repeated word passages by compaction of a de Bruijn graph: every window of ``window`` words is an edge between its first and
its last window - 1 words, and what is removed is every word of an edge that also stands earlier.

1. **Edges, local paths.** A window's minimizer is the smallest hash of a ``seed``-word shingle in it. Equal windows have equal
   minimizers, and consecutive windows mostly share one, so a document falls into a few short paths of consecutive edges, one row
   each: the minimizer, the place, and 48 bits for each edge. Paths of one block of documents that are equal and later than the
   first of them are repeated already and stay out of the shuffle, so copies and passages that many documents share are sent once
   a block. Minimizers that a sample finds in over 1 / ``FREQUENT`` of the documents name no partition: their edges go out one
   by one under their own hash. They are at most FREQUENT times the average number of paths of a document, whatever the input.
2. **Repeated edges.** All paths of one minimizer meet, in the order of places. Each edge is joined to its first occurrence; what
   stands later leaves as stretches that follow their source without a branch.
3. **Compaction.** The stretches of a document are joined end to start while they go on in the same source: one row for each
   maximal unbranched path, with its source coordinates.
4. **Verification.** Documents meet their paths and the places that others name as sources; both ends of each path are read from
   the texts as words, and their digests are joined. If one pair differs, hashes have met by chance, and all starts again under
   other hash functions; so a result is never wrong by a collision.

Places are ordered by id, then word number. Rows that share an id are one document's versions: equal places of theirs are not
earlier than each other, and repeated rows fare alike. Rows without an id come last, as one document. Null, empty and short texts
have no windows. Other columns are not read. No rows give no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessella.llm.scratch import arrow_map, drop, written
from tessella.llm.words import mix, slices, word_hashes

#: Bytes of an edge's hash in a path, beside the 64 bits of its minimizer; share and sample of the search for frequent minimizers.
EDGE, FREQUENT, SAMPLE = 6, 500, 64
LAST = (1 << 63) - 1  # in place of a null id
_BLOCK = 2_000_000
_PATHS = "key long, doc long, tag long, start int, edges binary, n int, source long, source_tag long, source_start int"
_RUNS = "doc long, tag long, start int, n int, source long, source_tag long, source_start int"


def _shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all shingles of n words, by doubling."""
    out, have, done, k = None, hashes, 0, 1
    while True:
        if n & k:
            out = have if out is None else mix(out[: len(have) - done] * np.uint64(0x9E3779B97F4A7C15) + have[done : len(have)])
            done += k
        if done == n:
            return out[: len(hashes) - n + 1]
        have = mix(have[:-k] * np.uint64(0xD6E8FEB86659FD93) + have[k:]) if len(have) > k else have[:0]
        k *= 2


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values."""
    k = 1
    while 2 * k <= n:
        values, k = np.minimum(values[:-k], values[k:]), 2 * k
    return np.minimum(values[: len(values) - (n - k)], values[n - k :]) if n > k else values


def windows(texts: list[bytes | None], window: int, seed: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of all texts: number of the text, start, 64-bit hash, minimizer."""
    hashes, bounds = word_hashes(texts, lower=False)
    if len(hashes) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    hashes = mix(hashes ^ np.uint64(salt * 0x5851F42D4C957F2D % 2**64)) if salt else hashes
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    inside = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :])
    edge, least = _shingles(hashes, window), _least(_shingles(hashes, seed), window - seed + 1)
    return text[inside], inside - bounds[text[inside]], edge[inside], least[inside]


def _joined(arrays: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Where a new stretch starts: the arrays change, or starts don't go on by one."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    for a in arrays:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def _rows(**columns) -> pa.RecordBatch:
    kinds = {"edges": pa.binary(), "start": pa.int32(), "n": pa.int32(), "source_start": pa.int32()}
    made = {c: x if isinstance(x, pa.Array) else pa.array(x, kinds.get(c, pa.int64())) for c, x in columns.items()}
    return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def paths(docs: DataFrame, window: int, seed: int, salt: int, frequent: np.ndarray) -> DataFrame:
    """Local paths of docs(doc, tag, text), and those found to be later than an equal one of the same block, with their sources."""

    def block(ids: np.ndarray, tags: np.ndarray, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        text, start, edge, key = windows(texts, window, seed, salt)
        if not len(text):
            return
        alone = np.isin(key, frequent)
        key = np.where(alone, mix(edge + np.uint64(1)), key)
        first = _joined([text, key], np.where(alone, 2 * np.arange(len(start)), start))
        n = np.diff(np.concatenate([first, [len(text)]]))
        doc, tag, at = ids[text[first]], tags[text[first]], start[first]
        last = first + n - 1
        # with under window edges, the first and the last edge and the number of edges say all words; longer paths hash all edges
        name = mix(edge[first] * np.uint64(3) + mix(edge[last] + n.astype(np.uint64))) ^ np.add.reduceat(mix(edge + np.uint64(7)), first)
        order = np.lexsort((tag, at, doc, name))
        group = np.concatenate([[True], name[order][1:] != name[order][:-1]])
        head = order[np.flatnonzero(group)[np.cumsum(group) - 1]]
        same = (doc[order] == doc[head]) & (at[order] == at[head])
        again = np.concatenate([[False], (name[order][1:] == name[order][:-1]) & (tag[order][1:] == tag[order][:-1])])
        sent = np.sort(order[same & ~again])
        data = np.frombuffer(edge.tobytes(), np.uint8).reshape(-1, 8)[:, :EDGE].tobytes()
        edges = [data[a * EDGE : b * EDGE] for a, b in zip(first[sent].tolist(), (first + n)[sent].tolist())]
        none = pa.nulls(len(sent))
        yield _rows(key=key[first][sent].view(np.int64), doc=doc[sent], tag=tag[sent], start=at[sent], edges=edges, n=n[sent], source=none.cast(pa.int64()), source_tag=none.cast(pa.int64()), source_start=none.cast(pa.int32()))
        late, of = order[~same], head[~same]
        if len(late):
            back = np.lexsort((at[late], tag[late], doc[late]))
            late, of = late[back], of[back]
            new = np.ones(len(late), bool)
            new[1:] = at[late][1:] != (at + n)[late][:-1]
            for x in (doc[late], tag[late], doc[of], tag[of], at[of] - at[late]):
                new[1:] |= x[1:] != x[:-1]
            cut = np.flatnonzero(new)
            size = np.add.reduceat(n[late], cut)
            late, of = late[cut], of[cut]
            yield _rows(key=mix(doc[late].astype(np.uint64) * np.uint64(2) + at[late].astype(np.uint64)).view(np.int64), doc=doc[late], tag=tag[late], start=at[late], edges=pa.nulls(len(late)).cast(pa.binary()), n=size, source=doc[of], source_tag=tag[of], source_start=at[of])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, at = batch.column("doc").to_numpy(), batch.column("tag").to_numpy(), 0
            for part in slices(batch.column("text").to_pylist(), _BLOCK):
                yield from block(ids[at : at + len(part)], tags[at : at + len(part)], part)
                at += len(part)

    return arrow_map(docs, work, _PATHS)


def frequent_minimizers(docs: DataFrame, window: int, seed: int, salt: int) -> np.ndarray:
    """Minimizers of over 1 / FREQUENT of the documents, by a sample of one in SAMPLE; they only decide how rows are dealt."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column("text").to_pylist(), _BLOCK):
                text, _, _, least = windows(part, window, seed, salt)
                found = np.unique(np.stack([text.astype(np.uint64), least]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([found[1].view(np.int64), [0]])), pa.array([0] * found.shape[1] + [len(part)], pa.int64())], names=["key", "docs"])
                at += len(part)

    sampled = docs.where(F.pmod(F.xxhash64("doc", "tag", F.lit(5)), F.lit(SAMPLE)) == 0)
    counted = written(arrow_map(sampled, work, "key long, docs long").groupBy("key", (F.col("docs") > 0).alias("total")).agg(F.sum("docs").alias("docs"), F.count("*").alias("n")), "minimizers")
    total = counted.where("total").agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    least = max(8, total // FREQUENT)
    keys = [r.key for r in counted.where(~F.col("total") & (F.col("n") >= least)).select("key").collect()]
    drop(counted)
    return np.array(sorted(keys), np.int64).view(np.uint64)


def repeated(paths: DataFrame) -> DataFrame:
    """Stretches of edges that stand earlier elsewhere, with the first places of theirs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the key that the last batch ended with: key, and each edge with its first place
        open_key, known = None, [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3
        for batch in batches:
            done = pa.compute.is_null(batch.column("edges"))
            local = batch.filter(done)
            if local.num_rows:
                yield local.select(["doc", "tag", "start", "n", "source", "source_tag", "source_start"])
            rows = batch.filter(pa.compute.invert(done))
            if not rows.num_rows:
                continue
            row_key, row_doc, row_tag, row_start, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("key", "doc", "tag", "start", "n"))
            data = np.frombuffer(b"".join(rows.column("edges").to_pylist()), np.uint8).reshape(-1, EDGE)
            edge = np.zeros((len(data), 8), np.uint8)
            edge[:, :EDGE] = data
            edge = edge.view("<u8").ravel()
            row = np.repeat(np.arange(len(n)), n)
            start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + row_start[row]
            key, doc, tag = row_key[row], row_doc[row], row_tag[row]
            before = len(known[0]) if open_key == row_key[0] else 0
            if before:
                key = np.concatenate([np.full(before, open_key), key])
                edge, doc, tag, start = (np.concatenate([a, b]) for a, b in zip(known, (edge, doc, tag, start)))
            name = mix(key.view(np.uint64) ^ mix(edge + np.uint64(11)))
            order = np.argsort(name, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
            group = np.cumsum(np.isin(np.arange(len(order)), cut)) - 1
            # rows come by id and start, so a group's first row has the smallest id; versions of one id can interleave
            least_doc = doc[order][cut]
            starts = np.where(doc[order] == least_doc[group], start[order], np.iinfo(np.int64).max)
            least_start = np.minimum.reduceat(starts, cut)
            tags = np.where(starts == least_start[group], tag[order], np.iinfo(np.int64).max)
            least_tag = np.minimum.reduceat(tags, cut)
            back = np.empty(len(order), np.int64)
            back[order] = group
            source, source_start, source_tag = least_doc[back], least_start[back], least_tag[back]
            late = (source != doc) | (source_start != start)
            late[:before] = False
            if late.any():
                at = np.flatnonzero(late)
                of_row = row[at - before]
                first = _joined([of_row, source[at], source_tag[at], source_start[at] - start[at]], start[at])
                size = np.diff(np.concatenate([first, [len(at)]]))
                at = at[first]
                yield _rows(doc=doc[at], tag=tag[at], start=start[at], n=size, source=source[at], source_tag=source_tag[at], source_start=source_start[at])
            open_key = row_key[-1]
            ends = cut[key[order][cut] == open_key]
            kept = group[ends]
            known = [edge[order][ends], least_doc[kept], least_tag[kept], least_start[kept]]

    return arrow_map(paths.repartition("key").sortWithinPartitions("key", "doc", "start"), work, _RUNS)


def compacted(runs: DataFrame) -> DataFrame:
    """Stretches of a document joined end to start while they go on in the same source: (doc, tag, start, n, source...)."""
    by = Window.partitionBy("doc", "tag").orderBy("start")
    before = {c: F.lag(c).over(by) for c in ("start", "n", "source", "source_tag", "source_start")}
    follows = (before["start"] + before["n"] == F.col("start")) & (before["source"] == F.col("source")) & (before["source_tag"] == F.col("source_tag")) & (before["source_start"] + before["n"] == F.col("source_start"))
    marked = runs.withColumn("new", F.when(follows, 0).otherwise(1))
    numbered = marked.withColumn("path", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = [F.min_by(c, "start").alias(c) for c in ("source", "source_tag", "source_start")]
    return numbered.groupBy("doc", "tag", "path").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), *firsts).drop("path")


def _digest(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def _applied(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Each document's kept text and repeated paths; checks: digests of its paths (by source) and of the places that others name."""
    spans = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n", "source", "source_tag", "source_start")).alias("spans"))
    named = found.select(F.col("source").alias("doc"), F.col("source_tag").alias("tag"), F.col("source_start").alias("start"), "n").distinct()
    named = named.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("named"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x and len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("doc"), batch.column("tag"), pa.array(data, pa.binary())], names=["id", "doc", "tag", "packed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())]))
        digests = pa.list_(pa.struct([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("digest", pa.int64()), ("named", pa.bool_())]))
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, tag, packed, spans, named in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "packed", "spans", "named"))):
                words = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True).split() if packed else []
                gone, checks = np.zeros(len(words), bool), []
                for s in spans or ():
                    gone[s["start"] : s["start"] + s["n"] + window - 1] = True
                    checks.append({"doc": s["source"], "tag": s["source_tag"], "start": s["source_start"], "n": s["n"], "digest": _digest(words[s["start"] : s["start"] + s["n"] + window - 1]), "named": False})
                for s in named or ():
                    checks.append({"doc": doc, "tag": tag, "start": s["start"], "n": s["n"], "digest": _digest(words[s["start"] : s["start"] + s["n"] + window - 1]), "named": True})
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if spans else words
                row = (len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"start": s["start"], "words": s["n"] + window - 1, "source_id": None if s["source"] == LAST else s["source"], "source_start": s["source_start"]} for s in sorted(spans or (), key=lambda s: s["start"])], checks)
                for x, y in zip(out, row):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(x, pa.int64()) for x in out[:2]], pa.array(out[2], pa.string()), pa.array(out[3], where), pa.array(out[4], digests)], names=["id", "n_words", "n_removed", "kept", "spans", "checks"])

    packed = arrow_map(docs.select("id", "doc", "tag", "text"), pack, "id long, doc long, tag long, packed binary")
    met = packed.join(spans, ["doc", "tag"], "left").join(named, ["doc", "tag"], "left").select("id", "doc", "tag", "packed", "spans", "named")
    schema = "id long, n_words long, n_removed long, kept string, spans array<struct<start: int, words: int, source_id: long, source_start: int>>, checks array<struct<doc: long, tag: long, start: int, n: int, digest: long, named: boolean>>"
    return arrow_map(met, work, schema)


def _verified(results: DataFrame) -> bool:
    """Whether all paths read the same in the document and at their source."""
    c = results.select(F.explode("checks").alias("c")).select("c.*")
    each = c.groupBy("doc", "tag", "start", "n").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.max("named").alias("named"))
    return each.where("a <> b OR NOT named").isEmpty()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, seed: int = 4) -> DataFrame:
    """(id, n_words, n_removed, kept, spans) for each row: its words without those of windows that stand earlier, joined by a
    space, and the repeated stretches (start, words, source_id, source_start)."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("tag"), F.col(text).cast("binary").alias("text"))
    for salt in range(8):
        frequent = frequent_minimizers(docs, window, seed, salt)
        found = written(compacted(repeated(paths(docs.select("doc", "tag", "text"), window, seed, salt, frequent))), "paths")
        results = written(_applied(docs, found, window), "kept")
        drop(found)
        if _verified(results):
            return results.drop("checks")
        drop(results)
    raise RuntimeError("hashes of unlike words meet under every hash function")


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
e AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS start, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, start, sha256(array_to_string(list_slice(w, start, start + 19), ' ')) AS edge FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY doc_id, start) AS place FROM k),
g AS (SELECT DISTINCT doc_id, start + unnest(range(0, 20)) AS i FROM f WHERE place > 1),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
r AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS n_removed
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
