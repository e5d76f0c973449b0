"""Incremental upkeep with Structured Streaming: the index from the commit log, edges, the refresh queue. Sessions: see sessions.py.

The index is a table in buckets by hash of the document. A batch rewrites the buckets that its documents fall into, as a new version
of these alone, and then publishes a manifest: a small file that names the version of each bucket, put in place by one rename.
Readers follow the newest manifest; nothing that it names is ever changed. A batch that runs again starts from the manifest
before it and writes the same versions again. Versions that none of the last manifests names are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.operators.edges import diff_rows, embedders_to_refresh
from tessella.sources.settle import settle


def versioned_upsert(index: DataFrame, writes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seq, ...) with the row of the highest seq for each key; a deletion is a row (deleted true) that stays as a tombstone."""
    both = index.unionByName(writes)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), "seq").alias("r")).select("r.*")


def expire_tombstones(index: DataFrame, now: str, keep: str = "1 day") -> DataFrame:
    """index without tombstones older than keep, the time in which a late write may still come."""
    return index.where(f"NOT deleted OR at >= TIMESTAMP '{now}' - INTERVAL {keep}")


def late_writes(writes: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of writes without repeats of (doc_id, seq) that arrive within the delay."""
    return writes.withWatermark("at", delay).dropDuplicatesWithinWatermark(["doc_id", "seq"])


def merge_edges(state: DataFrame, added: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """The edge table after a batch: removed keys go, added rows replace those of the same key."""
    return state.join(removed.select(*key).unionByName(added.select(*key)).distinct(), key, "left_anti").unionByName(added)


def refresh_queue(queue: DataFrame, snapshot: int) -> DataFrame:
    """(doc_id, seq): one entry for each document, at its highest seq that is not above the snapshot."""
    return queue.where(F.col("seq") <= snapshot).groupBy("doc_id").agg(F.max("seq").alias("seq"))


def affected_docs(changed: DataFrame, edges: DataFrame, edges_before: DataFrame, embedding: DataFrame, changed_props: DataFrame, flipped: DataFrame) -> DataFrame:
    """(doc_id): changed documents, targets of edges that came or went, embedders of changed properties, referrers of documents
    whose visibility flipped."""
    added, removed = diff_rows(edges, edges_before)
    out = changed.select("doc_id").unionByName(added.unionByName(removed).select(F.col("target").alias("doc_id")))
    out = out.unionByName(embedders_to_refresh(embedding, changed_props, flipped).select(F.col("embedder").alias("doc_id")))
    referrers = edges.join(flipped.select(F.col("doc_id").alias("target")), "target", "left_semi").select(F.col("source").alias("doc_id"))
    return out.unionByName(referrers).distinct()


BUCKETS, KEEP = 64, 3


def _folder(spark: SparkSession, path: str):
    """(file system, Hadoop path, constructor of paths)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make(path), make


def manifests(spark: SparkSession, path: str) -> dict[int, dict[int, int]]:
    """Version of each bucket by number of the manifest; at most KEEP small files, of one entry a bucket."""
    fs, folder, make = _folder(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return {}
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    out = {}
    for name in (n for n in names if n.startswith("m") and n[1:].isdigit()):
        stream = fs.open(make(folder, name))
        try:
            out[int(name[1:])] = {int(k): v for k, v in json.loads(bytes(stream.readAllBytes())).items()}
        finally:
            stream.close()
    return out


def _publish(spark: SparkSession, path: str, n: int, versions: dict[int, int]) -> None:
    fs, folder, make = _folder(spark, f"{path}/manifests")
    fs.mkdirs(folder)
    draft, final = make(folder, f"draft-{uuid.uuid4().hex}"), make(folder, f"m{n}")
    stream = fs.create(draft)
    try:
        stream.write(bytearray(json.dumps(versions).encode()))
    finally:
        stream.close()
    fs.delete(final, False)  # of the same batch, run before
    if not fs.rename(draft, final):
        raise OSError(f"{final.toString()} can't be published")


def _clear(spark: SparkSession, path: str) -> None:
    """Remove all but the last KEEP manifests, and the bucket versions that no manifest left names."""
    found = manifests(spark, path)
    fs, folder, make = _folder(spark, f"{path}/manifests")
    kept = sorted(found)[-KEEP:]
    for n in set(found) - set(kept):
        fs.delete(make(folder, f"m{n}"), False)
    named = {(v, b) for n in kept for b, v in found[n].items()}
    fs, data, make = _folder(spark, f"{path}/data")
    for version in fs.listStatus(data) if fs.exists(data) else []:
        v = int(version.getPath().getName()[1:])
        if v > max(kept, default=-1):
            continue  # of a batch that has not published yet
        left = 0
        for bucket in fs.listStatus(version.getPath()):
            name = bucket.getPath().getName()
            if name.startswith("bucket=") and (v, int(name[7:])) not in named:
                fs.delete(bucket.getPath(), True)
            else:
                left += name.startswith("bucket=")
        if not left:
            fs.delete(version.getPath(), True)


def _read(spark: SparkSession, path: str, versions: dict[int, int], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/data/v{v}/bucket={b}" for b, v in sorted(versions.items())])


def current(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The index as the newest manifest names it, or some buckets of it; None before the first."""
    found = manifests(spark, path)
    versions = found[max(found)] if found else {}
    versions = versions if buckets is None else {b: v for b, v in versions.items() if b in buckets}
    if not versions:
        return None
    return _read(spark, path, versions, spark.read.parquet(f"{path}/data/v{max(versions.values())}").drop("bucket").schema)


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def merge_batch(spark: SparkSession, path: str, n: int, rows: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> list[int]:
    """Merge rows (key, seq, deleted, ...) into the index as its version n, the row of the highest seq winning; the buckets written.
    What a document's rows were is replaced whole. Older rows than those in the index change nothing."""
    rows = settle(rows.withColumn("bucket", bucket_of(key, buckets)), "batch")
    touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most as many as buckets
    before = {k: v for k, v in manifests(spark, path).items() if k < n}
    versions = before[max(before)] if before else {}
    there = {b: v for b, v in versions.items() if b in touched}
    both = rows
    if there:
        both = _read(spark, path, there, rows.drop("bucket").schema).withColumn("bucket", bucket_of(key, buckets)).unionByName(rows)
    latest = both.groupBy("bucket", key).agg(F.max("seq").alias("__seq"))
    merged = both.join(latest, ["bucket", key]).where(F.col("seq") == F.col("__seq")).drop("__seq").dropDuplicates()
    if touched:
        merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v{n}")
    _publish(spark, path, n, versions | {b: n for b in touched})
    _clear(spark, path)
    return touched


def index_stream(spark: SparkSession, log: str, out: str, convert: Callable[[DataFrame], DataFrame], checkpoint: str, live: bool = False, buckets: int = BUCKETS, per_trigger: int | None = None):
    """Start the index from a folder of commit-log Parquet files (doc_id, seq, at, deleted, ...). convert turns a batch's latest changes
    to index rows (doc_id, seq, deleted, ...), one or several a document. A batch of k documents writes at most k buckets. Without
    live the backlog is worked off and the query ends; it resumes at its checkpoint. per_trigger files make a batch."""
    stream = spark.readStream.schema(spark.read.parquet(log).schema)
    stream = (stream if per_trigger is None else stream.option("maxFilesPerTrigger", per_trigger)).parquet(log)

    def work(batch: DataFrame, n: int) -> None:
        merge_batch(spark, out, n, convert(batch.groupBy("doc_id").agg(F.max_by(F.struct(*batch.columns), "seq").alias("r")).select("r.*")), buckets=buckets)

    write = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (write.trigger(processingTime="30 seconds") if live else write.trigger(availableNow=True)).start()


def rerender(spark: SparkSession, out: str, convert: Callable[[DataFrame], DataFrame], n: int, group: int = 8, buckets: int = BUCKETS) -> None:
    """Convert the latest rows of the index anew, without the log: as version n, a group of buckets at a time, published at the end.
    convert keeps the key columns and may give a document several rows or none; documents don't change buckets."""
    found = manifests(spark, out)
    before = {k: v for k, v in found.items() if k < n}
    versions = before[max(before)] if before else {}
    order = sorted(versions)
    schema = spark.read.parquet(f"{out}/data/v{max(versions.values())}").drop("bucket").schema if versions else None
    done = {}
    for i in range(0, len(order), group):
        part = {b: versions[b] for b in order[i : i + group]}
        rows = settle(convert(_read(spark, out, part, schema)).withColumn("bucket", bucket_of("doc_id", buckets)), "rendered")
        rows.repartition(len(part), "bucket").write.mode("overwrite" if not i else "append").partitionBy("bucket").parquet(f"{out}/data/v{n}")
        done |= {r.bucket: n for r in rows.select("bucket").distinct().collect()}
    _publish(spark, out, n, done)
    _clear(spark, out)


def rebuild_index(log: DataFrame, convert: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index from the whole log at once; equal to what index_stream() arrives at."""
    return convert(log.groupBy("doc_id").agg(F.max_by(F.struct(*log.columns), "seq").alias("r")).select("r.*"))


def progress(index: DataFrame, queue: DataFrame, log: DataFrame) -> DataFrame:
    """One row: the highest seq indexed, the lowest queued, how many log entries remain."""
    done = index.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    rest = log.agg(F.count_if(F.col("seq") > done).alias("remaining"))
    return rest.select(F.lit(done).alias("indexed"), F.lit(queue.agg(F.min("seq")).first()[0]).cast("long").alias("queued"), "remaining")


def complete_sessions(ops: DataFrame, ended: DataFrame) -> DataFrame:
    """(session, n, data): the operations of ended sessions folded into one change, in order; discarded(true) or empty ones give none."""
    live = ended.where("NOT discarded").select("session")
    rows = ops.join(live, "session", "left_semi")
    return rows.groupBy("session").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("operation", "data"))), lambda x: x.data), "\n").alias("data"))
