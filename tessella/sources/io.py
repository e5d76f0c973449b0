"""Sources and sinks: JSON documents, files and chunks, exports, the level-partitioned index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tessella.operators.claims import _family as family, _gathered as gathered, match_paths
from tessella.sources.settle import settle


def write_files(rows: DataFrame, path: str, form: str = "json", parts: int = 64) -> None:
    """Each row as a file of its own (JSON, or text of its one column). Files are written and moved to their place by parts tasks; else
    the one task that reads a small table would write them all, and the driver would move them one by one."""
    rows.repartition(parts).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).format(form).save(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All *.json files (UTF-8) below path, one document each. Unknown top-level keys are an error; a folder without files is empty.
    Files are opened once: their texts become a table, which is checked and then parsed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    text = settle(text.select(F.regexp_replace("value", "^\ufeff", "").alias("value")).hint("rebalance"), "texts")
    unknown = text.select(F.explode(F.array_except(F.json_object_keys("value"), F.array(*[F.lit(n) for n in schema.names]))).alias("key")).limit(1).collect()
    if unknown:
        raise ValueError(f"unknown field {unknown[0].key}")
    # as an array of documents: a file can hold an array, and one without any text holds no document
    return text.select(F.inline(F.from_json("value", T.ArrayType(schema), {"mode": "FAILFAST"})))


def log_after(log: DataFrame, after: int = -1, view: str | None = None) -> DataFrame:
    rows = log.where(F.col("seq") > after)
    return rows.where(F.col("view") == view) if view else rows


def commit_log(spark: SparkSession, path: str, after: int = -1, view: str | None = None) -> DataFrame:
    return log_after(spark.read.parquet(path), after, view).orderBy("seq")


def document_ids(records: DataFrame, classes: list[str] | None = None, prop: str = "INSTANCE_OF") -> DataFrame:
    """All documents, or those that are instances of a class (records are expanded, so of its sub-classes too)."""
    rows = records if classes is None else records.where((F.col("prop") == prop) & F.col("to").isin(classes))
    return rows.select("doc_id").distinct()


def _numbered(claims: DataFrame, specs: list[str]) -> DataFrame:
    rows = match_paths(claims, specs)
    value = F.coalesce("str_value", "raw", "to", F.upper("type"))
    rows = rows.select("doc_id", "path", value.alias("value"), "ord", "claim_id")
    return rows.withColumn("rep", F.row_number().over(Window.partitionBy("doc_id", "path").orderBy("ord", "claim_id")))


def export_csv(claims: DataFrame, specs: list[str], path: str | None = None) -> DataFrame:
    """One column for each path that occurs, the first row of a document with its id, further values in rows with a blank id;
    has-statements are the last column, __HAS__. The paths are the only thing the driver sees."""
    rows = _numbered(claims, specs)
    has = claims.where("type = 'has' AND depth = 0").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("prop")), ";").alias("__HAS__"))
    columns = [r.path for r in rows.select("path").distinct().orderBy("path").collect()]
    wide = rows.groupBy("doc_id", "rep").agg(*[F.max(F.when(F.col("path") == c, F.col("value"))).alias(c) for c in columns])
    first = F.col("rep") == 1
    out = wide.join(has, "doc_id", "left").select(F.when(first, F.col("doc_id")).otherwise("").alias("id"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns], F.when(first, F.coalesce("__HAS__", F.lit(""))).otherwise("").alias("__HAS__"), F.col("doc_id").alias("__doc"), "rep")
    if path:
        out.repartitionByRange("__doc").sortWithinPartitions("__doc", "rep").drop("__doc", "rep").write.option("header", True).csv(path)
    return out


def export_jsonl(claims: DataFrame, specs: list[str], path: str | None = None) -> DataFrame:
    """(doc_id, value): one JSON object for each document, from each path to the array of its values."""
    rows = _numbered(claims, specs).groupBy("doc_id", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("rep", "value"))), lambda x: x.value).alias("values"))
    out = rows.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "values"))))).alias("value"))
    if path:
        out.select("value").write.text(path)
    return out


def export_nested(claims: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, value): one JSON object for each document: each property to the array of its claims in order, a claim being an object of
    its value and, below sub, the same object of its sub-claims; of any depth.

    Claims are shuffled once, by document. Folded from the deepest level up inside tasks: a level's claims become JSON text with what
    is below them, and that of one parent is put together by property in the parent's row.
    """
    value = F.coalesce("str_value", "raw", "to", F.upper("type"))
    rows = claims.select("doc_id", "claim_id", "parent_claim_id", "depth", "prop", "ord", value.alias("value"))
    levels = 1 + rows.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    own = F.regexp_replace(F.to_json(F.struct("value")), "^[{]|[}]$", "")

    def item(sub: Column) -> Column:
        text = F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit('"sub":'), sub), F.when(own != "", own)), F.lit("}"))
        return F.struct("prop", "ord", "claim_id", text.alias("t"))

    def folded(items: Column) -> Column:
        """The object of sorted items: from each property to the array of its texts."""
        of = lambda p: F.concat(F.regexp_replace(F.to_json(F.array(p)), r"^\[|\]$", ""), F.lit(":["), F.array_join(F.transform(F.filter(items, lambda x: x.prop == p), lambda x: x.t), ","), F.lit("]"))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.array_distinct(F.transform(items, lambda x: x.prop)), of), ","), F.lit("}"))

    rows, sub = gathered(rows, levels), F.lit(None).cast("string")
    for depth in range(levels - 1, 0, -1):
        below = F.sort_array(F.collect_list(F.when(F.col("depth") == depth, item(sub))).over(family(depth)))
        rows = rows.withColumn("__below", below).where(F.col("depth") < depth).withColumn("sub", F.when(F.size("__below") > 0, folded(F.col("__below")))).drop("__below")
        sub = F.col("sub")
    out = rows.where("depth = 0").groupBy("doc_id").agg(F.sort_array(F.collect_list(item(sub))).alias("cs")).select("doc_id", folded(F.col("cs")).alias("value"))
    if path:
        out.select("value").write.text(path)
    return out


def export_typed(claims: DataFrame, struct: dict[str, tuple[str, str, bool]], path: str | None = None) -> DataFrame:
    """Documents as declared columns: name -> (property, SQL type, many). Of several values a single column takes the surest."""
    value = F.coalesce("str_value", "raw", "to", F.lit("true"))
    rows = claims.where(F.col("depth") == 0).select("doc_id", "prop", value.alias("v"), F.struct((-F.col("confidence")).alias("c"), "ord", "claim_id").alias("o"))
    made = []
    for name, (prop, kind, many) in struct.items():
        here = F.col("prop") == prop
        if many:
            values = F.transform(F.sort_array(F.collect_list(F.when(here, F.struct("o", "v")))), lambda x: x.v)
            made.append(values.cast(f"array<{kind}>").alias(name))
        else:
            made.append(F.min_by(F.when(here, F.col("v")), F.when(here, F.col("o"))).cast(kind).alias(name))
    out = rows.groupBy("doc_id").agg(*made)
    if path:
        out.write.parquet(path)
    return out


def write_index(records: DataFrame, path: str, buckets: int = 16) -> None:
    """records with level, in folders by level and by bucket of the property."""
    records.withColumn("prop_bucket", F.pmod(F.hash("prop"), F.lit(buckets))).write.partitionBy("level", "prop_bucket").parquet(path)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, hash, first): files with their content's hash; first is false for all but the smallest path of equal files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("hash"))
    rows = settle(rows.hint("rebalance"), "inventory")  # files are opened once
    first = rows.groupBy("hash").agg(F.min("path").alias("__first"))
    return rows.join(first, "hash").select("path", "length", "hash", (F.col("path") == F.col("__first")).alias("first"))


def chunk_coverage(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(session, size, gaps, overrun, short, redundant): whether chunks(session, chunk, start, length) cover files(session, size).
    At an equal start the newest chunk counts; a chunk that ends inside what came before is redundant."""
    end = F.col("start") + F.col("length")
    w = Window.partitionBy("session").orderBy("start", F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumn("end", end).withColumn("before", F.coalesce(F.max("end").over(w), F.lit(0)))
    found = rows.groupBy("session").agg(F.count_if(F.col("start") > F.col("before")).alias("gaps"), F.max("end").alias("last"), F.count_if(F.col("end") <= F.col("before")).alias("redundant"))
    out = files.join(found, "session", "left")
    return out.select("session", "size", F.coalesce("gaps", F.lit(0)).alias("gaps"), (F.coalesce("last", F.lit(0)) > F.col("size")).alias("overrun"), (F.coalesce("last", F.lit(0)) < F.col("size")).alias("short"), F.coalesce("redundant", F.lit(0)).alias("redundant"))
