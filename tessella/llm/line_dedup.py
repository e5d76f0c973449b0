"""Line deduplication with a tree of line templates, as joins on template keys.

A line's path in the tree has a fixed depth: its number of tokens, then its first ``LEAD`` tokens; a leaf holds templates.
Numbers are variable fields wherever they stand. Behind the leading tokens a line is cut into three runs of tokens; besides the
template of the whole line there is one template for each run left variable, so lines that differ in the fields of one run are
one template. Lines under ``min_tokens`` tokens are no templates, and under ``WIDE`` tokens only the whole line is one.

A template that stands in more than one document stays in the first of them (smallest id); its lines in all others go. Each
template key is counted by partial aggregates (smallest and largest id), so a template in a third of all lines is a few rows
for each task. Only recurring keys are joined back.

Defined results: null text stays null, with no lines dropped; an empty text has one empty line. Lines keep their order. Equal
rows are one document. A document whose every line with a word went has kept = false. Other columns pass through; the columns
this adds replace ones of the same name. Keys are 96-bit hashes of the template.

``cut_passages`` goes on where whole lines end: lines are cut at sentence ends, so that a passage inside a longer line is found
wherever it stands, and a short line goes if it stands in at least ``SHORT_DOCS`` documents. Equal sentences only (but for
numbers), so the first document always keeps what goes elsewhere. Sentences under ``min_tokens`` inside a line stay, and a
passage without a sentence end is found only as a whole line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.quality import SPACE, SPACES
from tessella.llm.scratch import written

LEAD, WIDE = 2, 12
#: Where a line is cut, and in how many documents a line under min_tokens has to stand to go.
CUT = r"(?<=[.!?] )(?=[^ ])"
SHORT_DOCS = 20


def template_keys(df: DataFrame, id_col: str, text: str, min_tokens: int) -> DataFrame:
    """(id, line, keys): for each line that is long enough, its number and the keys of its templates."""
    lines = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.regexp_replace(F.col(text), "[0-9]+", "<*>"), "\n", -1)).alias("line", "l"))
    tokens = lines.select("id", "line", F.array_remove(F.split("l", SPACE, -1), "").alias("m")).where(F.size("m") >= min_tokens)
    cut = tokens.select("id", "line", F.size("m").alias("n"), "m", F.expr(f"{LEAD} + (size(m) - {LEAD}) DIV 3").alias("a"), F.expr(f"{LEAD} + 2 * (size(m) - {LEAD}) DIV 3").alias("b"))
    runs = cut.select(
        "id", "line", "n",
        *[F.expr(f"array_join(slice(m, {start} + 1, {end} - {start}), ' ')").alias(name) for name, start, end in (("h", 0, LEAD), ("r1", LEAD, "a"), ("r2", "a", "b"), ("r3", "b", "n"))],
    )
    key = "struct(xxhash64({0}) AS x, hash({0}) AS y)"
    whole, *open_ = (key.format(f"n, {kind}, {parts}") for kind, parts in enumerate(("h, r1, r2, r3", "h, r2, r3", "h, r1, r3", "h, r1, r2")))
    return runs.select("id", "line", F.expr(f"CASE WHEN n < {WIDE} THEN array({whole}) ELSE array({whole}, {', '.join(open_)}) END").alias("keys"))


def clean(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_tokens: int = 6) -> DataFrame:
    """df with its text cleaned, and with n_lines, n_dropped and kept."""
    keys = written(template_keys(df, id_col, text, min_tokens), "templates")
    flat = keys.select("id", "line", F.explode("keys").alias("key"))
    common = flat.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first")
    gone = flat.join(common, "key").where(F.col("id") > F.col("first")).groupBy("id").agg(F.collect_set("line").alias("__gone"))
    added = ("n_lines", "n_dropped", "kept")
    rest = [c for c in df.columns if c not in added]
    # the columns of df travel in one struct, so none of them can meet a name that is made here
    joined = _packed(df, rest).join(gone.withColumnRenamed("id", "__id"), F.col("__row")[id_col] == F.col("__id"), "left")
    was = F.col("__row")[text]
    lines = joined.withColumn("__lines", F.split(F.coalesce(was, F.lit("")), "\n", -1)).withColumn("__gone", F.coalesce("__gone", F.expr("CAST(array() AS array<int>)")))
    left = F.expr("transform(array_except(sequence(0, size(__lines) - 1), __gone), i -> __lines[i])")
    new = lines.withColumn("__text", F.when(F.size("__gone") == 0, was).otherwise(F.array_join(left, "\n")))
    out = new.withColumns({
        "n_lines": F.when(was.isNull(), F.lit(0)).otherwise(F.size("__lines")),
        "n_dropped": F.size("__gone"),
        "kept": (F.size("__gone") == 0) | (F.btrim("__text", F.lit(SPACES)) != ""),
    })
    return out.select(*[F.col("__text").alias(c) if c == text else F.col("__row")[c].alias(c) for c in rest], *added)


def _packed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias("__row"))


def _units(df: DataFrame, id_col: str, text: str, min_tokens: int) -> DataFrame:
    """(id, line, seg, x, y): the sentences of at least min_tokens tokens, and as seg -1 the lines with fewer."""
    lines = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.regexp_replace(F.col(text), "[0-9]+", "<*>"), "\n", -1)).alias("line", "l"))
    tokens = lambda c: F.array_remove(F.split(c, SPACE, -1), "")
    lines = lines.select("id", "line", "l", (F.size(tokens(F.col("l"))) < min_tokens).alias("short"))
    parts = lines.select("id", "line", "short", F.posexplode(F.when(F.col("short"), F.array("l")).otherwise(F.split("l", CUT, -1))).alias("seg", "l"))
    parts = parts.select("id", "line", F.when(F.col("short"), -1).otherwise(F.col("seg")).alias("seg"), tokens(F.col("l")).alias("m"))
    parts = parts.where(F.when(F.col("seg") < 0, F.size("m") > 0).otherwise(F.size("m") >= min_tokens))
    return parts.select("id", "line", "seg", F.xxhash64("m").alias("x"), F.hash("m").alias("y"))


def _rebuilt(lines: Column, cuts: Column, at: Column) -> Column:
    """The text of lines without the sentences of cuts, (line, segs) by line; a line that keeps no token goes. at are the lines of cuts:
    taken from cuts for each of them, they would be the square of their number.

    Runs of untouched lines are taken as slices and indices are subtracted by array_except, so the work is that of the text's length.
    """
    def left(parts, segs):
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), segs)
        joined = F.array_join(F.transform(stay, lambda k: parts[k]), "")
        return F.when(F.array_contains(segs, F.size(parts) - 1), F.rtrim(joined)).otherwise(joined)

    def line(cut):
        # transform over an array of one binds the parts, so that they are split once
        made = F.transform(F.array(F.split(lines[cut["line"]], CUT, -1)), lambda parts: left(parts, cut["segs"]))
        return F.when(F.array_contains(cut["segs"], -1), F.expr("CAST(array() AS array<string>)")).otherwise(F.filter(made, lambda x: F.btrim(x, F.lit(SPACES)) != ""))

    def piece(cut, k):
        before = F.when(k == 0, F.lit(-1)).otherwise(F.get(at, k - 1))
        return F.concat(F.slice(lines, before + 2, cut["line"] - before - 1), line(cut))

    last = F.element_at(cuts, -1)["line"]
    return F.array_join(F.concat(F.flatten(F.transform(cuts, piece)), F.slice(lines, last + 2, F.size(lines))), "\n")


def cut_passages(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_tokens: int = 6, short_docs: int = SHORT_DOCS) -> DataFrame:
    """The result of clean() without recurring sentences and short lines, with n_cut, how many of them went; kept follows."""
    docs = written(df, "lines")
    units = written(_units(docs, id_col, text, min_tokens), "passages")
    long, short = units.where("seg >= 0"), units.where("seg < 0")
    often = long.groupBy("x", "y").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("x", "y", "first")
    # a document counts once for a short line, however often it has it
    many = short.select("x", "y", "id").distinct().groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= max(2, short_docs)).select("x", "y", "first")
    gone = long.join(often, ["x", "y"]).unionByName(short.join(many, ["x", "y"])).where(F.col("id") > F.col("first"))
    # dealt by document once, for both aggregations and the join
    gone = gone.select("id", "line", "seg").repartition("id").groupBy("id", "line").agg(F.collect_set("seg").alias("segs"))
    gone = gone.groupBy(F.col("id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("line", "segs"))).alias("__cut"))
    rest = [c for c in docs.columns if c != "n_cut"]
    was, kept = F.col("__row")[text], F.col("__row")["kept"]
    joined = _packed(docs, rest).join(gone, F.col("__row")[id_col] == F.col("__id"), "left").withColumn("__lines", F.split(was, "\n", -1))
    # another text of the same id may have fewer lines
    joined = joined.withColumn("__cut", F.filter("__cut", lambda c: c["line"] < F.size("__lines")))
    joined = joined.withColumn("__some", F.coalesce(F.size("__cut"), F.lit(0)) > 0)
    joined = joined.withColumns({"__lines": F.when(F.col("__some"), F.col("__lines")), "__cut": F.when(F.col("__some"), F.col("__cut"))})
    joined = joined.withColumn("__at", F.col("__cut.line"))
    # made by a generator: as a projection, a condition on kept that is moved below it would make the text again, lines split for each cut
    joined = joined.select("*", F.explode(F.array(_rebuilt(F.col("__lines"), F.col("__cut"), F.col("__at")))).alias("__new"))
    out = joined.withColumns({
        "__text": F.when(F.col("__some"), F.col("__new")).otherwise(was),
        "__kept": kept & (~F.col("__some") | (F.btrim("__new", F.lit(SPACES)) != "")),
        "n_cut": F.when(F.col("__some"), F.size(F.flatten(F.col("__cut.segs")))).otherwise(0),
    })
    made = {text: F.col("__text"), "kept": F.col("__kept")}
    return out.select(*[made.get(c, F.col("__row")[c]).alias(c) for c in rest], "n_cut")


#: DuckDB SQL with the same result for clean() on documents(doc_id, text).
ORACLE = """
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(range(len(ls))) AS i, ls FROM s WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, regexp_extract_all(regexp_replace(ls[i + 1], '[0-9]+', '<*>', 'g'), '[^\\x20\\x09-\\x0D]+') AS m FROM e),
c AS (SELECT doc_id, i, len(m) AS n, m, 2 + (len(m) - 2) // 3 AS a, 2 + 2 * (len(m) - 2) // 3 AS b FROM t WHERE len(m) >= 6),
r AS (SELECT doc_id, i, n, array_to_string(m[1:2], ' ') AS h, array_to_string(m[3:a], ' ') AS r1, array_to_string(m[a + 1:b], ' ') AS r2, array_to_string(m[b + 1:n], ' ') AS r3 FROM c),
k AS (SELECT doc_id, i, (n, 0, h, r1, r2, r3) AS key FROM r UNION ALL SELECT doc_id, i, (n, 1, h, r2, r3, '') FROM r WHERE n >= 12
    UNION ALL SELECT doc_id, i, (n, 2, h, r1, r3, '') FROM r WHERE n >= 12 UNION ALL SELECT doc_id, i, (n, 3, h, r1, r2, '') FROM r WHERE n >= 12),
g AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key HAVING min(doc_id) < max(doc_id)),
d AS (SELECT DISTINCT doc_id, i FROM k JOIN g USING (key) WHERE doc_id > first),
x AS (SELECT doc_id, list(i) AS gone FROM d GROUP BY doc_id),
y AS (SELECT s.doc_id, s.text, ls, coalesce(gone, []) AS gone FROM s LEFT JOIN x USING (doc_id)),
z AS (SELECT doc_id, CASE WHEN len(gone) = 0 THEN text ELSE array_to_string(list_filter(ls, lambda v, j: NOT list_contains(gone, j - 1)), chr(10)) END AS text,
    CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines, len(gone) AS n_dropped FROM y)
SELECT doc_id, text, n_lines::INT AS n_lines, n_dropped::INT AS n_dropped, n_dropped = 0 OR regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS kept FROM z
"""
