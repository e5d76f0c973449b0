"""Quality rules with thresholds that follow the data: mergeable quantile sketches for each language and source.

``measures`` computes the statistics of each text inside the row: no explode, no shuffle, no Python. ``sketch`` counts integer
measures in buckets of a bounded relative width (exact below 128, then 1/64): counts of equal buckets add up, so sketches merge
in any order to the same result, and a group has a few hundred buckets at most however many rows it has. ``thresholds`` reads
the median and a tail quantile (``TAIL`` by measure) from the merged sketches. The fence lies beyond the tail quantile by half its
distance from the median, or by one bucket where that is more, so no constant of the measure's own scale decides. Each source of
a language has its own; a source with fewer than ``MIN_GROUP`` texts, or whose tail equals its median, takes the language's merged
sketch, and such a language that of all texts. No source is looser than its language's tail quantile plus twice that quantile's
distance from the median, so a source that is mostly junk does not set the rule for itself. ``judge`` joins the fences back and
filters.

Defined results: a null or empty text has no words and fails the base rule. Null language or source is a group of its own.
Repeated rows are judged alike. An empty table gives an empty result. Windows of three words need three words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.scratch import written

#: What separates words, and what counts as a symbol.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Measure: the percentage of a group's texts that its tail quantile leaves below.
TAIL = {"symbols": 95, "dup_lines": 98, "repeats": 98, "word_len": 98}
MIN_GROUP = 100
_POS = 24  # low bits of a packed window that hold its position


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    names = [c for c in df.columns if c != text]
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = df.select(
        *kept,
        F.array_remove(F.split(t, SPACE, -1), "").alias("__w"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__l"),
    )
    step = step.select(
        *names, "word_chars", "n_symbols", "__w",
        F.size("__w").cast("long").alias("n_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        # hash and position of each window in one long; sorting brings equal windows together
        F.expr(f"CASE WHEN size(__w) < 3 THEN CAST(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, size(__w) - 3), i -> (xxhash64(__w[i], __w[i + 1], __w[i + 2]) & {~((1 << _POS) - 1)}L) | CAST(i AS bigint))) END").alias("__s"),
    )
    same = f"(shiftright(__s[j], {_POS}) = shiftright(__s[j + 1], {_POS}))"
    near = f"filter(sequence(0, size(__s) - 2), j -> {same})"
    step = step.select(
        *names, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "__w",
        # windows that may be repeated: a superset, as hashes are cut; a text beyond the position bits takes all
        F.expr(
            f"CASE WHEN n_words < 4 THEN CAST(array() AS array<int>) WHEN n_words >= {1 << _POS} THEN sequence(0, size(__w) - 3) ELSE "
            f"array_distinct(flatten(transform({near}, j -> array(CAST(__s[j] & {(1 << _POS) - 1}L AS int), CAST(__s[j + 1] & {(1 << _POS) - 1}L AS int))))) END"
        ).alias("__c"),
    )
    step = step.select(
        *names, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines",
        F.expr("sort_array(transform(__c, i -> struct(concat_ws(' ', __w[i], __w[i + 1], __w[i + 2]) AS w, i AS i)))").alias("__x"),
    )
    again = "filter(sequence(0, size(__x) - 1), j -> (j > 0 AND __x[j].w = __x[j - 1].w) OR (j < size(__x) - 1 AND __x[j].w = __x[j + 1].w))"
    repeats = F.expr(f"CASE WHEN size(__x) < 2 THEN 0L ELSE CAST(size(array_distinct(flatten(transform({again}, j -> array(__x[j].i, __x[j].i + 1, __x[j].i + 2))))) AS bigint) END")
    return step.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rates() -> dict[str, Column]:
    """Integer measures, each at least 0."""
    return {
        "symbols": F.expr("n_symbols * 1000 DIV greatest(n_words, 1)"),
        "dup_lines": F.expr("n_dup_lines * 1000 DIV greatest(n_lines, 1)"),
        "repeats": F.expr("n_repeat_words * 1000 DIV greatest(n_words, 1)"),
        "word_len": F.expr("word_chars * 100 DIV greatest(n_words, 1)"),
    }


def sketch(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, bucket, n): a mergeable histogram for each group and measure."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("long").alias("v")) for k, v in _rates().items()])).alias("p")
    rows = stats.select(*by, pairs).select(*by, "p.measure", "p.v")
    bucket = F.expr("CASE WHEN v < 128 THEN v ELSE v - v % shiftleft(1L, length(bin(v)) - 7) END")
    return rows.groupBy(*by, "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], percents: dict[str, int]) -> DataFrame:
    """(by, measure, total, one column for each name): the least bucket that percent of the group's rows do not exceed."""
    # a group's buckets are few, so they fit one array; the sort is over buckets, not rows
    arrays = sketches.groupBy(*by, "measure").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("total"))
    cum = F.expr("aggregate(b, named_struct('c', 0L, 'o', CAST(array() AS array<struct<bucket: bigint, c: bigint>>)), (a, x) -> named_struct('c', a.c + x.n, 'o', array_append(a.o, named_struct('bucket', x.bucket, 'c', a.c + x.n)))).o")
    found = arrays.select(*by, "measure", "total", cum.alias("b"))
    return found.select(*by, "measure", "total", *[F.expr(f"filter(b, x -> x.c * 100 >= total * {p})[0].bucket").alias(name) for name, p in percents.items()])


def _width(q: str) -> str:
    """The width of the bucket that starts at q."""
    return f"CASE WHEN {q} < 128 THEN 1L ELSE shiftleft(1L, length(bin({q})) - 7) END"


def thresholds(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, <measure>_max of each, word_len_min, own_<measure>): one row for each pair in stats. own_ tells whose sketch
    set the upper fence: source, language or all."""
    fine = written(sketch(stats, [lang, source]), "buckets")
    percents = {"mid": 50, "low": 100 - TAIL["word_len"], **{f"p{p}": p for p in sorted({*TAIL.values()})}}
    facts = lambda by: [*by, "measure", "total", "mid", "low", F.expr(f"CASE measure {' '.join(f"WHEN '{k}' THEN p{p}" for k, p in TAIL.items())} END").alias("top")]
    own = quantiles(fine, [lang, source], percents).select(*facts([lang, source]))
    of_lang = quantiles(merge(fine, [lang]), [lang], percents).select(*facts([lang]))
    of_all = quantiles(merge(fine, []), [], percents).select(*facts([]))
    renamed = lambda df, tag: df.withColumnsRenamed({c: f"{tag}_{c}" for c in df.columns})
    both = own.join(renamed(of_lang, "l"), F.col(lang).eqNullSafe(F.col(f"l_{lang}")) & (F.col("measure") == F.col("l_measure"))).join(renamed(of_all, "a"), F.col("measure") == F.col("a_measure"))

    def chosen(side: str, end: str) -> list[Column]:
        """The end (top or low) and the median of the first sketch that is large enough and has a tail."""
        mine, language = (f"{t}total >= {MIN_GROUP} AND {t}{end} <> {t}mid" for t in ("", "l_"))
        return [F.expr(f"CASE WHEN {mine} THEN {c} WHEN {language} THEN l_{c} ELSE a_{c} END").alias(f"{side}_{c}") for c in (end, "mid")] + [F.expr(f"CASE WHEN {mine} THEN 'source' WHEN {language} THEN 'language' ELSE 'all' END").alias(f"{side}_from")]

    both = both.select(lang, source, "measure", "l_total", "l_top", "l_mid", *chosen("up", "top"), *chosen("down", "low"))
    hi = f"up_top + greatest((up_top - up_mid) DIV 2, {_width('up_top')})"
    cap = f"CASE WHEN l_total >= {MIN_GROUP} AND l_top <> l_mid THEN l_top + greatest(2 * (l_top - l_mid), {_width('l_top')}) END"
    both = both.withColumn("hi", F.expr(f"least({hi}, {cap})"))  # least() leaves nulls out
    both = both.withColumn("lo", F.expr(f"down_low - greatest((down_mid - down_low) DIV 2, {_width('down_low')})"))
    limits = [F.max(F.when(F.col("measure") == k, F.col("hi"))).alias(f"{k}_max") for k in TAIL]
    owners = [F.max(F.when(F.col("measure") == k, F.col("up_from"))).alias(f"own_{k}") for k in TAIL]
    return both.groupBy(lang, source).agg(*limits, F.max(F.when(F.col("measure") == "word_len", F.col("lo"))).alias("word_len_min"), *owners)


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """df without its text, with the measures, base_failed and kept.

    Texts that fail the base rule do not shape the thresholds. The measures are written once and read twice: for the sketches
    and for the join, whose other side has one row for each language and source.
    """
    stats = written(measures(df, text).withColumn("base_failed", base_failed()), "quality")
    limits = thresholds(stats.where("NOT base_failed"), lang, source).drop(*[f"own_{k}" for k in TAIL]).withColumnsRenamed({lang: "__lang", source: "__source"})
    joined = stats.join(limits, stats[lang].eqNullSafe(limits["__lang"]) & stats[source].eqNullSafe(limits["__source"]), "left")
    fine = F.lit(True)
    for name, rate in _rates().items():
        fine = fine & (rate <= F.coalesce(F.col(f"{name}_max"), rate.cast("bigint")))
    fine = fine & (_rates()["word_len"] >= F.coalesce(F.col("word_len_min"), F.lit(0)))
    out = joined.withColumn("kept", ~F.col("base_failed") & fine)
    return out.drop("__lang", "__source", "word_len_min", "n_lines", *[f"{k}_max" for k in TAIL])


def _duck_width(q: str) -> str:
    return f"CASE WHEN {q} < 128 THEN 1 ELSE 1::BIGINT << (length(bin({q})) - 7) END"


def _levels() -> str:
    """Quantiles of each source, language and of all texts, from the bucket counts k."""
    top = " ".join(f"WHEN '{k}' THEN {p}" for k, p in TAIL.items())
    out = []
    for name, by in (("own", "lang, source, "), ("lang", "lang, "), ("all", "")):
        out.append(f"c_{name} AS (SELECT {by}measure, bucket, sum(sum(n)) OVER (PARTITION BY {by}measure ORDER BY bucket) AS c, sum(sum(n)) OVER (PARTITION BY {by}measure) AS total FROM k GROUP BY {by}measure, bucket)")
        out.append(f"q_{name} AS (SELECT {by}measure, any_value(total) AS total, min(bucket) FILTER (c * 100 >= total * 50) AS mid, min(bucket) FILTER (c * 100 >= total * {100 - TAIL['word_len']}) AS low, min(bucket) FILTER (c * 100 >= total * CASE measure {top} END) AS top FROM c_{name} GROUP BY {by}measure)")
    return ",\n".join(out)


def _pick(end: str) -> str:
    own, lang = (f"{t}.total >= {MIN_GROUP} AND {t}.{end} <> {t}.mid" for t in "ol")
    return ", ".join(f"CASE WHEN {own} THEN o.{c} WHEN {lang} THEN l.{c} ELSE a.{c} END AS {end}_{n}" for c, n in ((end, "q"), ("mid", "m")))


#: DuckDB SQL with the same result for a table documents(doc_id, text, lang, source).
ORACLE = f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, t, lang, source FROM t),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM w WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE c > 1) GROUP BY doc_id),
s AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
        n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 100 // greatest(n_words, 1) AS word_len FROM s),
m AS (SELECT lang, source, measure, v FROM (SELECT lang, source, symbols, dup_lines, repeats, word_len FROM b WHERE NOT base_failed)
        UNPIVOT (v FOR measure IN (symbols, dup_lines, repeats, word_len))),
k AS (SELECT lang, source, measure, CASE WHEN v < 128 THEN v ELSE v - v % (1::BIGINT << (length(bin(v)) - 7)) END AS bucket, count(*) AS n FROM m GROUP BY ALL),
{_levels()},
z AS (SELECT o.lang, o.source, o.measure, l.total AS l_total, l.top AS l_top, l.mid AS l_mid, {_pick("top")}, {_pick("low")}
        FROM q_own o JOIN q_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN q_all a ON o.measure = a.measure),
x AS (SELECT *, top_q + greatest((top_q - top_m) // 2, {_duck_width("top_q")}) AS hi, low_q - greatest((low_m - low_q) // 2, {_duck_width("low_q")}) AS lo,
        CASE WHEN l_total >= {MIN_GROUP} AND l_top <> l_mid THEN l_top + greatest(2 * (l_top - l_mid), {_duck_width("l_top")}) END AS cap FROM z),
f AS (SELECT lang, source, {', '.join(f"max(least(hi, coalesce(cap, hi))) FILTER (measure = '{k}') AS {k}_max" for k in TAIL)}, max(lo) FILTER (measure = 'word_len') AS word_len_min FROM x GROUP BY ALL)
SELECT b.doc_id, b.lang, b.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND {' AND '.join(f'({k} <= coalesce({k}_max, {k}))' for k in TAIL)} AND word_len >= coalesce(word_len_min, 0) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""
