"""Full-text search as joins on a token index, with corpus-wide statistics."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessella.functions.text import fold, tokens
from tessella.sources.settle import settle

K1, B = 1.2, 0.75
SUFFIXES = "(ing|edly|ed|es|s|ly)$"


def dedupe_text(rows: DataFrame) -> DataFrame:
    """(doc_id, lang, value, ord): each value once, at its first place; und values that a language has too are dropped."""
    first = rows.groupBy("doc_id", "lang", "value").agg(F.min("ord").alias("ord"))
    known = first.where("lang <> 'und'").select("doc_id", "value").distinct()
    return first.where("lang <> 'und'").unionByName(first.where("lang = 'und'").join(known, ["doc_id", "value"], "left_anti"))


def text_buckets(records: DataFrame, labels: DataFrame, excluded: list[str] = (), lang: str = "und") -> DataFrame:
    """(doc_id, lang, value): what text search sees of a document: its strings, labels(id, lang, label) of referenced documents
    and their ancestors (records are expanded), bounds of ranges, names of has properties."""
    r = records.where(~F.col("prop").isin(list(excluded)) & ~F.coalesce(F.col("parent_prop").isin(list(excluded)), F.lit(False)))
    strings = r.where("text IS NOT NULL").select("doc_id", F.lit(lang).alias("lang"), F.col("text").alias("value"))
    named = r.where("claim_type = 'ref'").select("doc_id", F.col("to").alias("id")).join(labels, "id").select("doc_id", "lang", F.col("label").alias("value"))
    bounds = r.where("collection = 'amount'").select("doc_id", F.lit(lang).alias("lang"), F.format_string("%.2f", (F.col("lo") + F.col("hi")) / 2).alias("value"))
    has = r.where("claim_type = 'has'").select("doc_id", F.lit(lang).alias("lang"), F.col("prop").alias("value"))
    rows = strings.unionByName(named).unionByName(bounds).unionByName(has)
    return dedupe_text(rows.withColumn("ord", F.lit(0))).drop("ord")


def _stem(word: Column) -> Column:
    return F.regexp_replace(word, SUFFIXES, "")


def build_token_index(docs: DataFrame, text: str = "text", folded: bool = True, terms: list[str] | None = None, exact: list[str] = (), prefixes: list[str] = (), ids: list = ()) -> DataFrame:
    """(doc_id, lang, token, exact, positions, n): positions of each token; token is folded and lightly stemmed, exact is not. With
    terms only these tokens are there, beside the words whose lower-cased form is one of exact or starts with one of prefixes, and all
    tokens of the documents ids: what a search of them needs, by one scan that makes no other rows."""
    words = tokens(F.coalesce(F.col(text), F.lit("")))
    if terms is None:
        docs = docs.select("doc_id", "lang", text).repartition("doc_id", "lang")  # texts travel, not their words: these are grouped where they are made
    if terms is not None and not folded:
        # chosen inside the array, so that only hits become rows
        chosen = lambda x: functools.reduce(lambda a, b: a | b, [_stem(F.lower(x)).isin(list(terms)), F.lower(x).isin(list(exact)), F.col("doc_id").isin(list(ids)), *[F.lower(x).startswith(p) for p in prefixes]])
        placed = F.filter(F.transform(words, lambda x, i: F.struct(i.alias("pos"), x.alias("exact"))), lambda x: chosen(x.exact))
        rows = docs.select("doc_id", "lang", F.explode(placed).alias("x")).select("doc_id", "lang", "x.pos", "x.exact")
    else:
        rows = docs.select("doc_id", "lang", F.posexplode(words).alias("pos", "exact"))
    rows = rows.withColumn("token", _stem(fold(F.col("exact")) if folded else F.lower("exact")))
    if terms is not None and folded:
        rows = rows.where(functools.reduce(lambda a, b: a | b, [F.col("token").isin(list(terms)), F.lower("exact").isin(list(exact)), F.col("doc_id").isin(list(ids)), *[F.lower("exact").startswith(p) for p in prefixes]]))
    return rows.groupBy("doc_id", "lang", "token", "exact").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.count("*").alias("n"))


def text_lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lang, len): how many tokens a document has in a language; without any it has no row."""
    rows = docs.select("doc_id", "lang", F.size(tokens(F.coalesce(F.col(text), F.lit("")))).alias("len")).where("len > 0")
    return rows.groupBy("doc_id", "lang").agg(F.sum("len").alias("len"))


def write_token_index(docs: DataFrame, path: str, buckets: int = 64, text: str = "text", folded: bool = True) -> None:
    """The index as a table: postings in folders by bucket of the token and sorted by token inside, so that a search reads the
    buckets of its terms and of these the row groups that hold them; lengths; and one row of what a score needs of all documents.
    Postings are written where they are made, a file for each bucket and share of the documents: they are not shuffled."""
    postings = build_token_index(docs, text, folded).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    postings.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/postings")
    text_lengths(docs, text).write.parquet(f"{path}/lengths")
    lengths = docs.sparkSession.read.parquet(f"{path}/lengths")
    lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/totals")


def read_token_index(spark: SparkSession, path: str, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, lengths, totals) of a stored index; with terms the postings of these tokens, from their buckets only."""
    postings, totals = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals")
    if terms is not None:
        buckets = totals.first().buckets
        # hashes of constants are folded before the scan, which then lists the buckets that they name
        postings = postings.where(F.col("bucket").isin([F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in terms]) & F.col("token").isin(list(terms)))
    return postings.drop("bucket"), spark.read.parquet(f"{path}/lengths"), totals


def text_match(index: DataFrame, terms: list[str], prefixes: list[str] = (), ids: list = ()) -> DataFrame:
    """(doc_id, lang): every term (as token) and every prefix (of an exact token) in one language of a document or in its und
    texts; documents whose id is one of ids match in all their languages."""
    wanted = F.filter(F.array(*[F.when(F.col("token") == t, F.lit(f"t:{t}")) for t in terms], *[F.when(F.lower("exact").startswith(p), F.lit(f"p:{p}")) for p in prefixes]), lambda x: x.isNotNull())
    found = index.select("doc_id", F.explode(F.transform(wanted, lambda t: F.struct("lang", t.alias("term")))).alias("x"))
    # a document's set holds at most one entry for each of its languages and each term
    sets = found.groupBy("doc_id").agg(F.collect_set("x").alias("x"))
    each = sets.select("doc_id", "x", F.explode(F.array_distinct(F.transform("x", lambda e: e.lang))).alias("lang"))
    have = F.size(F.array_distinct(F.transform(F.filter("x", lambda e: (e.lang == F.col("lang")) | (e.lang == "und")), lambda e: e.term)))
    out = each.where(have == len(set(terms)) + len(set(prefixes))).select("doc_id", "lang")
    if ids:
        out = out.unionByName(index.where(F.col("doc_id").isin(list(ids))).select("doc_id", "lang")).distinct()
    return out


def text_phrase(index: DataFrame, words: list[str], stemmed: bool = False) -> DataFrame:
    """(doc_id, lang): the exact words (lower-cased) in a row, or with stemmed the tokens that words are."""
    at = F.col("token") if stemmed else F.lower("exact")
    parts = None
    for i, w in enumerate(words):
        part = index.where(at == w).select("doc_id", "lang", F.explode("positions").alias("p")).select("doc_id", "lang", (F.col("p") - i).alias("start"), F.lit(i).alias("i"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.distinct().groupBy("doc_id", "lang", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("doc_id", "lang").distinct()


def bm25(index: DataFrame, terms: list[str], lengths: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, score): BM25 with frequencies and lengths of all documents. index may hold the terms' postings only if lengths is
    given (text_lengths(), or those of a stored index); totals is the stored index's row of (n, mean)."""
    if lengths is None:
        lengths = index.groupBy("doc_id", "lang").agg(F.sum("n").alias("len"))
    if totals is None:
        totals = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    n, mean = (totals.select(c).scalar() for c in ("n", "mean"))
    hits = index.where(F.col("token").isin(list(terms))).groupBy("doc_id", "lang", "token").agg(F.sum("n").alias("tf"))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    rows = hits.join(df, "token").join(lengths, ["doc_id", "lang"])
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return rows.groupBy("doc_id", "lang").agg(F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))).alias("score"))


def best_language(scores: DataFrame, rest: float = 0.1, display: DataFrame | None = None, weight: float = 3.0) -> DataFrame:
    """(doc_id, score): the best language's score plus a tenth of the others'. The scores of display labels, if given, count threefold
    in their language."""
    if display is not None:
        both = scores.select("doc_id", "lang", "score").unionByName(display.select("doc_id", "lang", (F.col("score") * weight).alias("score")))
        scores = both.groupBy("doc_id", "lang").agg(F.sum("score").alias("score"))
    return scores.groupBy("doc_id").agg((F.max("score") + rest * (F.sum("score") - F.max("score"))).alias("score"))


def phrase_bonus(scores: DataFrame, index: DataFrame, words: list[str], slop: int = 5, factor: float = 2.0) -> DataFrame:
    """scores doubled where all words stand within len(words) - 1 + slop positions of each other; admits no new document."""
    rows = index.where(F.col("token").isin(words)).select("doc_id", "token", F.explode("positions").alias("p"))
    w = Window.partitionBy("doc_id").orderBy("p").rangeBetween(0, len(words) - 1 + slop)
    near = rows.withColumn("seen", F.size(F.collect_set("token").over(w))).where(F.col("seen") == len(set(words))).select("doc_id").distinct().withColumn("near", F.lit(True))
    return scores.join(near, "doc_id", "left").withColumn("score", F.when(F.col("near"), F.col("score") * factor).otherwise(F.col("score"))).drop("near")


def boost(scores: DataFrame, docs: DataFrame, factor: float) -> DataFrame:
    """scores times log10(2 + factor * the document's own score)."""
    return scores.join(docs.select("doc_id", F.col("score").alias("own")), "doc_id", "left").withColumn("score", F.col("score") * F.log10(2 + F.lit(factor) * F.coalesce("own", F.lit(0)))).drop("own")


def display_fields(labels: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(id, lang, display): a document's label followed by those of its ancestors, nearest first."""
    up = ancestors.join(labels.select(F.col("id").alias("ancestor"), "lang", "label"), "ancestor").groupBy("id", "lang").agg(F.sort_array(F.collect_list(F.struct("min_depth", "label"))).alias("x"))
    rows = labels.join(up, ["id", "lang"], "left")
    return rows.select("id", "lang", F.concat(F.array("label"), F.coalesce(F.expr("transform(x, y -> y.label)"), F.expr("CAST(array() AS array<string>)"))).alias("display"))


#: Bytes of text that are counted at once.
_SLICE = 1 << 22


def _grams(points: np.ndarray) -> np.ndarray:
    """The character trigrams of a text as numbers of three times 21 bits; a shorter text is one, with 0 where it has no character."""
    points = np.concatenate([points, np.zeros(max(0, 3 - len(points)), np.int64)])
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def _counted(texts: list[bytes], by: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, n): the trigrams of the texts with an equal value of by, at the first row that has it."""
    plain = [t.decode("utf-8", "replace") for t in texts]
    points = np.frombuffer("".join(plain).encode("utf-32-le", "replace"), "<u4").astype(np.int64) + 1
    ends, rows, first = np.cumsum([len(t) for t in plain]), {}, {}
    for i, value in enumerate(by):
        rows.setdefault(first.setdefault(value, i), []).append(_grams(points[ends[i] - len(plain[i]) : ends[i]]))
    found = [np.unique(np.concatenate(x), return_counts=True) for x in rows.values()]
    return np.repeat(np.fromiter(rows, np.int64), [len(g) for g, _ in found]), np.concatenate([g for g, _ in found]), np.concatenate([n for _, n in found])


def _trigrams(df: DataFrame, key: str, each_row: bool) -> DataFrame:
    """(key, g, n): the trigrams of the lower-cased texts of df(key, text), counted where texts are read, so that no row is made for
    each place of a text: row by row, and then with a row of g = -1 whose n is the sum of the squares, or of equal keys together, as
    far as they are read together."""
    def count(batches):
        for batch in batches:
            at, texts = 0, batch.column("t")
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, "right")))
                keys = batch.column(key).slice(at, to - at)
                row, gram, n = _counted(texts.slice(at, to - at).cast(pa.binary()).to_pylist(), range(to - at) if each_row else keys.to_pylist())
                if each_row:
                    square = np.bincount(row, n.astype(np.float64) ** 2, minlength=to - at).astype(np.int64)
                    row, gram, n = (np.concatenate(x) for x in ((row, np.arange(to - at)), (gram, np.full(to - at, -1)), (n, square)))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=[key, "g", "n"])
                at = to

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.lower(F.coalesce("text", F.lit(""))).alias("t")).mapInArrow(count, f"{key} {kind}, g long, n long")


def route_language(texts: DataFrame, learned: DataFrame, margin: float = 0.05, least: int = 20) -> DataFrame:
    """(doc_id, lang): the language whose character trigrams, learned from learned(text, lang), a text's are nearest to by cosine;
    und for short texts and where two languages are too close. Profiles are counts by trigram; a text is its own counts.

    A document's products with the profiles add up over its texts, and so does the square of its size, but for documents of several
    texts: their counts are brought together first."""
    profile = settle(_trigrams(learned.where("lang IS NOT NULL"), "lang", False).groupBy("lang", "g").agg(F.sum("n").alias("n")), "profile")
    norm = profile.groupBy("lang").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    unit = settle(profile.join(norm, "lang").select("lang", "g", (F.col("n") / F.col("norm")).alias("w")), "unit")
    square = texts.sparkSession.range(1).select(F.lit(None).cast("string").alias("lang"), F.lit(-1).cast("long").alias("g"), F.lit(1.0).alias("w"))
    long = texts.where(F.length("text") >= least)
    dot = _trigrams(long, "doc_id", True).join(unit.unionByName(square), "g").groupBy("doc_id", "lang").agg(F.sum(F.col("n") * F.col("w")).alias("dot"))
    best = dot.groupBy("doc_id").agg(F.max(F.when(F.col("lang").isNull(), F.col("dot"))).alias("square"), F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("dot", "lang"))).alias("x"))
    many = settle(texts.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "many")
    if not many.isEmpty():
        again = _trigrams(long.join(many, "doc_id", "left_semi"), "doc_id", False).groupBy("doc_id", "g").agg(F.sum("n").alias("n"))
        again = again.groupBy("doc_id").agg(F.sum(F.col("n") * F.col("n")).alias("__all"))
        best = best.join(again, "doc_id", "left").withColumn("square", F.coalesce("__all", "square"))
    near = F.transform("x", lambda y: F.struct((y["dot"] / F.sqrt("square")).alias("c"), y["lang"].alias("lang")))
    best = best.where(F.size("x") > 0).select("doc_id", F.sort_array(near, asc=False).alias("x"))
    pick = best.select("doc_id", F.when((F.size("x") == 1) | (F.col("x")[0].c - F.coalesce(F.get("x", F.lit(1)).c, F.lit(0.0)) >= margin), F.col("x")[0].lang).otherwise("und").alias("lang"))
    return texts.select("doc_id").join(pick, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"))
