"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text, cut at quantiles by language.

The model is over bytes, n-grams of up to ``ORDER`` bytes. It is fitted on one half of the trusted texts, by a hash of the id, all of
them; the other half sets the limits. The fitted texts' n-gram counts, continuation counts, discounts and context weights are Spark joins over count
tables. Scoring covers all documents: each block asks for its different n-grams, the requests meet the model shard by shard, and
the answers (probability, back-off weight) return to the block (see ``blocks``); no table of the model is broadcast.

A language's limit is the ``percent`` quantile of the perplexity of its trusted documents outside the fitted half times ``slack``,
by mergeable quantile sketches; a language without any takes that of all languages.

Defined results: null and empty texts have perplexity null and kept false. A null language is one of its own. Without any trusted
text in the fitted half all bytes are equally likely, without any in the other half all texts with a byte are kept. Repeated ids
and null ids are rows of their own, with their own text and language. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm.blocks import TEXTS, answer, asked, gathered, shard_bits, texts, unpacked
from tessella.llm.scratch import drop, written
from tessella.llm.words import mix

ORDER = 4
#: Bits of the map of trusted ids: 2**18 rows at most, however many ids there are.
MAP_BITS = 24
_PAD = b"\n" * (ORDER - 1)


def _grams(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each byte of the block's texts, and the text of each; a text's first bytes follow padding."""
    data = np.frombuffer(b"".join(_PAD + t for t in block), np.uint8).astype(np.uint32)
    lengths = np.array([len(t) for t in block], np.int64)
    starts = np.cumsum(lengths + len(_PAD)) - lengths
    inside = np.ones(len(data), bool)
    for i in range(1, len(_PAD) + 1):
        inside[starts - i] = False
    gram = data.copy()
    for k in range(1, ORDER):
        gram[k:] |= data[:-k] << np.uint32(8 * k) if len(data) > k else 0
    return gram[inside], np.repeat(np.arange(len(block)), lengths)


def _shorter(grams: np.ndarray, k: int) -> np.ndarray:
    """The k-grams that end where the ORDER-grams do."""
    return grams & np.uint32((1 << 8 * k) - 1)


def _key(k: int, grams: np.ndarray) -> np.ndarray:
    return mix(grams.astype(np.uint64) | np.uint64(k) << np.uint64(40))


def counts(trusted: DataFrame) -> DataFrame:
    """(gram, c) of the ORDER-grams of trusted(t), counted in the task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, n = np.unique(_grams([t or b"" for t in batch.column(0).to_pylist()])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "c"])

    return trusted.select(F.col("t")).mapInArrow(work, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def model(trusted: DataFrame) -> tuple[DataFrame, float]:
    """(k, gram, p, gamma): probability of a seen k-gram's last byte, and weight of the next shorter order behind the k-gram as a
    context; and the probability of a byte that was never seen."""
    tables = {ORDER: written(counts(trusted), "counts")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy(F.expr(f"gram & {(1 << 8 * k) - 1}L").alias("gram")).agg(F.count("*").alias("c"))
    every = None
    for k, t in tables.items():
        part = t.select(F.lit(k).alias("k"), "gram", "c")
        every = part if every is None else every.unionByName(part)
    every = written(every, "orders")
    seen = {(r.k, r.c): r.n for r in every.where("c <= 4").groupBy("k", "c").agg(F.count("*").alias("n")).collect()}
    discount = {}
    for k in tables:  # from counts of counts; a count that never occurs leaves the next discount at the last one's rule
        n = [max(1, seen.get((k, i), 0)) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        discount[k] = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 0.9) for i in range(3)]
    out, below, unseen = None, None, 1 / 256
    contexts = {}
    for k in range(1, ORDER + 1):
        d = discount[k]
        t = every.where(F.col("k") == k).select("gram", "c").withColumn("ctx", F.expr("shiftright(gram, 8)"))
        less = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts[k] = t.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum(less) / F.sum("c")).alias("gamma"))
        if k == 1:
            first = contexts[1].first()
            if first is None:
                return every.selectExpr("k", "gram", "0D AS p", "1D AS gamma"), unseen
            unseen = first.gamma / 256
            probability = (F.col("c") - less) / F.lit(first.total) + F.lit(unseen)
            below = written(t.select("gram", probability.alias("p")), "order")
        else:
            shorter = below.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            rows = t.withColumn("suffix", F.expr(f"gram & {(1 << 8 * (k - 1)) - 1}L")).join(shorter, "suffix").join(contexts[k], "ctx")
            weights = contexts[k].select(F.col("ctx").alias("gram"), "gamma")
            part = below.join(weights, "gram", "full").select(F.lit(k - 1).alias("k"), "gram", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("gamma", F.lit(1.0)).alias("gamma"))
            out = part if out is None else out.unionByName(part)
            below = written(rows.select("gram", ((F.col("c") - less) / F.col("total") + F.col("gamma") * F.col("q")).alias("p")), "order")
    return out.unionByName(below.select(F.lit(ORDER).alias("k"), "gram", "p", F.lit(1.0).alias("gamma"))), unseen


def _keys(different: np.ndarray) -> np.ndarray:
    """Sorted keys of all n-grams and contexts that the different ORDER-grams need."""
    keys = [_key(k, np.unique(_shorter(different, k))) for k in range(1, ORDER + 1)]
    keys += [_key(k, np.unique(_shorter(different >> np.uint32(8), k))) for k in range(1, ORDER)]
    return np.unique(np.concatenate(keys))


def _ask(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _keys(np.unique(_grams(block)[0])), np.zeros(0, "u1")


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    keys = known.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, p, gamma = keys[order], known.column("p").to_numpy()[order], known.column("gamma").to_numpy()[order]
    made = []
    for data in asked.column("keys").to_pylist():
        wanted = unpacked(data)
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
        made.append(tuple(np.where(hit, x[at] if len(keys) else 0.0, miss).astype("<f4").tobytes() for x, miss in ((p, 0.0), (gamma, 1.0))))
    return answer(asked, [m[0] for m in made], [m[1] for m in made])


def perplexities(df: DataFrame, known: DataFrame, unseen: float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, perplexity) for each row of df."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    bits = shard_bits(rows, "t", 0.1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _key(0, b.column("gram").to_numpy().astype(np.uint64) | b.column("k").to_numpy().astype(np.uint64) << np.uint64(40))
            yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(64 - bits)).astype(np.int64)), pa.array(keys.view(np.int64)), b.column("p"), b.column("gamma")], names=["shard", "key", "p", "gamma"])

    def score(table: pa.Table) -> pa.Table:
        ids, block, answers = gathered(table)
        grams, doc = _grams(block)
        n = np.bincount(doc, minlength=len(block))
        log = np.zeros(len(block))
        if len(grams):
            different = np.unique(grams)  # each is worked out once
            keys = _keys(different)
            p, gamma = (np.concatenate([np.frombuffer(x[i], "<f4") for x in answers]).astype(np.float64) for i in (0, 1))
            value = np.full(len(different), unseen)
            for k in range(1, ORDER + 1):
                seen = p[np.searchsorted(keys, _key(k, _shorter(different, k)))]
                if k > 1:
                    value = value * gamma[np.searchsorted(keys, _key(k - 1, _shorter(different >> np.uint32(8), k - 1)))]
                value = np.where(seen > 0, seen, value)
            log = np.bincount(doc, np.log(value)[np.searchsorted(different, grams)], len(block))
        mean = pa.array(np.exp(-log / np.maximum(n, 1)), mask=n == 0)
        return pa.table({"id": ids, "n_bytes": pa.array(n.astype(np.int64)), "perplexity": mean})

    model_rows = known.select("k", "gram", "p", "gamma").mapInArrow(keyed, "shard long, key long, p double, gamma double")
    answers = asked(rows, _ask, bits).groupBy("shard").cogroup(model_rows.groupBy("shard")).applyInArrow(_answer, TEXTS)
    return texts(rows).unionByName(answers).groupBy("block").applyInArrow(score, "id long, n_bytes long, perplexity double")


def of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ids(id), each id once. A map of the ids' hashes, of a fixed size, goes to all tasks and leaves out nearly all other
    rows where they are read; what it lets through is joined with ids. So other texts are never shuffled."""
    cell = lambda df: df.withColumn("__bit", F.expr(f"xxhash64(id, 'map') & {(1 << MAP_BITS) - 1}L")).withColumn("__cell", F.expr("shiftright(__bit, 6)"))
    bits = cell(ids).groupBy("__cell").agg(F.expr("bit_or(shiftleft(1L, CAST(__bit & 63 AS int)))").alias("__bits"))
    near = cell(rows).join(F.broadcast(bits), "__cell").where("shiftright(__bits, CAST(__bit & 63 AS int)) & 1L = 1L")
    # a semi-join would be moved below the join with the map
    return near.drop("__cell", "__bit", "__bits").join(ids.hint("merge"), "id")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality", percent: float = 0.99, slack: float = 1.1) -> DataFrame:
    """(id, lang, n_bytes, perplexity, ppl_limit, kept) for each row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("t"))
    trusted = labels.where(F.col(label) == 1).select(F.col(id_col).cast("long").alias("id")).distinct()
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2))
    known, unseen = model(of_ids(rows, trusted.where(half == 0)).select("t"))
    known = written(known, "model")
    scored = written(perplexities(rows, known, unseen, "row", "t").withColumnRenamed("id", "row"), "perplexity")
    drop(known)
    judged = rows.select("row", "id", "lang").join(scored, "row")
    good = judged.join(trusted.where(half == 1), "id", "left_semi")
    q = F.percentile_approx("perplexity", F.lit(percent), F.lit(10_000))
    limits = good.groupBy(F.col("lang").alias("__lang")).agg((q * slack).alias("own"))
    overall = good.agg((q * slack).alias("all")).first()[0]
    judged = judged.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    limit = F.coalesce(F.col("own"), F.lit(overall), F.lit(float("inf")))
    return judged.select("id", "lang", "n_bytes", "perplexity", limit.alias("ppl_limit"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))
