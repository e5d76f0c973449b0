"""Stupid-backoff scores of all documents under the n-gram counts of all other documents.

1. The documents' n-grams of 1 to ``order`` words (lower-cased A-Z, hashed to 64 bits, the order in the last two bits) are exploded
   and counted in each block of documents, packed as in ``blocks``, and partitioned by hash range: one shuffle.
2. Each hash range sums its n-grams to its part of the count table and joins that to the n-grams it got, in the same partition.
   What is gathered grows with the corpus; no part of the table leaves its partition.
3. The counts found return to their block, where each document's logarithms are summed.

For a word w after the words of its context, with counts c from which the document's own are taken away, and N words in the other
documents: c(context, w) / c(context) if c(context, w) > 0, else ``BACKOFF`` times the same with the context cut by its first word;
without context c(w) / N if c(w) > 0, else 1 / (N + 1). A document's first words have shorter contexts, without a factor.
``log_score`` is the sum of the natural logarithms, ``mean_log`` that by word.

Defined results: null, empty and blank texts have n_words 0, log_score 0 and mean_log null. Repeated rows, whatever their ids, and
rows with a null id count as documents of their own. Columns other than id and text are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm.blocks import TEXTS, answer, asked, gathered, shard_bits, texts, unpacked
from tessella.llm.scratch import written
from tessella.llm.words import mix, word_hashes

ORDER = 2
BACKOFF = 0.4
_PAIR = np.uint64(0x9FB21C651E98DF25)
_TAG = np.uint64(3)


def _grams(block: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the n-gram that ends at each word, each word's document and its place there (an n-gram needs n words)."""
    words, bounds = word_hashes(block)
    doc = np.repeat(np.arange(len(block)), np.diff(bounds))
    place = np.arange(len(words)) - bounds[:-1][doc]
    grams, last = [words & ~_TAG], words
    for k in range(1, order):
        last = mix(np.concatenate([[np.uint64(0)], last[:-1]])[: len(words)] * _PAIR + words)
        grams.append(last & ~_TAG | np.uint64(k))
    return grams, doc, place


def _counted(order: int):
    def ask(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        grams, _, place = _grams(block, order)
        keys, counts = np.unique(np.concatenate([g[place >= k] for k, g in enumerate(grams)]), return_counts=True)
        return keys, counts.astype("<u4")

    return ask


def _joined(table: pa.Table) -> pa.Table:
    """A hash range: the count of each n-gram in all blocks, for each block that has it, and how many words the range counts."""
    keys = [unpacked(k) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in table.column("extra").to_pylist()])
    different, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, counts, len(different)).astype("<u8")
    words = int(total[different & _TAG == 0].sum())
    found = total.astype("<u4" if total.max(initial=0) < 1 << 32 else "<u8")[inverse]
    ends = np.cumsum([len(k) for k in keys])
    made = answer(table, [found.dtype.itemsize.to_bytes(1, "little")] * len(keys), [found[e - len(k) : e].tobytes() for k, e in zip(keys, ends)])
    return made.append_column("words", pa.array([words] * len(keys), pa.int64()))


def score(df: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(id, n_words, log_score, mean_log) for each row of df."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    bits = shard_bits(rows, "t", order / 2)
    found = written(asked(rows, _counted(order), bits).groupBy("shard").applyInArrow(_joined, f"{TEXTS}, words long"), "answers")
    corpus = found.groupBy("shard").agg(F.max("words").alias("words")).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]

    def summed(table: pa.Table) -> pa.Table:
        ids, block, answers = gathered(table)
        grams, doc, place = _grams(block, order)
        n_docs = len(block)
        n_words = np.bincount(doc, minlength=n_docs)
        log = np.zeros(n_docs)
        if len(doc):
            inside = [place >= k for k in range(order)]
            keys, inverse = np.unique(np.concatenate([g[i] for g, i in zip(grams, inside)]), return_inverse=True)
            total = np.concatenate([np.frombuffer(b, f"<u{a[0]}").astype(np.int64) for a, b in answers])
            docs = np.concatenate([doc[i] for i in inside])
            _, own_of, own = np.unique(docs * np.int64(len(keys)) + inverse, return_inverse=True, return_counts=True)
            others = np.split(total[inverse] - own[own_of], np.cumsum([i.sum() for i in inside])[:-1])
            rest = corpus - n_words[doc]
            value, before = np.where(others[0] > 0, others[0] / np.maximum(rest, 1), 1 / (rest + 1)), others[0]
            for k in range(1, order):
                seen = np.zeros(len(doc), np.int64)
                seen[inside[k]] = others[k]
                # the document's last word has no n-gram after it, so a context's count is that of the n-gram, not of its followers
                context = np.concatenate([[0], before[:-1]])
                value = np.where(seen > 0, seen / np.maximum(context, 1), np.where(inside[k], BACKOFF, 1.0) * value)
                before = seen
            log = np.bincount(doc, np.log(value), n_docs)
        mean = pa.array(np.divide(log, n_words, out=np.zeros(n_docs), where=n_words > 0), mask=n_words == 0)
        return pa.table({"id": ids, "n_words": pa.array(n_words.astype(np.int64)), "log_score": pa.array(log), "mean_log": mean})

    return texts(rows).unionByName(found.drop("words")).groupBy("block").applyInArrow(summed, "id long, n_words long, log_score double, mean_log double")
