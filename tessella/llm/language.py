"""Language identification by compression: the language whose dictionary makes a text smallest wins.

Each language's dictionary is raw text of that language, which zstandard may copy from. A text is lower-cased, its runs of ASCII non-letters become spaces, and it is cut into
blocks of ``BLOCK`` bytes; each block is compressed with each dictionary, and the sizes are summed over the whole text, so long
texts cannot drift away from the dictionary. ``score`` is 1 - smallest / second smallest, ``rejected`` marks a score below
``margin`` (the operator's own ``lang`` is then ``und``).

Only the dictionaries come from a sample. Training texts of any length are cut into blocks of ``BLOCK`` characters; a language's
different blocks, in the order of their hash, fill its dictionary up to ``DICTIONARY`` bytes, which is what bounds the sample
(and ``max_texts`` blocks, which only matters where blocks are short). Blocks are compared after normalization, so copies count once.

Defined results: null texts and texts without a letter are ``und`` with score 0. With one known language its score is 1 for
every text with letters; with none all texts are ``und``. Equal sizes go to the alphabetically first language, with score 0.
Repeated rows get equal results; extra columns pass through, and one named as an output column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

BLOCK = 4_096
DICTIONARY = 64_000
SHORT = 400
LEAD = 256
OUT = T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean").add("lang_out", "string")


_SPACES = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def plain(text: str) -> bytes:
    """Lower-case words with one space between: ASCII characters other than letters become spaces."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES).split())


class Coder:
    """Two compressors for each language: a fast one, and a thorough one for texts under SHORT bytes, whose sizes are close.

    A block that gains too little is stored as it is, which would make short texts equal in all languages. So a short text comes
    after the dictionary's last LEAD bytes: they cost one copy in each language and make the block one that is compressed."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 5, short_level: int = 19):
        self.langs = sorted(dictionaries)
        self.leads = [dictionaries[lang][-LEAD:] + b" " for lang in self.langs]
        self.fast, self.thorough = ([self._compressor(dictionaries[lang], n, m) for lang in self.langs] for n, m in ((level, 4), (short_level, 3)))

    @staticmethod
    def _compressor(data: bytes, level: int, min_match: int) -> zstandard.ZstdCompressor:
        raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(level, source_size=BLOCK, dict_size=len(data), min_match=min_match, write_content_size=0, write_dict_id=0, write_checksum=0)
        raw.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=raw, compression_params=params)

    def sizes(self, text: str) -> list[int]:
        data = plain(text)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        if len(data) >= SHORT:
            return [sum(len(c.compress(b)) for b in blocks) for c in self.fast]
        return [len(c.compress(lead + data)) for c, lead in zip(self.thorough, self.leads)]

    def judge(self, text: str | None, margin: float) -> tuple[str, float, bool, str]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True, "und"
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False, self.langs[0]
        sizes = self.sizes(text)
        best, second = np.argsort(sizes, kind="stable")[:2]
        score = 1 - sizes[best] / sizes[second]
        rejected = score < margin
        return self.langs[best], score, rejected, "und" if rejected else self.langs[best]


def _order(block: bytes) -> bytes:
    return hashlib.blake2b(block, digest_size=8).digest()


def _first(blocks: dict[bytes, bytes], max_texts: int) -> list[tuple[bytes, bytes]]:
    """The first max_texts of different blocks, or as many as fill DICTIONARY bytes, as (order, block)."""
    out, size = [], 0
    for block, order in sorted(blocks.items(), key=lambda x: (x[1], x[0]))[:max_texts]:
        if size >= DICTIONARY:
            break
        out.append((order, block))
        size += len(block) + 1
    return out


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", max_texts: int = 400, max_langs: int = 1_000) -> dict[str, bytes]:
    """A dictionary for each non-null language of labelled that has a text with a letter.

    Each task keeps the first different blocks of a language until they fill a dictionary; whatever is among the first of all
    blocks is among the first of its task, so the tasks' blocks are enough.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("t")).where(F.col("lang").isNotNull() & (F.length("t") > 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[bytes, bytes]] = {}
        sizes: dict[str, int] = {}
        limits: dict[str, tuple[bytes, bytes]] = {}  # the last block of a full dictionary: no later one can enter it
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in found and len(found) > max_langs:
                    continue  # learn() raises on what is already here
                blocks = found.setdefault(name, {})
                for i in range(0, len(t), BLOCK):
                    block = plain(t[i : i + BLOCK])
                    if not block or block in blocks:
                        continue
                    order = _order(block)
                    if name in limits and (order, block) > limits[name]:
                        continue
                    blocks[block] = order
                    sizes[name] = sizes.get(name, 0) + len(block) + 1
                    if sizes[name] >= 4 * DICTIONARY or len(blocks) >= 4 * max_texts:
                        first = _first(blocks, max_texts)
                        limits[name] = first[-1]
                        found[name] = blocks = {b: o for o, b in first}
                        sizes[name] = sum(len(b) + 1 for b in blocks)
        for name, blocks in found.items():
            for order, block in _first(blocks, max_texts):
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([order], pa.binary()), pa.array([block], pa.binary())], names=["lang", "o", "b"])

    different = rows.mapInArrow(work, "lang string, o binary, b binary").distinct()
    first = Window.partitionBy("lang").orderBy("o", "b")
    cut = different.withColumn("n", F.row_number().over(first)).where(F.col("n") <= max_texts)
    cut = cut.withColumn("before", F.coalesce(F.sum(F.octet_length("b") + 1).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < DICTIONARY)
    out: dict[str, list[bytes]] = {}
    for r in cut.orderBy("lang", "n").collect():  # DICTIONARY bytes and one block a language at most
        out.setdefault(r.lang, []).append(bytes(r.b))
    if len(out) > max_langs:
        raise ValueError(f"more than {max_langs} languages; max_langs bounds what is broadcast")
    return {name: b" ".join(blocks)[:DICTIONARY] for name, blocks in out.items()}


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = 0.02) -> DataFrame:
    """df without its text, with lang_pred (best guess), score, rejected and lang_out (und where rejected). No shuffle."""
    kept = [c for c in df.columns if c != text and c not in OUT.names]
    schema = T.StructType([*[df.schema[c] for c in kept], *OUT])
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)  # DICTIONARY bytes for each of at most max_langs languages

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            found = [coder.judge(t, margin) for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text__")).mapInArrow(work, schema)
