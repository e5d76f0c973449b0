"""The registered queries of the learned operators: op6 against a plain Kneser-Ney model, op8 and op9 on held-out rows and odd ones."""

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import kneser_ney, queries

WORDS = {"en": "the house was green and many people walked along river banks with their small dogs".split(), "de": "das grosse haus steht zwischen bergen und vielen alten schönen dörfern während regen".split(), "fr": "la maison était très belle avec des fleurs où les enfants jouaient après école".split()}


def written(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n_chars", "2 AS score", "3 AS kept").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")


def run(spark, name, path):
    return {r.doc_id: r for r in queries.queries()[name](spark, str(path)).collect()}


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def plain_model(texts, order=4):
    """Interpolated modified Kneser-Ney over bytes; a function of (context, byte)."""
    tables = {order: collections.Counter()}
    for t in texts:
        data = b"\n" * (order - 1) + t
        for i in range(len(t)):
            tables[order][data[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    less = {}
    for k, t in tables.items():
        n = [max(1, sum(c == i for c in t.values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        less[k] = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 0.9) for i in range(3)]
    total, cut = collections.Counter(), collections.Counter()
    for k, t in tables.items():
        for g, c in t.items():
            total[k, g[:-1]] += c
            cut[k, g[:-1]] += less[k][min(c, 3) - 1]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        ctx = (k, gram[:-1])
        if not total[ctx]:
            return p(gram[1:])
        c = tables[k][gram]
        return ((c - less[k][min(c, 3) - 1]) if c else 0) / total[ctx] + cut[ctx] / total[ctx] * p(gram[1:])

    return p


def test_quality_classifier_against_a_plain_model(spark, tmp_path):
    r = random.Random(3)
    prose = lambda: " ".join(r.choices(WORDS["en"], k=r.randint(3, 25)))
    junk = lambda: "".join(r.choices("qxzjkv#$%&0123", k=r.randint(30, 90)))
    docs = [(i, junk() if i % 7 == 6 else prose(), "en" if i % 3 else "de", "s") for i in range(84)] + [(200, None, "en", "s"), (201, "", "en", "s"), (202, "é", None, None), (203, "one " * 3000, "en", "s")]
    labels = [(i, int(i % 7 != 6), 0) for i in range(0, 60)]
    written(spark, tmp_path, docs, labels)
    half = {x.i: x.h for x in spark.range(300).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).alias("h")).collect()}
    text = {d[0]: (d[1] or "").encode() for d in docs}
    p = plain_model([text[i] for i, q, _ in labels if q == 1 and half[i] == 0])
    perplexity = {}
    for i, t in text.items():
        data = b"\n" * (kneser_ney.ORDER - 1) + t
        perplexity[i] = math.exp(-sum(math.log(p(data[j : j + kneser_ney.ORDER])) for j in range(len(t))) / len(t)) if t else None
    lang = {d[0]: d[2] for d in docs}
    good = [i for i, q, _ in labels if q == 1 and half[i] == 1]
    overall = max(perplexity[i] for i in good) * 1.1
    limit = {x: max((perplexity[i] for i in good if lang[i] == x), default=overall / 1.1) * 1.1 for x in set(lang.values())}
    got = run(spark, "op6_quality_classifier", tmp_path)
    assert set(got) == set(text)
    for i, x in got.items():
        assert x.n_bytes == len(text[i]) and x.ppl_limit == pytest.approx(limit[lang[i]], rel=1e-4)
        assert x.perplexity is None if perplexity[i] is None else x.perplexity == pytest.approx(perplexity[i], rel=1e-4)
        if perplexity[i] is None or abs(perplexity[i] / limit[lang[i]] - 1) > 1e-3:
            assert x.kept == (perplexity[i] is not None and perplexity[i] <= limit[lang[i]])
    assert not any(got[i].kept for i in range(84) if i % 7 == 6) and sum(got[i].kept for i in range(84) if i % 7 != 6) > 60


def test_language_query_on_held_out_rows(spark, tmp_path):
    r = random.Random(5)
    langs = list(WORDS)
    docs = [(i, " ".join(r.choices(WORDS[langs[i % 3]], k=r.randint(15, 60))), langs[i % 3], "s") for i in range(150)]
    odd = [(900, None, "en", "s"), (901, "", "en", None), (902, "123 !? 456", "de", "s"), (903, "das haus " * 4000, None, "s"), (904, " \n", None, "s")]
    written(spark, tmp_path, docs + odd, [])
    got = run(spark, "op8_language_id", tmp_path)
    assert set(got) == {d[0] for d in docs + odd}
    for i, x in got.items():
        assert x.held_out == (crc(i, 4) == 2) and 0 <= x.score <= 1 and x.lang_pred in (*langs, "und")
    held = [d for d in docs if crc(d[0], 4) == 2]
    assert len(held) > 20 and all(got[i].lang_pred == lang for i, _, lang, _ in held)
    assert all(got[i].lang_pred == "und" for i in (900, 901, 902, 904)) and got[903].lang_pred == "de"
    # neither lang nor source of a held-out row is an input
    written(spark, tmp_path, [(i, t, "fr" if crc(i, 4) == 2 else lang, "other") for i, t, lang, _ in docs + odd], [])
    again = run(spark, "op8_language_id", tmp_path)
    assert all(again[i].lang_pred == got[i].lang_pred for i, *_ in held)


def test_toxicity_query_on_held_out_rows(spark, tmp_path):
    r = random.Random(6)
    bad = "idiot scum moron filthy".split()
    toxic = {i: int(i % 4 == 0) for i in range(200)}
    docs = [(i, " ".join(r.sample(r.choices(WORDS["en"], k=20) + (r.choices(bad, k=6) if toxic[i] else []), 20 + 6 * toxic[i])), "en", "s") for i in range(200)]
    odd = [(900, None, "en", "s"), (901, "", "en", None), (902, "the green house " * 5000, None, "s"), (903, "é😀", "en", "s")]
    more = [(5, 1, toxic[5]), (950, 1, 1), (160, 1, None)]
    written(spark, tmp_path, docs + odd, [(i, 1, toxic[i]) for i in range(160)] + more)
    got = run(spark, "op9_toxicity", tmp_path)
    assert set(got) == {d[0] for d in docs + odd}
    for i, x in got.items():
        assert x.held_out == (crc(i, 5) == 0) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
    held = [i for i in range(200) if crc(i, 5) == 0]
    assert len(held) > 20 and sum(got[i].predicted == toxic[i] for i in held) >= 0.95 * len(held) and got[902].predicted == 0
    # labels of held-out rows, lang and source are no inputs
    written(spark, tmp_path, [(i, t, "xx", "other") for i, t, *_ in docs + odd], [(i, 0, 1 - toxic[i] if crc(i, 5) == 0 else toxic[i]) for i in range(160)] + more)
    again = run(spark, "op9_toxicity", tmp_path)
    assert all(again[i].score == pytest.approx(got[i].score, abs=1e-9) for i in got)
