"""Periodic runs against plain comparison of words at every distance, and the registered query on odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from tessella.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, power=4):
    out, n = [], len(w)
    for p in range(1, n // power + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, power * p):
                part = w[i : i + length]
                if not any(all(part[x] == part[x + q] for x in range(length - q)) for q in range(1, p)):
                    out.append((i, length, p))
            i = max(j, i) + 1
    return sorted(out)


def tailed(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 or not n or doc_id is None:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def samples(count, seed):
    r = random.Random(seed)
    for _ in range(count):
        n, k = r.randint(0, 80), r.choice([1, 2, 3, 6, 50])
        w = [r.randrange(k) for _ in range(n)]
        if n > 3 and r.random() < 0.6:
            a = r.randrange(n)
            p = r.randint(1, (n - a) // 4 + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] + [r.randrange(k) for _ in range(r.randint(0, 9))]
        yield w


def test_automaton_and_regions_find_all_runs():
    all_words = list(samples(1500, 3))
    texts = [" ".join(map(str, w)).encode() for w in all_words]
    for w, (_, together) in zip(all_words, periodic.runs_of_texts(texts)):
        assert periodic.find_runs(w) == together == brute(w)


def test_other_thresholds():
    for w in samples(200, 8):
        assert periodic.find_runs(w, 9, 5) == brute(w, 9, 5)
    with pytest.raises(ValueError):
        periodic.periodic_runs(None, power=3)


def test_long_block_and_long_prose():
    r = random.Random(1)
    block, prose = [r.randrange(900) for _ in range(3000)], [r.randrange(900) for _ in range(20_000)]
    assert periodic.find_runs(prose[:5000] + block * 4 + prose[5000:5010])[0][1:] >= (12_000, 3000)
    (_, found), (_, none) = periodic.runs_of_texts([" ".join(map(str, x)).encode() for x in (block * 4, prose)])
    assert found == [(0, 12_000, 3000)] and none == brute(prose[:400]) == []


def test_query(spark, tmp_path):
    r = random.Random(4)
    texts = [None, "", " \n\t ", "é" * 5, "x " * 40_000, "a b " * 30 + "c", "x\x1fy x\x0by" * 20]
    texts += [" ".join(map(str, w)) for w in samples(120, 6)] + [" ".join(r.choices("abcdef", k=r.randint(0, 200))) for _ in range(80)]
    rows = [*enumerate(texts), (5, texts[5]), (5, texts[5]), (None, "b b b b b b b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'z' AS runs", "2 AS h", "3 AS w", "4 AS n_words")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.queries()["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    want, planted = [], 0
    for i, t in rows:
        w = tailed(i, WORD.findall(t or ""))
        planted += w != WORD.findall(t or "")
        runs = brute(w) if len(w) < 5000 else [(0, len(w), 1)]
        gone = {x for s, n, p in runs for x in range(s + p, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, " ".join(x for j, x in enumerate(w) if j not in gone))]
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests))
    assert planted > 5 and got == sorted(want, key=repr)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_periodic_runs(spark, str(tmp_path)).collect() == []
