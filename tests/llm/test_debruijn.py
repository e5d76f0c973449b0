"""Repeated passages against plain windows and against SQL."""

import random
import re

import duckdb
import pytest

from tessella.llm import debruijn, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """(id, n_words, n_removed, kept) of each row, by the first place of each window."""
    first, texts = {}, [(debruijn.LAST if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, w in texts:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for (i, _), (o, w) in zip(rows, texts):
        gone = {x for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < (o, s) for x in range(s, s + window)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [r.choices(vocabulary, k=k) for k in (19, 20, 21, 35, 60, 150)]
    rows = []
    for i in r.sample(range(5 * n), n):
        w = r.choices(vocabulary, k=r.randint(0, 70))
        for _ in range(r.randint(0, 3)):
            p, at = r.choice(passages), r.randint(0, len(w))
            a = r.randrange(len(p))
            w[at:at] = r.choice([p, p[a:], p[:a], p + p])
        rows.append((i, " ".join(w)))
    rows += [(i + 5 * n, t) for i, t in rows[:20]]
    rows += [(i + 6 * n, t.replace("w7 ", "W7 ")) for i, t in rows[:20]]
    return rows


ODD = [(None, None), (-3, ""), (-2, " \n\t "), (-1, "one"), (9000, "a " * 30_000), (9001, "one " * 20), (9001, "one " * 25), (9001, "one " * 25), (None, "one " * 21), (None, "x\x1fy\x0bz " * 30), (9002, "é漢 " * 40 + "one " * 20)]


@pytest.mark.parametrize("frequent", [500, 10**9, 2])
def test_equals_plain_windows(spark, monkeypatch, frequent):
    monkeypatch.setattr(debruijn, "FREQUENT", frequent)
    monkeypatch.setattr(debruijn, "SAMPLE", 2)
    rows = corpus(frequent) + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS doc", "3 AS tag", "'k' AS kept").repartition(5)
    found = debruijn.remove_repeats(df).collect()
    assert sorted(map(lambda r: tuple(r)[:4], found), key=repr) == brute(rows)
    ids = [i for i, _ in rows]
    words = {i: WORD.findall(t or "") for i, t in rows if ids.count(i) == 1}
    for r in found:  # source coordinates hold the same words
        for s in r.spans if r.id in words else ():
            if s.source_id in words:  # an id of one text
                assert words[r.id][s.start : s.start + s.words] == words[s.source_id][s.source_start : s.source_start + s.words] and s.words >= 20


def test_false_sources_are_found_out_and_other_hashes_tried(spark, monkeypatch):
    rows = [(1, "p " + " ".join(f"w{i}" for i in range(30))), (2, "q r " + " ".join(f"w{i}" for i in range(30))), (3, " ".join(f"v{i}" for i in range(40)))]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "id AS doc", "xxhash64(text) AS tag", "CAST(text AS BINARY) AS text")
    tags = {r.id: r.tag for r in docs.collect()}
    for source, start, right in ((1, 1, True), (1, 0, False), (3, 1, False)):
        found = spark.createDataFrame([(2, tags[2], 2, 11, source, tags[source], start)], "doc long, tag long, start int, n int, source long, source_tag long, source_start int")
        assert debruijn._verified(debruijn._applied(docs, found, 20)) == right
    unsent = spark.createDataFrame([(2, tags[2], 2, 11, 99, 0, 1)], found.schema)  # a source that no document is
    assert not debruijn._verified(debruijn._applied(docs, unsent, 20))
    answers = iter([False, True])
    monkeypatch.setattr(debruijn, "_verified", lambda results: next(answers))
    rows = corpus(3, 60)
    found = debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == brute(rows) and not list(answers)


def test_other_windows(spark):
    rows = corpus(11, 50)
    found = debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=7, seed=3).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == brute(rows, 7)


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    got = sorted(map(tuple, queries.queries()["op12_substring_dedup"](spark, d).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op12_substring_dedup"]).fetchall())
    assert got == want and sum(r[2] for r in got) > 1000


def test_no_rows(spark):
    assert debruijn.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
