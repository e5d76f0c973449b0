"""Edit matching against the plain table of distances, and the decontamination query on planted cases."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from tessella.llm import decontaminate, queries
from tessella.llm.decontaminate import Items, Myers, plain


def table_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def edited(r, text, k):
    out = list(text)
    for _ in range(k):
        at = r.randrange(len(out))
        out[at : at + 1] = r.choice(["", "q", out[at] + "q"])
    return "".join(out)


def test_myers_equals_the_table():
    r = random.Random(8)
    for _ in range(600):
        p, t = "".join(r.choices("abc", k=r.randint(1, 90))), "".join(r.choices("abc", k=r.randint(0, 130)))
        assert Myers(p).distance(t) == table_distance(p, t)


def test_items_equal_the_table():
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 7)))
    for _ in range(60):
        items = [(i, " ".join(word() for _ in range(r.randint(3, 25)))) for i in range(4)]
        text = " ".join(" ".join(word() for _ in range(5)) + " " + edited(r, t, r.randint(0, max(1, len(t) // 9))) for _, t in items)
        budget = lambda t: len(plain(t)) * decontaminate.PERCENT // 100
        want = {i: d for i, t in items if (d := table_distance(plain(t), plain(text))) <= budget(t) and (budget(t) or f" {plain(t)} " in f" {plain(text)} ")}
        assert Items(items).find(text) == want


def test_short_items_are_whole_words():
    found = Items([(1, "cat"), (2, "B. C"), (3, "dog")]).find("Concatenate b c; dogs, hot-dog.")
    assert found == {2: 0, 3: 0} and Items([(1, "cat")]).find("cats cat") == {1: 0} and Items([(1, "cat")]).find("the cat") == {1: 0}


def test_item_blocks_and_ids_of_any_type(spark, monkeypatch):
    r = random.Random(10)
    item = lambda: " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(12))
    texts = [item() for _ in range(30)]
    items = spark.createDataFrame([(f"i{k % 29}", t) for k, t in enumerate(texts)] + [(None, "none " + texts[0])], "item_id string, text string")
    docs = spark.createDataFrame([(f"d{k}", "x y " + t) for k, t in enumerate(texts)] + [(None, texts[3]), ("n", None)], "doc_id string, text string")
    one = sorted(map(tuple, decontaminate.matches(docs, items).collect()), key=repr)
    assert ("d29", "i0", 0) in one and (None, "i3", 0) in one and ("d3", "i3", 0) in one and len(one) >= 31
    monkeypatch.setattr(decontaminate, "BLOCK", 500)
    assert sorted(map(tuple, decontaminate.matches(docs, items).collect()), key=repr) == one


def test_query_on_planted_cases(spark, tmp_path):
    r = random.Random(11)
    words = lambda n, letters: " ".join("".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(n))
    items = [words(40, "abcdefgh") for _ in range(5)]
    texts = [words(60, "klmnopqr") for _ in range(12)] + [f"{words(9, 'klmn')} {edited(r, t, len(t) * k // 100)} {words(9, 'klmn')}" for t in items for k in (0, 5, 7, 12, 20)]
    pq.write_table(pa.table({"item_id": range(5), "text": items}), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts, "lang": ["en"] * len(texts)}), tmp_path / "documents.parquet")
    want = [(d, i, k) for d, t in enumerate(texts) for i, p in enumerate(items) if (k := table_distance(plain(p), plain(t))) <= len(plain(p)) * 8 // 100]
    got = sorted(map(tuple, queries.queries()["op10_decontaminate"](spark, str(tmp_path)).collect()))
    assert got == sorted(want) and len(got) >= 10
