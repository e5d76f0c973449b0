"""The stored token index: same scores as a full index, pruned to the buckets of the terms; and nested grouped results."""

import random

from pyspark.sql import functions as F

from tessella.operators import grouping as G, textsearch as I


def test_stored_index_prunes_and_scores_alike(spark, tmp_path):
    r = random.Random(1)
    words = [f"word{i}x" for i in range(40)] + ["running", "runs"]
    rows = [(i, r.choice(["en", "de"]), " ".join(r.choices(words, k=r.randint(0, 30)))) for i in range(80)] + [(3, "en", "runs again"), (99, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    full, path = I.build_token_index(docs, folded=False), str(tmp_path / "index")
    I.write_token_index(docs, path, buckets=8, folded=False)
    rounded = lambda df: sorted((x.doc_id, x.lang, round(x.score, 9)) for x in df.collect())
    for terms in (["word3x"], ["runn", "run", "word1x"], ["nothing"]):
        postings, lengths, totals = I.read_token_index(spark, path, terms)
        want = rounded(I.bm25(full, terms))
        assert rounded(I.bm25(postings, terms, lengths, totals)) == want
        assert rounded(I.bm25(I.build_token_index(docs, folded=False, terms=terms), terms, I.text_lengths(docs))) == want
        plan = postings._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert postings.select(F.input_file_name().alias("f")).distinct().count() <= len(terms)
    everything, _, _ = I.read_token_index(spark, path)
    assert sorted(map(repr, everything.select(full.columns).collect())) == sorted(map(repr, full.collect()))


RECORD = "doc_id string, prop string, claim_type string, depth int, is_leaf boolean, to string"


def test_group_tree(spark):
    rec = [("a", "fr"), ("b", "eu"), ("c", "de"), ("d", "us"), ("e", "fr"), ("e", "us")]
    records = spark.createDataFrame([(d, "IN", "ref", 0, True, t) for d, t in rec], RECORD)
    docs = spark.createDataFrame([(d, s) for s, d in enumerate("abcdef")], "doc_id string, s int")
    labels = spark.createDataFrame([("eu", "europe"), ("fr", "France"), ("de", "allemagne"), ("us", "USA")], "id string, label string")
    paths = spark.createDataFrame([("fr", ["eu", "fr"]), ("de", ["eu", "de"]), ("eu", ["eu"])], "id string, id_path array<string>")
    show = lambda rows: [(r.doc_id, [(h.id, h.docs, h.first) for h in r.headings]) for r in sorted(rows.collect(), key=lambda r: r.position)]
    up = G.group_tree(docs, records, ["IN"], [F.asc("s")], labels, paths, 100)
    assert show(up) == [
        ("c", [("eu", None, True), ("de", 1, True)]), ("a", [("eu", None, False), ("fr", 2, True)]), ("e", [("eu", None, False), ("fr", 2, False)]),
        ("b", [("eu", 1, True)]), ("d", [("us", 2, True)]), ("e", [("us", 2, False)]), ("f", [(None, 1, True)]),
    ]
    assert not any(r.more for r in up.collect())
    down = G.group_tree(docs, records, ["IN"], [F.asc("s")], labels, paths, 4, [True])
    assert [x[0] for x in show(down)] == ["d", "e", "a", "e"] and all(r.more for r in down.collect())
    assert show(down)[2][1] == [("eu", None, True), ("fr", 2, True)]
    flat = G.group_tree(docs, records.limit(0), ["IN"], [F.asc("s")], labels)
    assert show(flat)[0] == ("a", [(None, 6, True)]) and len(show(flat)) == 6
