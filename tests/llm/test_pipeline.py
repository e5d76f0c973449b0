"""The pipeline's stages, each on its own input, against plain Python on planted cases, odd rows and clashing columns."""

import collections
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

from tessella.llm import bpe, line_dedup, toxicity

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["score", "predicted", "kept", "n_lines", "n_dropped", "n_cut", "id", "label", "__gone", "distance", "item_id"]


def words(r, n, letters="abcdefghij"):
    return " ".join("".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """(folder, docs, rows): documents with toxic texts, shared lines and passages, near copies, benchmark items and odd rows."""
    r = random.Random(12)
    bad, line, passage = ["vileword", "nastyterm", "cruelname"], words(r, 9), words(r, 55).capitalize() + "."
    items = [words(r, 30, "lmnopqrst") for _ in range(4)]
    texts = [words(r, r.randint(40, 80)) for _ in range(60)]
    texts += [" ".join(w if r.random() > 0.25 else r.choice(bad) for w in words(r, 60).split()) for _ in range(30)]
    texts += [f"{words(r, 20)}\n{line}\n{words(r, 20)}" for _ in range(4)] + [f"{words(r, 12).capitalize()}. {passage} {words(r, 12).capitalize()}." for _ in range(4)]
    texts += [" ".join(t.split()[:-1] + ["changed"]) for t in texts[:6]] + texts[6:9]
    texts += [f"{words(r, 10)} {t} {words(r, 10)}" for t in items] + [f"{words(r, 10)} {t.replace('l', 'z', 3)} {words(r, 10)}" for t in items]
    texts += [None, "", " \n\t ", "one", "one", "é漢😀 ' ‍", "w " * 20_000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, words(r, 50), None, None, None), (7, "another text of the same id " + words(r, 30), "en", "s", 9)]
    at = tmp_path_factory.mktemp("tables")
    pq.write_table(pa.table({"item_id": range(5), "text": [*items, None]}), at / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": range(90), "quality": [1] * 90, "toxic": [0] * 60 + [1] * 30}), at / "labels.parquet")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'own' AS `{c}`" for c in CLASH], "1 AS `a.b`")
    df.repartition(3).write.parquet(str(at / "documents.parquet"))
    return str(at), spark.read.parquet(str(at / "documents.parquet")), rows


def result(out, docs):
    """(doc_id, text) of what a stage keeps; its columns are those of docs, untouched."""
    assert out.columns == docs.columns
    got = out.collect()
    assert all(x[c] == "own" for x in got for c in CLASH) and all(x["a.b"] == 1 for x in got)
    return collections.Counter((x.doc_id, x.text) for x in got)


def test_toxicity(spark, planted):
    at, docs, rows = planted
    got = result(corpus_pipeline.stage_toxicity(spark, docs, at), docs)
    scored = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{at}/labels.parquet")).score(docs.selectExpr("doc_id", "text", "text AS t"), "t")
    assert got == collections.Counter((x.doc_id, x.text) for x in scored.collect() if x.predicted == 0)
    assert not {i for i, _ in got} & set(range(60, 90)) and {i for i, _ in got} >= {None, *range(60), *range(90, len(rows) - 2)}


def test_line_dedup(spark, planted):
    at, docs, rows = planted
    tokens = lambda s: WORD.findall(re.sub("[0-9]+", "<*>", s))

    def templates(line):
        m = tokens(line)
        n = len(m)
        if n < 6:
            return set()
        a, b = 2 + (n - 2) // 3, 2 + 2 * (n - 2) // 3
        h, r1, r2, r3 = (tuple(m[x:y]) for x, y in ((0, 2), (2, a), (a, b), (b, n)))
        return {(n, 0, h, r1, r2, r3)} | ({(n, 1, h, r2, r3), (n, 2, h, r1, r3), (n, 3, h, r1, r2)} if n >= 12 else set())

    owners = collections.defaultdict(set)
    for i, t, *_ in rows:
        for k in [k for x in (t or "").split("\n") for k in templates(x)] if i is not None else ():
            owners[k].add(i)
    texts, keep = [], []
    for i, t, *_ in rows:
        left = [x for x in (t or "").split("\n") if i is None or all(min(owners[k]) >= i for k in templates(x))]
        texts.append(t if t is None or len(left) == len(t.split("\n")) else "\n".join(left))
        keep.append(t is None or len(left) == len(t.split("\n")) or bool(WORD.search(texts[-1])))
    parts = lambda x: re.split(line_dedup.CUT, x)
    owners, short = collections.defaultdict(set), collections.defaultdict(set)
    for (i, *_), t in zip(rows, texts):
        for x in (t or "").split("\n") if i is not None else ():
            if len(tokens(x)) < 6:
                short[tuple(tokens(x))].add(i)
            for p in parts(x) if len(tokens(x)) >= 6 else ():
                owners[tuple(tokens(p))].add(i)
    want = collections.Counter()
    for (i, *_), t, ok in zip(rows, texts, keep):
        new = []
        for x in (t or "").split("\n"):
            m = tuple(tokens(x))
            if len(m) < 6:
                if not m or i is None or len(short[m]) < line_dedup.SHORT_DOCS or i == min(short[m]):
                    new.append(x)
                continue
            left = [p for p in parts(x) if i is None or len(tokens(p)) < 6 or i == min(owners[tuple(tokens(p))])]
            if len(left) == len(parts(x)):
                new.append(x)
            elif "".join(left).strip():
                new.append("".join(left) if left[-1] == parts(x)[-1] else "".join(left).rstrip(" "))
        done = t if t is None else "\n".join(new)
        if ok and (done == t or WORD.search(done)):
            want[i, done] += 1
    assert result(corpus_pipeline.stage_line_dedup(spark, docs, at), docs) == want


def test_near_dup(spark, planted):
    at, docs, rows = planted
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    near = lambda i, j: (rows[i][0] is not None and rows[i][0] == rows[j][0]) or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if near(i, j)]
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    least = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    want = collections.Counter((x[0], x[1]) for x, k in zip(rows, label) if x[0] is None or x[0] == least[k])
    assert result(corpus_pipeline.stage_near_dup(spark, docs, at), docs) == want and sum(want.values()) <= len(rows) - 9


def test_decontamination(spark, planted):
    at, docs, rows = planted
    got = result(corpus_pipeline.stage_decontaminate(spark, docs, at), docs)
    gone = collections.Counter((i, t) for i, t, *_ in rows) - got
    assert {i for i, _ in gone} == set(range(107, 115)) and sum(got.values()) == len(rows) - 8


def test_encoding(spark, planted):
    at, docs, rows = planted
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    got = corpus_pipeline.stage_encode(spark, docs, at).collect()
    want = [np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes() for _, t, *_ in rows]
    assert sorted((repr(x.doc_id), x.n_tokens, bytes(x.ids)) for x in got) == sorted((repr(r[0]), len(w) // 4, w) for r, w in zip(rows, want)) and all(x.round_trip for x in got)


def test_empty_documents(spark, planted):
    at, docs, _ = planted
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    done = corpus_pipeline.run(spark, DIR)
    assert done.where("NOT round_trip").count() == 0 and 0 < done.count() < docs.count()
