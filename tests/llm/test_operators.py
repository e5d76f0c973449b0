"""Each operator against a brute-force version, a round trip or held-out accuracy, and on odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessella.llm import blocks, bpe, decontaminate, kneser_ney, language, line_dedup, lm_score, near_dup, quality, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "a " * 30_000), (5, "one"), (5, "one"), (6, "é漢😀 ' ‍")]


def odd(spark, extra=True):
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "s") for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 AS n", "2 AS id", "3 AS label", "4 AS kept", "5 AS score") if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(1, 6))) for _ in range(150)]
    out = [" ".join(r.choices(vocabulary, k=r.randint(1, 120))) for _ in range(60)]
    for i in range(30):
        w = r.choice(out[:60]).split(" ")
        for _ in range(max(0, len(w) // 25)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    return [*out, *out[:5]]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_bpe_equals_tiktoken(spark, texts):
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    more = ["".join(r.choices("ab é漢😀\n\t .'s12", k=r.randint(0, 80))) for _ in range(60)]
    all_texts = [*texts, *more, "x" * 3000, ""]
    got = {x.doc_id: x for x in bpe.digests(frame(spark, all_texts), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(all_texts):
        ids = np.array(encoding.encode_ordinary(t), "<u4").tobytes()
        assert got[i].n_tokens == len(ids) // 4 and got[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_full_state_table_gives_the_same():
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    small, large = bpe.Transducer(ranks, max_states=5), bpe.Transducer(ranks)
    for w in (b"tokenization", b"aaaaaaaab", "naïveté".encode(), bytes(range(200, 256))):
        assert small.encode(w) == large.encode(w) == large.merged(w)


def test_streaming_decoder_in_pieces():
    codec = bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    ids = codec.encode("é漢😀 text 漢字" * 20)
    assert codec.decode(ids, chunk=1) == codec.decode(ids) == ("é漢😀 text 漢字" * 20).encode()


def brute_measures(t):
    w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, texts):
    r = random.Random(2)
    more = ["\n".join(" ".join(r.choices("ab#", k=r.randint(0, 6))) for _ in range(r.randint(0, 8))) for _ in range(80)]
    for df in (frame(spark, [*texts, *more]), odd(spark, False).select("doc_id", "text")):
        source = {x.doc_id: x.text for x in df.collect()}
        for x in quality.measures(df).collect():
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_measures(source[x.doc_id])


def test_quality_fences_follow_the_source(spark):
    """Texts of 100 words; a text with symbols in 150 of 1,000 words is usual in one source and not in the other."""
    r = random.Random(6)
    row = lambda i, source, marked: (i, " ".join(f"w{j}" + "#" * (j <= marked) for j in r.sample(range(1, 9_000), 9) + list(range(1, 92))), "en", source)
    rows = [row(i, "plain", i % 4) for i in range(200)] + [row(i, "code", 15 + i % 20) for i in range(200, 400)] + [row(400, "plain", 15), row(401, "code", 15), row(402, "plain", 3), row(403, "code", 90), row(404, "few", 3), row(405, "few", 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {x.doc_id: x.kept for x in quality.judge(df).collect()}
    assert [got[i] for i in range(400, 406)] == [False, True, True, False, True, False]
    stats = quality.measures(df).withColumn("base_failed", quality.base_failed())
    assert {x.source: x.own_symbols for x in quality.thresholds(stats).collect()} == {"plain": "source", "code": "source", "few": "language"}


def test_warc_round_trip(spark):
    long = "WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 5\r\n" * 9
    pages = [(1, "u", long), (2, None, long), (3, "a\r\nb", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (0, "u", "é" * 60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
    assert (got[2].record_type, got[2].refers_to) == ("revisit", 1) and {got[i].record_type for i in (0, 1, 3, 4, 5, 6)} == {"response"}
    assert got[2].request.uri == "about:blank" and got[1].response.record_id != got[2].response.record_id and got[3].metadata.page_id == 3
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_odd_page_ids(spark):
    x, y = "x" * 120, "y" * 130
    pages = [(None, "u", "b"), (2, "u", x), (2, "u", y), (3, "u", y), (None, "u", y), (4, "u", "z" * 100), (4, "u", "z" * 100), (-1, "u", "w" * 100), (5, "u", "w" * 100)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string"), payloads=True).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [
        (None, digest("b"), 1, "response", None), (2, digest(x), 120, "response", None), (2, digest(y), 130, "response", None), (3, digest(y), 130, "revisit", 2), (None, digest(y), 130, "revisit", 2),
        *[(4, digest("z" * 100), 100, "response", None)] * 2, (-1, digest("w" * 100), 100, "response", None), (5, digest("w" * 100), 100, "revisit", -1),
    ]
    rows = [(r.page_id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in got]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert all(hashlib.sha256(r.response.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_score(spark, texts, order):
    got = {r.id: r for r in lm_score.score(frame(spark, texts), order=order).collect()}
    words = [WORD.findall(t.lower()) for t in texts]
    grams = lambda w: [tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]
    corpus = collections.Counter(g for w in words for g in grams(w))
    for i, w in enumerate(words):
        own, n, log = collections.Counter(grams(w)), sum(map(len, words)) - len(w), 0.0
        left = lambda g: corpus[g] - own[g]
        for j in range(len(w)):
            factor = 1.0
            for k in range(min(order, j + 1), 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                if left(g) > 0:
                    log += math.log(factor * left(g) / (left(g[:-1]) if k > 1 else n))
                    break
                factor *= lm_score.BACKOFF
            else:
                log += math.log(factor / lm_score.BACKOFF / (n + 1))
        assert got[i].log_score == pytest.approx(log) and got[i].n_words == len(w)


def test_keys_of_a_block_survive_packing():
    r = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 9), (5, 9), (500, 2**64 - 1), (500, 2**40)):
        keys = np.unique(r.integers(0, top, n, np.uint64))
        assert (blocks.unpacked(blocks.packed(keys)) == keys).all()


@pytest.mark.parametrize("size", [2, 5])
def test_near_dup_groups(spark, texts, size):
    sets = []
    for t in [*texts, None, "", "one", "one"]:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.id: r for r in near_dup.groups(frame(spark, [*texts, None, "", "one", "one"]), size=size).collect()}
    assert [got[i].component_id for i in range(len(sets))] == label
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]


def test_register_estimate():
    r = np.random.default_rng(3)
    items = r.integers(0, 2**63, 3000, np.uint64)
    a, b = near_dup.registers(items[:2700]), near_dup.registers(items[300:])
    assert near_dup.likely(a[None], b[None], np.array([2700.0]), np.array([2700.0]))[0] == pytest.approx(2400 / 3000, abs=0.12)
    assert (np.maximum(a, b) == near_dup.registers(items)).all()


def test_kneser_ney_sums_to_one(spark):
    rows = spark.createDataFrame([(b"abracadabra abra",), (b"banana band",)], "t binary")
    known, unseen = kneser_ney.model(rows)
    table = {(r.k, r.gram): (r.p, r.gamma) for r in known.collect()}

    def p(context, byte):
        out = unseen
        for k in range(1, kneser_ney.ORDER + 1):
            ctx = context[len(context) - k + 1 :] if k > 1 else b""
            gram = int.from_bytes(ctx + bytes([byte]), "big")
            if k > 1:
                out *= table.get((k - 1, int.from_bytes(ctx, "big")), (0, 1.0))[1]
            out = table[k, gram][0] if table.get((k, gram), (0, 0))[0] > 0 else out
        return out

    for context in (b"abr", b"ban", b"xyz", b"\n\n\n"):
        assert sum(p(context, b) for b in range(256)) == pytest.approx(1)


def test_language_and_toxicity_held_out(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    train, held = docs.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 2"), docs.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2")
    found = language.identify(held.select("doc_id", "text", "lang"), language.learn(train)).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    scored = toxicity.fit(docs, labels.where("doc_id % 5 > 0")).score(docs.select("doc_id", "text")).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in scored) >= 0.9 * len(scored)


def test_line_templates(spark):
    line = "error in block {} of the disk number seven while the reader was still busy with it"
    df = spark.createDataFrame([(1, line.format("x1") + "\nown text"), (2, "mine\n" + line.format("x22")), (3, line.format("y3")), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.clean(df).collect()}
    assert got[1].text == line.format("x1") + "\nown text" and got[2].text == "mine" and not got[3].kept and got[4].text is None and got[5].kept


def test_captures_of_one_page_under_two_urls(spark):
    h = "x" * 200
    rows = [(1, "http://a/", h), (1, "http://b/", h), (2, "http://c/", h), (2, "http://c/", h), (1, "http://a/", "y"), (None, "http://d/", h)]
    found = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.response.uri, r.request.uri, r.record_type, r.refers_to, r.payload_bytes) for r in found) == [
        (0, "http://d/", "http://d/", "revisit", 1, 200), (1, "http://a/", "http://a/", "response", None, 1), (1, "http://a/", "http://a/", "response", None, 200),
        (1, "http://b/", "http://b/", "response", None, 200), (2, "http://c/", "http://c/", "revisit", 1, 200), (2, "http://c/", "http://c/", "revisit", 1, 200),
    ]


def test_decontamination(spark, texts):
    r = random.Random(4)
    item = " ".join("".join(r.choices("klmnopqrst", k=5)) for _ in range(40))
    near = list(item)
    for i in r.sample(range(len(near)), len(item) * decontaminate.PERCENT // 100):
        near[i] = "z"
    docs = frame(spark, [*texts, "before " + item.upper() + " after", "x " + "".join(near) + " y", item[: len(item) // 2]])
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.matches(docs, items).collect()) == [len(texts), len(texts) + 1]


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    runs = [
        lambda d: bpe.digests(d, RANKS, public_tokenizers.PATTERN), quality.judge, lm_score.score, lambda d: near_dup.groups(d, size=2), lambda d: kneser_ney.classify(d, labels),
        line_dedup.clean, lambda d: language.identify(d, language.learn(d)), lambda d: toxicity.fit(d, labels).score(d),
    ]
    for run in runs:
        assert len(run(odd(spark)).collect()) == len(ODD)
        assert run(empty(spark)).collect() == []
    assert decontaminate.matches(odd(spark), items).collect() == [] and decontaminate.matches(empty(spark), items.limit(0)).collect() == []
