"""Recurring content that is no whole line: passages inside lines, and short lines."""

import corpus_pipeline

from tessella.llm import line_dedup

PASSAGE = "The quick brown fox of number 12 jumps over the dog. It then went home again with all of its friends! "
OWN = "abcdefghijklmnopqrstuvwxyz"


def test_line_dedup_finds_passages_and_short_lines(spark):
    n = 20  # line_dedup.SHORT_DOCS
    rows = [
        (1, "Alone here we have some words. " + PASSAGE + "An end that only document one has got."),
        (2, "two own lines\nQuite another start of a line. " + PASSAGE.replace("12", "7") + "Yes."),
        (3, PASSAGE.strip()),
        (4, "before\n" + PASSAGE.strip() + "\nafter"),
        (5, None), (6, ""), (7, "twice rare\ntwice rare"), (8, "twice rare"),
    ]
    rows += [(100 + i, f"All rights reserved.\nunlike{OWN[i]} text\nAll rights reserved.") for i in range(n)]
    rows += [(200 + i, f"Too few.\nlone{OWN[i]} text") for i in range(n - 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in corpus_pipeline.stage_line_dedup(spark, docs, "").collect()}
    source = dict(rows)
    same = [1, 5, 6, 7, 8, 100, *range(200, 200 + n - 1)]
    assert {i: got[i] for i in same} == {i: source[i] for i in same}
    assert got[2] == "two own lines\nQuite another start of a line. Yes." and 3 not in got and got[4] == "before\nafter"
    assert all(got[100 + i] == source[100 + i].split("\n")[1] for i in range(1, n))
    assert line_dedup.SHORT_DOCS == n


def test_texts_of_one_id(spark):
    rows = [(1, PASSAGE.strip(), True), (2, "a\nb\nLast words. " + PASSAGE.strip(), True), (2, "one line", True), (2, None, True), (2, "", True)]
    got = line_dedup.cut_passages(spark.createDataFrame(rows, "doc_id long, text string, kept boolean").repartition(3)).collect()
    assert {(r.doc_id, r.text, r.n_cut) for r in got} == {(1, PASSAGE.strip(), 0), (2, "a\nb\nLast words.", 2), (2, "one line", 0), (2, None, 0), (2, "", 0)}
    assert all(r.kept for r in got)


def test_columns_named_like_those_made_inside(spark):
    line = "one two three four five six seven"
    rows = [(1, line), (2, line + "\nanother line"), (3, None)]
    names = ["__gone", "__lines", "__id", "__text", "__row", "__cut", "__some", "__new", "__kept", "line", "keys", "id"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = df.selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate(names)])
    plain = {r.doc_id: r for r in line_dedup.cut_passages(line_dedup.clean(df)).collect()}
    for r in line_dedup.cut_passages(line_dedup.clean(extra)).collect():
        assert [r[c] for c in names] == list(range(len(names)))
        assert all(r[c] == plain[r.doc_id][c] for c in plain[r.doc_id].__fields__)


def test_cleaned_texts_are_made_once(spark):
    """A condition on kept must not make the text again below the projection that makes it."""
    text = "\n".join(f"the word {chr(97 + k)} stands in this line. and another sentence of six words. {k}" for k in range(26))
    df = spark.createDataFrame([(1, text), (2, text + "\nx"), (3, None), (4, "own words of this one document only.")], "doc_id long, text string")
    out = line_dedup.cut_passages(line_dedup.clean(df)).where("kept")
    shown = out._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("array_join(concat(flatten(") == 1 and "Generate explode(array(array_join(" in shown
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[2] == "x" and got[3] is None and got[4] == "own words of this one document only." and got[1].startswith("the word a stands")
