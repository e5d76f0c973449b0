"""Correlation of sub-filters, and histograms, on hand-made records."""

import pytest

from tessella.operators import facets as A, filters as P

SCHEMA = "doc_id string, claim_id string, parent_claim_id string, parent_prop string, depth int, collection string, claim_type string, prop string, to string, direct boolean, is_leaf boolean, unit string, lo double, hi double, hi_incl boolean, text string"


def location(doc, claim, to):
    return (doc, claim, None, None, 0, "rel", "ref", "location", to, True, True, None, None, None, None, None)


def artist(doc, claim, to="artistA"):
    return (doc, claim + "a", claim, "location", 1, "rel", "ref", "artist", to, True, True, None, None, None, None, None)


def period(doc, claim):
    return (doc, claim + "p", claim, "location", 1, "time", "time", "period", None, None, None, None, 1000.0, 2000.0, False, None)


ARTIST, PERIOD = P.to("artist", "artistA", parent="location"), P.time("period", 1200, 1800, parent="location")


def run(spark, rows, filters):
    records = spark.createDataFrame(rows, SCHEMA)
    return sorted(r.doc_id for r in P.apply_filters(records.select("doc_id"), records, filters).collect())


def test_both_on_one_claim(spark):
    rows = [location("split", "1", "v1"), artist("split", "1"), location("split", "2", "v2"), period("split", "2"), location("same", "3", "v1"), artist("same", "3"), period("same", "3")]
    assert run(spark, rows, [ARTIST, PERIOD]) == ["same"]


def test_top_selection_narrows(spark):
    rows = [location("two", "1", "v"), artist("two", "1"), location("two", "2", "v"), period("two", "2"), location("one", "3", "v"), artist("one", "3"), period("one", "3")]
    assert run(spark, rows, [P.to("location", "v"), ARTIST, PERIOD]) == ["one"]


def test_both_missing_on_one_claim(spark):
    rows = [location("bare", "1", "v1"), artist("bare", "1"), period("bare", "1"), location("bare", "2", "v2"), location("comp", "3", "v1"), artist("comp", "3"), location("comp", "4", "v2"), period("comp", "4")]
    assert run(spark, rows, [P.missing("artist", parent="location"), P.missing("period", parent="location")]) == ["bare"]


def test_missing_with_and_without_siblings(spark):
    rows = [location("shift", "1", "v1"), artist("shift", "1"), period("shift", "1"), location("shift", "2", "v2"), period("shift", "2")]
    assert run(spark, rows, [PERIOD, P.missing("artist", parent="location")]) == ["shift"]
    assert run(spark, rows, [P.missing("artist", parent="location")]) == []


def amount(doc, v):
    return (doc, doc, None, None, 0, "amount", "amount", "size", None, None, None, None, v - 0.5, v + 0.5, False, None)


def test_histogram(spark):
    records = spark.createDataFrame([amount("a", 0.0), amount("b", 1.0), amount("c", 100.0)], SCHEMA)
    bins = {r.bin: (r.lo, r.docs) for r in A.histogram(records, "size").collect()}
    assert len(bins) == 100 and sum(n for _, n in bins.values()) == 4
    assert bins[0] == (-0.5, 2) and bins[1][1] == 1 and bins[99][1] == 1
    assert bins[1][0] == pytest.approx(0.51) and bins[99][0] == pytest.approx(99.49)


def test_no_values(spark):
    assert A.histogram(spark.createDataFrame([], SCHEMA), "size").count() == 0
