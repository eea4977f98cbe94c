"""Rows of null and repeated ids, and many sources."""

import random

from tallyline.llm import cube_mix, ngram_join


def words(*spans):
    return " ".join(f"w{i}" for a, b in spans for i in range(a, b))


def comps(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()), key=repr)


def test_one_id_stands_for_two_sets(spark):
    rows = [(1, words((0, 100))), (1, words((500, 600))), (2, words((5, 105))), (3, words((505, 605))), (4, words((900, 960)))]
    assert comps(spark, rows) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_a_row_without_an_id_ties_others(spark):
    rows = [(5, words((0, 100))), (None, words((10, 110))), (6, words((20, 120))), (None, words((700, 800))), (None, words((705, 805))), (None, None)]
    assert comps(spark, rows) == sorted([(5, 5), (None, 5), (6, 5), (None, None), (None, None), (None, None)], key=repr)


def test_many_sources_beside_a_hot_one(spark, monkeypatch):
    """Each source lands in one block, so its documents and words come near their shares."""
    monkeypatch.setattr(cube_mix, "BLOCK", 8)
    rnd = random.Random(3)
    rows = [(s * 1000 + i, f"s{s:03}", "x " * rnd.randrange(1, 40)) for s in range(501) for i in range(40 if s else 800)]
    got = {}
    for r in cube_mix.cube_mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect():
        got.setdefault(r["doc_id"] // 1000, []).append(r)
    assert len(got) == 501
    for one in got.values():
        ratio = one[0]["target"] / one[0]["source_size"]
        assert abs(sum(r["copies"] for r in one) - ratio * len(one)) < 2
        assert abs(sum(r["taken"] for r in one) - one[0]["target"]) < 40
