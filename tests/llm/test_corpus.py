"""Stages of the pipeline on null, repeated and empty rows, against plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from tallyline.llm import _text, cube_mix, quality_gam

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the stages use inside.
CLASH = ["row_hash", "total", "alike", "mix_id", "gone_id", "line_dedup", "id", "size", "bitmap_id", "own_row", "mix_total", "component_id", "y"]


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


TEXTS = [(1, words(0, 60)), (2, words(2, 62)), (2, words(300, 340)), (3, words(100, 160)), (3, words(100, 160)), (4, None), (5, ""), (None, words(1, 61)), (None, None), (6, words(200, 260)), (7, words(101, 161))]
ROWS = [(i, t, "en", "ab"[n % 2], len(t or "")) for n, (i, t) in enumerate(TEXTS)]


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_copies_against_plain_python(spark):
    sets, comp = [shingles(r[1]) for r in ROWS], list(range(len(ROWS)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                comp = [comp[i] if c == comp[j] else c for c in comp]
    least = {c: min((r[0] for r, d in zip(ROWS, comp) if d == c and r[0] is not None), default=None) for c in comp}
    gone = {r[0] for r, c in zip(ROWS, comp) if r[0] is not None and r[0] != least[c]}
    got = cp.drop_near_copies(spark, spark.createDataFrame(ROWS, DOC), "")
    assert gone == {2, 7}
    assert Counter(map(tuple, got.collect())) == Counter(r for r in ROWS if r[0] not in gone)
    assert cp.drop_near_copies(spark, spark.createDataFrame([], DOC), "").count() == 0


@pytest.mark.parametrize("most", (300_000, 0))
def test_mix_takes_each_row_as_often_as_drawn(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(cp, "BROADCAST_ROWS", most)
    monkeypatch.setattr(cube_mix, "RUN", 4)
    rows = ROWS + [(50, words(5, 9), "en", "a", i) for i in range(41)] + [(51, words(9, 12), "en", s, 0) for s in "abab"]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    drawn, size, target, taken = Counter(), Counter(), {}, Counter()
    for r in cube_mix.cube_mix(docs).collect():
        drawn[r["doc_id"], r["size"]] += r["copies"]
        target[r["source_size"]] = r["target"]
    out = cp.mix(spark, docs, "").collect()
    got = Counter((r["doc_id"], len((r["text"] or "").split())) for r in out)
    assert got == +drawn and got[50, 4] > 0
    each = Counter(r["n_chars"] for r in out if r["doc_id"] == 50)
    assert max(each.values()) - min([*each.values(), 0] if len(each) < 41 else each.values()) <= 1
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    for r in out:
        taken[r["source"]] += len((r["text"] or "").split())
    assert all(abs(taken[s] - target[size[s]]) <= 60 for s in size)


def test_lines_against_plain_python(spark):
    shared = "a line that many documents share"
    data = [(1, f"{shared}\nown words of the first one"), (2, shared), (2, shared), (3, f"  {shared.upper()}\t\n \n"), (4, f"x\n{shared}"), (5, None), (6, ""), (7, " \n"), (None, f"{shared}\nno id here, but words"), (8, "short\nshort"), (9, "short")]
    rows = [(i, t, "en", "a", len(t or "") + 7) for i, t in data]
    first = defaultdict(lambda: (2, 0))
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\f\r").lower()
            first[key] = min(first[key], (i is None, i))
    want = Counter()
    for i, t, lang, source, n in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(k := x.strip(" \t\n\x0b\f\r").lower()) < 10 or first[k] == (i is None, i)]
        if len(kept) == len(ls):
            want[i, t, lang, source, n] += 1
        elif "".join(kept).strip():
            want[i, "\n".join(kept), lang, source, len("\n".join(kept))] += 1
    assert Counter(map(tuple, cp.drop_lines(spark, spark.createDataFrame(rows, DOC), "").collect())) == want
    assert {k[0] for k in want} == {1, 4, 5, 6, 7, 8, 9, None}
    bare = cp.drop_lines(spark, spark.createDataFrame(rows, DOC).drop("n_chars"), "")
    assert bare.columns == ["doc_id", "text", "lang", "source"] and bare.count() == sum(want.values())
    assert cp.drop_lines(spark, spark.createDataFrame([], DOC), "").count() == 0


def plain_score(model, text):
    """The additive score by one lookup a table, a row at a time."""
    x = quality_gam.features(*_text.raw(_text.pa.array([text or ""])))[0]
    bin_ = lambda edges, v: sum(v >= e for e in edges)
    f = model.base + sum(t[bin_(e, v)] for e, t, v in zip(model.edges, model.tables, x))
    f += sum(t[bin_(model.pair_edges[i], x[i]), bin_(model.pair_edges[j], x[j])] for (i, j), t in zip(model.pairs, model.pair_tables))
    return 1 / (1 + np.exp(-f))


def test_classify_against_plain_additions(spark, tmp_path):
    rnd = random.Random(5)
    good = lambda: " ".join(f"{rnd.choice('bcdf')}a{rnd.choice('lmnr')}e" for _ in range(rnd.randrange(30, 90)))
    bad = lambda: " ".join(rnd.choice(["###", "BUY!!", "|", "$$$ x"]) for _ in range(rnd.randrange(5, 60)))
    rows = [(i, good() if i % 2 else bad(), None, None, None) for i in range(300)]
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, good(), None, None, None), (1, rows[1][1], None, None, None)]
    spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, None), (None, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, DOC)
    model = quality_gam.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert model.pairs
    want = Counter(r for r in rows if plain_score(model, r[1]) >= 0.7)
    got = Counter(map(tuple, cp.classify(spark, docs, str(tmp_path)).collect()))
    assert got == want and got[rows[1]] == 2 and len({sum(r[0] == i for r in got) for i in (900, 901)}) == 1
    scores = {(r["doc_id"], round(r["score"], 9)) for r in quality_gam.score(docs, model).collect()}
    assert scores == {(r[0], round(plain_score(model, r[1]), 9)) for r in rows}
    assert cp.classify(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pack_keeps_every_row(spark):
    docs = spark.createDataFrame([*ROWS, ROWS[0]], DOC)
    got = cp.pack(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in [*ROWS, ROWS[0]])
    assert cp.pack(spark, docs.limit(0), "").count() == 0


def test_stages_take_any_further_columns(spark, tmp_path):
    """Columns of names used inside come through each stage that returns documents."""
    spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = DOC + "".join(f", {c} string" for c in CLASH)
    spark.createDataFrame([(*r, *CLASH) for r in ROWS], schema).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    for name, function in cp.STAGES[:-1]:
        out = function(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert all([r[c] for c in CLASH] == CLASH for r in out.collect()), name
    assert cp.pack(spark, docs, "").count() == len(ROWS)
