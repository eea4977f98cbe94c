"""Passages that many sets share make no candidates, lose no link, and leave no tables behind."""

import os
import random

import numpy as np

from tallyline.llm import ngram_join


def test_linked_pairs_meet_whatever_is_hot():
    rnd = np.random.default_rng(6)
    for num in (80, 90):
        for n in (1, 5, 9, 20, 47, 100, 400, 1500):
            for _ in range(12):
                a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
                drop = int(len(a) * (100 - num) / (100 + num))
                b = np.sort(np.append(a[drop:], rnd.integers(0, 2**63, drop).astype(np.uint64)))
                if np.array_equal(a, b) or not ngram_join._linked(a, b, num, 100):
                    continue
                few = np.sort(a[rnd.random(len(a)) < rnd.random() ** 4])
                hot = np.packbits(rnd.random(1 << 15) < rnd.random())
                sig, row, terms = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, 100, few, hot)
                *_, shared, asked = ngram_join._pairs_of_runs(sig, row, terms)
                assert (shared >= asked).any(), (num, n)


def test_a_passage_of_many_documents_makes_no_candidates(spark, monkeypatch):
    """No shingle counts as frequent here, so the passage stands in signatures."""
    rnd = random.Random(8)
    own = lambda n: " ".join(f"{rnd.getrandbits(40):x}" for _ in range(n))
    passage = own(25)
    rows = [(i, f"{own(150)} {passage} {own(150)}") for i in range(400)]
    rows.append((400, f"{rows[7][1]} and two"))
    seen, plain = {}, ngram_join.stage

    def counted(df, label):
        out = plain(df, label)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "FREQUENT", 2.0)
    monkeypatch.setattr(ngram_join, "stage", counted)
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 7 if i == 400 else i for i in range(401)}
    assert seen["members"] == 2, seen
    assert not {x.split("-")[0] for x in set(os.listdir(shared)) - before} & {"hashes", "members"}


def test_the_most_common_signatures_fit_the_bitmap(spark, monkeypatch):
    often = spark.createDataFrame([(3 + 40_000 * i, m) for i, m in enumerate([9] * 20 + [100] * 5 + [900] * 2)], "sig bigint, m bigint")
    sigs = np.array([3 + 40_000 * i for i in range(27)], np.uint64)
    assert ngram_join._is_hot(sigs, ngram_join._bitmap(often)).all()
    monkeypatch.setattr(ngram_join, "HOT_MOST", 8)
    some = ngram_join._is_hot(sigs, ngram_join._bitmap(often))
    assert some[20:].all() and not some[:20].any()
    assert not ngram_join._is_hot(sigs, ngram_join._bitmap(often.limit(0))).any()
