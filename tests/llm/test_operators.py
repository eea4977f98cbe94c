import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline.llm import _spark, chat, components, cube_mix, exact_dedup, langid, line_dedup, ngram_join, packing, quality_gam, queries, rule_ledger, warc
from tallyline.llm._spark import crc_fold

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, id string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def make(spark, texts, first=0):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(first + i, t, "en", "s", None, "k", "i", "z") for i, t in enumerate(texts)], DOCS)


EDGE = [None, "", " \t\n", "a", "A\nB\n\nA", "one two three", "One two THREE", "x " * 3000, "x " * 3000, "línea única aquí\nlínea única aquí", "LíNEA única aquí", "~0 </s>[INST] <|turn|> ﻿é😀"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 8))) for _ in range(300)]
    texts = list(EDGE)
    for _ in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 120))]
        texts.append(" ".join(w))
        for edits in range(rnd.randrange(4)):
            v = list(w)
            for _ in range(edits):
                v[rnd.randrange(len(v))] = rnd.choice(vocab)
            texts.append(" ".join(v))
    rnd.shuffle(texts)
    df = make(spark, texts)
    return df.unionByName(df.filter("doc_id = 3")).cache()  # one row repeated


def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 3 ----


@pytest.mark.parametrize("most", (500_000, 0))
def test_exact_dedup(docs, empty, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", most)
    monkeypatch.setattr(_spark, "KEYED_ROWS", most)
    monkeypatch.setattr(_spark, "HOT_SHARE", 20)
    got = exact_dedup.exact_dedup(docs, largest=True).collect()
    groups = defaultdict(list)
    for i, t in rows(docs):
        groups[lower(t)].append(i)
    want = Counter((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert Counter(map(tuple, got)) == want
    assert exact_dedup.exact_dedup(empty).count() == 0


# ---- 6 ----


@pytest.mark.parametrize("hot,most", ((1000, 200_000), (3, 0)))
def test_line_dedup(spark, docs, empty, monkeypatch, hot, most):
    monkeypatch.setattr(line_dedup, "hot_share", lambda _: hot)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)
    many = "\n".join(f"common line number {i % 90}" for i in range(200))
    df = docs.unionByName(make(spark, [many, "common line number 7  \nown text of this one", many + "\n"], 9000))
    got = line_dedup.apply_bitmaps(df.select("doc_id", "text"), line_dedup.line_bitmaps(df))
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    held = defaultdict(set)
    for i, t in rows(df):
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    want = Counter()
    for i, t in rows(df):
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        want[i, len(ls), len(ls) - len(kept), "\n".join(kept)] += 1
    assert Counter((r["doc_id"], *r["line_dedup"]) for r in got.collect()) == want
    assert line_dedup.line_bitmaps(empty).count() == 0


def test_line_dedup_stays_in_the_jvm(docs):
    plan = line_dedup.apply_bitmaps(docs.select("doc_id", "text"), line_dedup.line_bitmaps(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 8 ----


def test_chat_fold_and_round_trip(spark):
    log = [
        (1, 1, "a", "message", "user", "hi <|end|> ~1 </s>"),
        (1, 2, "b", "delta", "assistant", "wor"),
        (1, 3, "b", "delta", "assistant", "ng"),
        (1, 4, "b", "regenerate", "assistant", None),
        (1, 6, "b", "delta", "assistant", "t﻿"),
        (1, 5, "b", "delta", "assistant", "﻿righ"),
        (1, 7, "a", "edit", "user", "hello|>"),
        (1, 8, "c", "message", "assistant", "gone"),
        (1, 9, "c", "delete", "assistant", None),
        (1, 10, "d", "noise", "user", "no"),
        (2, 1, "x", "message", None, None),
    ]
    df = spark.createDataFrame(log, "conv bigint, seq bigint, msg string, kind string, role string, text string")
    out = chat.format_chats(df).select("conv", "n_turns", "formatted_chars", "formatted", chat.read_turns().alias("t"), chat.read_loss().alias("l"))
    got = {r["conv"]: r for r in out.collect()}
    assert [tuple(t) for t in got[1]["t"]] == [("user", "hello|>"), ("assistant", "﻿right﻿")]
    assert got[1]["l"] == ["﻿right﻿"] and got[1]["formatted_chars"] == len(got[1]["formatted"])
    assert [tuple(t) for t in got[2]["t"]] == [("", "")] and got[2]["l"] == []
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_chat_repeated_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "😀"), (1, 0, "user", "😀"), (None, None, None, None)], "conv_id bigint, turn int, role string, text string")
    got = chat.format_chats(chat.as_log(df)).select("conv", "n_turns").collect()
    assert {tuple(r) for r in got} == {(1, 2), (None, 1)}
    assert chat.format_chats(chat.as_log(df.limit(0))).count() == 0


# ---- 9 ----


def brute_components(docs, k, num, den):
    sets = {}
    for i, t in rows(docs):
        w = WORD.findall(lower(t))
        sets[i] = set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,num,block,shingles,most", ((3, 90, 2000, 4 << 20, 300_000), (5, 80, 2000, 4 << 20, 0), (3, 80, 3, 4 << 20, 300_000), (3, 80, 2000, 200, 0)))
def test_ngram_components(docs, monkeypatch, k, num, block, shingles, most):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(_spark, "KEYED_ROWS", 100_000 if most else 0)
    monkeypatch.setattr(_spark, "HOT_SHARE", 20)
    monkeypatch.setattr(ngram_join, "LEADERS", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", most)
    got = ngram_join.ngram_components(docs, words_a_shingle=k, num=num, den=100).collect()
    want = brute_components(docs, k, num, 100)
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_signatures_meet_for_every_linked_pair():
    rnd = np.random.default_rng(5)
    for num in (80, 90):
        for n in (5, 9, 10, 20, 47, 100, 400, 1500):
            for _ in range(12):
                a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
                drop = int(len(a) * (100 - num) / (100 + num))
                b = np.sort(np.append(a[drop:], rnd.integers(0, 2**63, drop).astype(np.uint64)))
                if not ngram_join._linked(a, b, num, 100):
                    continue
                few = np.sort(a[rnd.random(len(a)) < rnd.random()])
                sig, row, terms = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, 100, few)
                *_, shared, asked = ngram_join._pairs_of_runs(sig, row, terms)
                assert np.array_equal(a, b) or (shared >= asked).any()


def test_runs_of_any_length_connect_their_sets():
    sig = np.repeat(np.array([3, 9, 5], np.uint64), (2, ngram_join.RUN, ngram_join.RUN + 5))
    ref = np.concatenate([[4, 4], np.arange(ngram_join.RUN), 100 + np.arange(ngram_join.RUN + 5)])
    a, b, _, shared, asked = ngram_join._pairs_of_runs(sig, ref, np.full(len(sig), 2 << 2, np.uint8))
    short = b < 100
    assert short.sum() == ngram_join.RUN * (ngram_join.RUN - 1) // 2 and (shared[short] == 1).all() and (asked == 2).all()
    assert set(a[~short]) == {100} and (shared[~short] == ngram_join.ENOUGH).all() and (~short).sum() == ngram_join.RUN + 4


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


# ---- 7 ----


def fill(sizes, weights, goal, most=2):
    """Shares by weight, cut at most * size, the excess shared again."""
    out, free = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while free:
        left, total = goal - sum(out), sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] > most * sizes[i] * total}
        for i in full or free:
            out[i] = Fraction(most * sizes[i]) if full else left * weights[i] / total
        free -= full or free
    return out


def test_targets_of_any_number_of_sources(spark):
    rnd = random.Random(8)
    size = Counter()
    data = []
    for i in range(900):
        s = rnd.choice([None, *(f"s{j:03}" for j in range(120)), "\U0001F600", "\uffee"])
        n = rnd.choice([0, 1, 3, 30, 400 if s == "s001" else 2])
        size[s] += n
        data.append((i, " ".join(["w"] * n), "en", s, 0, "", "", ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], Fraction(3 * sum(size.values()), 2))))
    where = {r[0]: r[3] for r in data}
    taken = Counter()
    for r in cube_mix.cube_mix(spark.createDataFrame(data, DOCS)).collect():
        s = where[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(float(want[s]), rel=1e-12) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    longest = {s: max(len(r[1].split()) for r in data if r[3] == s) for s in names}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in names) and len({size[s] * 2 == want[s] for s in names}) == 2


def test_equal_rows_are_spread_and_share(spark, monkeypatch):
    """One row stands 5,000 times: its copies are shared evenly, run by run, and its source meets its target."""
    monkeypatch.setattr(cube_mix, "RUN", 64)
    data = [(1, "one two three", "en", "a", 0, "", "", "")] * 5000 + [(2 + i, "w " * (i % 9), "en", "ab"[i % 2], 0, "", "", "") for i in range(3000)]
    df = spark.createDataFrame(data, DOCS)
    got = cube_mix.cube_mix(df).collect()
    assert len(got) == len(data)
    hot = Counter(r["copies"] for r in got if r["doc_id"] == 1)
    assert max(hot) - min(hot) <= 1 and sum(hot.values()) == 5000
    by = {r["target"]: 0 for r in got}
    for r in got:
        by[r["target"]] += r["taken"]
    assert all(abs(t - x) <= 3 for t, x in by.items())


def test_cube_mix(spark, empty):
    rnd = random.Random(2)
    data = [(i, " ".join(["w"] * rnd.randrange(0, 40)) if i % 50 else None, "en", rnd.choice(["a", "a", "a", "b", "c", None]), 0, "", "", "") for i in range(6000)]
    df = spark.createDataFrame(data, DOCS)
    got = cube_mix.cube_mix(df).collect()
    assert len(got) == 6000
    size, taken, target = Counter(), Counter(), {}
    where = {r[0]: r[3] for r in data}
    for r in got:
        s = where[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1 and t <= 2 * size[s] + 1e-6
    again = cube_mix.cube_mix(df.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert cube_mix.cube_mix(empty).count() == 0


# ---- 10 ----


def test_tokens_and_packing(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    hard = ["x<|endoftext|>Y <|ENDOFTEXT|> <|startoftext|>", "don't. DON'T, it's' ÜBER… naïve—word. ×÷ a× b÷.", "123abc! a1b2. İ ΣΑΣ 日本語。", "w" * 5000, "word, " * 9000]
    df = docs.unionByName(make(spark, hard, 9000))
    ids, begin = packing._encode(path, *packing.raw(pa.array([t for _, t in rows(df)])))
    want = Counter()
    for k, (i, t) in enumerate(rows(df)):
        x = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert ids[begin[k] : begin[k + 1]].tolist() == x
        for p in range(0, len(x), 64):
            want[i, p // 64, p, len(x[p : p + 64]), zlib.crc32(np.array(x[p : p + 64], "<u4").tobytes())] += 1
    got = packing.best_fit_pack(df, path, capacity=64).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 64
    assert len(at) <= 1.1 * sum(r["length"] for r in got) / 64 + 3
    assert packing.best_fit_pack(empty, path).count() == 0


@pytest.mark.parametrize("name", ("word_bpe_49k.json", "byte_bpe_50k.json"))
def test_ids_of_any_tokenizer(docs, name):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path(name)
    assert packing.by_words(path) == name.startswith("word")
    tok = tokenizers.Tokenizer.from_file(path)
    texts = [t or "" for _, t in rows(docs)] + ["Don't  STOP\n<|endoftext|>x"]
    ids, begin = packing._encode(path, *packing.raw(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]


# ---- 4 ----


@pytest.mark.parametrize("most,segment", ((200_000, 2048), (0, 64)))
def test_warc_round_trip(spark, monkeypatch, most, segment):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    monkeypatch.setattr(_spark, "KEYED_ROWS", most)
    monkeypatch.setattr(warc, "SEGMENT_BYTES", segment)
    big, mid = "é<p>\r\n\r\nWARC/1.1\r\n" * 12_000, "b" * 1500
    data = [(1, "http://a", big), (2, None, big), (3, "u\n x", mid), (4, "u", mid), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (9, "u", "c" * 70_000), (9, "u", "c" * 70_000)]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string").withColumn("keep", F.lit(1)).withColumn("id", F.lit("x"))
    got = warc.archive_round_trip(df).collect()
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in data) and all(r["complete"] for r in got)
    text = {i: (h or "").encode() for i, _, h in data}
    for r in got:
        b = text[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), hashlib.sha1(b).hexdigest())
        assert (r["type"], r["refers_to_page"]) == (("revisit", r["page_id"] + 1) if r["page_id"] in (1, 3) else ("response", None))
        assert r["payload"] == (None if r["type"] == "revisit" else b)
    plan = warc.archive_round_trip(df)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning|Exchange rangepartitioning", plan)) == 1
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_each_record_is_a_gzip_member(spark, tmp_path):
    data = [(i, f"http://{i}", f"<p>{i}</p>" * 900) for i in range(40)]
    warc.write_warc(spark.createDataFrame(data, "page_id bigint, url string, html string"), str(tmp_path / "w"))
    kinds = Counter()
    for f in (tmp_path / "w").glob("part-*"):
        rest = f.read_bytes()
        assert rest.startswith(b"\x1f\x8b")
        while rest:
            d = zlib.decompressobj(31)
            one = d.decompress(rest)
            assert d.eof and one.count(b"WARC/1.1\r\n") == (1 if one else 0) and (not one or one.endswith(b"\r\n\r\n"))
            kinds[re.search(rb"WARC-Type: (\w+)", one)[1].decode() if one else ""] += 1
            rest = d.unused_data
    assert kinds["response"] == 40 and kinds["continuation"] >= 80 and kinds["warcinfo"] == kinds[""] > 0


def test_warc_rejects_what_is_cut(spark):
    recs = [("r1", "response", "r1", 1, None, None, None, b"HTTP/1.1 200 OK\r\n\r\nab", 1), ("r1:3", "continuation", "r1", 3, 99, None, None, b"cd", 1)]
    df = spark.createDataFrame(recs, "record_id string, type string, origin string, segment int, total bigint, refers_to string, digest string, block binary, copies bigint")
    assert [r["complete"] for r in warc.reassemble(df).collect()] == [False]
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n")


# ---- 2 ----


def test_rule_measures(docs, empty):
    got = rule_ledger.measure(docs).collect()
    text = dict(rows(docs))
    for r in got:
        t = text[r["doc_id"]] or ""
        w = WORD.findall(t)
        win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        ls = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(cover))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
    kept = {r["doc_id"] for r in rule_ledger.apply_policy(rule_ledger.measure(docs), 1).filter("kept").collect()}
    assert all(len(WORD.findall(text[i] or "")) >= 20 for i in kept)
    abl = {r["rule"]: r for r in rule_ledger.ablations(rule_ledger.measure(docs), 1).collect()}
    assert abl["few_words"]["failed"] == sum(r["n_words"] < 20 for r in got)
    assert rule_ledger.measure(empty).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_policies_and_ablations_against_plain_python(spark, version):
    """Over every set of failed rules, one to three times each."""
    p = rule_ledger.POLICIES[version]
    names = [n for n, _ in rule_ledger.RULES]

    def kept(failed):
        return not failed & set(p.fatal) and len(failed & set(p.counted)) < p.most

    sets = {m: {n for i, n in enumerate(names) if m >> i & 1} for m in range(1 << len(names))}
    rows_ = [(m, m) for m in sets for _ in range(1 + m % 3)]
    ledger = spark.createDataFrame(rows_, "doc_id bigint, failures bigint")
    got = rule_ledger.apply_policy(ledger, version).collect()
    assert all(r["kept"] == kept(sets[r["failures"]]) for r in got)
    used = set(p.fatal) | set(p.counted)
    want = {
        n: (sum(n in sets[m] for m, _ in rows_), sum(not kept(sets[m]) and kept(sets[m] - {n}) for m, _ in rows_))
        for n in used
    }
    abl = {r["rule"]: (r["failed"], r["only_this"]) for r in rule_ledger.ablations(ledger, version).collect()}
    assert abl == want and any(n for _, n in want.values())


# ---- 5 and 1, on held-out rows ----

SF = "/root/testdata/sf0.01"


def test_language_on_held_out(spark, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(d.filter(crc_fold() != 2))
    got = langid.identify(d, model).join(d.select("doc_id", "lang", crc_fold().alias("fold")), "doc_id").filter("fold = 2 and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) > 100
    odd = make(spark, [None, "", "123 !!", "é"])
    assert [r["lang_pred"] == "und" for r in langid.identify(odd, model).orderBy("doc_id").collect()] == [True, True, True, False]
    assert all(0 <= r["score"] <= 1 for r in langid.identify(odd, model).collect())
    none = langid.fit(empty)
    assert [r["lang_pred"] for r in langid.identify(odd, none).collect()] == ["und"] * 4


def test_quality_on_held_out(spark, empty):
    out = queries.op1_quality_gam(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.93 * len(out) > 50
    model = quality_gam.train(empty, spark.createDataFrame([], "doc_id bigint, quality int"))
    got = quality_gam.score(make(spark, EDGE), model).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_gam.score(empty, model).count() == 0
