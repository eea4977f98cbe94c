import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyline.functions import scalars as sc
from tallyline.functions.cursor import Cursor
from tallyline.operators import events as ev, fees, ledgers as lg, state as st, transactions as tx
from tallyline.operators.events import EventFilter
from tallyline.plans import requests as rq
from tallyline.plans.errors import InvalidParams, InvalidRequest, NotFound
from tallyline.streaming import ingest

EV = "id string, pos bigint, event_index bigint, ledger_seq bigint, tx_index bigint, contract_id bigint, event_kind bigint, topics array<string>, n_topics int, topic1 string, topic2 string"


def events(spark, rows):
    """rows: (ledger, tx, contract, kind, topics)"""
    out = []
    for ledger, t, contract, kind, topics in rows:
        c = Cursor(ledger, t, 0, 0)
        out.append((str(c), c.pos(), 0, ledger, t, contract, kind, topics, len(topics), topics[0] if topics else None, topics[1] if len(topics) > 1 else None))
    return spark.createDataFrame(out, EV)


def ids(df):
    return [Cursor.parse(r["id"]).tx for r in df.orderBy("id").collect()]


def ledgers(spark, seqs):
    return spark.createDataFrame([(s, s * 25 + 100, 23) for s in seqs], "sequence bigint, close_time bigint, protocol_version int")


def test_cursor_round_trip_and_order():
    cs = [Cursor(random.randrange(2**31), random.randrange(2**20), random.randrange(2**12), random.randrange(2**31)) for _ in range(300)]
    assert [Cursor.parse(str(c)) for c in cs] == cs
    assert sorted(cs) == [Cursor.parse(x) for x in sorted(map(str, cs))]
    for bad in ("abc", "1", "1-x", "-1-0"):
        with pytest.raises(InvalidParams):
            Cursor.parse(bad)


def test_topic_patterns(spark):
    four = events(spark, [(1, i + 1, 1, 1, ["COUNTER", str(i), "x", "y"]) for i in range(10)])

    def find(*p):
        return ids(ev.matching(four, [EventFilter(topics=(p,))]))

    assert find("COUNTER", "4") == []
    assert find("**") == list(range(1, 11))
    assert find("COUNTER", "4", "**") == [5]
    assert find("COUNTER", "4", "*", "y") == [5]
    assert find("*", "*", "*") == []
    with pytest.raises(InvalidParams):
        ev.topic_pattern(("**", "a"))


def test_filters_do_not_starve_each_other(spark):
    df = events(spark, [(2, 1, 10, 1, ["COUNTER"]), (2, 2, 20, 1, ["TRANSFER"])])
    assert ids(ev.matching(df, [EventFilter(contracts=(10,)), EventFilter(topics=(("TRANSFER",),))])) == [1, 2]
    assert ids(ev.matching(df, [EventFilter(kinds=(0,)), EventFilter(contracts=(20,))])) == [2]
    assert ids(ev.matching(df, [EventFilter(contracts=(10,), topics=(("TRANSFER",),))])) == []


def test_pages_join_to_the_whole(spark):
    df = events(spark, [(1 + i // 20, i % 20 + 1, i % 3, 1, ["a"]) for i in range(180)])
    whole, got, after = [r["id"] for r in df.orderBy("id").collect()], [], None
    while True:
        page = [r["id"] for r in ev.page(df, after=after, limit=50).collect()]
        got += page
        if len(page) < 50:
            break
        after = rq.next_event_cursor(page, 50, 10)
    assert got == whole
    assert rq.next_event_cursor([], 50, 10) == str(Cursor.end_of(9))


def test_event_window():
    store = rq.LedgerRange(2, 2)
    for start in (1, 3):
        with pytest.raises(InvalidRequest, match="startLedger must be within the ledger range: 2 - 2"):
            rq.event_window(store, start)
    at, end = rq.event_window(rq.LedgerRange(1, 50_000), 5)
    assert (at.ledger, end) == (5, 10_005)
    at, _ = rq.event_window(rq.LedgerRange(1, 9), cursor=str(Cursor(5, 1, 0, 0)))
    assert at == Cursor(5, 1, 0, 1)


def test_stage_order(spark):
    rows = [(7, 1, 0, 0, s) for s in ("after_all", "before_all", "after_tx", None)] + [(7, 2, 0, 0, "after_all")]
    df = spark.createDataFrame(rows, "ledger_seq bigint, tx_index bigint, op_index bigint, ord bigint, stage string")
    got = ev.staged_ids(df).orderBy("id").select("stage", "event_index").collect()
    assert [tuple(r) for r in got] == [("before_all", 0), (None, 0), ("after_tx", 0), ("after_all", 0), ("after_all", 1)]


def test_ranges_gaps_and_trim(spark):
    df = ledgers(spark, range(1334, 1338))
    r = lg.range_of(df)
    assert (r.first, r.last, r.first_close) == (1334, 1337, 1334 * 25 + 100)
    with pytest.raises(InvalidRequest, match="DB is empty"):
        lg.range_of(ledgers(spark, []))
    holed = ledgers(spark, [100, 101, 102, 104, 105, 2000])
    assert [tuple(x) for x in lg.gaps(holed, 4).orderBy("gap_start").collect()] == [(103, 103), (106, 1999)]
    assert not lg.gap_check(holed, 100, 105).first()["gapless"]
    assert lg.gap_check(ledgers(spark, range(5)), 0, 9).first()["gapless"]
    assert tuple(lg.count_in_range(df, 1, 2).first()) == (0, 0, 0)
    kept = lg.trim(ledgers(spark, range(1, 13)), 12, 5)
    assert lg.range_of(kept).first == 8 and lg.trim(kept, 12, 5).count() == 5
    assert lg.trim(ledgers(spark, range(1, 12)), 11, 15).count() == 11
    assert lg.newest(df).first()["sequence"] == 1337
    with pytest.raises(NotFound):
        lg.one(df, 5)


def test_tiered_split(spark):
    cold, hot = ledgers(spark, range(2, 150)).withColumn("t", F.lit("c")), ledgers(spark, range(100, 201)).withColumn("t", F.lit("h"))
    for first, last, want in ((150, 151, "hh"), (50, 51, "cc"), (98, 102, "cchhh")):
        got = lg.tiered(cold, hot, 100, first, last).collect()
        assert [r["sequence"] for r in got] == list(range(first, last + 1)) and "".join(r["t"] for r in got) == want
    with pytest.raises(NotFound):
        lg.complete(ledgers(spark, [1, 3]), 1, 3)


def test_ledger_and_tx_requests():
    store = rq.LedgerRange(1, 10)
    assert rq.ledger_start(store, cursor="5") == 6
    with pytest.raises(InvalidParams, match="invalid syntax"):
        rq.ledger_start(store, cursor="invalid")
    with pytest.raises(InvalidParams, match=r"cursor \('15'\) must be between"):
        rq.ledger_start(store, cursor="15")
    with pytest.raises(InvalidParams, match="limit must not exceed 100"):
        rq.limit_of(200, (50, 100))
    with pytest.raises(InvalidParams, match=r"unexpected hash length \(2\)"):
        rq.check_hash("ab")
    with pytest.raises(InvalidParams, match="incorrect hash"):
        rq.check_hash("z" * 64)
    assert rq.tx_start(store, cursor=str(Cursor(1, 2, 1).pos())) == Cursor(1, 3, 0).pos()
    assert tx.next_cursor([], "77") == "77"
    with pytest.raises(InvalidRequest):
        rq.health(rq.LedgerRange(1, 2, 0, 100), 200)
    with pytest.raises(InvalidParams):
        rq.check_fee_windows(10, 50, 20)


def test_missing_ledger(spark):
    with pytest.raises(NotFound, match="database does not contain metadata for ledger: 2"):
        tx.check_ledgers(ledgers(spark, [1, 3]), 1, 3)


GOLDEN = [
    ([], [0] * 14 + [0]),
    ([100], [100] * 14 + [1]),
    ([100] * 4 + [1000] * 6, [1000, 100, 1000] + [100] * 4 + [1000] * 7 + [10]),
    ([100, 1000], [1000, 100, 100] + [100] * 5 + [1000] * 6 + [2]),
    ([515, 245, 245, 530, 221, 262, 927], [927, 221, 245, 221, 245, 245, 245, 262, 515, 515, 530, 927, 927, 927, 7]),
    ([515, 245, 530, 221, 262, 927, 927], [927, 221, 927, 221, 245, 262, 262, 515, 530, 530, 927, 927, 927, 927, 7]),
]


@pytest.mark.parametrize("values,want", GOLDEN)
def test_fee_distribution(spark, values, want):
    df = spark.createDataFrame([(5, "classic", x) for x in values], "ledger_seq bigint, kind string, fee bigint")
    row = fees.distribution(df, spark.range(3, 6).withColumnRenamed("id", "ledger_seq"), "classic", 5, 10).first()
    assert list(row)[:-1] == want and row["ledger_count"] == (3 if values else 0)


def test_contract_fees_by_op_type(spark):
    rows = [
        (2, 1, "invoke", 100, 3, 20, 5), (2, 1, "extend_ttl", 100, 4, 0, 130), (2, 1, "restore", 90, 4, 30, 0),
        (3, 1, "payment", 70, 2, None, None), (3, 2, "invoke", 71, 3, 1, 1), (3, 1, "invoke", 100, 2, 1, 1), (3, 1, "invoke", 100, 3, 1, None),
        (4, 0, None, 5, 3, 0, 0), (4, 1, None, 5, None, None, None),
    ]
    df = spark.createDataFrame(rows, "ledger_seq bigint, n_ops bigint, op_type string, fee_charged bigint, meta_version bigint, nonrefundable bigint, refundable bigint")
    got = sorted(tuple(r) for r in fees.derive(df, fees.by_op_type()).collect())
    assert got == [(2, "contract", f) for f in (-30, 60, 75)] + [(3, "classic", 35), (3, "classic", 70), (4, "classic", 5)]


def test_recent_quantiles_are_off_by_few_ranks(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), rnd.randrange(3600), rnd.choice([rnd.random(), 0.5, None])) for _ in range(20000)] + [(None, 10, 1.0), ("c", 10, None)]
    df = spark.createDataFrame(rows, "k string, s bigint, x double").withColumn("t", F.timestamp_seconds("s"))
    got = fees.recent_quantiles(df, "t", "x", "k").withColumn("start", F.unix_timestamp("start")).collect()
    assert {r["k"] for r in got} == {None, "a", "b"} and len({r["start"] for r in got if r["k"] == "a"}) == 13
    for r in got:
        s = sorted(x for k, at, x in rows if k == r["k"] and x is not None and r["start"] <= at < r["start"] + 600)
        assert r["n"] == len(s)
        for p, error in fees.RECENT:
            lo, hi = sum(x < r[f"q{p}"] for x in s), sum(x <= r[f"q{p}"] for x in s)
            assert lo - error * len(s) - 1 <= p / 100 * len(s) <= hi + error * len(s) + 1, (r, p, len(s), lo, hi)


def test_protocol_of_the_last_ledger(spark):
    df = spark.createDataFrame([(5, 2, 22), (6, 1, 23)], "sequence bigint, meta_version bigint, protocol_version bigint")
    assert lg.protocol_of(df) == 23
    with pytest.raises(InvalidRequest, match="unsupported ledger meta version: 3"):
        lg.protocol_of(df.unionByName(spark.createDataFrame([(7, 3, 24)], df.schema)))
    with pytest.raises(InvalidRequest, match="DB is empty"):
        lg.protocol_of(df.limit(0))


def test_fees_against_plain_python(spark):
    rnd, rows = random.Random(4), []
    for k in range(200):
        last = 0
        for _ in range(rnd.randrange(1, 60)):
            last = last if last and rnd.random() < 0.25 else rnd.randrange(100, 1000)
            rows.append((k * 5, "classic", last))
    df = spark.createDataFrame(rows, "ledger_seq bigint, kind string, fee bigint")
    got = {r["as_of"]: r for r in fees.sliding(df, "classic", 5).collect()}
    for k in range(200):
        s = sorted(f for q, _, f in rows if q == k * 5)
        r, c = got[k * 5], Counter(s)
        assert r["mode"] == min(c, key=lambda x: (-c[x], x)) and r["fee_count"] == len(s)
        assert all(r[f"p{p}"] == s[math.ceil(p * len(s) / 100) - 1] for p in fees.PERCENTS)


def test_state(spark):
    e = spark.createDataFrame([(1, "a", 5, None), (2, "b", 6, 9)], "key bigint, entry string, last_modified bigint, live_until bigint")
    assert [(r["ordinal"], r["key"]) for r in st.lookup(spark, e, [2, 7, 1, 2]).collect()] == [(0, 2), (2, 1), (3, 2)]
    with pytest.raises(InvalidParams):
        st.lookup(spark, e, list(range(201)))
    d = spark.createDataFrame([(1, None, "x"), (2, "x", None), (3, "x", "y"), (4, None, None)], "k int, before string, after string")
    assert [r["change"] for r in st.changes(d).orderBy("k").collect()] == ["created", "deleted", "updated"]


def test_backfill_plans():
    L = rq.LedgerRange
    p = rq.plan_backfill(L(1, 0), L(2, 200), 64, 50)
    assert p.backward == [] and p.forward == [(137, 186), (187, 191)]
    p = rq.plan_backfill(L(150, 160), L(2, 200), 100, 30)
    assert p.backward == [(120, 149), (101, 119)] and p.forward == [(161, 190), (191, 191)]
    assert rq.plan_backfill(L(90, 191), L(2, 200), 100).backward == []
    with pytest.raises(InvalidRequest):
        rq.plan_backfill(L(500, 600), L(2, 200), 100)
    assert rq.short_by(L(1, 600), 1000) == 400 and rq.short_by(L(1, 700), 1000) == 0
    assert L(1, 3).hull(L(7, 9)) == L(1, 9)


def test_checkpoints():
    """The first checkpoints of the public network are 63, 127 and 191."""
    assert [rq.checkpoint_before(s) for s in (63, 64, 126, 127, 190, 191, 200)] == [63, 63, 63, 127, 127, 191, 191]


def test_stored_events_prune(spark):
    from tallyline import queries as q
    from tallyline.sources import views

    d = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = ev.matching(views.stored_events(spark, d, 100, 300), [EventFilter(contracts=(3, 7, 11))])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "In(contract_id, [" in plan
    assert "ledger_bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    plan = q.Q["tx_by_hash"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hash," in plan and "lineitem" not in plan


def test_checked_ids():
    blob = bytes(range(32))
    text = sc.checked_id(blob)
    assert text[0] == "C" and len(text) == 56 and sc.parse_checked_id(text) == blob
    with pytest.raises(InvalidParams):
        sc.parse_checked_id(text[:-1] + ("A" if text[-1] != "A" else "B"))


def test_ingest_is_ordered_and_idempotent(spark, tmp_path):
    df = events(spark, [(s, t, 1, 1, ["a"]) for s in range(2, 8) for t in (1, 2)])
    run = ingest.ingest_batch(str(tmp_path / "store"))
    run(df.filter("ledger_seq <= 4"), 0)
    run(df.filter("ledger_seq <= 4"), 0)
    run(df.filter("ledger_seq <= 6"), 1)
    got = ingest.published(spark, str(tmp_path / "store"))
    assert got.count() == 10 and got.select("id").distinct().count() == 10
    with pytest.raises(InvalidRequest, match="not contiguous"):
        run(events(spark, [(9, 1, 1, 1, ["a"])]), 2)
    assert ingest.trimmed(spark, str(tmp_path / "store"), 2).count() == 4


def test_rows_of_a_failed_attempt_are_not_seen_and_doubles_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "store")
    df = events(spark, [(s, 1, 1, 1, ["a"]) for s in range(2, 6)])
    run = ingest.ingest_batch(path)
    ingest.lake.write(df.withColumn("attempt", F.lit("died")), f"{path}/rows", "ledger_seq", ["id"])
    run(df.unionByName(df), 0)
    got = ingest.published(spark, path)
    assert got.count() == 4 and "attempt" not in got.columns
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_retries_are_bounded_but_not_while_the_source_is_empty():
    def steps(*errors):
        todo, slept = list(errors), []

        def step():
            if todo:
                raise todo.pop(0)
            return len(slept)

        return step, slept

    step, slept = steps(OSError(), OSError(), NotFound(), *[OSError()] * 5)
    assert ingest.retrying(step, sleep=slept.append) == 8 and slept == [1.0] * 8
    step, slept = steps(*[OSError()] * 6)
    with pytest.raises(OSError):
        ingest.retrying(step, sleep=slept.append)
    step, slept = steps(InvalidRequest("gap"))
    with pytest.raises(InvalidRequest):
        ingest.retrying(step, sleep=slept.append)
    assert slept == []


def test_fees_follow_what_is_published(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(NotFound):
        ingest.current_fees(spark, path, "classic", 2)
    rows = [(f"{s}-{t}", s, s * 10 + t, 2, s * 200, 0) for s in range(2, 320) for t in (1, 2)]
    df = spark.createDataFrame(rows, "hash string, ledger_seq bigint, pos bigint, n_ops bigint, fee_charged bigint, resource_fee bigint")
    run = ingest.ingest_batch(path, order=("pos",))
    run(df.filter("ledger_seq <= 310"), 0)
    ingest.lake.write(df.filter("ledger_seq > 310").withColumn("attempt", F.lit("died")), f"{path}/rows", "ledger_seq", ["pos"])  # died before publishing
    row = ingest.current_fees(spark, path, "classic", 3).first()
    assert (row["min"], row["max"], row["fee_count"], row["ledger_count"]) == (30800, 31000, 6, 3)
    run(df, 1)
    assert ingest.current_fees(spark, path, "classic", 3).first()["max"] == 31900
    plan = ingest.published(spark, path, first=310)._jdf.queryExecution().executedPlan().toString()
    assert "ledger_bucket" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_filters_reach_the_scan(spark, tmp_path):
    events(spark, [(s, 1, s % 5, 1, ["a", str(s)]) for s in range(300)]).write.parquet(str(tmp_path / "e"))
    df = ev.matching(spark.read.parquet(str(tmp_path / "e")), [EventFilter(contracts=(1,)), EventFilter(topics=(("a", "7"),))])
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "EqualTo(topic2,7)" in plan


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
