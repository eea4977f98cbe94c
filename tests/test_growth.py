"""What grows with the input: copies of rows, jobs, and scans."""

import datetime as dt
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyline import queries as q
from tallyline.operators import events as ev, fees
from tallyline.plans import requests as rq
from tallyline.sources import views as v


def made(df, operator):
    """Rows that the operators of one name made when df was collected."""

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        kids = plan.children()
        own = plan.metrics().apply("numOutputRows").value() if name == operator else 0
        return own + sum(walk(kids.apply(i)) for i in range(kids.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("kind,window", [("classic", 10), ("contract", 50)])
def test_sliding_copies_a_fee_twice_at_most(spark, kind, window):
    """Over more rows a block than a batch holds, equal fees across batches and ledgers without fees; each number against plain Python."""
    rows = [(s, (i * i * 31 + s) % 6000 - 40 if i % 3 else 2**60 + s % 2) for s in range(2, 131) if s % 7 for i in range(300)]
    df = spark.createDataFrame(rows, "ledger_seq bigint, fee bigint").withColumn("kind", F.lit(kind))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        out = fees.sliding(df, kind, window)
        got = {r["as_of"]: r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    per = {}
    for s, fee in rows:
        per.setdefault(s, []).append(fee)
    assert set(got) == set(per) and len(got) == len(out.collect())
    for s, r in got.items():
        all_ = sorted(x for t in range(s - window + 1, s + 1) for x in per.get(t, ()))
        n = Counter(all_)
        want = {"as_of": s, "max": all_[-1], "min": all_[0], "mode": min(n, key=lambda x: (-n[x], x)), "fee_count": len(all_)}
        assert r.asDict() == want | {f"p{p}": all_[math.ceil(p * len(all_) / 100) - 1] for p in fees.PERCENTS}
    assert made(out, "GenerateExec") <= 2 * (len(set(rows)) + len(per))


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """A folder with orders on most days of ledgers 2 to 2300 and their lines; some have none."""
    d = str(tmp_path_factory.mktemp("orders"))
    days = [(i, dt.datetime(1995, 1, 1) + dt.timedelta(days=i * 3 % 2299), "FO"[i % 3 > 0], i * 7 % 1000 + 0.5) for i in range(3000)]
    lines = [(i, j, (i + j) % 9, "RAN"[j % 3], float(i % 50 + 1)) for i in range(3000) for j in range(i % 5)]
    spark.createDataFrame(days, "o_orderkey bigint, o_orderdate timestamp_ntz, o_orderstatus string, o_totalprice double").coalesce(2).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_returnflag string, l_quantity double").coalesce(2).write.parquet(f"{d}/lineitem.parquet")
    return d


def same(spark, d, name, tables):
    got = [tuple(r) for r in q.Q[name](spark, d).collect()]
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    assert sorted(got, key=repr) == sorted(con.execute(q.SQL[name]).fetchall(), key=repr)
    return got


@pytest.fixture
def asked(monkeypatch):
    """Counts how often a given table is read."""
    n, table = Counter(), v.table
    monkeypatch.setattr(v, "table", lambda spark, d, name: n.update([name]) or table(spark, d, name))
    return n


def test_backfill_deals_the_lines_once(spark, orders, asked):
    assert same(spark, orders, "backfill_resumed", ("orders", "lineitem"))
    assert asked["lineitem"] == 1


def hours(spark, d, n):
    """n events in each of ledgers 199 to 211, but 205."""
    rows = [(s * n + i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=s - 2, seconds=i), i % 5, "view", 1.0, '{"k":"1"}') for s in range(199, 212) if s != 205 for i in range(n)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{d}/events.parquet")
    return str(d)


def test_a_walk_takes_as_many_jobs_for_many_pages(spark, tmp_path):
    jobs = []
    for n in (7, 170):
        d = hours(spark, tmp_path / str(n), n)
        q.Q["ev_page_walk"](spark, d).count()  # stores the events
        spark.sparkContext.setJobGroup(d, "walk")
        assert len(same(spark, d, "ev_page_walk", ["events"])) == 10 * n
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(d)))
        spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


@pytest.mark.parametrize("n", [7, 10])
def test_page_ends_are_those_of_a_walk(spark, tmp_path, n):
    df, after, want = v.events(spark, hours(spark, tmp_path, n), 200, 210), None, []
    while not want or want[-1][3] == 20:
        ids = [r["id"] for r in ev.page(df, [ev.EventFilter(contracts=(0, 1, 2, 3))], after=after, limit=20).select("id").collect()]
        after = rq.next_event_cursor(ids, 20, 211)
        want.append((len(want), *(ids[:1] + ids[-1:] or (None, None)), len(ids)))
    got = ev.page_ends(df, [ev.EventFilter(contracts=(0, 1, 2, 3))], 20).orderBy("page").collect()
    assert [tuple(r) for r in got] == [x for x in want if x[3]] and len(got) > 2


def test_streamed_events_are_numbered_once(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(q, "STREAM_ROWS", 25)
    assert len(same(spark, hours(spark, tmp_path, 10), "stream_ingest_equiv", ["events"])) == 120
    assert asked["events"] == 2  # for the events and for the ledgers, whatever the number of batches


def test_streamed_ledgers_deal_the_lines_once(spark, orders, asked):
    v.lake._STORED.pop((spark.sparkContext.applicationId, orders, "nested"), None)
    assert same(spark, orders, "store_ingest_trim", ("orders", "lineitem"))
    assert asked["lineitem"] == 1


def test_streamed_transactions_need_no_single_task(spark, orders, monkeypatch):
    bases, scratch = [], v.lake.scratch
    monkeypatch.setattr(v.lake, "scratch", lambda s, label: bases.append(scratch(s, label)) or bases[-1])
    assert same(spark, orders, "stream_fee_window", ("orders", "lineitem"))
    at = next(b for b in bases if "ingest-" in b)
    assert spark.read.parquet(f"{at}/in").select(F.input_file_name()).distinct().count() > 2
