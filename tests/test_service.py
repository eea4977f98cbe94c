"""Whole requests and checked identifiers."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tallyline import queries as q
from tallyline.functions import scalars as sc
from tallyline.functions.cursor import Cursor
from tallyline.operators import service
from tallyline.operators.events import EventFilter
from tallyline.plans import requests as rq
from tallyline.plans.errors import InvalidParams, InvalidRequest

STORE = rq.LedgerRange(2, 6, 10, 30)


def events(spark, n=12):
    rows = [(str(Cursor(2 + i // 3, i % 3 + 1)), Cursor(2 + i // 3, i % 3 + 1).pos(), 2 + i // 3, i % 2, i % 2, ["a", str(i % 2), "c", "d", "e"], 5, "a", str(i % 2), 100, "{}", f"t{i}", True) for i in range(n)]
    return spark.createDataFrame(rows, "id string, pos bigint, ledger_seq bigint, contract_id bigint, event_kind bigint, topics array<string>, n_topics int, topic1 string, topic2 string, close_time bigint, data string, tx_hash string, in_successful boolean")


def test_events_page_by_page(spark):
    df, got, cursor = events(spark), [], None
    while True:
        r = service.get_events(df, STORE, start=None if cursor else 2, cursor=cursor, limit=5, form="json")
        rows = sorted(r.rows.collect(), key=lambda x: x["id"])
        got += [x["id"] for x in rows]
        cursor = r.cursor
        if len(rows) < 5:
            break
    assert got == sorted(x["id"] for x in df.collect()) and cursor == str(Cursor.end_of(6))
    assert rows[0]["topic"] == '["a","%s","c","d"]' % rows[0]["contract_id"] and (rows[0]["op_index"], rows[0]["closed_at"]) == (0, "1970-01-01T00:01:40Z")
    none = service.get_events(df, STORE, 3, 5, filters=[EventFilter(contracts=(9,))])
    assert none.rows.count() == 0 and none.cursor == str(Cursor.end_of(4)) and none.flat().columns[-1] == "cursor"
    for bad in (dict(start=9), dict(start=1)):
        with pytest.raises(InvalidRequest):
            service.get_events(df, STORE, **bad)
    for bad in (dict(start=2, form="xml"), dict(start=2, limit=10_001), dict(start=2, cursor=cursor), dict(start=4, end=4), dict(start=0)):
        with pytest.raises(InvalidParams):
            service.get_events(df, STORE, **bad)


def test_empty_pages_echo_their_cursor(spark):
    txs = spark.createDataFrame([], "hash string, ledger_seq bigint, application_order bigint, close_time bigint, fee_charged bigint, n_ops bigint, successful boolean, inner_hash string, pos bigint")
    assert service.get_transactions(txs, STORE, cursor=str(Cursor(5, 1, 1).pos())).cursor == str(Cursor(5, 1, 1).pos())
    led = spark.createDataFrame([(2, 10), (3, 15)], "sequence bigint, close_time bigint")
    page = service.get_ledgers(led, STORE, cursor="2", limit=1)
    assert page.cursor == "3" and page.rows.first()["closed_at"] == "1970-01-01T00:00:15Z"
    assert service.get_ledgers(led, STORE, cursor="5").cursor == "5"


def test_ttl_keys_are_refused(spark):
    with pytest.raises(InvalidParams, match="ttl entries cannot be queried directly"):
        service.get_entries(spark, spark.range(1), [1, rq.TtlKey(1)], STORE)


def bitwise_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def test_contract_ids_against_plain_python(spark):
    got = q.Q["fn_contract_ids"](spark, "/root/testdata/sf0.001").collect()
    assert bitwise_crc(b"123456789") == 0x31C3 and len(got) > 10
    for r in got:
        body = bytes([16]) + hashlib.sha256(str(r["user_id"]).encode()).digest()
        assert r["contract"] == base64.b32encode(body + bitwise_crc(body).to_bytes(2, "little")).decode().rstrip("=")
    assert spark.createDataFrame([(None,)], "b binary").select(sc.encode_contract("b")).first()[0] is None


def test_checked_values_raise(spark):
    one = spark.range(1)
    for bad in (sc.unsigned(F.lit(-1)), sc.unhex_checked(F.lit("zz")), sc.unbase64_capped(F.lit("AAAAAAAA"), 2), sc.to_int32(F.lit(2**40))):
        with pytest.raises(Exception, match="negative|invalid hex|exceeds|CAST_OVERFLOW"):
            one.select(bad).collect()
