"""Positions: a ledger, a transaction in it and an operation in that, in one sortable 64-bit number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..plans.errors import InvalidParams

TX_BITS, OP_BITS = 20, 12
MAX_TX, MAX_OP = (1 << TX_BITS) - 1, (1 << OP_BITS) - 1
MAX_LEDGER = (1 << 31) - 1


def pack(ledger, tx, op) -> Column:
    """ledger << 32 | tx << 12 | op of three columns or numbers."""
    c = [x if isinstance(x, Column) else F.lit(x) for x in (ledger, tx, op)]
    return c[0].cast("bigint") * (1 << (TX_BITS + OP_BITS)) + c[1].cast("bigint") * (1 << OP_BITS) + c[2].cast("bigint")


def ledger_of(pos: Column) -> Column:
    return F.shiftright(pos, TX_BITS + OP_BITS)


def tx_of(pos: Column) -> Column:
    return F.shiftright(pos, OP_BITS).bitwiseAND(MAX_TX)


def op_of(pos: Column) -> Column:
    return pos.bitwiseAND(MAX_OP)


def event_id(pos: Column, index: Column) -> Column:
    """Text id whose order is the numeric order: 19 digits, a dash, 10 digits."""
    return F.concat(F.lpad(pos.cast("string"), 19, "0"), F.lit("-"), F.lpad(index.cast("string"), 10, "0"))


@dataclass(frozen=True, order=True)
class Cursor:
    """A position on the driver; index is the event's number inside its operation."""

    ledger: int
    tx: int = 0
    op: int = 0
    index: int = 0

    def pos(self) -> int:
        return self.ledger << (TX_BITS + OP_BITS) | self.tx << OP_BITS | self.op

    def __str__(self) -> str:
        return f"{self.pos():019d}-{self.index:010d}"

    @classmethod
    def parse(cls, text: str) -> Cursor:
        pos, dash, index = text.partition("-")
        if not (dash and pos.isdecimal() and index.isdecimal() and int(pos) >> 63 == 0):
            raise InvalidParams(f"invalid event id {text!r}")
        n = int(pos)
        return cls(n >> (TX_BITS + OP_BITS), n >> OP_BITS & MAX_TX, n & MAX_OP, int(index))

    @classmethod
    def parse_position(cls, text: str) -> Cursor:
        """A bare position, as transaction pages use it."""
        if not text.isdecimal() or int(text) >> 63:
            raise InvalidParams(f"cannot parse cursor {text!r}: invalid syntax")
        n = int(text)
        return cls(n >> (TX_BITS + OP_BITS), n >> OP_BITS & MAX_TX, n & MAX_OP)

    @classmethod
    def end_of(cls, ledger: int) -> Cursor:
        """The largest position in a ledger."""
        return cls(ledger, MAX_TX, MAX_OP, (1 << 32) - 1)

    def after(self) -> Cursor:
        return Cursor(self.ledger, self.tx, self.op, self.index + 1)


def before_all(ledger: Column) -> Column:
    """Position of events that come before all transactions of a ledger."""
    return pack(ledger, 0, 0)


def after_tx(ledger: Column, tx: Column) -> Column:
    return pack(ledger, tx, MAX_OP)


def after_all(ledger: Column) -> Column:
    return pack(ledger, MAX_TX, 0)
