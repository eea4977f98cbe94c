"""Request arithmetic on the driver: ranges, limits and next cursors."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.cursor import Cursor
from .errors import InvalidParams, InvalidRequest

#: Fixed values of the service: ledgers one event request scans at most; (default, largest) page sizes.
SCAN_WINDOW = 10_000
EVENT_LIMITS, TX_LIMITS, LEDGER_LIMITS = (100, 10_000), (50, 200), (50, 200)
MAX_KEYS = 200
RETENTION = 120_960
CLASSIC_WINDOW, CONTRACT_WINDOW, MAX_FEE_WINDOW = 10, 50, 1000
HEALTHY_SECONDS = 30
FORMATS = ("", "base64", "json")


@dataclass(frozen=True)
class LedgerRange:
    """First and last ledger of a store, both included; `last < first` is empty."""

    first: int
    last: int
    first_close: int = 0
    last_close: int = 0

    def __contains__(self, seq: int) -> bool:
        return self.first <= seq <= self.last

    @property
    def empty(self) -> bool:
        return self.last < self.first

    def hull(self, other: LedgerRange) -> LedgerRange:
        """The smallest range that holds both; it may cover ledgers that neither has."""
        if self.empty or other.empty:
            return other if self.empty else self
        return LedgerRange(min(self.first, other.first), max(self.last, other.last))


def limit_of(asked: int | None, bounds: tuple[int, int]) -> int:
    default, most = bounds
    if asked is None or asked == 0:
        return default
    if asked < 0:
        raise InvalidParams("limit must be positive")
    if asked > most:
        raise InvalidParams(f"limit must not exceed {most}")
    return asked


def format_of(name: str) -> str:
    if name not in FORMATS:
        raise InvalidParams(f"expected format to be one of {FORMATS}, not {name!r}")
    return name or "base64"


def event_window(store: LedgerRange, start: int | None = None, end: int | None = None, cursor: str | None = None) -> tuple[Cursor, int]:
    """(first cursor, end ledger excluded) of an event request, clamped to the scan window."""
    if cursor is not None:
        if start is not None or end is not None:
            raise InvalidParams("ledger ranges and cursor cannot both be set")
        at = Cursor.parse(cursor).after()
    else:
        if start is None or start <= 0:
            raise InvalidParams("startLedger must be positive")
        at = Cursor(start)
    if end is not None and end <= at.ledger:
        raise InvalidParams("endLedger must be after startLedger")
    if at.ledger not in store:
        raise InvalidRequest(f"startLedger must be within the ledger range: {store.first} - {store.last}")
    stop = min(store.last + 1, at.ledger + SCAN_WINDOW)
    return at, min(stop, end) if end is not None else stop


def next_event_cursor(ids: list[str], limit: int, end: int) -> str:
    """After a full page its last id; else the end of the window."""
    return ids[-1] if len(ids) == limit else str(Cursor.end_of(end - 1))


def tx_start(store: LedgerRange, start: int | None = None, cursor: str | None = None) -> int:
    """First position of a transaction page."""
    if cursor is not None:
        c = Cursor.parse_position(cursor)
        return Cursor(c.ledger, c.tx + 1, 0).pos()
    if start is None or start not in store:
        raise InvalidParams(f"start ledger must be between the oldest ledger: {store.first} and the latest ledger: {store.last} for this rpc instance")
    return Cursor(start, 1, 1).pos()


def ledger_start(store: LedgerRange, start: int | None = None, cursor: str | None = None) -> int:
    """First sequence of a ledger page."""
    if cursor is not None:
        if not cursor.isdecimal():
            raise InvalidParams(f"cannot parse cursor {cursor!r}: invalid syntax")
        if int(cursor) + 1 not in store:
            raise InvalidParams(f"cursor ('{cursor}') must be between the oldest ledger: {store.first} and the latest ledger: {store.last} for this rpc instance")
        return int(cursor) + 1
    if start is None or start not in store:
        raise InvalidParams(f"start ledger must be between the oldest ledger: {store.first} and the latest ledger: {store.last} for this rpc instance")
    return start


def check_hash(text: str) -> str:
    """A transaction hash in lower-case hex."""
    if len(text) != 64:
        raise InvalidParams(f"unexpected hash length ({len(text)})")
    try:
        bytes.fromhex(text)
    except ValueError as e:
        raise InvalidParams(f"incorrect hash: {e}") from e
    return text.lower()


@dataclass(frozen=True)
class TtlKey:
    """The key of an entry's time to live, which comes with the entry and cannot be asked for."""

    key: int


def check_keys(keys: list) -> list:
    if any(isinstance(k, TtlKey) for k in keys):
        raise InvalidParams("ledger ttl entries cannot be queried directly")
    if not keys:
        raise InvalidParams("keys cannot be empty")
    if len(keys) > MAX_KEYS:
        raise InvalidParams(f"key count ({len(keys)}) exceeds maximum supported ({MAX_KEYS})")
    return keys


def check_fee_windows(classic: int, contract: int, retention: int) -> None:
    for n in (classic, contract):
        if not 0 < n <= MAX_FEE_WINDOW:
            raise InvalidParams(f"fee window must be between 1 and {MAX_FEE_WINDOW}")
        if n > retention:
            raise InvalidParams("fee window exceeds the retention window")


def health(store: LedgerRange, now: int, most: int = HEALTHY_SECONDS) -> dict:
    """Status row; an error when the last ledger is older than `most` seconds."""
    if store.empty:
        raise InvalidRequest("data stores are not initialized")
    late = now - store.last_close
    if late > most:
        raise InvalidRequest(f"latency ({late}s) since last known ledger closed is too high (>{most}s)")
    return {"status": "healthy", "latest": store.last, "oldest": store.first, "latest_close": store.last_close, "oldest_close": store.first_close}


# ---- backfill -----------------------------------------------------------------

CHUNK, TOLERANCE, CHECKPOINT = 960, 384, 64


@dataclass(frozen=True)
class BackfillPlan:
    """Chunks, newest first, of the ledgers below the store, then those above it, oldest first."""

    backward: list[tuple[int, int]]
    forward: list[tuple[int, int]]


def _chunks(first: int, last: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(a + size - 1, last)) for a in range(first, last + 1, size)]


def checkpoint_before(seq: int) -> int:
    """The last checkpoint up to seq: ledgers with (sequence + 1) % 64 = 0 are checkpoints; the first one if there is none."""
    return max(seq - (seq + 1) % CHECKPOINT, CHECKPOINT - 1)


def plan_backfill(store: LedgerRange, cold: LedgerRange, window: int, chunk: int = CHUNK) -> BackfillPlan:
    """What to copy from the cold store so that the last `window` ledgers of it are local.

    An empty store takes everything from the window's start to the last checkpoint; a
    store that covers the start only grows forward; else the gap below goes first.
    """
    if cold.empty:
        raise InvalidRequest("cold store is empty")
    tip = min(checkpoint_before(cold.last), cold.last)
    start = max(cold.first, cold.last - window + 1)
    if store.empty:
        return BackfillPlan([], _chunks(start, tip, chunk))
    if cold.last < store.first:
        raise InvalidRequest(f"cold store ends at {cold.last}, before the oldest local ledger {store.first}")
    back = [] if store.first <= start else [(max(start, b - chunk + 1), b) for b in range(store.first - 1, start - 1, -chunk)]
    return BackfillPlan(back, _chunks(store.last + 1, tip, chunk))


def short_by(store: LedgerRange, window: int) -> int:
    """Ledgers that a store lacks of its window, beyond the tolerance; 0 if none."""
    lacks = window - (store.last - store.first + 1)
    return lacks if lacks > TOLERANCE else 0
