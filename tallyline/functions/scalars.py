"""Value-level functions: encodings, times, checked numbers and identifiers."""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..plans.errors import InvalidParams

#: Largest encoded key and transaction that are decoded, in bytes.
MAX_KEY_BYTES, MAX_TX_BYTES = 16 << 10, 1 << 20
#: Version bytes of checked identifiers.
ACCOUNT, CONTRACT = 6 << 3, 2 << 3


def rfc3339(seconds: Column) -> Column:
    """Unix seconds as UTC text; the session time zone has to be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def base64_each(blobs: Column) -> Column:
    return F.transform(blobs, F.base64)


def unbase64_capped(text: Column, most: int = MAX_KEY_BYTES) -> Column:
    """Decoded bytes; an error if more than `most`."""
    out = F.unbase64(text)
    return F.when(F.length(out) <= most, out).otherwise(F.raise_error(F.concat(F.lit(f"decoded value exceeds {most} bytes: "), F.length(out).cast("string"))))


def hex_lower(blob: Column) -> Column:
    return F.lower(F.hex(blob))


def unhex_checked(text: Column) -> Column:
    """The bytes of hex text of either case; an error for anything else."""
    return F.when(F.unhex(text).isNotNull() | text.isNull(), F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("invalid hex: "), text)).cast("binary"))


def to_int32(n: Column) -> Column:
    """n as INT; an ANSI error when it does not fit."""
    return n.cast("int")


def unsigned(n: Column) -> Column:
    """n; an error when it is negative."""
    return F.when((n >= 0) | n.isNull(), n).otherwise(F.raise_error(F.lit("negative value")).cast("bigint"))


def strip_nul(text: Column) -> Column:
    return F.translate(text, "\x00", "")


def nearest_rank(values: Column, percent: int) -> Column:
    """Nearest-rank percentile of a sorted array: element ceil(p * n / 100), from 1."""
    return F.element_at(values, F.floor((F.size(values) * percent + 99) / 100).cast("int"))


def _crc_table() -> np.ndarray:
    """What each byte does to the upper byte of a CRC-16 with polynomial 0x1021."""
    crc = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        crc = np.where(crc & 0x8000, crc << 1 ^ 0x1021, crc << 1) & 0xFFFF
    return crc


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x1021, start 0) of each row of a byte matrix, a column a step."""
    table, crc = _crc_table(), np.zeros(len(rows), np.uint32)
    for column in rows.T:
        crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ column]
    return crc


def checked_ids(blobs: Sequence[bytes], version: int = CONTRACT) -> list[str]:
    """Base32 of version byte, 32 bytes and a little-endian CRC-16, without padding, of each blob."""
    if any(len(b) != 32 for b in blobs):
        raise InvalidParams("an identifier has 32 bytes")
    body = np.full((len(blobs), 33), version, np.uint8)
    body[:, 1:] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 32)
    crc = crc16(body).astype("<u2").view(np.uint8).reshape(-1, 2)
    return [base64.b32encode(row.tobytes()).decode().rstrip("=") for row in np.hstack([body, crc])]


def checked_id(blob: bytes, version: int = CONTRACT) -> str:
    return checked_ids([blob], version)[0]


def parse_checked_id(text: str, version: int = CONTRACT) -> bytes:
    try:
        raw = base64.b32decode(text + "=" * (-len(text) % 8))
    except ValueError as e:
        raise InvalidParams(f"invalid identifier {text!r}") from e
    if len(raw) != 35 or raw[0] != version or int(crc16(np.frombuffer(raw[:-2], np.uint8)[None])[0]) != int.from_bytes(raw[-2:], "little"):
        raise InvalidParams(f"invalid identifier {text!r}")
    return raw[1:-2]


@F.pandas_udf(T.StringType())
def encode_contract(blobs: pd.Series) -> pd.Series:
    """Checked identifiers of 32-byte contract ids; for output only, never in a filter."""
    there = blobs.notna()
    out = pd.Series([None] * len(blobs), index=blobs.index, dtype=object)
    out[there] = checked_ids([bytes(b) for b in blobs[there]])
    return out
