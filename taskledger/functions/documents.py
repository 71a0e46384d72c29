"""JSON documents as the ledger stores them: compact text, strictly JSON."""

from __future__ import annotations

import json
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the base-32 alphabet of ids.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_ENCODER = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def dump(value: object) -> str:
    """Compact JSON; NaN, infinities and values that JSON lacks raise ValueError or TypeError."""
    return _ENCODER.encode(value)


def envelope(type: str, code: str, message: str, retryable: bool, details: dict | None = None) -> str:
    """The one shape in which errors are stored."""
    return dump({"type": type, "code": code, "message": message, "retryable": retryable, "details": details or {}})


def is_json(column: Column | str) -> Column:
    """Whether a stored document is valid; null is."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isNull() | F.try_parse_json(column).isNotNull()


def new_id(now_ms: int) -> str:
    """task_ and 26 characters that order by time: 48 bits of milliseconds, then 80 random bits."""
    value = (now_ms & ((1 << 48) - 1)) << 80 | secrets.randbits(80)
    return "task_" + "".join(ALPHABET[value >> shift & 31] for shift in range(125, -1, -5))
