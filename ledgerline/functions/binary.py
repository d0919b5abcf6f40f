"""Scalar functions of the formats, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIGN = 512


def op_byte(op: Column) -> Column:
    return F.unhex(F.lpad(F.hex(op.cast("long")), 2, "0"))


def record_crc(op: Column, key: Column, value: Column) -> Column:
    """CRC-32 of an operation: its type, key and value."""
    return F.crc32(F.concat(op_byte(op), key, F.coalesce(value, F.lit(b""))))


def record_bytes(key: Column, value: Column) -> Column:
    """A log record's size before padding."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + 13).cast("long")


def aligned(size: Column, to: int = ALIGN) -> Column:
    return (F.floor((size + (to - 1)) / to) * to).cast("long")


def run_name(level: int, counter: int) -> str:
    return f"sst-{level}-{counter:06d}.sst"


_NAME = re.compile(r"sst-([0-9]+)-([0-9]+)\.sst\Z")


def parse_run_name(name: str) -> tuple[int, int] | None:
    """Level and counter, or none where the name doesn't parse."""
    m = _NAME.match(name)
    return (int(m[1]), int(m[2])) if m else None


def run_level(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^sst-([0-9]+)-([0-9]+)\.sst$", 1), F.lit("")).cast("long")


def run_counter(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^sst-([0-9]+)-([0-9]+)\.sst$", 2), F.lit("")).cast("long")
