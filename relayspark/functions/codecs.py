"""Scalar functions: text, clocks, addresses, JSON and compression, as Column expressions."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relayspark.model import WORKER_PREFIX


def decode(frame: Column) -> Column:
    """Bytes to text, UTF-8."""
    return F.decode(frame, "UTF-8")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def encode(text: Column, strict: bool = False) -> Column:
    """Text to bytes, ASCII. Other characters raise if ``strict``, else give null (route them to rejects)."""
    coded = F.encode(text, "US-ASCII")
    return coded if strict else F.when(is_ascii(text), coded)


def unix_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC in any session."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds; halves go to the even second."""
    return F.bround(unix_micros(ts) / 1e6, 0).cast("bigint")


def epoch_millis(ts: Column) -> Column:
    return F.bround(unix_micros(ts) / 1e3, 0).cast("bigint")


def epoch_float(ts: Column) -> Column:
    return unix_micros(ts) / 1e6


def zero_filled(text: Column, width: int = 4) -> Column:
    """Zeros in front up to ``width``; longer text stays whole."""
    text = text.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def worker_name(number: Column) -> Column:
    return F.concat(F.lit(WORKER_PREFIX), zero_filled(number))


def address(text: Column) -> Column:
    """``host:port`` to struct(host, port); without exactly two parts the port is null."""
    parts = F.split(text, ":")
    return F.struct(F.get(parts, F.lit(0)).alias("host"), F.when(F.size(parts) == 2, F.get(parts, F.lit(1)).try_cast("int")).alias("port"))


def endpoint(host: Column, port: Column) -> Column:
    return F.format_string("tcp://%s:%s", host, port.cast("string"))


#: How each byte is written between the quotes of a bytes literal, by the language's own rule.
_WRITTEN = [repr(bytes([i]))[2:-1] if i != 0x27 else "'" for i in range(256)]


def bytes_text(frame: Column) -> Column:
    """A frame as a bytes literal, as a log of raw frames shows it: b'...' with escapes; in double quotes where only
    single ones are in it."""
    table = F.array(*map(F.lit, _WRITTEN))
    pairs = F.regexp_extract_all(F.hex(frame), F.lit("(..)"), F.lit(1))
    body = F.array_join(F.transform(pairs, lambda x: F.element_at(table, F.conv(x, 16, 10).cast("int") + 1)), "")
    single, double = F.instr(body, "'") > 0, F.instr(body, '"') > 0
    quoted = F.concat(F.lit("b'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(single & ~double, F.concat(F.lit('b"'), body, F.lit('"'))).otherwise(quoted)


def float_text(number: Column) -> Column:
    """A double in plain digits, with one behind the point at least (1700000000.25, 3.0); in exponent form from 1e16 on
    and below 0.0001."""
    text = number.cast("double").cast("string")
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    plain = F.when(plain.contains("."), plain).otherwise(F.concat(plain, F.lit(".0")))
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d)", "e+$1"), "E-", "e-")
    power = F.regexp_replace(power, r"e([+-])(\d)$", "e$10$2")
    size = F.abs(number)
    return F.when(number.isNull() | F.isnan(number) | (size == float("inf")), F.replace(F.lower(text), F.lit("infinity"), F.lit("inf"))).when((size >= 1e16) | ((size < 1e-4) & (size > 0)), power).when(number == 0, F.when(text.startswith("-"), "-0.0").otherwise("0.0")).otherwise(plain)


def field(fields: Column, key: str, strict: bool = False) -> Column:
    """A field of a map; null if it is not there, or an error if ``strict``."""
    if not strict:
        return F.try_element_at(fields, F.lit(key))
    return F.when(F.map_contains_key(fields, key), F.try_element_at(fields, F.lit(key))).otherwise(F.raise_error(F.lit(f"no field {key}")).cast("string"))


def head(items: Column) -> Column:
    return F.get(items, F.lit(0))


def tail(items: Column) -> Column:
    """All but the first; empty for empty."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def total_bytes(frames: Column) -> Column:
    return F.aggregate(frames, F.lit(0).cast("bigint"), lambda n, frame: n + F.octet_length(frame))


@F.pandas_udf(T.BinaryType())
def compress(text: pd.Series) -> pd.Series:
    """UTF-8 text to zlib bytes."""
    return text.map(lambda x: None if x is None else zlib.compress(x.encode("utf-8", "surrogatepass")))


@F.pandas_udf(T.StringType())
def decompress(packed: pd.Series) -> pd.Series:
    return packed.map(lambda x: None if x is None else zlib.decompress(x).decode("utf-8", "surrogatepass"))
