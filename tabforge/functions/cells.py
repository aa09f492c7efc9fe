"""Typed cells: parsing of text, checks of values, order units and canonical bytes, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabforge.schema import INT64_MAX, INT64_MIN, TEXT_KINDS, ColumnSchema

#: The texts that count as each kind.
INTEGER_RE = r"\A[+-]?[0-9]+\z"
DECIMAL_RE = r"\A[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)\z"
FLOAT_RE = r"\A[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\z"
BOOLEAN_RE = r"\A(true|false)\z"
DATE_RE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DATETIME_RE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}.*\z"
#: Strptime directives and their pattern letters.
STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%I": "hh", "%p": "a", "%%": "%"}


def java_pattern(strptime: str) -> str:
    """A strptime format as a Spark datetime pattern; literal letters are quoted."""
    out, i = [], 0
    while i < len(strptime):
        two = strptime[i : i + 2]
        if two in STRPTIME:
            out.append(STRPTIME[two])
            i += 2
        elif strptime[i] == "%":
            raise ValueError(f"no pattern for {two}")
        else:
            c = strptime[i]
            out.append(f"'{c}'" if c.isalpha() else c)
            i += 1
    return "".join(out)


def is_null_text(c: Column) -> Column:
    """Raw text is null if it is absent or empty."""
    return c.isNull() | (c == "")


def parsed(c: Column, column: ColumnSchema) -> Column:
    """The typed value of raw text, or null where it is none; over-scale decimals are rounded half up."""
    t, kind = F.trim(c), column.kind
    when = lambda pattern, value: F.when(t.rlike(pattern), value)
    if kind == "integer":
        return when(INTEGER_RE, t.try_cast("bigint"))
    if kind == "fixed_decimal":
        return when(DECIMAL_RE, t.try_cast(f"decimal(38,{column.decimal_places})"))
    if kind == "float":
        x = t.try_cast("double")
        return F.when(t.rlike(FLOAT_RE) & ~F.isnan(x) & (F.abs(x) < float("inf")), x)
    if kind == "boolean":
        return F.when(F.lower(t).rlike(BOOLEAN_RE), F.lower(t) == "true")
    if kind == "date":
        return F.try_to_date(t, java_pattern(column.format)) if column.format else when(DATE_RE, t.try_cast("date"))
    if kind == "datetime":
        wall = F.try_to_timestamp(t, F.lit(java_pattern(column.format))) if column.format else when(DATETIME_RE, t.try_cast("timestamp"))
        return F.to_utc_timestamp(wall, column.timezone) if column.timezone and column.timezone != "UTC" else wall
    return c


def fits(c: Column, column: ColumnSchema) -> Column:
    """A typed value that the declared kind allows: finite floats, exact decimals; nulls if nullable."""
    ok = F.lit(True)
    if column.kind == "float":
        ok = ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(ok, F.lit(True)) & (F.lit(column.nullable) | c.isNotNull())


def units(c: Column, column: ColumnSchema) -> Column:
    """Order units as decimal(38,0) (floats as they are): whole numbers, scaled decimals half to even, days, microseconds."""
    if column.kind == "float":
        return c.cast("double")
    if column.kind == "fixed_decimal":
        p = column.decimal_places
        return (F.bround(c.cast(f"decimal(38,{min(18, p + 6)})"), p) * F.lit(10**p).cast("decimal(19,0)")).cast("decimal(38,0)")
    if column.kind == "date":
        return F.unix_date(c).cast("decimal(38,0)")
    if column.kind == "datetime":
        return F.unix_micros(c).cast("decimal(38,0)")
    return c.cast("decimal(38,0)")


def in_int64(u: Column) -> Column:
    return (u >= F.lit(str(INT64_MIN)).cast("decimal(38,0)")) & (u <= F.lit(str(INT64_MAX)).cast("decimal(38,0)"))


def from_units(u: Column, column: ColumnSchema) -> Column:
    """The value that has these units; null where they do not fit."""
    if column.kind == "float":
        return u
    if column.kind == "fixed_decimal":
        return (u.cast("decimal(38,0)") / F.lit(10**column.decimal_places).cast("decimal(19,0)")).cast(f"decimal(38,{column.decimal_places})")
    if column.kind == "date":
        return F.date_from_unix_date(u.try_cast("int"))
    if column.kind == "datetime":
        return F.timestamp_micros(u.try_cast("bigint"))
    return u.try_cast("bigint")


def numeric(c: Column, column: ColumnSchema) -> Column:
    """A number for distances: epoch days or microseconds for times, doubles else."""
    if column.kind == "date":
        return F.unix_date(c).cast("double")
    if column.kind == "datetime":
        return F.unix_micros(c).cast("double")
    return c.cast("double")


def literal(value, column: ColumnSchema) -> Column:
    """A typed literal of a compiled rule value."""
    return F.lit(value if value is None or column.kind not in ("fixed_decimal",) else str(value)).cast(column.spark_type)


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """NFC normalisation, which Spark has no expression for: an Arrow-batched function."""
    return F.pandas_udf(_nfc, "string")(c)


def _little_endian(x: Column) -> Column:
    """The 8 bytes of a long, least significant first, by shifts: whole-stage code without string work."""
    turned = reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255).cast("long")), 56 - 8 * i) for i in range(8)))
    return F.unhex(F.lpad(F.hex(turned), 16, "0"))


def _bytes(text: str) -> Column:
    return F.unhex(F.lit(text))


def _framed(c: Column, body: Column, size: int | Column) -> Column:
    """Length, null tag and body of a cell whose body has ``size`` bytes; the length counts the tag."""
    if isinstance(size, int):
        head = _bytes(f"{size + 1:02x}00000000000000" + "01")
    else:
        long = (size + 1).cast("long")
        short = F.unhex(F.concat(F.lpad(F.hex(long), 2, "0"), F.lit("0000000000000001")))
        head = F.when(long < 256, short).otherwise(F.concat(_little_endian(long), _bytes("01")))
    return F.when(c.isNull(), _bytes("0100000000000000" + "00")).otherwise(F.concat(head, body))


def cell_bytes(c: Column, column: ColumnSchema, normal: bool = True) -> Column:
    """Canonical bytes of a cell: little-endian length, a null tag, and the value.  ``normal`` puts text into NFC."""
    if column.kind in ("integer", "fixed_decimal"):
        whole = c if column.kind == "integer" else (c * F.lit(10**column.decimal_places).cast("decimal(19,0)")).cast("decimal(38,0)")
        digits = whole.cast("string")
        return _framed(c, digits.cast("binary"), F.octet_length(digits))
    if column.kind == "float":
        bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), c).cast("long")
        return _framed(c, F.get(F.transform(F.array(bits), _little_endian), F.lit(0)), 8)  # reflection once a cell
    if column.kind == "boolean":
        return _framed(c, F.when(c, _bytes("01")).otherwise(_bytes("00")), 1)
    if column.kind in ("date", "datetime"):
        return _framed(c, _little_endian((F.unix_date(c) if column.kind == "date" else F.unix_micros(c)).cast("long")), 8)
    if column.kind in TEXT_KINDS and column.kind != "excluded":
        text = nfc(c) if normal else c
        return _framed(c, F.concat(_bytes("73"), text.cast("binary")), F.octet_length(text) + 1)
    raise ValueError(f"{column.kind} has no canonical bytes")


def row_bytes(schema: Sequence[ColumnSchema], normal: bool = True) -> Column:
    return F.concat(*(cell_bytes(F.col(f"`{c.name}`"), c, normal) for c in schema))
