"""Deterministic hash keys shared by the Spark code and the DuckDB oracle text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hx(*parts) -> Column:
    """First four hex digits of md5(concat_ws('|', parts...)) as an int in 0..65535.

    ``parts`` may be Columns or Python literals; everything is cast to string.
    """
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 4), 16, 10).cast("int")


def hx_sql(*parts: str) -> str:
    """DuckDB text of :func:`hx`; ``parts`` are SQL expressions."""
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 4))::INTEGER"


def shl(value, bits) -> Column:
    """value << bits where ``bits`` may be a Column (the Python helper only takes an int)."""
    v = value if isinstance(value, Column) else F.lit(value).cast("long")
    b = bits if isinstance(bits, Column) else F.lit(bits)
    return F.call_function("shiftleft", v, b)


def shr(value, bits) -> Column:
    v = value if isinstance(value, Column) else F.lit(value).cast("long")
    b = bits if isinstance(bits, Column) else F.lit(bits)
    return F.call_function("shiftright", v, b)
