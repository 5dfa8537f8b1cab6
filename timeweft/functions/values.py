"""The value semantics of the query language as Column expressions.

A value is text that may read as a number. Comparison is numeric when both sides do, else by
bytes of their renderings, with ``<nil>`` for a missing value, so it never yields SQL's null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The texts that read as a number, and the rendering of a missing value.
NUMBER = r"^[+-]?(inf|infinity|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$|^nan$"
NIL = "<nil>"
#: Microseconds from the Unix epoch to 2025-01-01, the epoch of packed clock values.
EPOCH_US = 1_735_689_600_000_000
#: Microseconds of each duration unit.
UNITS = {"ns": 0.001, "us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def num(text: Column) -> Column:
    """The number that a text reads as, else null. Digits that overflow stay text."""
    cast = text.try_cast("double")
    spelled = F.lower(text).rlike("inf")
    return F.when(F.lower(text).rlike(NUMBER) & (spelled | cast.isNull() | F.isnan(cast) | (F.abs(cast) < float("inf"))), cast)


def fmt(number: Column) -> Column:
    """A double as shortest text: plain digits for decimal exponents from -4 to 5, else ``d.ddde±XX``."""
    size = F.abs(number)
    text = number.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)(E.*)?$", 1), r"\.0$", "")
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int")
    sign = F.when(number < 0, "-").otherwise("")
    # Spark leaves plain digits up to 1e7, so 1e6 to 1e7 need their exponent made.
    big = F.concat(sign, F.regexp_replace(F.regexp_replace((size / 1e6).cast("decimal(20,15)").cast("string"), "0+$", ""), r"\.$", ""), F.lit("e+06"))
    scientific = F.concat(sign, mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    # 1e-4 to 1e-3 is plain here but not in Spark.
    small = F.concat(sign, F.regexp_replace(size.cast("decimal(38,30)").cast("string"), "0+$", ""))
    return (
        F.when(number.isNull(), NIL)
        .when(F.isnan(number), "NaN")
        .when(number == float("inf"), "+Inf")
        .when(number == float("-inf"), "-Inf")
        .when(size == 0, "0")
        .when((size >= 1e6) & (size < 1e7), big)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .when(text.contains("E"), scientific)
        .otherwise(F.regexp_replace(text, r"\.0$", ""))
    )


@dataclass(frozen=True)
class Value:
    """A value of an expression: its number, if it reads as one, and its rendering, never null."""

    num: Column
    text: Column
    #: What it is where a bare value is asked for (projection), null if missing.
    raw: Column
    #: True for any Column of booleans.
    flag: Column | None = None

    @staticmethod
    def of_text(text: Column) -> Value:
        n = num(text)
        return Value(n, F.coalesce(F.when(n.isNotNull(), fmt(n)), text, F.lit(NIL)), text)

    @staticmethod
    def of_number(number: Column) -> Value:
        number = number.cast("double")
        return Value(number, fmt(number), number)

    @staticmethod
    def of_flag(flag: Column) -> Value:
        return Value(F.lit(None).cast("double"), flag.cast("string"), flag, flag)

    @staticmethod
    def missing() -> Value:
        return Value(F.lit(None).cast("double"), F.lit(NIL), F.lit(None).cast("string"))


def less(a: Value, b: Value) -> Column:
    both = a.num.isNotNull() & b.num.isNotNull()
    ordered = ~F.isnan(F.coalesce(a.num, F.lit(0.0))) & ~F.isnan(F.coalesce(b.num, F.lit(0.0)))
    return F.when(both, F.coalesce((a.num < b.num) & ordered, F.lit(False))).otherwise(a.text < b.text)


def compare(op: str, a: Value, b: Value) -> Column:
    lt, gt = less(a, b), less(b, a)
    return {"=": ~lt & ~gt, "!=": lt | gt, "<": lt, ">": gt, "<=": ~gt, ">=": ~lt}[op]


def truthy(v: Value) -> Column:
    if v.flag is not None:
        return F.coalesce(v.flag, F.lit(False))
    # A text is true unless empty; one that reads as a number, unless zero; a missing value is false.
    return F.coalesce(F.when(v.num.isNotNull(), F.isnan(v.num) | (v.num != 0)).otherwise((v.text != "") & v.raw.isNotNull()), F.lit(False))


def glob_regex(pattern: str) -> str | None:
    """An anchored regular expression for a glob: ``*`` and ``?`` don't match ``/``, ``[a-z]``, ``[^a-z]``, ``\\`` escapes. None if malformed."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out += re.escape(pattern[i])
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] != "^" else i + 3)
            body = pattern[i + 1 : end] if end > 0 else ""
            if not body or body == "^":
                return None
            out += f"[{body.replace('[', chr(92) + '[')}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def micros(stamp: str) -> int:
    """ISO 8601 (a date alone is midnight UTC) to microseconds since the Unix epoch. Raises ValueError."""
    text = re.sub(r"(\.\d{6})\d+", r"\1", stamp.strip().replace("Z", "+00:00"))
    at = datetime.fromisoformat(text)
    at = at.replace(tzinfo=UTC) if at.tzinfo is None else at
    delta = at - datetime(1970, 1, 1, tzinfo=UTC)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def duration(text: str) -> int:
    """``1h30m``, ``500ms``, ``30s``; a bare number is seconds. In microseconds. Raises ValueError."""
    parts = re.findall(r"([0-9]*\.?[0-9]+)([a-zµ]*)", text.strip())
    if not parts or "".join(a + b for a, b in parts) != text.strip() or any(u and u not in UNITS for _, u in parts):
        raise ValueError(f"not a duration: {text!r}")
    return round(sum(float(a) * UNITS[u or "s"] for a, u in parts))


def pack_hlc(ts_us: Column, node: Column, seq: Column) -> Column:
    """The 64-bit clock value as DECIMAL(20,0): wall since 2025 in 48 bits, node in 4, logical in 12. Null before 2025."""
    wall = (ts_us - F.lit(EPOCH_US)).cast("decimal(20,0)")
    return F.when(wall >= 0, (wall * 65_536 + (node.cast("int") * 4_096 + seq.cast("int")).cast("decimal(10,0)")).cast("decimal(20,0)"))


def unpack_hlc(packed: Column) -> tuple[Column, Column, Column]:
    wall = F.floor(packed / 65_536)
    rest = (packed - wall * 65_536).cast("int")
    return (wall + F.lit(EPOCH_US)).cast("bigint"), F.floor(rest / 4_096).cast("tinyint"), (rest % 4_096).cast("smallint")
