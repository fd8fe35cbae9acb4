"""Dotted metric names: validity, parts, and the hash by which points are dealt to destinations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Segments of these characters, joined by single dots.
VALID = r"^[A-Za-z0-9_:=%-]+(\.[A-Za-z0-9_:=%-]+)*$"


def is_valid(name: Column) -> Column:
    """True for legal names; false for null and for anything below ``root.``."""
    return F.coalesce(name.rlike(VALID) & ~name.startswith("root."), F.lit(False))


def parts(name: Column) -> Column:
    return F.split(name, r"\.")


def depth(name: Column) -> Column:
    return F.size(parts(name))


def namespace(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def parent(name: Column) -> Column:
    """All but the last segment; null at the top level."""
    return F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1))


def prefix(name: Column, n) -> Column:
    """The first ``n`` segments."""
    return F.array_join(F.slice(parts(name), F.lit(1), n if isinstance(n, Column) else F.lit(n)), ".")


def ancestors(name: Column) -> Column:
    """Array of all proper prefixes, shortest first."""
    n = depth(name)
    some = F.transform(F.sequence(F.lit(1), n - 1), lambda i: prefix(name, i))
    return F.when(n > 1, some).otherwise(F.array().cast("array<string>"))


def sanitize(name: Column) -> Column:
    """White space becomes a dash, for names that are put together from free text."""
    return F.regexp_replace(name, r"\s+", "-")


def java_hash(name: Column) -> Column:
    """The 32-bit polynomial string hash of base 31 over character codes, as a signed BIGINT. For legal (ASCII) names."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: F.pmod(acc * 31 + c, F.lit(1 << 32)))
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total)


def destination_of(name: Column, n: int) -> Column:
    """Number of the destination in a group of ``n``: the absolute hash, taken as a BIGINT, modulo n."""
    return F.pmod(F.abs(java_hash(name)), F.lit(n)).cast("int")


def plain_value(value: Column) -> Column:
    """Text of a value with at most two decimals, rounded half away from zero, without trailing zeros; NaN and infinities by name."""
    inside = F.when(F.abs(value) < 1e30, value)
    whole = F.round(inside, 2).cast("decimal(34,2)")
    trimmed = F.regexp_replace(whole.cast("string"), r"0$", "")
    text = F.when(whole == F.floor(whole), F.floor(whole).cast("string")).otherwise(trimmed)
    return F.when(F.isnan(value), F.lit("NaN")).otherwise(F.coalesce(text, value.cast("string")))


def compat_value(value: Column) -> Column:
    """The text that older relays print: two decimals of the part behind the point, put after the truncated integer.

    So a fraction that rounds to 100 hundredths prints as ``.10``, a value between -1 and 0 loses its sign, and NaN prints as 0.
    """
    value = F.when(F.isnan(value), F.lit(0.0)).otherwise(value)
    whole = F.when(value >= 9.223372036854775e18, F.lit((1 << 63) - 1)).when(value <= -9.223372036854775e18, F.lit(-(1 << 63))).otherwise(_truncated(value))
    hundredths = F.when(F.abs(value) < 1e15, F.floor(F.abs(value - whole.cast("double")) * 100 + 0.5).cast("long")).otherwise(F.lit(0))
    tail = F.when(hundredths % 10 == 0, (hundredths / 10).cast("long").cast("string")).otherwise(hundredths.cast("string"))
    return F.concat(whole.cast("string"), F.when(hundredths <= 0, F.lit("")).when(hundredths < 10, F.concat(F.lit(".0"), hundredths.cast("string"))).otherwise(F.concat(F.lit("."), tail)))


def _truncated(value: Column) -> Column:
    inside = F.least(F.greatest(value, F.lit(-9.2e18)), F.lit(9.2e18))
    return F.when(inside < 0, F.ceil(inside)).otherwise(F.floor(inside)).cast("long")
