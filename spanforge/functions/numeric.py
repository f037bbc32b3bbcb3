"""Numbers whose rules matter for exact results: rounding, four percentiles, safe ratios, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers up to this are exact in a double.
SAFE = (1 << 53) - 1


def half_up(x: Column) -> Column:
    """Nearest integer, halves toward positive infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percentile_nearest(xs: Column, p: float) -> Column:
    """Element at the rounded place (n - 1) p of the sorted array; null without elements."""
    return F.get(F.array_sort(xs), F.floor((F.size(xs) - 1) * F.lit(float(p)) + 0.5).cast("int"))


def percentile_linear(x: Column, p: float) -> Column:
    return F.percentile(x, F.lit(float(p)))


def percentile_ceil(name: str, p: float) -> Column:
    """Element at ceil(p n) - 1 of the sorted values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {name})")


def decibels(energy: Column, offset: float = 0.0) -> Column:
    """10 log10 of an energy; minus infinity for 0 and less."""
    return F.when(energy > 0, F.lit(offset) + 10 * F.log10(energy)).otherwise(F.lit(float("-inf")))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of a text, as eight hexadecimal digits."""
    code = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.lpad(F.lower(F.hex(code)), 8, "0")


def cost_micro(seconds: Column, per_hour: int) -> Column:
    """Price in millionths of whole seconds begun, rounded up."""
    whole = F.ceil(seconds).cast("long")
    return F.expr("0").cast("long") + F.floor((whole * per_hour + 3599) / F.lit(3600).cast("decimal(20,0)")).cast("long")
