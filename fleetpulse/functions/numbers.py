"""Strict number, port-range and duration parsing."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per duration unit.
UNIT_SECONDS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}

_DURATION = r"^(?:[0-9]+(?:\.[0-9]+)?(?:ms|s|m|h|d))+\z"
_DURATION_PART = r"([0-9]+(?:\.[0-9]+)?)(ms|s|m|h|d)"


def atoi(text: Column) -> Column:
    """A base-10 64-bit integer with an optional sign; null for anything else.

    A plain cast would also accept surrounding blanks, hence the pattern. The cast still
    guards against overflow.
    """
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))


def atoi_or_zero(text: Column) -> Column:
    """Like `atoi`, with 0 for anything that is no integer."""
    return F.coalesce(atoi(text), F.lit(0).cast("bigint"))


def parse_port_range(text: Column) -> Column:
    """``"lo-hi"`` to a struct (lo, hi); null unless both are integers and lo < hi."""
    parts = F.split(text, "-", 2)
    lo, hi = atoi(F.get(parts, F.lit(0))), atoi(F.get(parts, F.lit(1)))
    return F.when(lo < hi, F.struct(lo.alias("lo"), hi.alias("hi")))


def parse_duration(text: Column) -> Column:
    """``"200ms"``, ``"10s"``, ``"1m"``, ``"1h30m"``, ``"1d"`` to seconds; null for anything else."""
    amounts = F.regexp_extract_all(text, F.lit(_DURATION_PART), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(_DURATION_PART), F.lit(2))
    table = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])
    parts = F.zip_with(amounts, units, lambda a, u: a.cast("double") * table[u])
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(text.rlike(_DURATION), total)


def seconds(duration) -> float:
    """`parse_duration` for an argument given when the plan is built."""
    if isinstance(duration, (int, float)):
        return float(duration)
    if not re.fullmatch(_DURATION.strip("^").replace(r"\z", ""), duration):
        raise ValueError(f"not a duration: {duration!r}")
    return sum(float(a) * UNIT_SECONDS[u] for a, u in re.findall(_DURATION_PART, duration))


def micros(duration) -> int:
    """A duration argument in whole microseconds."""
    return round(seconds(duration) * 1_000_000)
