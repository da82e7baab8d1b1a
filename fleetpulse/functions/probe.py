"""Probe values and error classes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text of a missing key, which is no failure, and the error classes in the
# order in which they are tested.
MISSING_KEY = "redis: nil"
PREFIX_KINDS = [("READONLY", "readonly"), ("LOADING", "loading"), ("MASTERDOWN", "master_down")]
TIMEOUT_TEXTS = ["deadline exceeded", "i/o timeout"]
NETWORK_TEXTS = ["connection refused", "EOF", "broken pipe", "reset by peer"]


def parse_value(raw: Column) -> Column:
    """``"<n>:<unix-nano>"`` to a struct (n, written_at_ns); null if either is no 64-bit integer.

    The pattern refuses what a cast would accept, such as blanks; the casts guard against overflow.
    """
    shaped = F.when(raw.rlike(r"^[+-]?[0-9]+:[+-]?[0-9]+\z"), raw)
    n = F.substring_index(shaped, ":", 1).try_cast("bigint")
    ns = F.substring_index(shaped, ":", -1).try_cast("bigint")
    return F.when(n.isNotNull() & ns.isNotNull(), F.struct(n.alias("n"), ns.alias("written_at_ns")))


def format_value(n: Column, ns: Column) -> Column:
    """The text form that `parse_value` reads."""
    return F.concat(n.cast("string"), F.lit(":"), ns.cast("string"))


def error_kind(err: Column, net_timeout: Column) -> Column:
    """The class of an error text; null for success and for a missing key. Case-sensitive."""
    kind = F.when(err.isNull() | (err == MISSING_KEY), F.lit(None).cast("string"))
    kind = kind.when(F.coalesce(net_timeout, F.lit(False)), "timeout")
    for prefix, name in PREFIX_KINDS:
        kind = kind.when(err.startswith(prefix), name)
    for text in TIMEOUT_TEXTS:
        kind = kind.when(err.contains(text), "timeout")
    for text in NETWORK_TEXTS:
        kind = kind.when(err.contains(text), "network")
    return kind.otherwise("other")


def op_status(err: Column, net_timeout: Column) -> Column:
    """``error`` for a classified error, else ``ok``."""
    return F.when(error_kind(err, net_timeout).isNotNull(), "error").otherwise("ok")
