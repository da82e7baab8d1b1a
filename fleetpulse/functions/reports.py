"""Reading what nodes and coordinators say: replication reports and flat key/value replies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import atoi_or_zero

_BLANKS = r" \t\r\x0b\x0c"


def kv_get(reply: Column, key: str) -> Column:
    """The value of `key` in a flat array key, value, key, value ...; the last one wins.

    A trailing key without a value is dropped. Null if the key does not occur. The last item equal
    to `key` is nearly always a key with a value, which compiled code finds; only where it is a
    value or the trailing item are all items looked at.
    """
    back = F.array_position(F.reverse(reply), key)
    at = F.size(reply) - back.cast("int")
    values = F.transform(
        reply,
        lambda item, i: F.when(
            (i % 2 == 1) & (F.get(reply, i - 1) == key), F.coalesce(item, F.lit(""))
        ),
    )
    return (
        F.when(back == 0, F.lit(None).cast("string"))
        .when((back > 1) & (at % 2 == 0), F.coalesce(F.get(reply, at + 1), F.lit("")))
        .otherwise(F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1)))
    )


def replication_state(text: Column) -> Column:
    """A node's report to a struct (role, master_host, master_port, link); null if there is none.

    Blanks around a line do not count; of several lines for one field the last one wins.
    """

    def last(field: str) -> Column:
        lines = F.regexp_extract_all(text, F.lit(rf"(?md)^[{_BLANKS}]*{field}:(.*)"), F.lit(1))
        return F.coalesce(F.rtrim(F.try_element_at(lines, F.lit(-1)), F.lit(" \t\r\x0b\x0c")), F.lit(""))

    return F.when(
        text.isNotNull(),
        F.struct(
            last("role").alias("role"),
            last("master_host").alias("master_host"),
            atoi_or_zero(last("master_port")).alias("master_port"),
            last("master_link_status").alias("link"),
        ),
    )


def replication_target(state: Column) -> Column:
    """The port a node follows: 0 if it calls itself master, null if it gave no report."""
    return F.when(state["role"] == "master", F.lit(0).cast("bigint")).otherwise(state["master_port"])


def is_synced(state: Column, leader_port: Column) -> Column:
    """True if the link is up and leads to `leader_port`."""
    return F.coalesce((state["link"] == "up") & (state["master_port"] == leader_port), F.lit(False))


def live_role(state: Column, port: Column, leader_port: Column) -> Column:
    """The role a node really has; `leader_port` is 0 or null when no coordinator knows a leader."""
    known = F.coalesce(leader_port, F.lit(0)) > 0
    return (
        F.when(state.isNull(), "unreachable")
        .when((state["role"] == "master") & known & (port != leader_port), "isolated")
        .when(state["role"] == "master", "master")
        .when(state["role"] == "slave", "replica")
        .otherwise(state["role"])
    )


def replicating_from(state: Column) -> Column:
    """``host:port (link)`` for followers, else ``-``."""
    return F.when(
        state["role"] == "slave",
        F.format_string("%s:%d (%s)", state["master_host"], state["master_port"], state["link"]),
    ).otherwise("-")


def is_chained(state: Column, leader_port: Column) -> Column:
    """True for a follower of some node other than the known leader."""
    return F.coalesce(
        (state["role"] == "slave") & (leader_port > 0) & (state["master_port"] != leader_port),
        F.lit(False),
    )
