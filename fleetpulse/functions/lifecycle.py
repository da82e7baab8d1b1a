"""The upgrade lifecycle as columns: states, triggers, marks, commands and priorities."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lifecycle's edges as (state, trigger, next state), the state of a cluster
# without any record, and the last state.
EDGES = [
    ("AllV6", "AddV8Instance", "MixedVersions"),
    ("MixedVersions", "Failover", "FailoverComplete"),
    ("FailoverComplete", "BreakReplication", "ReplicationBroken"),
    ("ReplicationBroken", "DestroyV6", "V6Destroyed"),
    ("V6Destroyed", "AddV8Sentinels", "V8SentinelsAdded"),
    ("V8SentinelsAdded", "RemoveV6Sentinels", "Done"),
]
INITIAL = "AllV6"
DONE = "Done"

# The command that fires each trigger; "{tool}" is the name of the operator's
# command-line tool.
COMMANDS = {
    "AddV8Instance": "{tool} instance add <cluster> --version=8",
    "Failover": "{tool} sentinel failover <cluster>",
    "BreakReplication": "{tool} cluster isolate-v6-replicas <cluster>",
    "DestroyV6": "{tool} instance rm <last v6 instance>   (auto-advances)",
    "AddV8Sentinels": "{tool} sentinel bootstrap --version=8",
    "RemoveV6Sentinels": "{tool} sentinel rm <last v6 sentinel>   (auto-advances)",
}
V8_PRIORITY, V6_PRIORITY = 1, 100


def literal_map(pairs) -> Column:
    """A constant map column from (key, value) pairs."""
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def version_group(version: Column) -> Column:
    """Version 6 is v6; every other version counts as v8."""
    return F.when(version == 6, "v6").otherwise("v8")


def initial_state(version: Column) -> Column:
    """The state of a newly created cluster."""
    return F.when(version == 6, INITIAL).otherwise(DONE)


def priority_for(version: Column) -> Column:
    """The promotion priority of a follower while both versions are present; lower is preferred."""
    return F.when(version == 6, V6_PRIORITY).otherwise(V8_PRIORITY)


def step_mark(position: Column, current: Column) -> Column:
    return (
        F.when(position < current, "done").when(position == current, "current").otherwise("pending")
    )


def command_for(trigger: Column, cluster: Column, tool: str = "fleet") -> Column:
    """The command that fires a trigger, with the cluster filled in; null for an unknown trigger."""
    commands = literal_map((t, c.format(tool=tool)) for t, c in COMMANDS.items())
    return F.replace(F.try_element_at(commands, trigger), F.lit("<cluster>"), cluster)
