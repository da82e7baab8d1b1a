"""Scalar functions. Each takes and returns Spark columns; none uses a Python UDF."""

from fleetpulse.functions.lifecycle import command_for, initial_state, priority_for, step_mark, version_group
from fleetpulse.functions.names import (
    addr,
    coordinator_name,
    instance_name,
    label_key,
    probe_name,
    target_uri,
)
from fleetpulse.functions.numbers import atoi, atoi_or_zero, parse_duration, parse_port_range, seconds
from fleetpulse.functions.probe import error_kind, format_value, op_status, parse_value
from fleetpulse.functions.reports import (
    is_chained,
    is_synced,
    kv_get,
    live_role,
    replicating_from,
    replication_state,
    replication_target,
)

__all__ = [
    "addr", "atoi", "atoi_or_zero", "command_for", "coordinator_name", "error_kind", "format_value",
    "initial_state", "instance_name", "is_chained", "is_synced", "kv_get", "label_key", "live_role",
    "op_status", "parse_duration", "parse_port_range", "parse_value", "priority_for", "probe_name",
    "replicating_from", "replication_state", "replication_target", "seconds", "step_mark",
    "target_uri", "version_group",
]
