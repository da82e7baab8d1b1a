"""Schemas of the logical tables. Readers use them as they are; nothing is inferred."""

PROBE_LOG = (
    "seq bigint, ts timestamp_ntz, cluster string, role string, replica string, dur_s double, "
    "err string, net_timeout boolean, raw string"
)
NODE_LABELS = "id string, names array<string>, labels map<string,string>, status string"
NODE_SNAPSHOT = (
    "name string, cluster string, role_label string, status string, version int, port bigint, "
    "info_text string"
)
COORDINATOR_VIEW = (
    "poll_ts timestamp_ntz, ord int, coordinator string, version int, cluster string, "
    "kind string, ok boolean, kv array<string>"
)
TRIGGER_LOG = "seq bigint, ts timestamp_ntz, cluster string, trig string, ok boolean"
LIFECYCLE_STATE = "cluster string, state string"
METRIC_SAMPLE = "metric string, labels map<string,string>, ts timestamp_ntz, value double"
DISCOVERED_TARGET = "labels map<string,string>"
COMMAND_LOG = "ts timestamp_ntz, seq bigint, node string, cluster string, line string"
