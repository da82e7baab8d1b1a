"""String builders for names, addresses and label keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def instance_name(cluster: Column, port: Column, prefix: str = "fleet") -> Column:
    return F.format_string(f"{prefix}-%s-%d", cluster, port)


def coordinator_name(port: Column, prefix: str = "fleet") -> Column:
    return F.format_string(f"{prefix}-sentinel-%d", port)


def probe_name(cluster: Column, prefix: str = "fleet") -> Column:
    return F.format_string(f"{prefix}-workload-%s", cluster)


def addr(host: Column, port: Column) -> Column:
    return F.format_string("%s:%d", host, port)


def target_uri(name: Column, port: Column) -> Column:
    return F.format_string("redis://%s:%s", name, port.cast("string"))


def label_key(label: Column) -> Column:
    """A container label's name to its discovery label."""
    return F.concat(
        F.lit("__meta_docker_container_label_"), F.regexp_replace(label, "[^a-zA-Z0-9_]", "_")
    )
