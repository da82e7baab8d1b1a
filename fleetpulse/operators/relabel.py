"""Relabelling of discovered targets."""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One rule: ``keep`` drops rows that do not match; ``replace`` builds a label from captures."""

    source: tuple[str, ...] = ()
    regex: str = "(.*)"
    target: str = ""
    replacement: str = "$1"
    action: str = "replace"


def _short(replacement: str) -> str:
    """The long form of a group's number, ``${1}``, in the short one. A digit after it is escaped, so
    that it stays text."""
    return re.sub(r"\$\{([0-9]+)\}([0-9]?)", lambda m: f"${m[1]}" + (f"\\{m[2]}" if m[2] else ""), replacement)


def relabel(targets: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """Apply `rules` in order to the map column `labels`; other columns are passed on.

    Source labels are joined by ``;``, a missing one being empty. Patterns must match the whole
    text. A replacement that is empty removes the label; without a match nothing changes. With
    `keep`, those labels become columns in place of the map.
    """
    changed: dict[str, Column] = {}
    kept = F.lit(True)

    def label(name: str) -> Column:
        return changed.get(name, F.coalesce(F.try_element_at("labels", F.lit(name)), F.lit("")))

    for rule in rules:
        text = F.concat_ws(";", *[label(s) for s in rule.source]) if rule.source else F.lit("")
        pattern = rf"^(?s:{rule.regex})\z"
        if rule.action == "keep":
            kept = kept & text.rlike(pattern)
        elif rule.action == "replace":
            if (rule.regex, _short(rule.replacement)) == ("(.*)", "$1"):
                changed[rule.target] = text
            else:
                made = F.regexp_replace(text, pattern, _short(rule.replacement))
                changed[rule.target] = F.when(text.rlike(pattern), made).otherwise(label(rule.target))
        else:
            raise ValueError(f"unknown action {rule.action!r}")

    rows = targets.where(kept)
    if keep is not None:
        return rows.select(
            *[c for c in rows.columns if c != "labels"],
            *[F.nullif(label(n), F.lit("")).alias(n) for n in keep],
        )
    rest = F.map_filter("labels", lambda k, _: ~k.isin(list(changed))) if changed else F.col("labels")
    made = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in changed.items()])
    made = F.map_from_entries(F.filter(made, lambda e: e["value"] != ""))
    return rows.withColumn("labels", F.map_concat(rest, made) if changed else rest)


def instance_rules(prefix: str = "fleet", exporter: str = "fleet-redis-exporter:9121") -> list[Rule]:
    """Data-plane nodes, scraped through one shared exporter."""
    meta = f"__meta_docker_container_label_{prefix}_"
    return [
        Rule((f"{meta}role",), "(master|replica)", action="keep"),
        Rule(("__meta_docker_network_name",), prefix, action="keep"),
        Rule((f"{meta}name", f"{meta}port"), "(.+);(.+)", "__param_target", "redis://$1:$2"),
        Rule(("__param_target",), target="instance"),
        Rule((f"{meta}name",), target="redis_instance"),
        Rule((f"{meta}cluster",), target="redis_cluster"),
        Rule((f"{meta}version",), target="redis_version_major"),
        Rule(target="__address__", replacement=exporter),
    ]


def probe_rules(prefix: str = "fleet") -> list[Rule]:
    """Probe containers, scraped directly."""
    return [
        Rule(("__meta_docker_network_name",), prefix, action="keep"),
        Rule(("__meta_docker_network_ip", f"__meta_docker_container_label_{prefix}_target_port"),
             "(.+);(.+)", "__address__", "$1:$2"),
        Rule((f"__meta_docker_container_label_{prefix}_cluster",), target="workload_cluster"),
    ]


def discovered_with(targets: DataFrame, label: str, value: str) -> DataFrame:
    """Discovered targets of containers with that label."""
    name = "__meta_docker_container_label_" + label.replace(".", "_")
    return targets.where(F.try_element_at("labels", F.lit(name)) == value)


def scrape_targets(targets: DataFrame, prefix: str = "fleet") -> DataFrame:
    """Final targets of both jobs. Without an instance label the address is the instance."""
    node_job = relabel(
        discovered_with(targets, f"{prefix}.managed", "true"), instance_rules(prefix),
        ["__address__", "__param_target", "instance", "redis_instance", "redis_cluster", "redis_version_major"],
    ).select(
        F.lit("redis-instances").alias("job"), F.col("__address__").alias("address"),
        F.col("__param_target").alias("param_target"), F.coalesce("instance", "__address__").alias("instance"),
        "redis_instance", "redis_cluster", "redis_version_major",
        F.lit(None).cast("string").alias("workload_cluster"),
    )
    probe_job = relabel(
        discovered_with(targets, f"{prefix}.role", "client-workload"), probe_rules(prefix),
        ["__address__", "workload_cluster"],
    ).select(
        F.lit("workload").alias("job"), F.col("__address__").alias("address"),
        F.lit(None).cast("string").alias("param_target"), F.col("__address__").alias("instance"),
        *[F.lit(None).cast("string").alias(c) for c in ("redis_instance", "redis_cluster", "redis_version_major")],
        "workload_cluster",
    )
    return node_job.unionByName(probe_job)
