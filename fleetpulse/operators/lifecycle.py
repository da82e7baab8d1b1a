"""Upgrade states: replay of triggers, order of states, and changes to the state table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.lifecycle import EDGES, INITIAL, literal_map
from fleetpulse.operators.ordered import CHUNK, cut

STATES = list(dict.fromkeys([s for s, _, _ in EDGES] + [d for _, _, d in EDGES]))


def after(state: Column, trig: Column) -> Column:
    """The next state; a trigger that the state does not allow changes nothing."""
    table = literal_map((f"{s}:{t}", d) for s, t, d in EDGES)
    return F.coalesce(F.try_element_at(table, F.concat(state, F.lit(":"), trig)), state)


def allowed(state: Column) -> Column:
    """The triggers a state allows, in order; an empty array at the end."""
    table = F.create_map(
        *[x for s in STATES for x in (
            F.lit(s), F.array(*[F.lit(t) for src, t, _ in EDGES if src == s]).cast("array<string>"),
        )]
    )
    return F.coalesce(F.try_element_at(table, state), F.array().cast("array<string>"))


def replay(triggers: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Each cluster's state after its triggers in order; `initial` holds (cluster, state) before.

    Failed triggers leave the state alone. A cluster's history is folded in one array while it is
    short. A long one is cut into chunks, each folded from every possible state at once. What a
    chunk does to each state is a small array; these are put together a thousand at a time, so no
    array grows with the history.
    """
    rows = triggers.where(F.col("ok") & F.col("trig").isin([t for _, t, _ in EDGES]))
    found = cut(rows.select("cluster", "ts", "seq", "trig"), ["cluster"], ["ts", "seq"], "foldRows")
    rows = found.rows
    history = F.array_sort(F.collect_list(F.struct("ts", "seq", "trig"))).alias("steps")

    def fire(state: Column, step: Column) -> Column:
        return after(state, step["trig"])

    def through(state: Column, step: Column) -> Column:
        return F.coalesce(F.get(step["ends"], F.array_position(starts, state).cast("int") - 1), state)

    def from_every_state(next_state) -> Column:
        each = F.aggregate("steps", starts, lambda acc, x: F.transform(acc, lambda s: next_state(s, x)))
        return each.alias("ends")

    starts = F.array(*[F.lit(s) for s in STATES])
    in_order = F.array_sort(F.collect_list(F.struct(CHUNK, "ends"))).alias("steps")
    if found.chunked:
        parts = rows.groupBy("cluster", CHUNK).agg(history).select("cluster", CHUNK, from_every_state(fire))
        spans = parts.groupBy("cluster", F.floor(F.col(CHUNK) / 1000).alias("_span")).agg(in_order)
        spans = spans.select("cluster", F.col("_span").alias(CHUNK), from_every_state(through))
        folded, next_state = spans.groupBy("cluster").agg(in_order), through
    else:
        folded, next_state = rows.groupBy("cluster").agg(history), fire
    start = F.lit(INITIAL)
    if initial is not None:
        folded = folded.join(initial.select("cluster", F.col("state").alias("start")), "cluster", "left")
        start = F.coalesce("start", start)
    return folded.select("cluster", F.aggregate("steps", start, next_state).alias("state"))


def state_order(spark: SparkSession) -> DataFrame:
    """The states by distance from the first, walked over the edges."""
    edges = ", ".join(f"('{s}', '{d}')" for s, _, d in EDGES)
    return spark.sql(
        f"""
        WITH RECURSIVE edges(state, dest) AS (VALUES {edges}),
        walk(state, depth) AS (
            SELECT '{INITIAL}', 0
            UNION ALL
            SELECT e.dest, w.depth + 1 FROM walk w JOIN edges e ON e.state = w.state
            WHERE w.depth < {len(STATES)}
        )
        SELECT state, min(depth) AS depth FROM walk GROUP BY state
        """
    )


def with_state(clusters: DataFrame, states: DataFrame) -> DataFrame:
    """Add each cluster's stored state; a cluster without one is in the first state."""
    return clusters.join(states.select("cluster", "state"), "cluster", "left").withColumn(
        "state", F.coalesce("state", F.lit(INITIAL))
    )


def upsert_states(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The state table after `changes` (cluster, state)."""
    kept = current.join(changes.select("cluster"), "cluster", "left_anti")
    return kept.select("cluster", "state").unionByName(changes.select("cluster", "state"))


def drop_states(current: DataFrame, gone: DataFrame) -> DataFrame:
    """The state table without the given clusters; one that is not there is no error."""
    return current.join(gone.select("cluster"), "cluster", "left_anti")
