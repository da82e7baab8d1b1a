"""How leadership moves, who led when, and how long a condition takes to hold."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import seconds
from fleetpulse.operators.ordered import Look, following, look, previous
from fleetpulse.operators.sizing import few, written
from fleetpulse.operators.topology import leader_answers

# How long each condition may take.
LIMITS = {"ready": "30s", "synced": "30s", "visible": "30s", "priorities": "30s", "failover": "60s"}

# Beyond this many times of leadership per node, comparing each command with all of them costs
# more than sorting.
RUNS_PER_NODE = 64


def leader_changes(view: DataFrame) -> DataFrame:
    """The polls at which a cluster's leader differs from the poll before, the first one included."""
    first = F.min_by("port", F.when(F.col("told"), F.col("ord")))
    polls = leader_answers(view).groupBy("cluster", "poll_ts").agg(first.alias("port"))
    polls = polls.where(F.col("port").isNotNull())
    # Written, so that the replies are read and taken apart once.
    steps = previous(written(polls, "polls"), ["cluster"], ["poll_ts"], ["port"])
    return steps.where(F.col("prev").isNull() | (F.col("prev.port") != F.col("port"))).select(
        "cluster", "poll_ts", "port", F.col("prev.port").alias("prev_port")
    )


def leader_intervals(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Who led from when to when, by node name; `to_ts` is null while it lasts."""
    runs = following(written(changes, "changes"), ["cluster"], ["poll_ts"], ["poll_ts"]).select(
        "cluster", "port", F.col("poll_ts").alias("from_ts"), F.col("next.poll_ts").alias("to_ts")
    )
    names = nodes.groupBy("cluster", "port").agg(F.min("name").alias("node"))
    return runs.join(names, ["cluster", "port"]).select("cluster", "node", "from_ts", "to_ts")


def disjoint(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals `[from_ts, to_ts)` of a key put together where they overlap or touch.

    `to_ts` is null while one lasts. Empty intervals and null keys hold nothing and are left out."""
    given = intervals.where(F.col("to_ts").isNull() | (F.col("from_ts") < F.col("to_ts"))).dropna(subset=[*keys, "from_ts"])
    order = Window.partitionBy(*keys).orderBy("from_ts", F.col("to_ts").desc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lasts = F.coalesce(F.max(F.col("to_ts").isNull()).over(before), F.lit(False))
    apart = ~lasts & F.coalesce(F.col("from_ts") > F.max("to_ts").over(before), F.lit(True))
    runs = given.withColumn("_apart", apart.cast("int"))
    runs = runs.withColumn("_run", F.sum("_apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(
        F.min("from_ts").alias("from_ts"),
        F.when(~F.max(F.col("to_ts").isNull()), F.max("to_ts")).alias("to_ts"),
    ).drop("_run")


def leader_commands(commands: DataFrame, intervals: DataFrame, apart: bool = False) -> DataFrame:
    """Commands of the node that led its cluster when they ran.

    With `apart` the intervals of a node are known not to overlap, as those of `leader_intervals` are, which
    follow each other in a cluster; else they are made so.

    Leadership moves seldom, so the intervals are written and counted, and
    broadcast while they are few, in all and per node: the commands, the large side, are then not
    shuffled. Beyond that, commands and the ends of leadership are put in one order per node and
    each command looks back. Both ways give the same rows.
    """
    key = ["cluster", "node"]
    runs = written(intervals if apart else disjoint(intervals, key), "intervals")
    per_node = runs.groupBy(*key).agg(F.count("*").alias("n"))
    size = per_node.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("node")).first()
    if size["node"] <= RUNS_PER_NODE and few(runs, size["all"]):
        inside = (F.col("ts") >= F.col("from_ts")) & (F.col("to_ts").isNull() | (F.col("ts") < F.col("to_ts")))
        led = F.broadcast(runs.withColumnsRenamed({"cluster": "l_cluster", "node": "l_node"}))
        same = (F.col("cluster") == F.col("l_cluster")) & (F.col("node") == F.col("l_node"))
        return commands.join(led, same & inside, "left_semi")
    ends = runs.where(F.col("to_ts").isNotNull()).select(*key, F.col("to_ts").alias("ts"), F.lit(0).alias("rank"))
    starts = runs.select(*key, F.col("from_ts").alias("ts"), F.lit(1).alias("rank"))
    rows = commands.dropna(subset=[*key, "ts"]).withColumn("rank", F.lit(2))
    rows = rows.unionByName(starts.unionByName(ends), allowMissingColumns=True)
    now = Look("now", F.when(F.col("rank") < 2, F.struct(F.col("rank").alias("mark"))))
    seen = look(rows, key, ["ts", "rank", "seq"], now)
    return seen.where((F.col("rank") == 2) & (F.col("now.mark") == 1)).select(*commands.columns)


def time_to(starts: DataFrame, polls: DataFrame, keys: list[str], limit: str) -> DataFrame:
    """For each start (keys, `id`, `ts`) the first poll (keys, `ts`) at or after it, within `limit`.

    `polls` are those at which the condition holds. Starts without one in time are kept and marked.
    Each start looks ahead in one common order; pairs of starts and polls are never formed.
    """
    rows = starts.select(*keys, "ts", F.lit(0).alias("rank"), "id").unionByName(
        polls.select(*keys, "ts", F.lit(1).alias("rank"), F.lit(None).cast("bigint").alias("id"))
    )
    met = Look("met", F.when(F.col("rank") == 1, F.struct("ts")), ahead=True)
    # Written, so that what finds the condition runs once.
    seen = look(written(rows, "polls"), keys, ["ts", "rank", "id"], met)
    waited = F.unix_micros(F.col("met.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    in_time = waited <= round(seconds(limit) * 1_000_000)
    return seen.where(F.col("rank") == 0).select(
        *keys, "id", "ts",
        F.when(in_time, waited).alias("waited_us"),
        (~F.coalesce(in_time, F.lit(False))).alias("timed_out"),
    )


def failover_outcome(requests: DataFrame, view: DataFrame, nodes: DataFrame, limit: str = LIMITS["failover"]) -> DataFrame:
    """What became of each failover request (cluster, `id`, `ts`): promoted port and time taken.

    While the cluster has a v8 node besides the leader, only a v8 leader counts; else any new one.
    A request needs the next v8 leader that is not the one it started from. So every v8 start of
    leadership also knows the next one on another port, and one look ahead is enough.
    """
    facts = nodes.groupBy("cluster", "port").agg(F.max(F.col("version") != 6).alias("v8"))
    moves = written(leader_changes(view), "changes").join(facts, ["cluster", "port"], "left").select(
        "cluster", F.col("poll_ts").alias("ts"), "port", F.coalesce("v8", F.lit(False)).alias("v8")
    )
    v8_moves = previous(moves.where("v8"), ["cluster"], ["ts"], ["port"])
    moved = F.when(F.col("prev").isNull() | (F.col("prev.port") != F.col("port")), F.struct("ts", "port"))
    v8_moves = look(v8_moves, ["cluster"], ["ts"], Look("other", moved, inclusive=False, ahead=True))
    marks = moves.select("cluster", "ts", "port", "v8").join(
        v8_moves.select("cluster", "ts", "other"), ["cluster", "ts"], "left"
    )
    marks = written(marks, "marks")

    rows = marks.withColumn("rank", F.lit(1)).unionByName(
        requests.select("cluster", "ts", "id", F.lit(2).alias("rank")), allowMissingColumns=True
    )
    # A request at the instant of a poll sees that poll as the past.
    order = ["ts", "rank", "id"]
    is_move = F.col("rank") == 1
    rows = look(
        rows, ["cluster"], order,
        Look("old", F.when(is_move, F.struct("port", "v8"))),
        Look("any_new", F.when(is_move, F.struct("ts", "port")), ahead=True),
        Look("v8_new", F.when(is_move & F.col("v8"), F.struct("ts", "port", "other")), ahead=True),
    )
    candidates = facts.groupBy("cluster").agg(F.count_if("v8").alias("v8_nodes"))
    asked = rows.where(F.col("rank") == 2).join(candidates, "cluster", "left")
    others = F.coalesce("v8_nodes", F.lit(0)) - F.coalesce(F.col("old.v8").cast("int"), F.lit(0))
    another = F.coalesce(F.col("v8_new.port") != F.col("old.port"), F.lit(True))
    target = F.when(
        others > 0,
        F.when(another, F.struct("v8_new.ts", "v8_new.port")).otherwise(F.col("v8_new.other")),
    ).otherwise(F.struct("any_new.ts", "any_new.port"))
    asked = asked.withColumn("target", target)
    waited = F.unix_micros(F.col("target.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    in_time = F.coalesce(waited <= round(seconds(limit) * 1_000_000), F.lit(False))
    return asked.select(
        "cluster", "id", "ts", F.col("old.port").alias("old_port"),
        F.when(in_time, F.col("target.port")).alias("promoted_port"),
        F.when(in_time, waited).alias("waited_us"),
        (~in_time).alias("timed_out"),
    )
