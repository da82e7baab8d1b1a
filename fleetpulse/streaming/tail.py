"""Command tails that follow the leader, with leadership as state between batches.

One stream carries commands and coordinators' replies (`both`). What is known of leadership is kept
by cluster: the replies of the newest poll, which others may still add to; the run of the leader of
the polls before it; and the runs that ended within `keep` before that poll. A batch extends these
from its own replies alone, so that its work does not grow with history.

* A command before its cluster's newest poll is decided: it counts if its node led then.
* A command at or after it waits, at most until other clusters are known `patience` further; the last
  leader then counts.
* A command older than all runs that are kept comes too late to be decided here. It goes to the results
  marked `late`, and `commands_now` judges it, as those that wait, by intervals it is given.
* A reply to a poll before the newest one comes too late and changes nothing.
"""

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import seconds
from fleetpulse.operators.convergence import leader_commands
from fleetpulse.operators.ordered import following, previous
from fleetpulse.operators.sizing import written
from fleetpulse.operators.topology import leader_answers
from fleetpulse.streaming import running

COMMAND = ["ts", "seq", "node", "cluster", "line"]
#: `kind` is wait (a command), reply (to the newest poll), run (of a leader, `ts` to `to_ts`) or cut (runs before `ts` are gone).
TAIL_STATE = "kind string, cluster string, ts timestamp_ntz, seq bigint, node string, line string, ord int, port bigint, to_ts timestamp_ntz"
_FIELDS = [f.split(" ")[0] for f in TAIL_STATE.split(", ")]


def both(commands: DataFrame, view: DataFrame) -> DataFrame:
    """One stream of commands and coordinators' replies on leaders."""
    replies = view.where(F.col("kind") == "master").select(F.lit("reply").alias("what"), *view.columns)
    return commands.select(F.lit("command").alias("what"), *COMMAND).unionByName(replies, allowMissingColumns=True)


def _state(rows: DataFrame, kind: str) -> DataFrame:
    have = rows.columns
    types = dict(f.split(" ") for f in TAIL_STATE.split(", "))
    return rows.select(F.lit(kind).alias("kind"), *[(F.col(c) if c in have else F.lit(None).cast(types[c])).alias(c) for c in _FIELDS[1:]])


def _seconds(text: str) -> Column:
    return F.make_dt_interval(secs=F.lit(seconds(text)).cast("decimal(18,6)"))


def _led(batch: DataFrame, before: DataFrame, keep: str) -> tuple[DataFrame, ...]:
    """After a batch: replies of the newest polls, runs of leaders, the time from which runs are kept, the
    newest poll by cluster (`known_to`), and those runs that are kept."""
    told = F.when(F.col("told"), F.col("port"))
    new = leader_answers(batch.where("what = 'reply'")).select("cluster", F.col("poll_ts").alias("ts"), "ord", told.alias("port"))
    open_polls = before.where("kind = 'reply'").select("cluster", "ts", "ord", "port")
    since = open_polls.groupBy("cluster").agg(F.max("ts").alias("since"))
    new = new.join(since, "cluster", "left").where(F.col("since").isNull() | (F.col("ts") >= F.col("since"))).drop("since")
    replies = written(new.unionByName(open_polls).where("ts IS NOT NULL"), "tail-replies")
    known = replies.groupBy("cluster").agg(F.max("ts").alias("known_to"))
    replies = replies.join(known, "cluster")
    newest = replies.where(F.col("ts") == F.col("known_to")).select("cluster", "ts", "ord", "port").dropDuplicates()
    first = F.min_by("port", F.when(F.col("port").isNotNull(), F.col("ord")))
    polls = replies.groupBy("cluster", "ts").agg(first.alias("port")).where("port IS NOT NULL")
    runs = before.where("kind = 'run'").select("cluster", "ts", "port", "to_ts")
    # The run at hand is one more poll, the first.
    polls = written(polls.unionByName(runs.where("to_ts IS NULL").drop("to_ts")), "tail-polls")
    changes = previous(polls, ["cluster"], ["ts"], ["port"])
    changes = written(changes.where(F.col("prev").isNull() | (F.col("prev.port") != F.col("port"))).select("cluster", "ts", "port"), "tail-changes")
    ends = following(changes, ["cluster"], ["ts"], ["ts"]).select("cluster", "ts", "port", F.col("next.ts").alias("to_ts"))
    runs = ends.unionByName(runs.where("to_ts IS NOT NULL")).join(known, "cluster")
    # What the newest poll says is not settled: what it began or ended goes on as it was before.
    settled = runs.where(F.col("ts") < F.col("known_to")).withColumn("to_ts", F.when(F.col("to_ts") < F.col("known_to"), F.col("to_ts")))
    gone = F.coalesce(F.col("to_ts") < F.col("known_to") - _seconds(keep), F.lit(False))
    cuts = before.where("kind = 'cut'").select("cluster", "ts").unionByName(settled.where(gone).select("cluster", F.col("to_ts").alias("ts")))
    return newest, runs, cuts.groupBy("cluster").agg(F.max("ts").alias("ts")), known, settled.where(~gone)


def tail_step(batch: DataFrame, before: DataFrame, nodes, patience: str, keep: str):
    """The commands of leaders that a batch decides, with `late`; see `follow_leader`."""
    newest, runs, cuts, known, kept = _led(batch, before, keep)
    old_cuts = before.where("kind = 'cut'").select("cluster", F.col("ts").alias("cut"))
    names = nodes(batch.sparkSession).groupBy("cluster", "port").agg(F.min("name").alias("node"))
    intervals = runs.join(names, ["cluster", "port"]).select("cluster", "node", F.col("ts").alias("from_ts"), "to_ts")
    rows = batch.where("what = 'command'").select(*COMMAND).unionByName(before.where("kind = 'wait'").select(*COMMAND))
    at_least = known.agg(F.max("known_to")).scalar() - _seconds(patience)
    rows = rows.join(known.join(old_cuts, "cluster", "left"), "cluster", "left")
    rows = written(rows.withColumn("known_to", F.greatest("known_to", at_least)), "tail-commands")
    early = F.col("ts").isNotNull() & F.coalesce(F.col("ts") >= F.col("known_to"), F.lit(True))
    late = F.coalesce(F.col("ts") < F.col("cut"), F.lit(False))
    decided = leader_commands(rows.where(~early & ~late).select(*COMMAND), intervals).withColumn("late", F.lit(False))
    out = decided.unionByName(rows.where(~early & late).select(*COMMAND, F.lit(True).alias("late")))
    after = [_state(rows.where(early), "wait"), _state(newest, "reply"), _state(kept, "run"), _state(cuts, "cut")]
    return out, after[0].unionByName(after[1]).unionByName(after[2]).unionByName(after[3])


def follow_leader(nodes, patience: str = "60s", keep: str = "1h"):
    """`tail_step`, to run over `both` with `running.run_steps` and `TAIL_STATE`; `nodes` takes the session
    and returns the inventory as it is at that batch."""
    return partial(tail_step, nodes=nodes, patience=patience, keep=keep)


def commands_now(spark: SparkSession, path: str, intervals: DataFrame) -> DataFrame:
    """All commands of leaders so far. Those that wait or came late are judged by `intervals`."""
    rows = running.results(spark, path)
    waiting = running.current(spark, path).where("kind = 'wait'").select(*COMMAND)
    open_ones = waiting.unionByName(rows.where("late").select(*COMMAND))
    return rows.where("not late").select(*COMMAND).unionByName(leader_commands(open_ones, intervals))
