"""Rates, increases, grids and label matching over sampled series.

A series is a metric with its whole label set, which the column `SERIES` stands for. Rates, grids
and "now" are taken per series; sums by some of the labels come after.
"""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import micros, seconds
from fleetpulse.operators.ordered import CHUNK, following, previous
from fleetpulse.operators.probes import latest

SERIES = "series"


def series_id() -> Column:
    """128 bits for a whole label set, whatever the order of its entries; an empty label is none."""
    entries = F.filter(F.map_entries("labels"), lambda e: e["value"] != "")
    return F.md5(F.coalesce(F.to_json(F.array_sort(entries)), F.lit("[]")))


def promote(samples: DataFrame, metric: str, labels: list[str]) -> DataFrame:
    """One metric with its `SERIES` and the given labels as columns; a missing label is null."""
    return samples.where(F.col("metric") == metric).select(
        *[F.try_element_at("labels", F.lit(name)).alias(name) for name in labels],
        series_id().alias(SERIES), "ts", "value",
    )


def match(df: DataFrame, label: str, op: str, value: str) -> DataFrame:
    """Keep rows whose label column equals `value` (``=``) or wholly matches it (``=~``).

    A missing label counts as empty.
    """
    text = F.coalesce(F.col(label), F.lit(""))
    if op == "=":
        # The plain comparison can be pushed into the scan.
        return df.where(F.col(label) == value) if value else df.where(text == "")
    if op == "=~":
        return df.where(text.rlike(rf"^(?:{value})\z"))
    raise ValueError(f"unknown matcher {op!r}")


def _steps_until(us: Column, step: int) -> Column:
    """The number of the first step at or after an instant in micros since the epoch.

    The division is exact enough: micros fit a double, and a step is at least a microsecond.
    """
    return F.ceil(us / F.lit(step)).cast("bigint")


def _us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _at(step_number: Column, step: int) -> Column:
    return F.timestamp_micros(step_number * step).cast("timestamp_ntz")


def pairs(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring samples of a series with the increase between them.

    A fall means that the counter restarted: then the new value is the increase. The column
    `CHUNK` is kept for grouping in place.
    """
    step = F.when(F.col("value") >= F.col("prev.value"), F.col("value") - F.col("prev.value"))
    return (
        previous(samples, keys, ["ts", "value"], ["ts", "value"], keep_chunk=True)
        .where(F.col("prev").isNotNull())
        .select(*keys, CHUNK, "ts", F.col("prev.ts").alias("prev_ts"), F.col("prev.value").alias("prev_value"),
                step.otherwise(F.col("value")).alias("increase"))
    )


def increase(samples: DataFrame, keys: list[str], grain: str) -> DataFrame:
    """A counter's increase per calendar unit (``hour``, ``day``); a pair counts where it ends."""
    return (
        pairs(samples, keys)
        .groupBy(*keys, F.date_trunc(grain, F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"))
        .agg(F.sum("increase").alias("increase"))
    )


def rate(
    samples: DataFrame, keys: list[str], window: str = "1m", step: str = "15s", extrapolate: bool = False
) -> DataFrame:
    """Per-second increase over ``(t - window, t]`` at each step `t`; `keys` must name a series.

    A pair of samples counts where both lie in the window, so a row needs two samples. For a pair
    those steps form one run, from the first step at or after the later sample to the last step
    less than a window after the earlier one. Pairs with the same run are summed first, where they
    are; only then is the run spread over its steps. With `extrapolate` the increase between the
    first and the last sample is carried on to the window's edges (see `_carried_on`).
    """
    w, s = micros(window), micros(step)
    first = _steps_until(_us(F.col("ts")), s)
    last = _steps_until(_us(F.col("prev_ts")) + w, s) - 1
    sums = [F.sum("increase").alias("increase")]
    more = []
    if extrapolate:
        more = ["pairs", "head", "tail"]
        sums += [F.sum("pairs").alias("pairs"), F.min("head").alias("head"), F.max("tail").alias("tail")]
    head = F.struct(_us(F.col("prev_ts")).alias("us"), F.col("prev_value").alias("value"))
    spans = pairs(samples, keys).select(
        *keys, CHUNK, "increase", first.alias("first"), last.alias("last"),
        F.lit(1).alias("pairs"), head.alias("head"), _us(F.col("ts")).alias("tail"),
    )
    runs = spans.where(F.col("first") <= F.col("last")).groupBy(CHUNK, *keys, "first", "last").agg(*sums)
    steps = (
        runs.select(*keys, "increase", *more, F.explode(F.sequence("first", "last")).alias("n"))
        .groupBy(*keys, "n")
        .agg(*sums)
    )
    total = F.col("increase") * _carried_on(F.col("n") * s, w) if extrapolate else F.col("increase")
    return steps.select(*keys, _at(F.col("n"), s).alias("ts"), (total / seconds(window)).alias("rate"))


def _carried_on(t: Column, window: int) -> Column:
    """What to multiply the increase by, so that it covers all of ``(t - window, t]``.

    As publicly documented for instant rates: up to an edge that is less than 1.1 mean sample
    distances away, else by half a distance; and back no further than to where the counter was 0.
    """
    start, tail = F.col("head.us"), F.col("tail")
    covered = (tail - start).cast("double")
    mean = covered / F.col("pairs")

    def gap(us: Column) -> Column:
        return F.when(us >= 1.1 * mean, mean / 2).otherwise(us.cast("double"))

    grew = (F.col("increase") > 0) & (F.col("head.value") >= 0)
    since_zero = F.when(grew, covered * F.col("head.value") / F.nullif(F.col("increase"), F.lit(0.0)))
    whole = covered + F.least(gap(start - (t - window)), since_zero) + gap(t - tail)
    return F.coalesce(whole / F.nullif(covered, F.lit(0.0)), F.lit(1.0))


def sum_by(df: DataFrame, labels: list[str], value: str, at: list[str] | None = None) -> DataFrame:
    """The sum by label, per instant. Rates are summed after they are taken, never before."""
    return df.groupBy(*labels, *(at or [])).agg(F.sum(value).alias(value))


def ops_per_step(log: DataFrame, keys: list[Column | str], step: str = "15s") -> DataFrame:
    """Operations per step; `first` is the step's number. Works on streams too."""
    first = _steps_until(_us(F.col("ts")), micros(step)).alias("first")
    return log.groupBy(*keys, first).agg(F.count("*").alias("ops"))


def rate_of_counts(per_step: DataFrame, window: str = "1m", step: str = "15s") -> DataFrame:
    """Operations per second over ``(t - window, t]`` from `ops_per_step`: each count is added to
    the steps it belongs to. `window` must be a multiple of `step`."""
    w, s = micros(window), micros(step)
    if w % s:
        raise ValueError("window must be a multiple of step")
    names = [c for c in per_step.columns if c not in ("first", "ops")]
    spread = F.sequence(F.col("first"), F.col("first") + (w // s - 1))
    return (
        per_step.select(*names, "ops", F.explode(spread).alias("n"))
        .groupBy(*names, "n")
        .agg((F.sum("ops") / seconds(window)).alias("rate"))
        .select(*names, _at(F.col("n"), s).alias("ts"), "rate")
    )


def op_rate(log: DataFrame, keys: list[Column | str], window: str = "1m", step: str = "15s") -> DataFrame:
    """Operations per second over ``(t - window, t]`` straight from the log, counted per step first."""
    return rate_of_counts(ops_per_step(log, keys, step), window, step)


def resample(samples: DataFrame, keys: list[str], step: str = "15s", stale_after: str | None = "5m") -> DataFrame:
    """The value of each series at each step: the last sample at or before it.

    From the step of the first sample to the step of the last one; a gap is filled no longer than
    `stale_after` (None: wholly). Samples are reduced to the last one per step before neighbours are
    compared.
    """
    s = micros(step)
    per_step = latest(
        samples.withColumn("n", _steps_until(_us(F.col("ts")), s)), [*keys, "n"], ["value"], ["ts"]
    )
    ahead = following(per_step.withColumn("at", _at(F.col("n"), s)).drop("ts"), keys, ["at"], ["n"])
    until = F.coalesce(F.col("next.n") - 1, F.col("n"))
    if stale_after:
        until = F.least(until, F.col("n") + micros(stale_after) // s)
    return ahead.select(*keys, "value", F.explode(F.sequence(F.col("n"), until)).alias("n")).select(
        *keys, _at(F.col("n"), s).alias("ts"), "value"
    )


def recent(samples: DataFrame, look_back: str = "5m", at: datetime | None = None) -> DataFrame:
    """Samples of ``(at - look_back, at]``; `at` is by default the newest sample's time.

    A series without such a sample is gone. Of dated samples only the folders needed are read.
    """
    if at is None:
        return retain(samples, look_back)
    oldest = at - timedelta(seconds=seconds(look_back))
    young = samples.where((F.col("ts") > F.lit(oldest)) & (F.col("ts") <= F.lit(at)))
    return young.where(F.col("date").between(oldest.date(), at.date())) if "date" in samples.columns else young


def instant(
    samples: DataFrame, metric: str, labels: list[str], look_back: str = "5m", at: datetime | None = None
) -> DataFrame:
    """The value now of each series of a metric (see `recent`), a row for each whole label set."""
    series = promote(recent(samples, look_back, at), metric, labels)
    return latest(series, [*labels, SERIES], ["value"], ["ts"]).select(*labels, "value")


def subtract(
    samples: DataFrame, left: str, right: str, on: list[str] | None = None, labels: list[str] | None = None,
    look_back: str = "5m", at: datetime | None = None,
) -> DataFrame:
    """`left` now minus `right` now, where both exist: a row for each series of `right`, with `labels`.

    Without `on` the whole label sets must be equal, and both sides come out of one aggregation.
    With `on` one `left` series stands against all `right` series of the same labels; `lefts` says
    how many there were, and the value is null where they were several.
    """
    labels = labels or on or []
    both = recent(samples, look_back, at).where(F.col("metric").isin(left, right)).select(
        "metric", "ts", "value", series_id().alias(SERIES),
        *[F.try_element_at("labels", F.lit(n)).alias(n) for n in dict.fromkeys([*(on or []), *labels])]
    )
    if on is None:
        def last(metric: str) -> Column:
            return F.max_by("value", F.when(F.col("metric") == metric, F.col("ts")))

        sides = both.groupBy(*labels, SERIES).agg(last(left).alias("_left"), last(right).alias("_right"))
        return sides.where(F.col("_left").isNotNull() & F.col("_right").isNotNull()).select(
            *labels, (F.col("_left") - F.col("_right")).alias("value")
        )
    keys = dict.fromkeys([*on, *labels])
    now = latest(both, ["metric", *keys, SERIES], ["value"], ["ts"])
    lefts = now.where(F.col("metric") == left).groupBy(*on).agg(
        F.count("*").alias("lefts"), F.max("value").alias("_left")
    )
    difference = F.when(F.col("lefts") == 1, F.col("_left") - F.col("value"))
    return now.where(F.col("metric") == right).join(lefts, on).select(*labels, difference.alias("value"), "lefts")


def retain(df: DataFrame, retention: str = "2h", ts: str = "ts") -> DataFrame:
    """Rows younger than `retention`, measured from the latest row.

    Where the rows have a `date`, as stored samples do, the latest row is looked for in the last
    date's folder only, and older folders than needed are not read.
    """
    age = F.make_dt_interval(secs=F.lit(seconds(retention)).cast("decimal(18,6)"))
    dated = "date" in df.columns
    last = df.where(F.col("date") == df.agg(F.max("date")).scalar()) if dated else df
    oldest = last.agg(F.max(ts).alias("newest")).select(F.col("newest") - age).scalar()
    young = df.where(F.col(ts) > oldest)
    return young.where(F.col("date") >= oldest.cast("date")) if dated else young
