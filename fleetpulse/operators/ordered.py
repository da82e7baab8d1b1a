"""Looking back and ahead along time within a key, without giving a hot key to one task.

A window over a key needs all its rows in one task. Here the rows are first measured, and a key
with too many is cut into chunks that follow each other in time:

* a key within the limit is one chunk, a plain window;
* a key above it is cut by the hour, again one shuffle, as long as the hour is within the limit;
* the rows of a key's hour above the limit (a third of all rows may share one instant), and these
  alone, go through a range partitioning on key and order, whose pieces are about equal whatever the
  skew, and which is written once so that the pieces stay fixed.

All three are united: a key may have quiet hours and hot ones. Keys and hours above the limit are
few, at most all rows over the limit, and the rows are told by a join with them that is a broadcast
while they are counted small.

Within a chunk a window finds the nearest row. What it cannot see, the last value of the chunks
before, comes from one row per key and chunk, which a partial aggregation makes small before
anything is shuffled.
"""

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.operators.sizing import few, limit_of, written

CHUNK = "_chunk"
CELL_SECONDS = 3600
# Pieces of an hour are numbered below this; their chunks lie between those of the hours around.
PIECES = 1 << 20


@dataclass(frozen=True)
class Cut:
    """Rows with their `CHUNK`, whether a key may have several, and whether a key may be null."""

    rows: DataFrame
    chunked: bool
    null_keys: bool


def cut(
    df: DataFrame, keys: list[str], order: list[str], limit: str = "rowsPerTask", measure: DataFrame | None = None
) -> Cut:
    """Tag rows with a chunk.

    `order` must start with a timestamp and end the ties. `measure` may give rows that are cheaper
    to count: at least those of `df`, with the keys and the timestamp.
    """
    measure = df if measure is None else measure
    most = limit_of(df.sparkSession, limit)
    hour = F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / (CELL_SECONDS * 1_000_000))
    per_hour = measure.groupBy(*keys, hour.alias(CHUNK)).agg(F.count("*").alias("rows"))
    per_key = per_hour.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.max("rows").alias("peak"))
    missing = reduce(or_, [F.col(k).isNull() for k in keys])
    size = per_key.agg(
        F.coalesce(F.bool_or(missing), F.lit(False)).alias("null_keys"),
        F.coalesce(F.max("rows"), F.lit(0)).alias("key"),
        F.coalesce(F.max("peak"), F.lit(0)).alias("hour"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("all"),
    ).first()
    if size["key"] <= most:
        return Cut(df.withColumn(CHUNK, F.lit(0).cast("bigint")), False, size["null_keys"])
    marked = _mark(df, per_key.where(F.col("rows") > most), keys, "_hot")
    chunk = F.when(F.col("_hot"), hour * PIECES).otherwise(0).cast("bigint")
    if size["hour"] <= most:
        return Cut(marked.withColumn(CHUNK, chunk).drop("_hot"), True, size["null_keys"])
    heavy = per_hour.where(F.col("rows") > most)
    marked = _mark(marked.withColumn(CHUNK, hour), heavy, [*keys, CHUNK], "_heavy").withColumn(CHUNK, chunk)
    quiet = marked.where(~F.col("_heavy")).drop("_hot", "_heavy")
    rest = marked.where("_heavy").drop("_hot", "_heavy")
    many = heavy.agg(F.sum("rows")).first()[0]
    pieces = rest.repartitionByRange(-(-many // most) + 1, *keys, *order)
    pieces = written(pieces.withColumn(CHUNK, F.col(CHUNK) + F.spark_partition_id()), "ordered")
    return Cut(quiet.unionByName(pieces), True, size["null_keys"])


def _mark(df: DataFrame, few_rows: DataFrame, on: list[str], name: str) -> DataFrame:
    """`df` with the boolean `name`: whether a row's `on`, nulls included, is among the counted ones."""
    table = written(few_rows.select(*[F.col(c).alias(f"_of_{c}") for c in on], F.lit(True).alias(name)), "hot")
    if few(table):
        table = F.broadcast(table)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on])
    return df.join(table, same, "left").select(*df.columns, F.coalesce(name, F.lit(False)).alias(name))


@dataclass(frozen=True)
class Look:
    """What to look for: the nearest non-null `value` at or before a row, as column `out`.

    With ``inclusive=False`` the row itself does not count; with ``ahead=True`` the search goes
    forward in time. To find values that may be null, use a struct.
    """

    out: str
    value: Column
    inclusive: bool = True
    ahead: bool = False


def look(
    df: DataFrame, keys: list[str], order: list[str], *looks: Look,
    measure: DataFrame | None = None, keep_chunk: bool = False,
) -> DataFrame:
    """Add the columns of all `looks`, which share one measuring (see `cut`) and one shuffle.

    With `keep_chunk` the column `CHUNK` stays: rows are partitioned by it and the keys, so that
    grouping by both needs no further shuffle.
    """
    sources = {f"_source{i}": x for i, x in enumerate(looks)}
    kept = [*df.columns, CHUNK] if keep_chunk else df.columns
    found = cut(df.withColumns({c: x.value for c, x in sources.items()}), keys, order, measure=measure)
    rows = found.rows

    def nearest(c: str, first: list[str], by: list[str], x: Look, last: int) -> Column:
        way = [F.col(b).desc() if x.ahead else F.col(b).asc() for b in by]
        frame = Window.partitionBy(*first).orderBy(*way).rowsBetween(Window.unboundedPreceding, last)
        return F.last(c, ignorenulls=True).over(frame)

    def inside(c: str, x: Look, first: list[str]) -> Column:
        return nearest(c, first, order, x, 0 if x.inclusive else -1)

    if not found.chunked:
        return rows.select(*kept, *[inside(c, x, keys).alias(x.out) for c, x in sources.items()])

    def end(c: str, x: Look) -> Column:
        last = F.when(F.col(c).isNotNull(), F.struct(*order, c))
        return (F.min(last) if x.ahead else F.max(last))[c].alias(f"{c}_end")

    ends = rows.groupBy(CHUNK, *keys).agg(*[end(c, x) for c, x in sources.items()])
    beyond = ends.select(
        *[F.col(k).alias(f"_beyond_{k}") for k in [CHUNK, *keys]],
        *[nearest(f"{c}_end", keys, [CHUNK], x, -1).alias(f"{c}_beyond") for c, x in sources.items()],
    )
    near = rows.select("*", *[inside(c, x, [CHUNK, *keys]).alias(f"{c}_near") for c, x in sources.items()])
    # Plain equality keeps the partitioning of the rows; only null keys need the other one.
    same = [
        F.col(k).eqNullSafe(F.col(f"_beyond_{k}")) if found.null_keys else F.col(k) == F.col(f"_beyond_{k}")
        for k in [CHUNK, *keys]
    ]
    joined = near.join(beyond, reduce(and_, same), "left")
    return joined.select(
        *kept, *[F.coalesce(f"{c}_near", f"{c}_beyond").alias(x.out) for c, x in sources.items()]
    )


def previous(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str],
    measure: DataFrame | None = None, keep_chunk: bool = False,
) -> DataFrame:
    """Add the struct `prev` with `cols` of the row before; null for the first row of a key."""
    before = Look("prev", F.struct(*cols), inclusive=False)
    return look(df, keys, order, before, measure=measure, keep_chunk=keep_chunk)


def following(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Add the struct `next` with `cols` of the row after; null for the last row of a key."""
    return look(df, keys, order, Look("next", F.struct(*cols), inclusive=False, ahead=True))
