"""Joins and carries along time: overlapping intervals, the row before, and the state at an event.

Time is cut in buckets, so that a busy key is spread over the tasks that its buckets go to, and no task sorts a key's whole
history. What a bucket needs from earlier ones is carried by a second level that has one row for each bucket of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MICROS_A_DAY = 86_400_000_000
#: Each level's buckets are so many times as wide as those below it; an interval is held where it covers at most REACH + 1.
GROWTH, REACH, LEVELS = 4, 8, 12
MOST = 1 << 62


def micros(at: str | Column) -> Column:
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def _wide(level: Column, days: float) -> Column:
    width = int(days * MICROS_A_DAY)
    return F.element_at(F.array(*[F.lit(min(width * GROWTH**k, MOST)) for k in range(LEVELS)]), level + 1)


def _timed(df: DataFrame, key: str, start: str, end: str, days: float) -> DataFrame:
    """(key, row, from, to, own): the rows that can overlap others, with the level that their length gives them."""
    width = int(days * MICROS_A_DAY)
    own = F.size(F.filter(F.array(*[F.lit(min(width * GROWTH**k * REACH, MOST)) for k in range(LEVELS - 1)]), lambda most: F.col("to") - F.col("from") > most))
    timed = df.select(F.col(key).alias("key"), F.struct(*df.columns).alias("row"), micros(start).alias("from"), micros(end).alias("to"))
    return timed.where("key is not null and from <= to").withColumn("own", own)


def _highest(df: DataFrame) -> int:
    """The widest level that any row has; none is placed beyond it."""
    return df.agg(F.max("own")).first()[0] or 0


def _placed(timed: DataFrame, side: str, last: int, days: float, covered: bool) -> DataFrame:
    """Every row as struct _<side> on its own level and wider ones up to `last`: in each bucket that it covers, or in that where it starts."""
    levels = timed.withColumn("level", F.explode(F.sequence("own", F.greatest("own", F.lit(last))))).withColumn("wide", _wide(F.col("level"), days))
    first, final = F.floor(F.col("from") / F.col("wide")), F.floor(F.col("to") / F.col("wide"))
    bucket = F.explode(F.sequence(first, final)) if covered else first
    return levels.select("key", "level", bucket.alias("bucket"), F.struct("row", "from", "to", "own").alias(f"_{side}"))


def _later(earlier: DataFrame, later: DataFrame, days: float, highest: tuple[int, int], ties: bool) -> DataFrame:
    """The pairs whose second row starts after the first one does, or with it if `ties`, and before that ends."""
    a, b = _placed(earlier, "a", highest[1], days, True), _placed(later, "b", highest[0], days, False)
    after = F.col("_a.from") <= F.col("_b.from") if ties else F.col("_a.from") < F.col("_b.from")
    level = F.greatest("_a.own", "_b.own") == F.col("level")
    return a.join(b, ["key", "level", "bucket"]).where(level & after & (F.col("_b.from") <= F.col("_a.to")))


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str, end: str, days: float = 30, ordered: bool = False) -> DataFrame:
    """(left, right): structs of all rows with one key whose closed intervals from start to end have a time in common, each pair
    once; if `ordered`, only those where the left one starts no later than the right one. Rows with a null key, start or end, or
    that end before they start, overlap nothing.

    Intervals meet in buckets of time: of `days`, or for long ones of wider levels, so that no interval is copied for more than
    REACH + 1 buckets of a level, and a key's rows are compared only where they are near. A pair meets in the bucket, on
    the wider one's level, where the later of the two starts; so the later one is in one bucket of a level, and no level is
    used that is wider than the longest interval needs.
    """
    a, b = _timed(left, key, start, end, days), _timed(right, key, start, end, days)
    most = _highest(a)
    highest = (most, most if right is left else _highest(b))
    met = _later(a, b, days, highest, True).select(F.col("_a.row").alias("left"), F.col("_b.row").alias("right"))
    if ordered:
        return met
    other = _later(b, a, days, highest[::-1], False)
    return met.unionByName(other.select(F.col("_b.row").alias("left"), F.col("_a.row").alias("right")))


def _bucketed(df: DataFrame, at: str, days: float) -> DataFrame:
    return df.withColumn("_at", micros(at)).withColumn("_bucket", F.floor(F.col("_at") / int(days * MICROS_A_DAY)))


def carried(buckets: DataFrame, key: str) -> DataFrame:
    """buckets (_key, _bucket, _last) with _before: the last value of an earlier bucket of the key that has one."""
    earlier = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return buckets.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)).select("_key", "_bucket", "_before")


def previous(df: DataFrame, key: str, at: str, tie: str, days: float = 30) -> DataFrame:
    """df with previous: a struct of the row before it of its key, in order of time and tie; null for the first. Null keys are
    one key; rows without a time come before all others.

    Within a bucket the row before is a lag; a bucket's first row gets the last one of the bucket before, of which each has one.
    """
    row, order = F.struct(*df.columns), [F.col("_at").asc_nulls_first(), F.col(tie).asc_nulls_first()]
    timed = _bucketed(df.withColumn("_row", row), at, days)
    last = timed.groupBy(F.col(key).alias("_key"), "_bucket").agg(F.max_by("_row", F.struct("_at", tie)).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(W.partitionBy("_key").orderBy(F.col("_bucket").asc_nulls_first()))).drop("_last")
    within = timed.withColumn("_lag", F.lag("_row").over(W.partitionBy(key, "_bucket").orderBy(*order)))
    met = within.join(before.withColumnRenamed("_bucket", "_b"), F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return met.select(*df.columns, F.coalesce("_lag", "_before").alias("previous"))


def as_of(events: DataFrame, states: DataFrame, key: str, at: str, tie: str, days: float = 1) -> DataFrame:
    """events with state: a struct of the key's newest row of states that is no later than the event; null if there is none.

    Of states of one time that with the greatest tie counts (a null tie is the least). Rows of either with a null key or time
    have or are no state. Events and states go through time together; a state is carried on within its bucket, and to later
    buckets by one row for each bucket of a key.
    """
    own = lambda df, kind, state: df.select(F.col(key).alias("_key"), micros(at).alias("_at"), F.lit(kind).alias("_kind"), *state)
    event, state = F.struct(*events.columns), F.struct(*states.columns)
    event_type, state_type = events.select(event.alias("x")).schema["x"].dataType, states.select(state.alias("x")).schema["x"].dataType
    tie_type = states.schema[tie].dataType
    rows = own(states, 0, [F.col(tie).alias("_tie"), state.alias("_state"), F.lit(None).cast(event_type).alias("_event")])
    rows = rows.where("_key is not null and _at is not null")
    rows = rows.unionByName(own(events, 1, [F.lit(None).cast(tie_type).alias("_tie"), F.lit(None).cast(state_type).alias("_state"), event.alias("_event")]))
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") / int(days * MICROS_A_DAY)))
    known = rows.where("_key is not null and _at is not null")
    buckets = known.groupBy("_key", "_bucket").agg(F.max_by("_state", F.when(F.col("_kind") == 0, F.struct("_at", "_tie"))).alias("_last"))
    so_far = W.partitionBy("_key", "_bucket").orderBy("_at", "_kind", F.col("_tie").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    met = known.withColumn("_now", F.last("_state", ignorenulls=True).over(so_far)).where("_kind = 1").join(carried(buckets, key), ["_key", "_bucket"], "left")
    out = met.select("_event", F.coalesce("_now", "_before").alias("state"))
    rest = rows.where("_kind = 1 and (_key is null or _at is null)").select("_event", F.lit(None).cast(state_type).alias("state"))
    return out.unionByName(rest).select("_event.*", "state")
