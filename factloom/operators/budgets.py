"""Two kinds of budget over ordered rows: stop at the first that does not fit, or skip
it and go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import stored


def prefix_cut(rows: DataFrame, order: str, size: str, most: int, buckets: int | None = None) -> DataFrame:
    """Rows, by ``order``, before the running total of ``size`` first exceeds ``most``.

    ``order`` is a unique number.  Only it and the size are sorted, in two levels (ranges
    of the order, then within a range), so no single task sorts all rows; what is found is
    the one number from which rows go, and the rows themselves are not moved.  A null size
    counts nothing.
    """
    narrow = rows.select(F.col(order).alias("_o"), F.coalesce(F.col(size), F.lit(0)).alias("_s"))
    ranged = stored((narrow.repartitionByRange(buckets, "_o") if buckets else narrow.repartitionByRange("_o")).withColumn("_b", F.spark_partition_id()))
    totals = ranged.groupBy("_b").agg(F.sum("_s").alias("_t"))
    before = totals.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_base"))  # a row for each range
    running = F.sum("_s").over(Window.partitionBy("_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0))
    full = ranged.withColumn("_run", running).join(F.broadcast(before), "_b")  # buckets rows
    first = full.where(F.col("_base") + F.col("_run") > most).agg(F.min("_o")).first()[0]
    return rows if first is None else rows.where(F.col(order) < F.lit(first))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with _at, a different number for each row that rises with ``order`` (nulls
    first), and _b, the range it lies in: at most one for each shuffle partition.

    Written once, so that every later read sees the same numbers.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return stored(ranged.withColumn("_b", F.shiftright("_at", 33)))


def greedy_fit(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """group, taken and spent: within each group, rows by ``order`` are taken if they fit
    into what is left, else skipped.  Sizes are integers of 0 or more (a negative one fails
    the run); a null size never fits.

    No task holds a group.  In each round, of the later rows no larger than what is left,
    those of up to half of it are sure to be taken until their running total (made in two
    levels, over ranges and within one) exceeds half, or until a larger row fits beside
    them.  Up to there a group is decided, and less than half is left to it; so rounds grow
    with the logarithm of ``most`` and not with the rows.
    """
    held = F.struct(F.col(group).alias("g"))  # a null group is a group too
    long = F.col(size).cast("bigint")
    checked = F.when(long < 0, F.raise_error(F.lit("a size is negative")).cast("bigint")).otherwise(long)
    at = placed(rows.select(held.alias("_g"), F.col(order).alias("_o"), checked.alias("_s")), "_g", "_o", "_s")
    pairs = stored(at.select("_g", "_b").distinct())
    zero = F.lit(0).cast("bigint")
    state = stored(pairs.groupBy("_g").agg(F.lit(most).cast("bigint").alias("_left"), zero.alias("_taken"), F.lit(-1).cast("bigint").alias("_from")))
    done = []
    while True:
        # A row for each range of a group, so that no key of the join has a whole group.
        now = pairs.join(state, "_g")
        later = at.join(now, ["_g", "_b"]).where((F.col("_at") > F.col("_from")) & (F.col("_s") <= F.col("_left")))
        small = F.col("_s") * 2 <= F.col("_left")
        later = later.withColumn("_small", F.when(small, F.col("_s")).otherwise(0)).withColumn("_one", small.cast("bigint"))
        totals = later.groupBy("_g", "_b").agg(F.sum("_small").alias("_t"), F.sum("_one").alias("_n"))
        before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        base = totals.select("_g", "_b", F.coalesce(F.sum("_t").over(before), zero).alias("_t"), F.coalesce(F.sum("_n").over(before), zero).alias("_n"))
        above = Window.partitionBy("_g", "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        run = later.select("_g", "_b", "_at", "_s", "_left", "_one", F.sum("_small").over(above).alias("_rt"), F.sum("_one").over(above).alias("_rn")).join(base, ["_g", "_b"])
        run = run.withColumns({"_rt": F.col("_rt") + F.col("_t"), "_rn": F.col("_rn") + F.col("_n")})
        spent = F.when(F.col("_one") == 1, F.col("_rt")).otherwise(F.col("_rt") + F.col("_s"))
        decides = F.when(F.col("_one") == 1, F.col("_rt") * 2 > F.col("_left")).otherwise(spent <= F.col("_left"))
        taken = F.col("_rn") + 1 - F.col("_one")
        first = run.groupBy("_g").agg(F.min(F.when(decides, F.struct("_at", spent.alias("s"), taken.alias("n")))).alias("e"), F.max("_rt").alias("t"), F.max("_rn").alias("n"))
        after = stored(
            state.join(first, "_g", "left").select(
                "_g", (F.col("_left") - F.coalesce("e.s", "t", zero)).alias("_left"), (F.col("_taken") + F.coalesce("e.n", "n", zero)).alias("_taken"), F.coalesce("e._at", F.lit(-1)).alias("_from")
            )
        )
        done.append(after.where("_from < 0"))
        state = after.where("_from >= 0")
        if state.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out.select(F.col("_g.g").alias(group), F.col("_taken").alias("taken"), (F.lit(most) - F.col("_left")).cast("bigint").alias("spent"))
