"""Global order statistics without a single-partition window.

``Window.orderBy(x)`` with no partition key sends every row to one task. The
helpers here instead range-partition on the order key, checkpoint the
partition ids, add up each partition's total (one row per partition, so the
offset table is bounded by the partition count and safe to broadcast) and run
the running sum inside each partition. The result is an exact global running
sum, rank or midrank, and exact quantiles per group, at any skew: a hot group
is spread over several range partitions like any other run of keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.plans.runtime import bounded_broadcast, reliable_checkpoint, shuffle_partitions, small_side

_PID = "_ll_pid"


def _order_cols(order: Sequence) -> list[Column]:
    cols = []
    for o in order:
        if isinstance(o, str):
            cols.append(F.col(o).asc_nulls_last())
        elif isinstance(o, tuple):
            name, ascending = o
            cols.append(F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last())
        else:
            cols.append(o)
    return cols


def ordered_prefix(df: DataFrame, order: Sequence, sums: dict[str, Column],
                   inclusive: bool = True, partitions: int | None = None,
                   partition_by: Sequence[str] = (), totals: dict[str, str] | None = None) -> DataFrame:
    """Add running sums over a total order of ``df``, restarting per
    ``partition_by`` group.

    ``order``: column names (ascending), ``(name, ascending)`` pairs or Columns;
    callers include a tiebreak so the order is total. ``sums`` maps output
    name to the expression summed. ``inclusive`` counts the row itself.
    ``totals`` maps a sum name to an output column holding its group total.

    Rows are range-partitioned on (group, order); the per-(partition, group)
    totals table has at most partitions + groups rows, so the offsets of
    each partition within its group come from a small window over it.
    """
    spark = df.sparkSession
    n = partitions or shuffle_partitions(spark)
    by = list(partition_by)
    keep = df.columns
    weights = {name: f"_ll_w{i}" for i, name in enumerate(sums)}
    staged = df.select("*", *[expr.alias(weights[name]) for name, expr in sums.items()])
    ocols = _order_cols(order)
    ranged = (staged.repartitionByRange(n, *[F.col(b).asc_nulls_last() for b in by], *ocols)
                    .withColumn(_PID, F.spark_partition_id()))
    ranged = reliable_checkpoint(ranged)

    part_tot = ranged.groupBy(_PID, *by).agg(*[F.sum(w).alias(w) for w in weights.values()])
    grp = Window.partitionBy(*by)
    before = grp.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_tot.select(
        _PID, *by,
        *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"{w}_off") for w in weights.values()],
        *[F.sum(weights[s]).over(grp).alias(out) for s, out in (totals or {}).items()])
    if not by:
        offsets = bounded_broadcast(offsets, n, "partition offsets")

    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(_PID, *by).orderBy(*ocols).rowsBetween(Window.unboundedPreceding, end)
    joined = ranged.join(offsets, [_PID, *by])
    return joined.select(
        *keep,
        *[(F.col(f"{w}_off") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(name)
          for name, w in weights.items()],
        *[F.col(out) for out in (totals or {}).values()])


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Non-null values with their multiplicity (per group): the input of every
    rank and quantile. ``weight`` names a column of multiplicities when the
    rows have been counted before."""
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(times.alias("_c"))


def midranks(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Average ranks (ties share the mean rank) of ``value`` within each
    ``by`` group (or overall). Returns (by..., value, _c, midrank, _n); one
    row per distinct value (per group); _n is the group size."""
    vc = value_counts(df, value, by, weight)
    pre = ordered_prefix(vc, [value], {"_before": F.col("_c")}, inclusive=False, partition_by=by,
                         totals={"_before": "_n"})
    return pre.select(*by, value, "_c", (F.col("_before") + (F.col("_c") + 1) / F.lit(2.0)).alias("midrank"), "_n")


def attach_midranks(df: DataFrame, value: str, out: str, by: Sequence[str] = (), weight: str | None = None,
                    size: str | None = None, ties: str | None = None) -> DataFrame:
    """``df`` with the midrank of ``value`` (its average rank within the ``by``
    group, over ``weight`` copies of each row) written beside every row, the
    group's size as ``size`` and the weight of the row's value in the group as
    ``ties``. Rows with a null value are dropped.

    Nothing is joined on a value. Rows are range-partitioned on (group, value,
    hash of the row), so a value that many rows share goes to several
    partitions; inside one, a frame over the value's peers gives running and
    tied weights. Each partition reports its total and its first and last
    value with their weights: a table of at most partitions + groups rows that
    gives offsets, and the whole weight of values that straddle a border.
    Repeated rows have one hash: count them first and pass ``weight``.
    """
    spark = df.sparkSession
    by, keep = list(by), df.columns
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    rows = df.where(F.col(value).isNotNull()).withColumn("_ll_w", w)
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in keep])
    ranged = rows.repartitionByRange(shuffle_partitions(spark), *by, value, spread).withColumn(_PID, F.spark_partition_id())
    part = Window.partitionBy(_PID, *by)
    # the place of a row follows from its own columns, so the ids stay if a task runs again
    placed = reliable_checkpoint(ranged.select(
        *keep, _PID, "_ll_w", F.sum("_ll_w").over(part.orderBy(value)).alias("_ll_le"),
        F.sum("_ll_w").over(Window.partitionBy(_PID, *by, value)).alias("_ll_tie")))

    ends = placed.groupBy(_PID, *by).agg(F.sum("_ll_w").alias("t"), F.min(F.struct(F.col(value).alias("v"), "_ll_tie")).alias("lo"),
                                         F.max(F.struct(F.col(value).alias("v"), "_ll_tie")).alias("hi"))
    order = Window.partitionBy(*by).orderBy(_PID)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("off", F.coalesce(F.sum("t").over(before), F.lit(0))).withColumn(
        "n", F.sum("t").over(Window.partitionBy(*by)))
    edge = ends.select(_PID, *by, "off", "n", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("e"))
    run = Window.partitionBy(*by, "e.v")
    edge = edge.select(_PID, *by, "off", "n", "e.v", F.sum("e._ll_tie").over(run).alias("all"), F.coalesce(
        F.sum("e._ll_tie").over(run.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("early"))
    edge = reliable_checkpoint(edge.groupBy(_PID, *by).agg(
        F.first("off").alias("_ll_off"), F.first("n").alias("_ll_n"),
        F.min(F.struct("v", "all", "early")).alias("_ll_a"), F.max(F.struct("v", "all")).alias("_ll_b")))
    joined = placed.join(small_side(edge), [_PID, *by])
    v, first, last = F.col(value), F.col("_ll_a"), F.col("_ll_b")
    less = F.col("_ll_off") + F.when(v == first["v"], -first["early"]).otherwise(F.col("_ll_le") - F.col("_ll_tie"))
    tied = F.when(v == first["v"], first["all"]).when(v == last["v"], last["all"]).otherwise(F.col("_ll_tie"))
    return joined.select(*keep, (less + (tied + 1) / F.lit(2.0)).alias(out),
                         *([F.col("_ll_n").alias(size)] if size else []), *([tied.alias(ties)] if ties else []))


SKETCH = 100_000        # accuracy of the bracketing sketch
MARGIN = 10             # bracket half-width in units of n / SKETCH: ten times the sketch's error
ORDERED = 1 << 16       # distinct values of a bracket that one task may order; a longer one is narrowed
PIVOTS = 32             # parts that a narrowing round cuts a bracket into


def grouped_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                      by: Sequence[str] = (), names: Sequence[str] | None = None,
                      weight: str | None = None, distinct: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation (position (n-1)p, as in
    pandas, Spark ``percentile`` and SQL ``quantile_cont``), one row per group.

    Selection without sorting: a sketch brackets each quantile, one aggregate
    counts what lies between the brackets and the distinct values inside, and
    rounds of pivots cut every bracket that holds more than ``ORDERED``
    distinct values to the part with the wanted position. So a task orders at
    most that many values, whatever a group's size, and the work after the
    first aggregate shrinks PIVOTS-fold a round. A counted table (``weight``)
    is one bracket a group; ``distinct`` says that it has each value of a group
    once and no null. Null/NaN-free input is the caller's concern.
    """
    names = list(names or [f"q{i}" for i in range(len(probs))])
    by = list(by)
    if weight is None:
        cells = _bracketed(df, value, probs, by)
    else:
        cells = (df.withColumnRenamed(weight, "_c") if distinct else value_counts(df, value, by, weight)).select(
            *(by or [F.lit(0).alias("_one")]), F.lit(0).cast("long").alias("_slot"), F.col(value).alias("_v"), "_c")
    return _covering(_narrowed(reliable_checkpoint(cells), probs, by or ["_one"]).withColumnRenamed("_v", value),
                     value, probs, by, names)


def _bracketed(df: DataFrame, value: str, probs: Sequence[float], by: list[str]) -> DataFrame:
    """(by, _slot, _v, _c): counts of the values inside the quantiles' brackets,
    and with a null _v of what follows a bracket up to the next."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    keys = by or ["_one"]
    if not by:
        rows = rows.withColumn("_one", F.lit(0))
    near = sorted(set(probs))
    at = [x for p in near for x in (max(0.0, p - MARGIN / SKETCH), min(1.0, p + MARGIN / SKETCH))]
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                   F.percentile_approx("_v", F.array(*map(F.lit, at)), SKETCH).alias("_a"))
    whole = F.col("_m") <= ORDERED
    ends = ends.select(
        *keys,
        *[F.when(whole | F.lit(p <= MARGIN / SKETCH), F.col("_lo")).otherwise(F.col("_a")[2 * i]).alias(f"_l{i}")
          for i, p in enumerate(near)],
        *[F.when(whole | F.lit(p >= 1 - MARGIN / SKETCH), F.col("_hi")).otherwise(F.col("_a")[2 * i + 1]).alias(f"_h{i}")
          for i, p in enumerate(near)])
    # one row a group: rows stay where they are instead of being sorted by group, a few keys to a few tasks
    joined = rows.join(small_side(reliable_checkpoint(ends)) if by else bounded_broadcast(ends, 1, "brackets"), keys)
    v = F.col("_v")
    slot = sum(((v >= F.col(f"_l{i}")).cast("long") for i in range(1, len(near))), (v >= F.col("_l0")).cast("long"))
    inside = F.lit(False)
    for i in range(len(near)):
        inside = inside | ((v >= F.col(f"_l{i}")) & (v <= F.col(f"_h{i}")))
    return joined.groupBy(*keys, slot.alias("_slot"), F.when(inside, v).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def _holds(probs: Sequence[float], before: Column, inside: Column, n: Column) -> Column:
    """Whether a wanted position lies among ``inside`` rows after ``before``."""
    out = F.lit(False)
    for p in probs:
        h = (n - 1).cast("double") * F.lit(float(p))
        for at in (F.floor(h), F.ceil(h)):
            out = out | ((before <= at) & (at < before + inside))
    return out


def _narrowed(cells: DataFrame, probs: Sequence[float], keys: list[str]) -> DataFrame:
    """(keys, _v, _c, _before, _n) of the values in the slots that hold a wanted
    position, each slot cut to at most ORDERED distinct values."""
    inside = F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(F.lit(0)))
    slots = cells.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_t"), inside.alias("_in"), F.count("_v").alias("_vals"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*keys, "_slot", "_in", "_vals", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_low"),
                         F.sum("_t").over(group).alias("_n"))
    live = reliable_checkpoint(slots.where(_holds(probs, F.col("_low"), F.col("_in"), F.col("_n"))))
    cells = cells.where(F.col("_v").isNotNull())
    longest, n_live = live.agg(F.max("_vals"), F.count(F.lit(1))).first()
    while (longest or 0) > ORDERED:
        long = live.where(F.col("_vals") > ORDERED).select(*keys, "_slot")
        grid = F.array(*[F.lit((k + 1) / PIVOTS) for k in range(PIVOTS - 1)])
        pivots = cells.join(small_side(long, n_live), [*keys, "_slot"], "left_semi").groupBy(*keys, "_slot").agg(
            F.percentile_approx("_v", grid, 50 * PIVOTS).alias("_p"))
        cells = cells.join(small_side(live.select(*keys, "_slot", "_low", "_n"), n_live), [*keys, "_slot"]).join(
            small_side(reliable_checkpoint(pivots), n_live), [*keys, "_slot"], "left")
        part = F.coalesce(F.size(F.filter("_p", lambda x: x < F.col("_v"))), F.lit(0))
        cells = cells.withColumn("_old", F.col("_slot")).withColumn("_slot", F.col("_slot") * PIVOTS + part)
        parts = cells.groupBy(*keys, "_old", "_slot", "_low", "_n").agg(F.sum("_c").alias("_in"), F.count("_v").alias("_vals"))
        before = Window.partitionBy(*keys, "_old").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_low", F.col("_low") + F.coalesce(F.sum("_in").over(before), F.lit(0)))
        live = reliable_checkpoint(parts.where(_holds(probs, F.col("_low"), F.col("_in"), F.col("_n"))).drop("_old"))
        longest, n_live = live.agg(F.max("_vals"), F.count(F.lit(1))).first()
        cells = reliable_checkpoint(cells.select(*keys, "_slot", "_v", "_c").join(
            small_side(live.select(*keys, "_slot"), n_live), [*keys, "_slot"], "left_semi"))
    order = Window.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(small_side(live.select(*keys, "_slot", "_low", "_n"), n_live), [*keys, "_slot"]).select(
        *keys, "_v", "_c", (F.col("_low") + F.coalesce(F.sum("_c").over(order), F.lit(0))).alias("_before"), "_n")


def _covering(pre: DataFrame, value: str, probs: Sequence[float], by: list[str], names: list[str]) -> DataFrame:
    """Quantiles from values with their counts before; an error if a position
    is covered by no value (a bracket that missed)."""
    pos = F.col("_before")
    cover = []
    aggs = []
    for p, nm in zip(probs, names):
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        c_lo = (pos <= lo) & (lo < pos + F.col("_c"))
        c_hi = (pos <= hi) & (hi < pos + F.col("_c"))
        cover += [c_lo, c_hi]
        aggs += [F.max(F.when(c_lo, F.col(value))).alias(f"_{nm}_lo"),
                 F.max(F.when(c_hi, F.col(value))).alias(f"_{nm}_hi"),
                 F.first(h - lo).alias(f"_{nm}_d")]
    anyc = cover[0]
    for c in cover[1:]:
        anyc = anyc | c
    picked = pre.where(anyc).groupBy(*by).agg(*aggs)
    out = [F.col(b) for b in by]
    for nm in names:
        vlo, vhi, d = F.col(f"_{nm}_lo").cast("double"), F.col(f"_{nm}_hi").cast("double"), F.col(f"_{nm}_d")
        missed = F.col(f"_{nm}_d").isNotNull() & (vlo.isNull() | vhi.isNull())
        out.append(F.when(missed, F.raise_error(F.lit("a quantile bracket missed"))).when(d == 0, vlo)
                   .otherwise(vlo + d * (vhi - vlo)).alias(nm))
    return picked.select(*out)


def group_modes(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-null value per group, smallest value on ties.
    Two partial-aggregated levels: (group, value) counts, then ``min_by``."""
    vc = value_counts(df, value, by)
    key = F.struct((-F.col("_c")).alias("nc"), F.col(value).alias("v"))
    return vc.groupBy(*by).agg(F.min_by(F.col(value), key).alias("mode"))
