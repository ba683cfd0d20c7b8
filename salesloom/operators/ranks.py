"""Exact quantiles of groups of any size, without one group in one task.

Values are counted in cells between the least and the largest of a group; the cell that holds the rank becomes the new
range, until a range has few distinct values. Every round is one aggregation with partial sums, and what is gathered for a
group is bounded by the number of cells or by FEW.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from salesloom.session import stored

CELLS, FEW = 1024, 1024


def exact_quantiles(counts: DataFrame, keys: list[str], value: str, n: str, wanted: dict[str, tuple[int, int]]) -> DataFrame:
    """keys and one column per quantile: the least value that (p of q) of the group's rows do not exceed.

    counts: distinct (keys, value) with their numbers of rows n, written; no null values. Keys may be null.
    """
    v, rows = F.col(value), F.col(n)
    ranges = counts.groupBy(*keys).agg(F.sum(n).alias("_all"), F.min(value).alias("_low"), F.max(value).alias("_high"),
                                       F.count(F.lit(1)).alias("_distinct"))
    ranks = F.array(*[F.struct(F.lit(name).alias("_name"), F.expr(f"(_all * {p} + {of - 1}) DIV {of}").alias("_rank"))
                      for name, (p, of) in wanted.items()])
    targets = stored(ranges.select(*keys, "_low", "_high", "_distinct", F.inline(ranks)), "ranks").filter("_rank > 0")
    closed = targets.filter(F.col("_distinct") <= FEW)
    while not (far := targets.filter(F.col("_distinct") > FEW)).isEmpty():
        part = F.floor((v.cast("double") - F.col("_low").cast("double")) * (CELLS - 2) /
                       (F.col("_high").cast("double") - F.col("_low").cast("double")))
        # The ends have cells of their own, so every round makes the range smaller whatever the values are.
        cell = F.when(v == F.col("_low"), 0).when(v == F.col("_high"), CELLS - 1).otherwise(
            F.lit(1) + F.coalesce(F.greatest(F.least(part, F.lit(CELLS - 3)), F.lit(0)), F.lit(0)))
        cells = within(counts, far, keys, v).groupBy(*keys, "_name", "_rank", cell.alias("_cell")).agg(
            F.sum(rows).alias("_n"), F.min(v).alias("_low"), F.max(v).alias("_high"), F.count(F.lit(1)).alias("_distinct"))
        place = first_reaching(F.array_sort(F.collect_list(F.struct("_cell", "_n", "_low", "_high", "_distinct"))))
        found = cells.groupBy(*keys, "_name", "_rank").agg(place.alias("_p"))
        targets = stored(found.select(*keys, "_p.c._low", "_p.c._high", "_p.c._distinct", "_name",
                                      (F.col("_rank") - F.col("_p.before")).alias("_rank")), "ranks")
        closed = closed.unionByName(targets.filter(F.col("_distinct") <= FEW))
    last = within(counts, closed, keys, v).groupBy(*keys, "_name", "_rank").agg(
        first_reaching(F.array_sort(F.collect_list(F.struct(v.alias("v"), rows.alias("_n"))))).alias("_p"))
    return last.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_p.c.v"))).alias(name) for name in wanted])


def within(counts: DataFrame, targets: DataFrame, keys: list[str], v: Column) -> DataFrame:
    """Counts whose value lies in the range of a target of their group."""
    named = targets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return counts.join(named, same & v.between(F.col("_low"), F.col("_high"))).drop(*[f"_of_{k}" for k in keys])


def first_reaching(cells: Column) -> Column:
    """The first of ordered cells with which the running sum of _n reaches _rank, and the sum before it."""
    empty = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("before"), F.lit(-1).alias("i"), F.lit(0).alias("at"))

    def step(state: Column, c: Column) -> Column:
        here = (state["i"] < 0) & (state["sum"] + c["_n"] >= F.col("_rank"))
        return F.struct((state["sum"] + c["_n"]).alias("sum"), F.when(here, state["sum"]).otherwise(state["before"]).alias("before"),
                        F.when(here, state["at"]).otherwise(state["i"]).alias("i"), (state["at"] + 1).alias("at"))

    both = F.transform(F.array(cells), lambda all: F.struct(F.aggregate(all, empty, step).alias("s"), all.alias("all")))[0]
    return F.transform(F.array(both), lambda b: F.struct(b["s"]["before"].alias("before"), F.get(b["all"], b["s"]["i"]).alias("c")))[0]
