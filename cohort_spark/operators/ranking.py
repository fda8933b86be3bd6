"""Exact places and running totals in groups of any size.

Rows are dealt to ranges of (group, value), as for a global sort, and written
with the number of their range.  The totals of a group's ranges make a small
table, whose running sum says where each range starts; a window then runs
within one range only, so no task ever holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.sources.stages import stage

_RANGE, _START, _SIZE, _ALL = "__range", "__start", "__size", "__all"


def _quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{name}`") for name in names]


@dataclass(frozen=True)
class Ranges:
    """``rows`` with the range they lie in; ``starts``: for each group and range
    the weight before it, its own weight and that of the whole group."""

    rows: DataFrame
    starts: DataFrame
    group: tuple[str, ...]
    by: tuple[str, ...]
    weight: str | None

    def with_before(self, starts: DataFrame | None = None) -> DataFrame:
        """Rows with ``__before``, the weight of the group's earlier rows, and ``__all``.

        ``starts`` may hold a part of the ranges; only their rows are read on.
        """
        starts = self.starts if starts is None else starts
        keys = [F.col(f"`{name}`").alias(f"__group_{i}") for i, name in enumerate(self.group)]
        starts = starts.select(F.col(_RANGE).alias("__at"), *keys, _START, _ALL)
        same = self.rows[_RANGE] == starts["__at"]
        for i, name in enumerate(self.group):
            same = same & self.rows[f"`{name}`"].eqNullSafe(starts[f"__group_{i}"])
        earlier = (Window.partitionBy(_RANGE, *_quoted(self.group)).orderBy(*_ordered(self.by))
                   .rowsBetween(Window.unboundedPreceding, -1))
        here = F.coalesce(F.sum(_weight(self.weight)).over(earlier), F.lit(0))
        return (self.rows.join(starts, same)
                .withColumn("__before", F.col(_START) + here)
                .drop("__at", _RANGE, _START, *[f"__group_{i}" for i in range(len(self.group))]))


def _weight(weight: str | None) -> Column:
    return F.lit(1).cast("long") if weight is None else F.col(f"`{weight}`")


def _ordered(by: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_last(f"`{name}`") for name in by]


def ranges(df: DataFrame, group: Sequence[str], by: Sequence[str], weight: str | None = None,
           parts: int | None = None) -> Ranges:
    """Deal ``df`` to ranges of its groups in the order of ``by``, missing values last.

    ``weight`` names whole numbers to sum; without it each row counts one.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *[F.asc_nulls_last(f"`{g}`") for g in group], *_ordered(by))
    rows = stage(dealt.withColumn(_RANGE, F.spark_partition_id()), "ranges")
    sizes = rows.groupBy(*_quoted(group), _RANGE).agg(F.sum(_weight(weight)).alias(_SIZE))
    whole = Window.partitionBy(*_quoted(group))
    earlier = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*_quoted(group), _RANGE, _SIZE,
                          F.coalesce(F.sum(_SIZE).over(earlier), F.lit(0)).alias(_START),
                          F.sum(_SIZE).over(whole).alias(_ALL))
    return Ranges(rows, stage(starts, "range_starts"), tuple(group), tuple(by), weight)


def exact_quantiles(counts: DataFrame, col: str, times: str, probs: Sequence[float],
                    group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Interpolated quantiles of ``col``, each value weighing ``times``, by selection.

    A quantile lies between the values at two neighbouring places; only the
    ranges that hold such a place are read on.
    """
    places = [(F.floor((F.col(_ALL) - 1) * float(p)), (F.col(_ALL) - 1) * float(p)) for p in probs]
    dealt = ranges(counts, group, [col], times)

    def covers(first: Column, size: Column) -> list[tuple[Column, Column]]:
        return [((low >= first) & (low < first + size), (low + 1 >= first) & (low + 1 < first + size))
                for low, _ in places]

    wanted = None
    for pair in covers(F.col(_START), F.col(_SIZE)):
        for test in pair:
            wanted = test if wanted is None else wanted | test
    rows = dealt.with_before(dealt.starts.where(wanted))
    value = F.col(f"`{col}`").cast("double")
    picks = []
    for i, (low, high) in enumerate(covers(F.col("__before"), F.col(f"`{times}`"))):
        picks += [F.max(F.when(low, value)).alias(f"__low_{i}"), F.max(F.when(high, value)).alias(f"__high_{i}")]
    found = rows.groupBy(*_quoted(group)).agg(F.max(_ALL).alias(_ALL), *picks)
    out = []
    for i, ((low, place), name) in enumerate(zip(places, names)):
        near, far = F.col(f"__low_{i}"), F.col(f"__high_{i}")
        out.append((near + F.coalesce(far - near, F.lit(0.0)) * (place - low)).alias(name))
    return found.select(*_quoted(group), *out)


def id_pages(df: DataFrame, group: Sequence[str], col: str, size: int = 10_000,
             name: str = "ids") -> DataFrame:
    """Sorted ids of each group as pages (group, page, n, ids) of at most ``size`` ids.

    Pages count from 0 and are full but for a group's last; a missing id comes
    last, equal ids stand side by side.
    """
    if size < 1:
        raise ValueError("a page holds one id at least")
    rows = ranges(df.select(*_quoted(group), F.col(f"`{col}`")), group, [col]).with_before()
    page = F.floor(F.col("__before") / size).cast("long")
    held = F.array_sort(F.collect_list(F.struct(F.col("__before").alias("at"), F.col(f"`{col}`").alias("id"))))
    return (rows.groupBy(*_quoted(group), page.alias("page"))
            .agg(F.count("*").alias("n"), F.transform(held, lambda row: row["id"]).alias(name)))
