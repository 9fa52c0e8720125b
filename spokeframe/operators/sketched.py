"""Exact quantiles of many columns in two scans: a sketch brackets each wanted rank, then one exact count.

The first scan merges a sketch per column. It tells for each quantile two values that
almost surely lie on either side of it, with a few thousandths of the rows between
them. The second scan counts rows exactly: those between brackets by bracket, those
inside by value. The counts prove whether a wanted rank lies in its bracket; one that
does not is looked for in the gap that holds it, with one more scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keeping import Keep, as_planned
from .quantiles import ranked

SIZE = 4096  #: of a sketch; one per column and task, some 80 KB
#: Share of the rows to either side of a wanted rank: four times the error that a sketch keeps with 99 %.
MARGIN = 4 * 2.446 / SIZE**0.9433
#: Up to so many rows all values count as inside the bracket.
FEW = 4 * math.ceil(1 / MARGIN)
TARGETS = "column long, prob double, upper boolean, fraction double, rank long, low double, high double, left long"


def summaries(table: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One row: per column ``of_<position>`` with rows, n, low, high and bounds; made in one scan.

    ``table`` has double columns without NaN. The last task merges one sketch per column and task.
    """
    columns = [f"v{i}" for i in range(len(table.columns))]
    measures = {"rows": lambda _: F.count(F.lit(1)), "n": F.count, "low": F.min, "high": F.max}
    wanted = F.array(*[F.lit(min(1.0, max(0.0, p + side * MARGIN))) for p in probs for side in (-1, 1)])
    aggregates = [m(F.col(c)).alias(f"{c}_{name}") for c in columns for name, m in measures.items()]
    aggregates += [F.kll_sketch_agg_double(F.col(c), F.lit(SIZE)).alias(f"{c}_sketch") for c in columns]

    def of(c: str) -> Column:
        bounds = F.when(F.col(f"{c}_n") > FEW, F.kll_sketch_get_quantile_double(f"{c}_sketch", wanted))
        fields = [F.col(f"{c}_{name}").alias(name) for name in measures]
        return F.struct(*fields, bounds.alias("bounds")).alias(f"of_{c[1:]}")

    return table.toDF(*columns).agg(*aggregates).select(*[of(c) for c in columns])


def _disjoint(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _counted(
    table: DataFrame, brackets: dict[int, list[tuple[float, float]]], sums: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Rows, and sums over values, per column, interval and, inside a bracket, value; one scan.

    Interval 2k+1 is the k-th bracket of the column, 2k what lies before it.
    """
    most = max(map(len, brackets.values()))
    never = float("nan")  # sorts after all other numbers
    edges = [(i, *[edge for b in own for edge in b], *[never] * (2 * (most - len(own)))) for i, own in brackets.items()]
    names = [f"edge_{k}" for k in range(2 * most)]
    schema = "column long, " + ", ".join(f"{name} double" for name in names)
    # One row per column: safe to broadcast.
    edges = F.broadcast(table.sparkSession.createDataFrame(edges, T.StructType.fromDDL(schema)))
    named = table.toDF(*[f"v{i}" for i in range(len(table.columns))])
    entries = [F.struct(F.lit(i).cast("long").alias("column"), F.col(f"v{i}").alias("number")) for i in brackets]
    number = F.col("number")
    passed = [number >= F.col(name) if k % 2 == 0 else number > F.col(name) for k, name in enumerate(names)]
    interval = sum((p.cast("int") for p in passed[1:]), passed[0].cast("int"))
    rows = named.select(F.inline(F.array(*entries))).where(number.isNotNull()).join(edges, "column")
    counted = rows.select(
        "column",
        interval.alias("interval"),
        F.when(interval % 2 == 1, number).alias("value"),
        *[of(number).alias(name) for name, of in sums.items()],
    )
    added = [F.sum(name).alias(name) for name in sums]
    return counted.groupBy("column", "interval", "value").agg(F.count(F.lit(1)).alias("rows"), *added)


def column_quantiles(
    table: DataFrame, probs: Sequence[float], sums: dict[str, Callable[[Column], Column]] | None = None, keep: Keep = as_planned
) -> list[dict]:
    """Per column of doubles, in order: rows, n, low, high, the ``sums`` of functions of its
    values, and ``quantiles`` by probability, interpolated.

    NULL is missing; NaN must be. A column without values has no sums and quantiles. The
    second scan's counts are handed to ``keep`` and are then read several times. The jobs
    run when this is called, and bring back a few numbers a column.
    """
    sums = sums or {}
    spark = table.sparkSession
    found = [r.asDict() | dict.fromkeys(sums) for r in summaries(table, probs).first()]
    brackets: dict[tuple[int, float], tuple[float, float]] = {}
    for i, column in enumerate(found):
        bounds, column["quantiles"] = column.pop("bounds"), {}
        for k, p in enumerate(probs if column["n"] else ()):
            low, high = (column["low"], column["high"]) if bounds is None else bounds[2 * k : 2 * k + 2]
            # The sketch keeps no end of a column for certain, and a margin may reach beyond it.
            at_start, at_end = p - MARGIN <= 0, p + MARGIN >= 1
            brackets[i, p] = (column["low"] if at_start else low, column["high"] if at_end else high)
    while brackets:
        by_column = {i: _disjoint([b for (c, _), b in brackets.items() if c == i]) for i in {c for c, _ in brackets}}
        counted = keep(_counted(table, by_column, sums))
        sizes = counted.groupBy("column", "interval").agg(
            F.sum("rows").alias("rows"), F.count("value").alias("values"), F.min("value").alias("low"), F.max("value").alias("high"),
            *[F.sum(name).alias(name) for name in sums],
        )
        intervals: dict[int, list] = {i: [] for i in by_column}
        for r in sorted(sizes.collect(), key=lambda r: (r["column"], r["interval"])):  # a few per column
            intervals[r["column"]].append(r)
        for i, own in intervals.items():
            for name in sums:
                known = [r[name] for r in own if r[name] is not None]
                found[i][name] = sum(known) if known else None
        sums = {}
        targets, missed = [], {}
        for i, p in brackets:
            position = (found[i]["n"] - 1) * p
            below = 0
            ranks = {False: math.floor(position), True: math.ceil(position)}
            own: list[tuple] = []
            for r in intervals[i]:
                for upper, rank in ranks.items():
                    if below <= rank < below + r["rows"]:
                        if r["interval"] % 2:
                            own.append((i, p, upper, position - math.floor(position), rank - below, r["low"], r["high"], r["values"]))
                        else:  # the bracket missed: everything from the bracket before to the one after
                            k = r["interval"] // 2
                            start = by_column[i][k - 1][1] if k else found[i]["low"]
                            end = by_column[i][k][0] if k < len(by_column[i]) else found[i]["high"]
                            old = missed.get((i, p), brackets[i, p])
                            missed[i, p] = (min(start, old[0]), max(end, old[1]))
                below += r["rows"]
            if (i, p) not in missed:
                targets += own
        if targets:
            inside = counted.where("value IS NOT NULL").select("column", "value", "rows")
            schema = T.StructType.fromDDL(TARGETS)
            for r in ranked(inside, spark.createDataFrame(targets, schema)).collect():
                found[r["column"]]["quantiles"][r["prob"]] = r["quantile"]
        brackets = missed
    return found
