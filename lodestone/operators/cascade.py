"""Deletion along declared references: what is removed from one table takes what refers to it in others with it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.storage import written


@dataclass(frozen=True)
class Reference:
    """`column` of `child` names a row of `parent` by its key; where the parent goes, the child's row goes too, or, with `clears`, loses the value."""

    child: str
    column: str
    parent: str
    clears: bool = False


def order(tables: dict[str, str], references: tuple[Reference, ...]) -> list[str]:
    """Tables with parents before children; a circle is an error. A table may refer to itself only by a column that is cleared."""
    left, done = dict.fromkeys(tables), []
    while left:
        ready = [t for t in left if all(r.parent in done or r.clears or r.parent == t for r in references if r.child == t)]
        if not ready:
            raise ValueError(f"references go in a circle: {sorted(left)}")
        done += ready
        for t in ready:
            del left[t]
    return done


def purge(tables: dict[str, DataFrame], keys: dict[str, str], references: tuple[Reference, ...], gone: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """tables by name, the key column of each, and gone: rows' keys (a column named as the key) to remove from some of them. The tables as they are
    afterwards, and a report: relation, removed, cleared (rows that lost a value) and remaining.

    The keys that go are carried from table to table, each step a semi join of narrow columns; they are written once, as children
    and the anti join at the end read them. A row whose key is null is never removed by its key."""
    if bad := [r for r in references if r.parent == r.child and not r.clears]:
        raise ValueError(f"{bad[0].child} refers to itself")
    removed: dict[str, DataFrame] = {}
    for name in order(keys, references):
        key = keys[name]
        sets = [gone[name].select(F.col(key).alias("k"))] if name in gone else []
        for r in references:
            if r.child == name and not r.clears and r.parent in removed:
                rows = tables[name].select(F.col(key).alias("k"), F.col(r.column).alias("p"))
                sets.append(rows.join(removed[r.parent].withColumnRenamed("k", "p"), "p", "left_semi").select("k"))
        if sets:
            every = sets[0]
            for s in sets[1:]:
                every = every.union(s)
            removed[name] = written(every.where("k is not null").distinct(), "removed-keys")
    after, report = {}, None
    for name, df in tables.items():
        kept = df.join(removed[name], df[keys[name]] == F.col("k"), "left_anti") if name in removed else df
        cleared = F.lit(False)
        for i, r in enumerate(r for r in references if r.child == name and r.clears and r.parent in removed):
            lost = removed[r.parent].select(F.col("k").alias(f"__p{i}"))
            kept = kept.join(lost, F.col(r.column) == F.col(f"__p{i}"), "left")
            hit = F.col(f"__p{i}").isNotNull()
            cleared = cleared | hit
            kept = kept.withColumn(r.column, F.when(~hit, F.col(r.column))).withColumn("__cleared", cleared).drop(f"__p{i}")
            cleared = F.col("__cleared")
        flag = F.col("__cleared") if "__cleared" in kept.columns else F.lit(False)
        n = df.agg(F.count("*").alias("before")).crossJoin(kept.agg(F.count("*").alias("remaining"), F.count_if(flag).alias("cleared")))  # one row each
        one = n.select(F.lit(name).alias("relation"), (F.col("before") - F.col("remaining")).alias("removed"), "cleared", "remaining")
        report = one if report is None else report.union(one)
        after[name] = kept.drop("__cleared")
    return after, report


def reported(tables: dict[str, DataFrame], keys: dict[str, str], references: tuple[Reference, ...], gone: dict[str, DataFrame]) -> DataFrame:
    """The report of `purge` alone, as a written table."""
    return written(purge(tables, keys, references, gone)[1], "purge-report")


