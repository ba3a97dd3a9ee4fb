"""Ordered sweeps: rows are offered one after another to a list of targets that grows, in isles that cannot meet and in chunks.

A sweep must remember only its targets, so a long one is cut into chunks that hand the list on. First all chunks start with the
targets of the first one, which mostly hold them all; a chunk whose start turns out different is swept again, so the
result is that of one serial sweep, after one round per chunk in the worst case.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from veridoc.session import small, written


def packed(targets: list[list]) -> str:
    return json.dumps(targets)


def unpacked(state: str) -> list[list]:
    return json.loads(state)


def islands(boxes: DataFrame, keys: list[str], axes: list[tuple[str, str, str, float]]) -> DataFrame:
    """Adds a column per axis (name, low, high, gap): rows of different isles lie more than the gap apart on that axis.

    A merged box stays inside the hull of its members, so rows of different isles never meet, however far boxes widen. Isles are
    found on distinct intervals, which are few beside the boxes of a hot page.
    """
    out, inside = boxes, list(keys)
    for name, lo, hi, gap in axes:
        order = W.partitionBy(*inside).orderBy(lo, hi)
        reach = F.max(hi).over(order.rowsBetween(W.unboundedPreceding, -1))
        first = F.when(reach.isNull() | (reach + gap < F.col(lo)), 1).otherwise(0)
        spans = out.select(*inside, lo, hi).distinct().withColumn("_first", first)
        spans = spans.withColumn(name, F.sum("_first").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_first")
        out = out.join(small(written(spans)), [*inside, lo, hi])
        inside.append(name)
    return out


def chunked_sweep(rows: DataFrame, isle: list[str], item: list[str], sweep: Callable[[list[list], list[list]], list[str]],
                  chunk: int) -> tuple[DataFrame, DataFrame]:
    """(id, target) of every row, and (isle, state) with the targets that each isle ends with.

    `rows` holds the isle's keys, `rn` from 1 on in the order of the sweep, and the columns of an item, whose first is its id.
    `sweep(targets, items)` offers items in order, changes the list of targets and returns the id of each item's target.
    """
    rows = written(rows.select(*isle, F.floor((F.col("rn") - 1) / chunk).alias("chunk"), "rn", *item))
    keys, name = [*isle, "chunk"], item[0]
    key_types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def swept(part: DataFrame, starts: DataFrame) -> DataFrame:
        """(keys, id, target, start, state): rows with their target, and a row without id for the targets at the end."""
        def run(pdf: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
            start = first["state"].iloc[0]
            targets, pdf = unpacked(start), pdf.sort_values("rn")
            took = sweep(targets, [[None if pd.isna(v) else v for v in r] for r in zip(*(pdf[c].tolist() for c in item))])
            out = pd.DataFrame({name: [*pdf[name], None], "target": [*took, None]})
            out["start"], out["state"] = [None] * len(took) + [start], [None] * len(took) + [packed(targets)]
            for k in keys[::-1]:
                out.insert(0, k, pdf[k].iloc[0])
            return out
        fresh = starts.toDF(*[f"_{c}" for c in starts.columns]).toDF(*starts.columns)  # no shared attributes with `part`
        return part.groupBy(*keys).cogroup(fresh.groupBy(*keys)).applyInPandas(run, f"{key_types}, {name} string, target string, start string, state string")

    ends = lambda df: df.where(F.col(name).isNull()).select(*keys, "start", "state")
    head = rows.where("chunk = 0")
    first = written(swept(head, head.select(*keys).distinct().withColumn("state", F.lit("[]"))))
    done, last = first, ends(first)
    later = rows.where("chunk > 0")
    if not later.isEmpty():
        chunks = later.select(*keys).distinct()
        begin = chunks.join(last.select(*isle, "state"), isle)
        run = written(swept(later, begin))
        while True:
            # The chunk before hands on what it ends with; rows of chunks that started otherwise are swept again.
            before = ends(first).union(ends(run)).select(*isle, (F.col("chunk") + 1).alias("chunk"), F.col("state").alias("want"))
            wrong = written(ends(run).join(before, keys).where("start <> want").select(*keys, F.col("want").alias("state")))
            if wrong.isEmpty():
                break
            again = swept(later.join(wrong.select(*keys), keys, "left_semi"), wrong)
            run = written(run.join(wrong.select(*keys), keys, "left_anti").unionByName(again))
        done = first.unionByName(run)
        newest = W.partitionBy(*isle).orderBy(F.col("chunk").desc())
        last = ends(done).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return done.where(F.col(name).isNotNull()).select(name, "target"), last.select(*isle, "state")
