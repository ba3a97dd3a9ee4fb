"""Passes that settle unmatched tokens: moved, split, re-flowed or re-joined text is no difference.

`toks` holds the unmatched tokens of both sides: (pair_id, side, row, idx, page, text, x0, y0, font_size, ...).
Every pass returns matched keys (pair_id, side, row, idx); `without` removes them. Choices depend on the choices before
them, in reading order (row, idx) or by cost, so `settle` decides them where the tokens of a pair meet; `*_edges` give all
candidates of a pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from veridoc.operators import settle as S
from veridoc.operators.settle import NEAR_X, NEAR_Y, SEQUENCE_SHIFT

KEY = ["pair_id", "side", "row", "idx"]


def without(toks: DataFrame, matched: DataFrame) -> DataFrame:
    return toks.join(matched, KEY, "left_anti")


def _meet(df: DataFrame, cols: list[str], equal: list[str]) -> DataFrame:
    """Source rows with target rows of the same pair that agree on `equal`; columns get the prefix s_ or t_."""
    pick = lambda side, p: df.where(F.col("side") == side).select("pair_id", *equal, *[F.col(c).alias(f"{p}_{c}") for c in cols])
    out = pick("S", "s").join(pick("T", "t"), ["pair_id", *equal])
    both = [F.col(c).alias(f"{p}_{c}") for c in equal for p in ("s", "t")]
    return out.select("pair_id", *[f"{p}_{c}" for c in cols for p in ("s", "t")], *both)


def _near(shift: int) -> Column:
    return (F.col("s_page") == F.col("t_page")) | (F.abs(F.col("s_row") - F.col("t_row")) <= shift)


def settled(toks: DataFrame, *passes) -> DataFrame:
    """Keys of the tokens that the given passes settle, one after another; all of them if none is named."""
    cols = ["side", "row", "idx", "page", "text", "x0", "y0", "font_size"]
    types = {f.name: f.dataType for f in toks.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "idx"], kind="stable")
        parts = [pdf[pdf["side"] == side] for side in ("S", "T")]
        sides = [S.Side(*(part[c].tolist() for c in cols[1:2] + cols[3:])) for part in parts]
        for one in passes or S.PASSES:
            one(*sides)
        return pd.concat([part[~np.array(side.free, dtype=bool)] for part, side in zip(parts, sides)])[KEY]

    return toks.select("pair_id", *cols).groupBy("pair_id").applyInPandas(run, T.StructType([T.StructField(k, types[k]) for k in KEY]))


def match_spaceless_lines(toks: DataFrame) -> DataFrame:
    return settled(toks, S.spaceless_lines)


def match_moved_lines(toks: DataFrame) -> DataFrame:
    return settled(toks, S.moved_lines)


def runs(toks: DataFrame, longest: int, shortest: int = 1) -> DataFrame:
    """Runs of up to `longest` consecutive unmatched tokens (reading order), with their joined text."""
    seq = W.partitionBy("pair_id", "side").orderBy("row", "idx")
    w = toks.select("pair_id", "side", "row", "page", "x0", "y0", "text", F.row_number().over(seq).alias("seq"), *[
        F.lead(c, k).over(seq).alias(f"{c}{k}") for c in ("text", "page", "y0") for k in range(1, longest)])
    options, text, ok = [], F.col("text"), F.lit(True)
    for k in range(1, longest + 1):
        if k > 1:
            text = F.concat(text, F.col(f"text{k - 1}"))
            ok = ok & (F.col(f"page{k - 1}") == F.col("page")) & (F.abs(F.col(f"y0{k - 1}") - F.col("y0")) <= 36.0)
        if k >= shortest:
            options.append(F.when(F.coalesce(ok & text.isNotNull(), F.lit(False)), F.struct(F.lit(k).alias("n"), text.alias("key"))))
    return w.select("pair_id", "side", "seq", "row", "page", "x0", "y0", F.explode(F.filter(F.array(*options), lambda o: o.isNotNull())).alias("o")).select(
        "pair_id", "side", "seq", "row", "page", "x0", "y0", "o.n", "o.key")


def run_edges(toks: DataFrame, longest: int) -> DataFrame:
    """Pairs of runs with the same joined text, not one token with one token, on one page or within a few rows."""
    return _meet(runs(toks, longest), ["seq", "n", "row", "page", "y0"], ["key"]).where("s_n + t_n > 2")


def match_split_words(toks: DataFrame) -> DataFrame:
    """2 or 3 fragments with 1 word, 1 with 2 or 3, 2 with 2 cut elsewhere."""
    return settled(toks, S.split_words)


def match_spaceless_runs(toks: DataFrame) -> DataFrame:
    """1 to 6 tokens with 1 to 6 tokens of the same joined text, on one page within 65 points."""
    return settled(toks, S.spaceless_runs)


def match_page_lcs(toks: DataFrame, limit: int | None = None) -> DataFrame:
    """Per page: longest common token sequence within 85 points of height; pages with more tokens than `limit` are left out."""
    return settled(toks, lambda s, t: S.page_lcs(s, t, limit))


def token_edges(toks: DataFrame) -> DataFrame:
    """Pairs of equal tokens on the same page."""
    e = _meet(toks, ["row", "idx", "x0", "y0", "font_size"], ["page", "text"])
    return e.withColumn("dy", F.abs(F.col("s_y0") - F.col("t_y0"))).withColumn("dx", F.abs(F.col("s_x0") - F.col("t_x0")))


def nearby_edges(toks: DataFrame) -> DataFrame:
    return token_edges(toks).where((F.col("dy") < F.greatest(F.lit(NEAR_Y), F.col("s_font_size") * 4.5)) & (F.col("dx") < NEAR_X))


def match_nearby_word(toks: DataFrame) -> DataFrame:
    return settled(toks, S.nearby_words)


def cost_edges(toks: DataFrame) -> DataFrame:
    limit = F.when(F.col("s_text").rlike(r"\d"), F.when(F.col("dx") <= 45, 95.0).otherwise(42.0)).when(
        F.length("s_text") >= 4, 260.0).otherwise(110.0)
    return token_edges(toks).where(F.col("dy") <= limit).withColumn("cost", F.col("dy") + F.col("dx") * 0.25)


def match_min_cost(toks: DataFrame) -> DataFrame:
    return settled(toks, S.cheapest_pairs)


def reflow_edges(toks: DataFrame) -> DataFrame:
    """Equal tokens on one page within 2 rows or 38 points, or on adjacent pages within 5 rows."""
    e = _meet(toks, ["row", "idx", "page", "y0"], ["text"])
    rows, pages = F.abs(F.col("s_row") - F.col("t_row")), F.abs(F.col("s_page") - F.col("t_page"))
    return e.where(((pages == 0) & ((rows <= 2) | (F.abs(F.col("s_y0") - F.col("t_y0")) <= 38.0))) | ((pages == 1) & (rows <= 5)))


def match_reflow(toks: DataFrame) -> DataFrame:
    """First open partner in reading order that does not lie before an earlier match."""
    return settled(toks, S.reflow)


def match_sequences(toks: DataFrame) -> DataFrame:
    """Equal runs of two or more tokens, each as long as it goes."""
    return settled(toks, S.sequences)


def prune_common_prefix(toks: DataFrame) -> DataFrame:
    """Unmatched tokens at one spot that share a word glued to different numbers keep only the rest."""
    long = toks.where(F.length("text") >= 4)
    spot = (F.abs(F.col("s_y0") - F.col("t_y0")) <= 16) & (F.abs(F.col("s_x0") - F.col("t_x0")) <= 85)
    head = lambda c: F.regexp_extract(c, r"^(\p{L}+)", 1)
    # The shared first three letters are an equality, so tokens do not meet everything around them.
    long = long.withColumn("lead", F.substring("text", 1, 3))
    e = _meet(long, ["row", "idx", "text", "x0", "y0"], ["page", "lead"]).where(spot).withColumn("n", F.length(common_prefix(head(F.col("s_text")), head(F.col("t_text")))))
    after = lambda c: F.substring(c, F.col("n") + 1, F.lit(1))
    e = e.where("n >= 3 and n < length(s_text) and n < length(t_text)").where(
        after(F.col("s_text")).rlike(r"\d") | after(F.col("t_text")).rlike(r"\d"))
    cut = e.groupBy("pair_id", F.lit("S").alias("side"), F.col("s_row").alias("row"), F.col("s_idx").alias("idx")).agg(
        F.min_by("n", F.struct("t_row", "t_idx")).alias("n")).union(
        e.groupBy("pair_id", F.lit("T"), "t_row", "t_idx").agg(F.min_by("n", F.struct("s_row", "s_idx")).alias("n")))
    out = toks.join(cut, KEY, "left")
    width = (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))
    return out.withColumn("x0", F.when(F.col("n").isNotNull(), F.col("x0") + width * F.col("n")).otherwise(F.col("x0"))).withColumn(
        "text", F.when(F.col("n").isNotNull(), F.expr("substring(text, n + 1)")).otherwise(F.col("text"))).drop("n")


def common_prefix(a: Column, b: Column) -> Column:
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop > 0, F.substring(a, F.lit(1), (stop - 1).cast("int"))).otherwise(a)
