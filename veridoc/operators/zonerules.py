"""Zones made from difference blocks: a new box widens the first user zone that it meets, or becomes a zone itself.

Boxes are applied one after another, so a zone that has been widened, or has just been made, takes later boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from veridoc.operators import sweeps
from veridoc.operators.ranking import rank_in_group

# Tolerances in points and the least size of a zone.
LEVEL, OVERLAP, BESIDE = 16.0, 2.0, 10.0
LEAST_WIDTH, LEAST_HEIGHT = 8.0, 6.0
# More than rounding to one decimal can move a side of a zone away from its boxes.
ROUNDING = 1.0
# Boxes of one isle that a task sweeps.
CHUNK = 20_000

#: Places in a zone or box: id, left, bottom, width, height; a zone goes on with the number of boxes it took, a box with its
#: right and top side and whether it is an older zone.
ID, X, Y, WIDTH, HEIGHT, TOOK = range(6)
RIGHT, TOP, OLD = 5, 6, 7


def tenths(v: float) -> float:
    return round(v * 10.0) / 10.0


def meets(zone: list, box: list) -> bool:
    right, top = zone[X] + zone[WIDTH], zone[Y] + zone[HEIGHT]
    return (min(box[TOP], top) + OVERLAP >= max(box[Y], zone[Y])
            and abs((box[Y] + box[TOP]) * 0.5 - (zone[Y] + top) * 0.5) <= LEVEL
            and min(box[RIGHT], right) + BESIDE >= max(box[X], zone[X]))


def place(zone: list, left: float, bottom: float, right: float, top: float) -> None:
    zone[X], zone[Y] = tenths(left), tenths(bottom)
    zone[WIDTH], zone[HEIGHT] = tenths(max(LEAST_WIDTH, right - left)), tenths(max(LEAST_HEIGHT, top - bottom))


def sweep(zones: list[list], boxes: list[list]) -> list[str]:
    """Apply boxes in order to `zones`, which grow in number and size; the id of the zone of each box."""
    out = []
    for box in boxes:
        if box[OLD]:
            zones.append([*box[:TOOK], 0])
            out.append(box[ID])
            continue
        zone = next((z for z in zones if meets(z, box)), None)
        if zone is None:
            zone = [box[ID], 0.0, 0.0, 0.0, 0.0, 0]
            place(zone, box[X], box[Y], box[RIGHT], box[TOP])
            zones.append(zone)
        else:
            place(zone, min(zone[X], box[X]), min(zone[Y], box[Y]), max(zone[X] + zone[WIDTH], box[RIGHT]), max(zone[Y] + zone[HEIGHT], box[TOP]))
        zone[TOOK] += 1
        out.append(zone[ID])
    return out


def zone_box(blocks: DataFrame) -> DataFrame:
    """Blocks that a zone can be made from, with that zone's sides in left, bottom, right, top: the field's box if there is one,
    otherwise the text's box with a margin. Pages count from 1."""
    side = lambda c, other: F.when((F.col("f_right") > F.col("f_left")) & (F.col("f_top") > F.col("f_bottom")), F.col(f"f_{c}")).otherwise(other)
    placed = F.col("left").isNotNull() & F.col("bottom").isNotNull() & F.col("right").isNotNull() & F.col("top").isNotNull()
    zero = F.lit(0.0)
    return blocks.where(placed & ((F.coalesce("f_right", zero) > F.coalesce("f_left", zero)) | (F.col("right") > F.col("left")))).withColumns({
        "left": side("left", F.greatest(zero, F.col("left") - 4.0)), "bottom": side("bottom", F.greatest(zero, F.col("bottom") - 2.5)),
        "right": side("right", F.col("right") + 12.0), "top": side("top", F.col("top") + 2.5), "page": F.greatest(F.lit(1), "page")})


def scope(product) -> F.col:
    """Scopes are compared without blanks around them and without case; null is the empty scope, all products."""
    return F.upper(F.trim(F.coalesce(product, F.lit(""))))


STATE = T.ArrayType(T.StructType([T.StructField("zone_id", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in (
    "x", "y", "width", "height", "boxes")]]))


@F.pandas_udf(STATE)
def _zones(states):
    return states.map(lambda s: [(z[ID], *map(float, z[X:])) for z in sweeps.unpacked(s)])


def upsert_zones(zones: DataFrame, new: DataFrame, zone_order: list[str], box_order: list[str], chunk: int = CHUNK,
                 limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """User zones after the boxes of `new` are applied in order, and (box_id, zone_id): the zone that each box ended in.

    Both tables: (product, page, left, bottom, right, top), `zones` with zone_id, `new` with box_id, and the columns of their
    order, which must be total; zones and boxes must not share ids. A box meets zones of its product and page only, and widens the first in order; new zones come after
    the older ones and carry the box_id of their first box. Result: (zone_id, product, page, left, bottom, right, top, boxes) with
    the number of boxes taken; zones that took none keep their sides. Boxes or zones with a null side, and older zones without a
    page, are left out of the sweep: such zones are returned as they are, such boxes make no zone.
    """
    sides = ["left", "bottom", "right", "top"]
    whole = F.col("page").isNotNull()
    for c in sides:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)

    def rows(df, key, order, old):
        placing = F.struct(*[F.col(c) for c in order])
        flat = df.select(F.col(key).cast("string").alias("id"), F.trim(F.coalesce("product", F.lit(""))).alias("product"), "page",
                         *[F.col(c).cast("double").alias(c) for c in sides], F.lit(old).alias("old"), placing.alias("at"))
        return flat.withColumn("scope", scope(F.col("product")))

    had = rows(zones, "zone_id", zone_order, True)
    came = rows(new, "box_id", box_order, False).where(whole)
    # Ranks number the zones before the boxes; each side is ordered by its own columns.
    part = had.where(whole).withColumn("zone_at", F.col("at")).withColumn("box_at", F.lit(None).cast(came.schema["at"].dataType)).drop("at").unionByName(
        came.withColumn("box_at", F.col("at")).withColumn("zone_at", F.lit(None).cast(had.schema["at"].dataType)).drop("at"))
    wide = part.withColumn("_hi", F.greatest("right", F.col("left") + LEAST_WIDTH)).withColumn("_up", F.greatest("top", F.col("bottom") + LEAST_HEIGHT))
    wide = wide.withColumn("_lo", F.least("left", "right")).withColumn("_down", F.least("bottom", "top"))
    spread = sweeps.islands(wide, ["scope", "page"], [("y_isle", "_down", "_up", OVERLAP + ROUNDING), ("x_isle", "_lo", "_hi", BESIDE + ROUNDING)])
    isle = ["scope", "page", "y_isle", "x_isle"]
    order = [F.when(F.col("old"), 0).otherwise(1), F.col("zone_at"), F.col("box_at")]
    items = rank_in_group(spread.withColumn("width", F.col("right") - F.col("left")).withColumn("height", F.col("top") - F.col("bottom")), isle, order, "rn", limit)
    took, last = sweeps.chunked_sweep(items, isle, ["id", "left", "bottom", "width", "height", "right", "top", "old"], sweep, chunk)
    after = last.select("page", F.explode(_zones("state")).alias("z")).select("page", "z.*")
    named = part.select(F.col("id").alias("zone_id"), "product", *[F.col(c).alias(f"_{c}") for c in sides])
    both = after.withColumn("_kept", F.col("boxes") == 0).join(named, "zone_id")
    new_sides = {"left": F.col("x"), "bottom": F.col("y"), "right": F.bround(F.col("x") + F.col("width"), 1), "top": F.bround(F.col("y") + F.col("height"), 1)}
    out = both.select("zone_id", "product", "page", *[F.when(F.col("_kept"), F.col(f"_{c}")).otherwise(v).alias(c) for c, v in new_sides.items()],
                      F.col("boxes").cast("long").alias("boxes"))
    aside = had.where(~whole).select(F.col("id").alias("zone_id"), "product", "page", *sides, F.lit(0).cast("long").alias("boxes"))
    return out.unionByName(aside), took.withColumnsRenamed({"id": "box_id", "target": "zone_id"})
