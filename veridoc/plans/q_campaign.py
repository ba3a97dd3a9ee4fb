"""Folder discovery, releases and upserts over the file listing of both sides."""

from pyspark.sql import functions as F

from veridoc.functions import paths as P
from veridoc.functions.text import fold
from veridoc.operators import campaign as C, review as V, runs as R, zonerules as Z
from veridoc.operators.grouping import top_k
from veridoc.plans.oracle import cte, with_
from veridoc.plans.q_blocks import SPOT, block_table, status_table
from veridoc.plans.registry import query
from veridoc.session import cut, shared_path
from veridoc.sources import corpus


def listing(spark, sf_dir):
    return corpus.files(spark, sf_dir, "S").select("path").union(corpus.files(spark, sf_dir, "T").select("path"))


cte("cnt", """SELECT channel, product, count_if(side = 'S')::BIGINT AS s, count_if(side = 'T')::BIGINT AS t FROM docs GROUP BY ALL""", "docs")
ITEM = """SELECT channel, product, CASE WHEN t > 0 THEN '2026_R11' END AS release, '/data/' || channel || '/' || product || '/Source' AS source_dir, s AS source_count, t AS target_count, s > 0 AND t > 0 AS is_ready,
  CASE WHEN t > 0 THEN 'Ready (' || s || ' / ' || t || ')' ELSE '2026_R11 missing' END AS status_text FROM cnt"""


def items(spark, sf_dir):
    return C.discover_product_subfolders(listing(spark, sf_dir), "/data", ["Bank", "Broker"], "2026_R11")


@query("a3_discover_product_subfolders", with_(ITEM, "cnt"))
def a3(spark, sf_dir):
    return items(spark, sf_dir).select("channel", "product", "release", "source_dir", "source_count", "target_count", "is_ready", "status_text")


@query("b14_channel_filter", with_(f"SELECT * FROM ({ITEM}) WHERE channel = 'Bank'", "cnt"))
def b14(spark, sf_dir):
    return a3(spark, sf_dir).where("channel = 'Bank'")


@query("b15_campaign_ready", with_(f"SELECT channel, count(*) AS n, count_if(is_ready)::BIGINT AS ready FROM ({ITEM}) GROUP BY ALL", "cnt"))
def b15(spark, sf_dir):
    return items(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.count_if("is_ready").alias("ready"))


@query("a4_discover_mirror_trees", with_("""SELECT product || '/Source' AS rel, '/data/Bank/' || product || '/Source' AS source_dir, s AS source_count, coalesce(t2, 0) AS target_count FROM cnt LEFT JOIN (
  SELECT product AS p2, s AS t2 FROM cnt WHERE channel = 'Broker') ON p2 = product WHERE channel = 'Bank' AND s > 0""", "cnt"))
def a4(spark, sf_dir):
    src = listing(spark, sf_dir).where("path like '%/Source/%'")
    return C.discover_mirror_trees(src, "/data/Bank", "/data/Broker").select("rel", "source_dir", "source_count", "target_count")


@query("a5_discover_auto_pairs", with_("""SELECT '/data/' || channel || '/' || product AS dir, product, 'Source' AS source_name, s AS source_count, t AS target_count, t > 0 AS is_ready FROM cnt WHERE s > 0""", "cnt"))
def a5(spark, sf_dir):
    return C.discover_auto_pairs(listing(spark, sf_dir), "/data")


NAMED = P.Channels(aliases={"Bank": ["Bank"], "Broker": ["Broker"]})


@query("a3_root_is_parent", with_(f"SELECT * FROM ({ITEM}) WHERE channel = 'Bank'", "cnt"))
def a3_parent(spark, sf_dir):
    """No folder is named as the channel asked for, so the children of the root are products."""
    found = C.discover_product_subfolders(listing(spark, sf_dir), "/data/Bank", ["Shop"], "2026_R11", rules=NAMED)
    return found.select("channel", "product", "release", "source_dir", "source_count", "target_count", "is_ready", "status_text")


@query("a3_inner_folder", with_(ITEM, "cnt"))
def a3_inner(spark, sf_dir):
    """The channels lie one folder deeper."""
    found = C.discover_product_subfolders(listing(spark, sf_dir), "/", ["Bank", "Broker"], "2026_R11", inner="data")
    return found.select("channel", "product", "release", "source_dir", "source_count", "target_count", "is_ready", "status_text")


@query("a3_root_is_product", with_("""SELECT 'Bank' AS channel, 'All' AS product, '2026_R11' AS release, '/Bank/All/Source' AS source_dir, sum(s)::BIGINT AS source_count, sum(t)::BIGINT AS target_count,
  'Ready (' || sum(s)::BIGINT || ' / ' || sum(t)::BIGINT || ')' AS status_text FROM cnt""", "cnt"))
def a3_product(spark, sf_dir):
    """All files in the folders of one product, which is the root."""
    files = listing(spark, sf_dir).select(F.regexp_replace("path", "^/data/[^/]+/[^/]+", "/Bank/All").alias("path"))
    found = C.discover_product_subfolders(files, "/Bank/All", ["Shop"], "2026_R11", rules=NAMED)
    return found.select("channel", "product", "release", "source_dir", "source_count", "target_count", "status_text")


@query("a5_two_folders", with_("""SELECT '/both' AS dir, 'both' AS product, 'Left' AS source_name, sum(s)::BIGINT AS source_count, sum(t)::BIGINT AS target_count, true AS is_ready FROM cnt""", "cnt"))
def a5_two(spark, sf_dir):
    """No folder has a known name, but the root has exactly two that hold files."""
    side = lambda s, to: corpus.files(spark, sf_dir, s).select(F.regexp_replace("path", "^.*/", f"/both/{to}/").alias("path"))
    return C.discover_auto_pairs(side("S", "Left").union(side("T", "Right")), "/both")


def releases(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "orders")
    return o.select(F.concat(F.year("o_orderdate"), F.lit("_R"), F.month("o_orderdate").cast("string")).alias("release"))


@query("o4_release_order", "SELECT DISTINCT year(o_orderdate) || '_R' || month(o_orderdate) AS release FROM orders")
def o4(spark, sf_dir):
    return C.order_releases(releases(spark, sf_dir))


@query("u5_known_products", with_("SELECT DISTINCT product FROM docs UNION SELECT DISTINCT lang FROM docs", "docs"))
def u5(spark, sf_dir):
    f = corpus.files(spark, sf_dir, "S")
    return C.known_products(f.select(F.concat_ws(" ; ", "product", "lang").alias("product_filter")), f.select(F.col("product").alias("product_filter")))


@query("u6_discovered_channels", with_("SELECT DISTINCT channel FROM docs", "docs"))
def u6(spark, sf_dir):
    return items(spark, sf_dir).select("channel").distinct()


@query("u2_rule_upsert", with_("""SELECT product AS product_filter, signature AS ignored_signature, max(enabled) AS is_enabled FROM (SELECT product, upper(signature) AS signature, CASE WHEN side = 'new' THEN true ELSE severity = 3 END AS enabled FROM (
  SELECT product, signature, max(severity) AS severity, 'old' AS side FROM blocks WHERE change_type <> 2 GROUP BY ALL UNION ALL SELECT product, signature, max(severity), 'new' FROM blocks WHERE change_type <> 1 GROUP BY ALL)) GROUP BY ALL""", "blocks"))
def u2(spark, sf_dir):
    b = block_table(spark, sf_dir)
    def rules(df, on):
        r = df.groupBy("product", fold(F.col("signature")).alias("signature")).agg(F.max("severity").alias("severity"))
        return r.select(F.col("product").alias("product_filter"), F.col("signature").alias("ignored_signature"), F.lit("x").alias("pattern"), F.lit("").alias("replacement_mask"),
                        on.alias("is_enabled"), F.lit(True).alias("is_user_rule"))
    out = C.upsert_rules(rules(b.where("change_type <> 2"), F.col("severity") == 3), rules(b.where("change_type <> 1"), F.lit(True)))
    return out.select("product_filter", "ignored_signature", "is_enabled")


cte("zo", 'SELECT product, page, min("left") AS l, min(bottom) AS b, max("right") AS r, min(top) AS t FROM blocks WHERE severity = 3 GROUP BY ALL', "blocks")
# Zones of blocks without digits, in order of their first block.
cte("zn", """SELECT product, page, f_left AS l, f_bottom AS b, f_right AS r, f_top AS t, min(struct_pack(pair_id := pair_id, seq := seq)) AS first_at
  FROM blocks WHERE severity = 2 GROUP BY ALL""", "blocks")
MEET = "least(n.t, z.y + z.h) + 2 >= greatest(n.b, z.y) AND abs((n.b + n.t) * 0.5 - (z.y + (z.y + z.h)) * 0.5) <= 16 AND least(n.r, z.x + z.w) + 10 >= greatest(n.l, z.x)"


def closure(old: str, new: str) -> str:
    """Recursive SQL: boxes of `new`(product, page, l, b, r, t, first_at) are applied one after another to the list of zones of their page."""
    tenth = lambda v: f"round_even(({v}) * 10, 0) / 10"
    pack = lambda l, b, r, t, n: (f"struct_pack(x := {tenth(l)}, y := {tenth(b)}, w := {tenth(f'greatest(8.0, ({r}) - ({l}))')}, "
                                  f"h := {tenth(f'greatest(6.0, ({t}) - ({b}))')}, n := {n})")
    grown = pack("least(z.x, n.l)", "least(z.y, n.b)", "greatest(z.x + z.w, n.r)", "greatest(z.y + z.h, n.t)", "z.n + 1")
    return f"""(WITH RECURSIVE box AS (SELECT *, row_number() OVER (PARTITION BY product, page ORDER BY first_at) AS i FROM {new}),
   start AS (SELECT product, page, coalesce(zs, []) AS zs FROM (SELECT DISTINCT product, page FROM {new} UNION SELECT product, page FROM {old}) LEFT JOIN (
     SELECT product, page, list(struct_pack(x := l::DOUBLE, y := b::DOUBLE, w := (r - l)::DOUBLE, h := (t - b)::DOUBLE, n := 0::BIGINT)) AS zs FROM {old} GROUP BY ALL) USING (product, page)),
   walk AS (SELECT product, page, 0::BIGINT AS i, zs FROM start
     UNION ALL SELECT product, page, i, CASE WHEN k IS NULL THEN list_append(zs, {pack("n.l", "n.b", "n.r", "n.t", "1::BIGINT")})
       ELSE list_transform(zs, lambda z, j: CASE WHEN j = k THEN {grown} ELSE z END) END
     FROM (SELECT s.product, s.page, n.i, s.zs, n, list_position(list_transform(s.zs, lambda z: {MEET}), true) AS k
       FROM walk s JOIN box n ON n.product = s.product AND n.page = s.page AND n.i = s.i + 1))
   SELECT product, page, unnest(zs) AS z FROM (SELECT product, page, arg_max(zs, i) AS zs FROM walk GROUP BY ALL))"""


ZONES = """SELECT product, page, z.x AS "left", z.y AS bottom, CASE WHEN z.n > 0 THEN round_even((z.x + z.w) * 10, 0) / 10 ELSE z.x + z.w END AS "right",
  CASE WHEN z.n > 0 THEN round_even((z.y + z.h) * 10, 0) / 10 ELSE z.y + z.h END AS top, z.n AS boxes FROM {}"""


def new_boxes(blocks):
    """Zone boxes of blocks, equal ones of a page once, in order of their first block."""
    first = Z.zone_box(blocks).groupBy("product", "page", "left", "bottom", "right", "top").agg(F.min(F.struct("pair_id", "seq")).alias("at"))
    return first.withColumn("box_id", F.concat_ws("-", F.lit("box"), "at.pair_id", "at.seq"))


def old_zones(blocks):
    box = blocks.where("severity = 3").groupBy("product", "page").agg(F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.min("top").alias("top"))
    return box.withColumn("zone_id", F.concat_ws("-", F.lit("zone"), "product", "page"))


@query("u3_zone_upsert", with_(ZONES.format(closure("zo", "zn")), "zo", "zn"))
def u3(spark, sf_dir):
    b = block_table(spark, sf_dir)
    out, _ = Z.upsert_zones(old_zones(b), new_boxes(b.where("severity = 2")), ["zone_id"], ["at"])
    return out.select("product", "page", "left", "bottom", "right", "top", "boxes")


# A reviewer clicks on the first three blocks of each product.
cte("clicked", "SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY product ORDER BY pair_id, seq) <= 3", "blocks")
cte("clicked_box", "SELECT product, page, f_left AS l, f_bottom AS b, f_right AS r, f_top AS t, struct_pack(pair_id := pair_id, seq := seq) AS first_at FROM clicked", "clicked")
cte("no_zone", "SELECT * FROM zo LIMIT 0", "zo")
cte("made", f"SELECT * FROM ({ZONES.format(closure('no_zone', 'clicked_box'))})", "no_zone", "clicked_box")
# Sums over a block's side and a zone's side: the centre lies inside or 45 % of the block do.
INSIDE = """(((b."{0}" + b."{1}") * 0.5 BETWEEN m."{0}" AND m."{1}") OR greatest(0, least(b."{1}", m."{1}") - greatest(b."{0}", m."{0}")) / greatest(0.1, b."{1}" - b."{0}") >= 0.45)"""
HIT = f"""EXISTS (SELECT 1 FROM made m WHERE m.product = b.product AND m.page = b.page AND b."left" <= m."right" AND b."right" >= m."left" AND b.bottom <= m.top AND b.top >= m.bottom
  AND {INSIDE.format("left", "right")} AND {INSIDE.format("bottom", "top")})
  OR EXISTS (SELECT 1 FROM clicked a WHERE a.product = b.product AND {SPOT}) OR EXISTS (SELECT 1 FROM clicked a WHERE a.product = b.product AND a.page = b.page AND a.signature = b.signature)"""


@query("j20_zone_rule", with_(f"""SELECT pair_id, status, diff_count, critical_count, max_severity, insertions, deletions FROM (SELECT pair_id, CASE WHEN st.status <> 'Different' THEN st.status WHEN n IS NULL THEN 'Identical' ELSE 'Different' END AS status,
  CASE WHEN st.status = 'Different' THEN coalesce(n, 0) ELSE diff_count END AS diff_count, coalesce(c, 0)::BIGINT AS critical_count, coalesce(s, 0) AS max_severity,
  CASE WHEN n IS NULL THEN 0 ELSE insertions END AS insertions, CASE WHEN n IS NULL THEN 0 ELSE deletions END AS deletions
  FROM st LEFT JOIN (SELECT pair_id, count(*) AS n, count_if(severity = 3)::BIGINT AS c, max(severity) AS s FROM blocks b WHERE NOT ({HIT}) GROUP BY ALL) k USING (pair_id))""", "st", "clicked", "made"))
def j20z(spark, sf_dir):
    """A stored run after zones were made from clicked blocks: the blocks they exclude are taken out of it."""
    st, b = status_table(spark, sf_dir)
    path = shared_path(spark, "runs")
    R.snapshot_run(st.withColumn("note", F.lit("")), b, path, "run")
    clicks = top_k(b, ["product"], [F.col("pair_id"), F.col("seq")], 3).withColumn("box_id", F.concat_ws("-", F.lit("box"), "pair_id", "seq"))
    clicks = cut(clicks.drop("rank"))
    zones, took = Z.upsert_zones(old_zones(b).limit(0), Z.zone_box(clicks), ["zone_id"], ["pair_id", "seq"])
    zones, clicks = cut(zones), cut(clicks.join(took, "box_id"))
    R.retract_blocks(spark, path, "run", lambda blocks: V.excluded_by_zones(blocks, zones, clicks), V.EXCLUDED)
    return R.restore_run(spark, path, "run")[0].select("pair_id", "status", "diff_count", "critical_count", "max_severity", "insertions", "deletions")


@query("e4_dedupe_overprint_glyphs", with_(r"""SELECT tok, regexp_replace(tok, '^(.)', '\1') AS text FROM tokens WHERE regexp_matches(tok, '^[A-Za-z]+$')""", "tokens"))
def e4(spark, sf_dir):
    """Every word with each letter printed twice at one place comes out with single letters."""
    from veridoc.operators.words import dedupe_overprint_glyphs
    from veridoc.plans.q_text import token_table
    t = token_table(spark, sf_dir).where(F.col("tok").rlike("^[A-Za-z]+$"))
    glyph = lambda c, x: F.struct(c.alias("ch"), x.alias("x0"), (x + 5.0).alias("x1"), F.lit(100.0).alias("y"), F.lit(10.0).alias("size"))
    chars = F.filter(F.split("tok", ""), lambda c: c != "")
    letters = F.flatten(F.transform(chars, lambda c, i: F.array(glyph(c, i * 6.0), glyph(c, i * 6.0 + 0.2))))
    out = dedupe_overprint_glyphs(t.withColumn("letters", letters))
    return out.select("tok", F.array_join(F.transform("letters", lambda x: x["ch"]), "").alias("text"))
