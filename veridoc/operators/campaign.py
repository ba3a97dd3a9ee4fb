"""Finding source and target folders in a file listing, and upserts of rules.

A listing is a table `files(path)`; folders are derived from it, so one pass over the names replaces a walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veridoc.functions import paths as P
from veridoc.functions.text import fold


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def ready_status(src_ok: Column, trg_ok: Column, n_src: Column, n_trg: Column, src: str, trg: Column) -> tuple[Column, Column]:
    """(ready, reason in priority order)."""
    ready = src_ok & trg_ok & (n_src > 0) & (n_trg > 0)
    text = (F.when(ready, F.concat(F.lit("Ready ("), n_src.cast("string"), F.lit(" / "), n_trg.cast("string"), F.lit(")")))
            .when(~src_ok, F.lit(f"{src} not found")).when(n_src == 0, F.lit(f"{src} empty"))
            .when(~trg_ok, F.concat(trg, F.lit(" missing"))).otherwise(F.concat(trg, F.lit(" empty"))))
    return ready, text


def folder_counts(files: DataFrame) -> DataFrame:
    """PDF files directly in each folder."""
    return files.where(F.lower("path").endswith(".pdf")).groupBy(folder(F.col("path")).alias("dir")).agg(F.count("*").alias("n"))


def with_fallback(counts: DataFrame, base: DataFrame, name: str) -> DataFrame:
    """Files of a base folder; an empty one hands over to its first child folder with files (not Output)."""
    child = counts.withColumn("_up", folder(F.col("dir"))).where(F.lower(F.regexp_extract("dir", r"([^/]*)$", 1)) != "output")
    first = child.groupBy("_up").agg(F.min(F.struct(F.upper("dir").alias("u"), "dir", "n")).alias("c"))
    out = base.join(counts.withColumnRenamed("dir", name).withColumnRenamed("n", "_n"), name, "left").join(
        first.withColumnRenamed("_up", name), name, "left")
    return out.withColumn(f"{name}_files", F.coalesce("_n", "c.n", F.lit(0))).withColumn(
        name, F.when(F.col("_n").isNull() & F.col("c").isNotNull(), F.col("c.dir")).otherwise(F.col(name))).drop("_n", "c")


def product_files(files: DataFrame, root: str, channels: list[str], inner: str | None = None, rules: P.Channels = P.Channels()) -> DataFrame:
    """Files with the product they belong to: (path, channel, product, top, rest), `rest` the names below the product's folder `top`.

    The first level at which the whole scan finds a product holds for all files: <root>/<channel>/<product>; the same below the
    folder `inner`, if given; the root is itself a product, with a child Source; every child of the root but channels is a product.
    A root that is named as a channel stands for its parent. Outside the first two levels the channel follows from the path. A root
    without files gives no rows.
    """
    root = root.rstrip("/")
    up, _, last = root.rpartition("/")
    root = up if last.upper() in [c.strip().upper() for c in channels] else root
    below = files.where(F.col("path").startswith(root + "/")).withColumn("_p", F.split(F.expr(f"substring(path, {len(root) + 2})"), "/"))
    at = lambda i: F.try_element_at("_p", F.lit(i))
    known = lambda x: F.coalesce(P.among(x, channels), F.lit(False))

    def level(n, skip, fits, top, channel, product):
        return F.when(F.coalesce(fits, F.lit(False)) & (F.size("_p") > skip), F.struct(
            F.lit(n).alias("level"), channel.alias("channel"), product.alias("product"), top.alias("top"),
            F.slice("_p", F.lit(skip + 1), F.greatest(F.size("_p") - skip, F.lit(0))).alias("rest")))

    folder_of = lambda n: F.concat_ws("/", F.lit(root), F.slice("_p", 1, n)) if n else F.lit(root)
    none = F.lit(None).cast("string")
    name = F.lit(root.rpartition("/")[2])
    levels = [level(0, 2, known(at(1)), folder_of(2), at(1), at(2)),
              level(1, 3, (F.upper(at(1)) == (inner or "").upper()) & known(at(2)), folder_of(3), at(2), at(3)),
              level(2, 0, F.lit(True), folder_of(0), P.resolve_channel(none, F.lit(root), none, none, rules), name),
              level(3, 1, ~known(at(1)), folder_of(1), P.resolve_channel(none, folder_of(1), none, at(1), rules), at(1))]
    every = below.select("path", F.explode(F.filter(F.array(*levels), lambda x: x.isNotNull())).alias("f")).select("path", "f.*")
    # The root is a product only with a child Source.
    found = every.agg(F.min(F.when((F.col("level") != 2) | ((F.size("rest") > 1) & (F.upper(F.col("rest")[0]) == "SOURCE")), F.col("level"))).alias("level"))
    return every.join(F.broadcast(found), "level").drop("level")  # one row


def discover_product_subfolders(files: DataFrame, root: str, channels: list[str], release: str, source: str = "Source",
                                target: str = "Target", inner: str | None = None, rules: P.Channels = P.Channels()) -> DataFrame:
    """Products of a scan (`product_files`): their source folder and the target folder of the release."""
    base = product_files(files, root, channels, inner, rules).withColumnRenamed("rest", "_p")
    src, rel, trg = (F.upper(F.col("_p")[0]) == source.upper()), P.release_order(F.col("_p")[0]), F.upper(F.try_element_at("_p", F.lit(2))) == target.upper()
    want = P.release_order(F.lit(release))
    match = (F.upper(F.col("_p")[0]) == release.upper()) | ((want > 0) & (rel == want))
    items = base.groupBy("channel", "product", "top").agg(
        F.max(F.when(src, F.col("_p")[0])).alias("_s"), F.max(F.when(match, F.col("_p")[0])).alias("release"),
        F.max(F.when(match & trg, F.try_element_at("_p", F.lit(2)))).alias("_t"),
        F.array_join(F.slice(F.reverse(F.array_sort(F.collect_set(F.when(rel > 0, F.struct(rel.alias("o"), F.col("_p")[0].alias("r"))))))["r"], 1, 6), ", ").alias("releases"))
    top = F.col("top")
    items = items.withColumn("source_dir", F.concat(top, F.lit("/"), F.coalesce("_s", F.lit(source)))).withColumn(
        "target_dir", F.concat(top, F.lit("/"), F.coalesce("release", F.lit(release)), F.when(F.col("_t").isNotNull() | F.col("release").isNull(), F.concat(
            F.lit("/"), F.coalesce("_t", F.lit(target)))).otherwise("")))
    counts = folder_counts(files)
    out = with_fallback(counts, with_fallback(counts, items, "source_dir"), "target_dir")
    ok, text = ready_status(F.col("_s").isNotNull(), F.col("release").isNotNull(), F.col("source_dir_files"), F.col("target_dir_files"), source, F.lit(release))
    return out.select("channel", "product", "release", "releases", "source_dir", "target_dir", F.col("source_dir_files").alias("source_count"),
                      F.col("target_dir_files").alias("target_count"), ok.alias("is_ready"), text.alias("status_text"))


def discover_mirror_trees(files: DataFrame, source_root: str, target_root: str, depth: int = 3) -> DataFrame:
    """Folders with files under the source root, with the folder at the same relative path under the target root."""
    def tree(root, name):
        c = folder_counts(files.where(F.col("path").startswith(root + "/"))).withColumn("rel", F.expr(f"substring(dir, {len(root) + 2})"))
        return c.select(F.upper("rel").alias("key"), "rel", F.col("dir").alias(f"{name}_dir"), F.col("n").alias(f"{name}_count"))
    s = tree(source_root, "source").where((F.size(F.split("rel", "/")) <= depth) & ~F.upper("rel").rlike("(^|/)OUTPUT(/|$)"))
    t = tree(target_root, "target").groupBy("key").agg(F.min("target_dir").alias("target_dir"), F.sum("target_count").alias("target_count"))
    return s.join(t, "key", "left").select("rel", "source_dir", "target_dir", "source_count", F.coalesce("target_count", F.lit(0)).alias("target_count"),
                                           F.coalesce(F.col("target_count") > 0, F.lit(False)).alias("is_ready"))


def discover_auto_pairs(files: DataFrame, root: str, source_names: list[str] = P.SOURCE_FOLDERS, target_names: list[str] = P.TARGET_FOLDERS,
                        depth: int = 4) -> DataFrame:
    """Topmost folders that hold a source-named child and a target-named one (as a child, or one level below a sibling).

    Where the whole scan finds none, a root with exactly two child folders that hold files is a pair of its own, in order of
    their names.
    """
    f = files.where(F.col("path").startswith(root + "/") & F.lower("path").endswith(".pdf")).withColumn(
        "_d", F.split(F.expr(f"substring(path, {len(root) + 2})"), "/"))
    f = f.withColumn("_d", F.slice("_d", F.lit(1), F.size("_d") - 1))
    # Every ancestor of a file with the two folder names below it.
    up = f.select("path", F.explode(F.sequence(F.lit(0), F.least(F.size("_d") - 1, F.lit(depth)))).alias("i"), "_d").where("size(_d) > 0")
    up = up.select(F.concat_ws("/", F.lit(root), F.array_join(F.slice("_d", F.lit(1), F.col("i")), "/")).alias("dir"), "i",
                   F.element_at("_d", F.col("i") + 1).alias("c1"), F.try_element_at("_d", F.col("i") + 2).alias("c2"), F.size("_d").alias("deep"))
    up = up.withColumn("dir", F.regexp_replace("dir", "/$", ""))
    s = P.among(F.col("c1"), source_names)
    t = P.among(F.col("c1"), target_names) | (~s & F.coalesce(P.among(F.col("c2"), target_names), F.lit(False)))
    hits = up.groupBy("dir", "i").agg(F.count_if(s).alias("source_count"), F.count_if(t).alias("target_count"),
                                      F.min(F.when(s, F.col("c1"))).alias("source_name")).where("source_count > 0")
    above = hits.select(F.col("dir").alias("top"))
    parents = hits.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("dir", "/")) - 1, F.lit(1))), lambda k: F.array_join(
        F.slice(F.split("dir", "/"), F.lit(1), k), "/"))).alias("top"))
    covered = parents.join(above, "top", "left_semi").select("dir").distinct()
    name = F.regexp_extract("dir", r"([^/]*)$", 1)
    pairs = hits.join(covered, "dir", "left_anti").select("dir", name.alias("product"), "source_name", "source_count", "target_count",
                                                          (F.col("target_count") > 0).alias("is_ready"))
    here = folder_counts(files).where(folder(F.col("dir")) == root)
    ends = here.withColumn("at", F.struct(F.upper("dir").alias("u"), name.alias("name"), F.col("n"))).agg(F.count("*").alias("k"), F.min("at").alias("s"), F.max("at").alias("t"))
    two = ends.where("k = 2").withColumn("_any", F.lit(1)).join(hits.select(F.lit(1).alias("_any")).limit(1), "_any", "left_anti")
    return pairs.unionByName(two.select(F.lit(root).alias("dir"), F.lit(root.rpartition("/")[2]).alias("product"), F.col("s.name").alias("source_name"),
                                        F.col("s.n").alias("source_count"), F.col("t.n").alias("target_count"), F.lit(True).alias("is_ready")))


def order_releases(names: DataFrame) -> DataFrame:
    """Distinct release names, newest first."""
    one = names.groupBy(F.upper("release").alias("_u")).agg(F.min("release").alias("release"))
    return one.orderBy(F.desc(P.release_order(F.col("release"))), F.desc("_u")).select("release")


def known_products(*sources: DataFrame) -> DataFrame:
    """Distinct product names (case-insensitive) from tables with a `product_filter` list."""
    all_ = sources[0]
    for s in sources[1:]:
        all_ = all_.union(s)
    toks = all_.select(F.explode(F.split("product_filter", r"[,;|]")).alias("t")).select(F.trim("t").alias("product")).where("product <> ''")
    return toks.groupBy(F.upper("product").alias("_u")).agg(F.min("product").alias("product")).select("product")


def upsert_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """A new rule with a known pattern or signature in its scope updates the old one; any other is added."""
    key = lambda df: df.withColumn("_scope", F.upper(F.trim(F.coalesce("product_filter", F.lit(""))))).withColumn(
        "_key", fold(F.coalesce(F.when(F.coalesce("ignored_signature", F.lit("")) != "", F.col("ignored_signature")), F.col("pattern"))))
    o, n = key(rules).alias("o"), key(new).alias("n")
    both = o.join(n, (F.col("o._scope") == F.col("n._scope")) & (F.col("o._key") == F.col("n._key")), "full_outer")
    update = {"is_enabled", "is_user_rule"}
    cols = [F.when(F.col("n._key").isNotNull(), F.lit(True)).otherwise(F.col(f"o.{c}")).alias(c) if c in update
            else (F.coalesce(f"n.{c}", f"o.{c}") if c in ("pattern", "replacement_mask") else F.coalesce(f"o.{c}", f"n.{c}")).alias(c) for c in rules.columns]
    return both.select(*cols)
