"""The layouts of a corpus of exports: files whose headers are nearly the same, and one fingerprint for each such group.

Headers are redacted first, so nothing of a sample's or an analyte's name is compared or shown but laboratory vocabulary. Files with
equal sets of names are one layout. Layouts get MinHash signatures (``BANDS`` bands of ``ROWS`` minima); those that agree in a
band meet, and of these the ones whose sets are similar enough, exactly, are linked. A group is what links connect. Pairs at the limit of 0.8 are
missed with a chance of 6e-15; names that many layouts have don't make them meet, as bands are of minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.functions.units import stripped
from batchlens.model import cut
from batchlens.sources.profile import redacted

BANDS, ROWS = 32, 2


def layout_sets(headers: DataFrame) -> DataFrame:
    """file, layout, names: the set of a file's redacted names (file, col, name), and its digest. Empty names don't count; a file without names is the empty layout."""
    shown = F.nullif(F.lower(stripped(redacted(F.col("name"), F.lit(False)))), F.lit(""))
    names = headers.groupBy("file").agg(F.array_sort(F.collect_set(shown)).alias("names"))
    return names.select("file", F.sha2(F.array_join("names", "\n"), 256).alias("layout"), "names")


def _linked(layouts: DataFrame, least: float) -> DataFrame:
    """a, b: pairs of layouts (layout, names) with a Jaccard similarity of ``least`` or more."""
    seeded = lambda seed: lambda x: F.xxhash64(F.lit(seed), x)  # noqa: E731  a second argument of the lambda would be the place in the array
    minima = [F.array_min(F.transform("names", seeded(i))) for i in range(BANDS * ROWS)]
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(*minima[k * ROWS : (k + 1) * ROWS]).alias("key")) for k in range(BANDS)])
    keyed = cut(layouts.where("size(names) > 0").select("layout", F.inline(bands)))
    pairs = keyed.select(F.col("layout").alias("a"), "band", "key").join(keyed.select(F.col("layout").alias("b"), "band", "key"), ["band", "key"]).where("a < b").select("a", "b").distinct()
    one, two = (layouts.select(F.col("layout").alias(c), F.col("names").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(both >= least * (F.size("x") + F.size("y") - both)).select("a", "b")


def _groups(links: DataFrame) -> DataFrame:
    """layout, low: the smallest layout that links lead to. The number of distinct layouts bounds the work; each round ends in a short plan."""
    both = cut(links.select("a", "b").union(links.select("b", "a")))
    now = cut(both.select(F.col("a").alias("layout")).distinct().withColumn("low", F.col("layout")))
    while True:
        near = both.join(now, both["b"] == now["layout"]).groupBy("a").agg(F.min("low").alias("near"))
        step = now.join(near, now["layout"] == near["a"]).select("layout", F.least("low", "near").alias("mid"))
        jump = now.select(F.col("layout").alias("mid"), F.col("low").alias("far"))
        new = cut(step.join(jump, "mid").select("layout", F.least("mid", "far").alias("low")))
        settled = new.join(now.withColumnRenamed("low", "before"), "layout").where("low <> before").isEmpty()
        now = new
        if settled:
            return now


def layout_groups(headers: DataFrame, least: float = 0.8) -> DataFrame:
    """file, layout, group: the group's id is the smallest digest in it."""
    sets = cut(layout_sets(headers))
    layouts = cut(sets.groupBy("layout").agg(F.first("names").alias("names")))
    groups = _groups(_linked(layouts, least))
    return sets.join(groups, "layout", "left").select("file", "layout", F.coalesce("low", "layout").alias("group"))


def group_fingerprints(headers: DataFrame, groups: DataFrame, share: float = 0.5) -> DataFrame:
    """group, n_files, n_layouts, names: the redacted names that at least ``share`` of a group's files have."""
    size = groups.groupBy("group").agg(F.count("*").alias("n_files"), F.count_distinct("layout").alias("n_layouts"))
    each = layout_sets(headers).join(groups.select("file", "group"), "file").select("group", F.explode("names").alias("name"))
    common = each.groupBy("group", "name").count().join(size, "group").where(F.col("count") >= share * F.col("n_files"))
    names = common.groupBy("group").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return size.join(names, "group", "left").select("group", "n_files", "n_layouts", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
