"""Decisions about when and what to index, as column expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.tables import few
from sextant.operators.roots import longest_root


def out_of_space(free: Column, total: Column, limit_percent: Column) -> Column:
    """Whether indexing pauses; a negative limit never does."""
    return (limit_percent >= 0) & (100.0 * free / total <= limit_percent)


def throttle(setting: Column, on_battery: Column) -> Column:
    """Between 0 and 1: a twentieth of the setting, a quarter more on battery."""
    return F.least(F.greatest(setting / 20.0 + F.when(on_battery, 0.25).otherwise(0.0), F.lit(0.0)), F.lit(1.0))


def crawl_needed(interval: Column, clean_stop: Column, days_since: Column) -> Column:
    """-2: never, -1: after an unclean stop, 0: always, n: if the last crawl is n days old."""
    return F.when(interval == -2, False).when(interval == -1, ~clean_stop).when(interval == 0, True).otherwise(days_since >= interval)


def over_limit(folders: DataFrame, limit: int) -> DataFrame:
    """``root, folders, over``: whether a root has more folders than can be watched, so that it is crawled first (root, folder)."""
    return folders.groupBy("root").agg(F.count_distinct("folder").alias("folders")).withColumn("over", F.col("folders") > limit)


def stale(removable: Column, unmounted: Column, now: Column, days: int) -> Column:
    """Whether a removable volume has been away for more than so many days; 0: never."""
    if days == 0:
        return F.lit(False)
    return F.coalesce(removable & (unmounted < now - F.make_dt_interval(F.lit(days))), F.lit(False))


def network_allows(kind: Column) -> Column:
    """Feeds are fetched over a local network only; an unknown one doesn't count as such."""
    return F.coalesce(F.lower(kind) == "lan", F.lit(False))


def order_roots(roots: DataFrame) -> DataFrame:
    """``root, place`` of roots (root, priority, added): priority roots come first, the last added of them at the front."""
    once = roots.groupBy("root").agg(F.max("priority").alias("priority"), F.min("added").alias("added"))
    first = F.when(F.col("priority"), F.struct(F.lit(0).alias("a"), (-F.col("added")).alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("added").alias("b")))
    return once.select("root", first.alias("place")).orderBy("place").select("root", F.col("place.a").alias("later"), F.col("place.b").alias("rank"))


def edit_list(values: Column, add: list[str], remove: list[str]) -> Column:
    """A configured list after additions and removals; order kept, no repeats."""
    with_new = F.array_union(values, F.array(*[F.lit(a) for a in add]).cast("array<string>"))
    return F.filter(with_new, lambda v: ~v.isin(remove)) if remove else with_new


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def fallback_types(mimes: DataFrame, rules: DataFrame) -> DataFrame:
    """``mime, types, all_types``: of the first rule with types, and of all rules that allow the mime."""
    hits = mimes.select("mime").distinct().join(few(rules.where(F.size("types") > 0)), F.expr("mime RLIKE allow_regex"))
    return hits.groupBy("mime").agg(F.min_by("types", "rule_order").alias("types"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("all_types"))


def writers(resources: DataFrame, modules: DataFrame) -> DataFrame:
    """``resource, module``: by any of a resource's types; null where no module writes it back."""
    typed = resources.select("resource", F.explode("types").alias("type")).join(few(modules), "type").select("resource", "module").distinct()
    return resources.select("resource").join(typed, "resource", "left")


def not_in_flight(work: DataFrame, in_flight: DataFrame, key: str) -> DataFrame:
    """Without what was being read when a run ended abruptly."""
    return work.join(in_flight.select(key), key, "left_anti")


def ranked(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """``item, module, field, value``: of several sources of one field the one that the module ranks first.

    values: item, module, field, source, value; ranks: module, field, source, rank.  Blank values don't count.
    """
    known = values.where(F.trim("value") != "").join(few(ranks), ["module", "field", "source"])
    return known.groupBy("item", "module", "field").agg(F.min_by(F.trim("value"), "rank").alias("value"))


def pause_on_battery(on_battery: Column, low: Column, allowed: Column, first_time_allowed: Column, first_done: Column) -> Column:
    """Whether indexing pauses: never on mains; on battery if it is low, or if it isn't allowed, but for a first run that is allowed and not done."""
    on_battery, low, allowed, first_time_allowed, first_done = (F.coalesce(c, F.lit(False)) for c in (on_battery, low, allowed, first_time_allowed, first_done))
    return on_battery & (low | (~allowed & (~first_time_allowed | first_done)))


def queue_order(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Events (path, ...) with ``root`` and ``priority``: 0 below a root that comes first, 1 below others; null outside of all roots (root, priority)."""
    held = longest_root(events.select("path").distinct(), roots)
    flagged = held.join(roots.select("root", F.when(F.col("priority"), 0).otherwise(1).alias("priority")), "root")
    return events.join(flagged, "path", "left")


def root_counters(entries: DataFrame, roots: DataFrame, ignored: Column) -> DataFrame:
    """``root, folders, files, folders_ignored, files_ignored`` of entries (path, is_dir); each counts for the deepest root that holds it, and roots without any have zeros."""
    held = entries.join(longest_root(entries.select("path").distinct(), roots), "path")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counted = held.withColumn("_ignored", ignored).groupBy("root").agg(n(F.col("is_dir") & ~F.col("_ignored")).alias("folders"), n(~F.col("is_dir") & ~F.col("_ignored")).alias("files"), n(F.col("is_dir") & F.col("_ignored")).alias("folders_ignored"), n(~F.col("is_dir") & F.col("_ignored")).alias("files_ignored"))
    return roots.select("root").distinct().join(counted, "root", "left").fillna(0)
