"""All queries of the engine, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import dates, media, paths, strings, urns
from sextant.model import CLASSES
from sextant.operators import diff, feeds, policy, roots, search, status, tags
from sextant.plans import contents, extraction, images, oracle, packages, store, upkeep
from sextant.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


# Searches.


def _class_search(name: str, class_name: str | None, terms: list[str], **how) -> None:
    QUERIES[name] = lambda s, d: search.search_class(store.elements(s, d), store.volumes(s, d), class_name, terms, **how)


_class_search("q1_documents_fts", CLASSES[0], ["the", "and"], limit=50)
_class_search("q1_documents_all", CLASSES[0], [], show_all=True, offset=5, limit=20)
_class_search("q1_documents_detailed", CLASSES[0], ["that"], detailed=True, limit=30)
_class_search("q2_videos", CLASSES[3], ["the"], limit=40)
_class_search("q3_images_or", CLASSES[1], ["clown", "idiot", "que"], any_term=True, limit=-1)
_class_search("q4_music", CLASSES[2], ["und"], limit=-1)
_class_search("q8_software", CLASSES[4], ["the"], order="title", columns=("ie", "title"), limit=25)
_class_search("q10_files", None, ["with", "from"], limit=60)


@query("q5_artists")
def _(s, d):
    artists = store.table(s, d, "supplier").select(F.concat(F.lit("urn:artist:"), strings.urn_escape(F.col("s_name"))).alias("ie"), F.col("s_name").alias("title"), F.lit("nmm:Artist").alias("class"), F.col("s_name").alias("text"))
    return search.search_class(artists, None, "nmm:Artist", ["supplier"], order="title", columns=("ie", "title"), volume_check=False, limit=-1)


@query("q6_albums")
def _(s, d):
    p = store.table(s, d, "part")
    urn = F.concat(F.lit("urn:album:"), strings.urn_escape(F.col("p_name")), F.lit(":"), strings.urn_escape(F.col("p_brand")))
    albums = p.select(urn.alias("ie"), F.col("p_name").alias("title"), F.lit("nmm:MusicAlbum").alias("class"), F.col("p_type").alias("text"))
    return search.search_class(albums, None, "nmm:MusicAlbum", ["promo"], order="title", columns=("ie", "title"), volume_check=False, limit=-1)


@query("q7_feed_messages")
def _(s, d):
    m = store.messages(s, d).withColumns({"ie": F.col("urn"), "class": F.lit("mfo:FeedMessage")})
    return search.search_class(m, None, "mfo:FeedMessage", ["the"], order="title", columns=("ie", "title"), volume_check=False, limit=-1)


@query("q9_software_categories")
def _(s, d):
    c = store.table(s, d, "part").select(F.concat(F.lit("urn:software-category:"), F.split_part("p_type", F.lit(" "), F.lit(1))).alias("ie"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("title"), F.lit("nfo:SoftwareCategory").alias("class"), F.col("p_type").alias("text"))
    return search.search_class(c, None, "nfo:SoftwareCategory", [], order="title", columns=("ie", "title"), volume_check=False)


@query("q11_folders")
def _(s, d):
    v = store.volumes(s, d)
    folders = v.select(F.concat(F.lit("urn:folder:"), F.col("urn")).alias("ie"), F.col("root_uri").alias("url"), F.lit("nfo:Folder").alias("class"), F.col("urn").alias("text"), F.col("urn").alias("data_source"))
    return search.search_class(folders, v, "nfo:Folder", ["src1"])


@query("q12_everything")
def _(s, d):
    return search.search_everything(store.elements(s, d), store.files(s, d), store.volumes(s, d), ["that"])


@query("fts_index_and")
def _(s, d):
    return search.search_index(search.inverted_index(store.elements(s, d), only=["that", "with"]), ["that", "with"])


@query("fts_stop_words")
def _(s, d):
    words = store.elements(s, d).select(F.explode(strings.tokens(F.col("text"), stop=["the", "and", "of"])).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).where("n >= 50")


# Tags.


@query("q13_tag_list")
def _(s, d):
    return tags.list_tags(store.tags(s), store.edges(s, d))


@query("q13_tag_list_some")
def _(s, d):
    return tags.list_tags(store.tags(s), store.edges(s, d), ["toxic:1", "unused", "no such"])


@query("q14_all_tags")
def _(s, d):
    return tags.with_all_tags(store.tags(s), store.edges(s, d), ["quality:1", "toxic:0", "no such"])


@query("q14_all_tags_none")
def _(s, d):
    return tags.with_all_tags(store.tags(s), store.edges(s, d), ["no such"])


@query("q15_files_of_tag")
def _(s, d):
    return tags.files_of(store.tags(s), store.edges(s, d), store.files(s, d), "toxic:1")


@query("q16_urns_of_files")
def _(s, d):
    return tags.urns_of(store.files(s, d), ["file:///src0/0.txt", "file:///src1/1.txt", "file:///src4/4.txt"], store.edges(s, d), "urn:tag:toxic:0")


@query("q17_tags_of_file")
def _(s, d):
    return tags.tags_of(store.tags(s), store.edges(s, d), store.files(s, d).withColumn("stored_as", F.col("subject")), "urn:fileid:0")


@query("q18_tag_resources")
def _(s, d):
    new = store.elements(s, d).where(F.col("class") == CLASSES[1]).select(F.col("ie").alias("subject"))
    return tags.tag_resources(store.edges(s, d), new, "urn:tag:unused")


@query("q18_untag_resources")
def _(s, d):
    gone = store.elements(s, d).where("sn < 10").select(F.col("ie").alias("subject"))
    return tags.untag_resources(store.edges(s, d), gone, "urn:tag:toxic:0")


@query("q18_remove_tag")
def _(s, d):
    return tags.remove_tag(store.tags(s), store.edges(s, d), "toxic:0")[1]


@query("k14_insert_tag_if_absent")
def _(s, d):
    p = store.table(s, d, "part")
    known = p.where("p_size < 5").select(F.concat(F.lit("urn:tag:"), "p_brand").alias("urn"), F.col("p_brand").alias("label"), F.lit("known").alias("description")).distinct()
    label = F.explode(F.array("p_brand", F.concat("p_brand", F.lit("/"), "p_size")))
    new = p.select(label.alias("label"), F.concat(F.lit("urn:new:"), F.col("p_partkey").cast("string")).alias("urn"), F.lit("added").alias("description"))
    return tags.add_tags(known, new)


# Status and details.


def _quads(s, d):
    e = store.elements(s, d)
    facts = {"class": "rdf:type", "title": "nie:title", "mime": "nie:mimeType", "url": "nie:isStoredAs"}
    files = store.files(s, d).withColumn("folder", paths.parent(F.col("uri")))
    return status.quads_of(e, "ie", facts, "content").unionByName(status.quads_of(files, "uri", {"subject": "nie:interpretedAs", "file_name": "nfo:fileName", "folder": "nfo:belongsToContainer"}, "FileSystem"))


@query("q19_class_statistics")
def _(s, d):
    return status.class_statistics(_quads(s, d))


@query("q19_class_statistics_named")
def _(s, d):
    return status.class_statistics(_quads(s, d), "DOC")


@query("q20_counts")
def _(s, d):
    e = store.elements(s, d)
    marked = e.join(store.volumes(s, d).select(F.col("urn").alias("data_source"), "available"), "data_source", "left")
    return marked.agg(F.count("*").alias("files"), F.countDistinct("container").alias("folders"), F.countDistinct(F.when(F.col("available"), F.col("container"))).alias("available_folders"))


@query("q21_eta")
def _(s, d):
    m = store.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity")).alias("elapsed"), F.count("*").alias("done"), F.sum((F.col("l_returnflag") == "N").cast("int")).alias("left"))
    eta = m.select(F.col("l_suppkey").alias("miner"), dates.remaining(F.col("elapsed"), F.col("done"), F.col("left")).alias("seconds"))
    return eta.select("miner", "seconds", strings.seconds_text(F.col("seconds")).alias("text"), eta.agg(F.max("seconds")).scalar().alias("longest"))


@query("q22_failures")
def _(s, d):
    e = store.elements(s, d).where("sn % 7 = 2").select(F.col("url").alias("uri"), F.col("text").alias("message"))
    return status.failures(e, 24)


@query("k20_error_report")
def _(s, d):
    e = store.elements(s, d)
    errors = e.where("sn = 3").select(F.md5("url").alias("key"), F.col("url").alias("uri"), strings.truncate(F.col("text"), 40).alias("message"))
    fixed = e.where("sn = 3 AND doc_id % 2 = 0").select(F.md5("url").alias("key"))
    return diff.delete(errors, fixed, ["key"])


@query("q23_describe")
def _(s, d):
    return status.describe(_quads(s, d), "file:///src0/0.txt")


@query("q24_prefixes")
def _(s, d):
    p = store.table(s, d, "part").select(F.concat(F.element_at(F.array(F.lit("http://a.org/n#"), F.lit("http://b.org/m#"), F.lit("http://c.org/x#")), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_brand")).alias("iri")).distinct()
    return p.select("iri", strings.shorten(F.col("iri"), {"http://a.org/n#": "a", "http://b.org/m#": "b"}).alias("short"))


@query("q27_reset_file")
def _(s, d):
    return diff.delete_under(store.files(s, d), "file:///src3", "uri", itself=True).select("uri", "data_source")


@query("q28_turtle")
def _(s, d):
    return status.turtle(_quads(s, d).where("g = 'FileSystem' AND s LIKE 'file:///src7/%'"), {"http://a#": "a"})


@query("q28_json_ld")
def _(s, d):
    return status.json_ld(_quads(s, d).where("s LIKE 'file:///src7/%'")).select("s", F.get_json_object("text", "$['@id']").alias("id"), F.get_json_object("text", "$.properties['nfo:fileName'][0]").alias("name"))


@query("q28_insert_data")
def _(s, d):
    return status.insert_data(_quads(s, d).where("s LIKE 'file:///src7/%'"))


@query("a11_extractor_statistics")
def _(s, d):
    e = store.table(s, d, "events").select(F.col("event_type").alias("module"), (F.col("value") > 50).alias("failed"), F.floor("value").alias("seconds"))
    return status.extractor_statistics(e)


# Store scans, work lists.


@query("s3_content_check")
def _(s, d):
    e = store.elements(s, d).select(F.col("url").alias("path"))
    return roots.poisoned(e, ["1?.txt", "7.txt"])


@query("s6_store_scan")
def _(s, d):
    e, h = store.elements(s, d), store.hashed(s, d).withColumn("has_hash", F.lit(True))
    return e.where("data_source = 'src2'").join(h, "ie", "left").join(store.volumes(s, d).select(F.col("urn").alias("data_source"), F.col("root_uri").alias("folder")), "data_source", "left").select("url", "folder", "mime", F.coalesce("has_hash", F.lit(False)).alias("has_hash")).orderBy("url")


@query("s7_channel_scan")
def _(s, d):
    c = store.channels(s, d)
    settings = c.select("urn", feeds.refresh_interval(F.col("update_interval")).alias("minutes"))
    return feeds.scan_channels(c.select("urn", "title"), settings, ["urn:channel:1", "urn:channel:2", "urn:channel:x"])


@query("s8_volumes")
def _(s, d):
    return store.volumes(s, d)


@query("s11_sidecars")
def _(s, d):
    # Every third document has a sidecar of the same stem.
    e = store.elements(s, d)
    sidecars = e.where("doc_id % 3 = 0").select(F.concat(strings.stem(F.col("url")), F.lit(".xmp")).alias("sidecar"))
    return e.select("url", F.concat(strings.stem(F.col("url")), F.lit(".xmp")).alias("sidecar")).join(sidecars, "sidecar", "left_semi").select("url", "sidecar")


@query("s12_cue_lookup")
def _(s, d):
    e = store.elements(s, d).where(F.col("class") == CLASSES[2])
    cues = e.where("doc_id % 2 = 0").select("container", F.concat(strings.stem(F.col("url")), F.lit(".cue")).alias("cue"))
    other = cues.groupBy("container").agg(F.min("cue").alias("other"))
    own = e.select("url", "container", F.concat(strings.stem(F.col("url")), F.lit(".cue")).alias("exact"))
    return own.join(cues.select(F.col("cue").alias("exact"), F.lit(True).alias("hit")), "exact", "left").join(other, "container", "left").select("url", F.when(F.col("hit"), F.col("exact")).otherwise(F.col("other")).alias("cue"))


RANKS = {"Documents": 0, "Audio": 1, "Video": 2}


@query("d15_work_list")
def _(s, d):
    return diff.work_list(store.elements(s, d), store.hashed(s, d), RANKS)


@query("o8_work_list_next_page")
def _(s, d):
    return diff.work_list(store.elements(s, d), store.hashed(s, d), RANKS, after=(0, "urn:fileid:5"), batch=50)


@query("a6_remaining_items")
def _(s, d):
    return store.elements(s, d).join(store.hashed(s, d), "ie", "left_anti").groupBy("graph").agg(F.count("*").alias("n"))


@query("a12_progress")
def _(s, d):
    e = store.elements(s, d).join(store.hashed(s, d).withColumn("done", F.lit(1)), "ie", "left")
    return e.groupBy("graph").agg(F.count("done").alias("done"), F.count("*").alias("total"), (F.count("done") / F.count("*")).alias("ratio"))


# Diff and mutations.


@query("d1_diff")
def _(s, d):
    return diff.diff(store.disk(s, d), store.stored(s, d))


@query("a9_diff_counters")
def _(s, d):
    return diff.diff(store.disk(s, d), store.stored(s, d)).groupBy("state").agg(F.count("*").alias("n"))


@query("k1_upsert")
def _(s, d):
    changed = store.disk(s, d).select("uri", "mtime", "hash")
    return diff.upsert(store.stored(s, d).select("uri", "mtime", "hash"), changed.unionByName(changed), ["uri"])


@query("k4_recursive_delete")
def _(s, d):
    return diff.delete_under(store.elements(s, d), "file:///src1", "url").select("url", "data_source")


@query("k5_delete_files")
def _(s, d):
    e = store.elements(s, d).select("url", "graph")
    return diff.delete(e, e.where("graph = 'Audio'"), ["url"])


@query("k6_move")
def _(s, d):
    return diff.move(store.elements(s, d).select("doc_id", "url"), "file:///src1", "file:///new/place", "url").where("url LIKE '%new%'")


@query("k7_invalidate")
def _(s, d):
    t = store.stored(s, d).select("uri", "hash")
    return diff.invalidate(t, t.where("uri LIKE '%7'"))


@query("k8_set_attributes")
def _(s, d):
    t = store.stored(s, d).select("uri", "mtime", "hash")
    return diff.set_attributes(t, store.disk(s, d), ["mtime"])


@query("k9_mark_volumes")
def _(s, d):
    return diff.mark_volumes(store.volumes(s, d), ["src0", "src3"], False, F.lit("2024-06-01 00:00:00").cast("timestamp"))


@query("k10_delete_of_removable")
def _(s, d):
    return diff.delete_of_volumes(store.files(s, d), store.volumes(s, d), F.col("is_removable") & ~F.col("is_optical")).select("uri", "data_source")


@query("k11_delete_unmounted_before")
def _(s, d):
    return diff.delete_of_volumes(store.files(s, d), store.volumes(s, d), F.col("unmount_date") < F.lit("2024-01-12 00:00:00").cast("timestamp")).select("uri", "data_source")


@query("k12_insert_hash")
def _(s, d):
    e = store.elements(s, d).where("graph = 'Video'").select("ie")
    return diff.insert_absent(store.hashed(s, d), e, ["ie"]).select("ie")


@query("k13_drop_content_copy")
def _(s, d):
    q = _quads(s, d)
    gone = store.elements(s, d).where("sn = 4").select(F.col("ie").alias("s"), F.lit("content").alias("g"))
    return diff.delete(q, gone, ["s", "g"]).select("g", "s", "p", "o")


@query("d25_reconcile_mounts")
def _(s, d):
    v = store.volumes(s, d)
    mounted = v.where("substring(urn, 4) % 2 = 0").select("urn").unionByName(s.createDataFrame([("fresh",)], "urn string"))
    return roots.reconcile_mounts(v.select("urn", "available"), mounted)


# Roots, filters, rules.


def _roots(s, d):
    t = store.tree(s, d)
    nations = t.where("n_nationkey % 3 = 0").select(paths.parent(F.col("path")).alias("root"), (F.col("n_nationkey") % 2 == 0).alias("recursive"), (F.col("n_nationkey") == 9).alias("ignored")).distinct()
    regions = t.where("r_name IN ('ASIA', 'EUROPE')").select(F.concat(F.lit("/"), F.col("r_name")).alias("root"), F.lit(True).alias("recursive"), F.lit(False).alias("ignored")).distinct()
    return nations.unionByName(regions)


@query("j_longest_root")
def _(s, d):
    return roots.longest_root(store.tree(s, d), _roots(s, d))


@query("j_reparent")
def _(s, d):
    return roots.reparent(_roots(s, d))


@query("j_dedupe_roots")
def _(s, d):
    return roots.dedupe_roots(_roots(s, d).select("root"))


@query("p16_indexable")
def _(s, d):
    return roots.indexable(store.tree(s, d), _roots(s, d), ["*7", "Customer#0000000?1"])


@query("p14_glob_filter")
def _(s, d):
    t = store.tree(s, d)
    return t.select("path", roots.filtered(paths.base_name(F.col("path")), ["*1?", "*99*"]).alias("accept"), roots.filtered(paths.base_name(F.col("path")), ["*1?"], accept_by_default=False).alias("deny"), roots.path_filtered(F.col("path"), "/ASIA").alias("under"))


@query("p17_parent_indexable")
def _(s, d):
    t = store.tree(s, d)
    bad = roots.filtered(paths.base_name(F.col("path")), ["*5"])
    return t.groupBy(paths.parent(F.col("path")).alias("folder")).agg((~F.bool_or(bad)).alias("indexable"), F.count_if(bad).alias("ignored"), F.count_if(~bad).alias("found"))


@query("p20_rule_dispatch")
def _(s, d):
    mimes = store.table(s, d, "part").select(F.col("p_type").alias("mime"))
    rules = [("10-a", "alpha", "PROMO *", "*BRASS"), ("11-b", "beta", "*STEEL", None), ("12-c", "gamma", "S*", None), ("90-z", "generic", "*", "LARGE*")]
    table = s.createDataFrame([(o, m, paths.glob_regex(a), paths.glob_regex(b) if b else None) for o, m, a, b in rules], "rule_order string, module string, allow_regex string, block_regex string")
    return roots.dispatch(mimes, table)


@query("o7_priority_queue")
def _(s, d):
    c = store.changes(s, d)
    return c.select("seq", F.when(F.col("kind") == "DELETED", 0).otherwise(1).alias("priority")).orderBy("priority", "seq").limit(100)


# Feeds.


@query("a10_latest_message")
def _(s, d):
    return feeds.latest(store.messages(s, d), "url", "published", "turn").select("url", "urn", "published")


@query("d20_feed_reconcile")
def _(s, d):
    m = store.messages(s, d)
    new = m.where("turn != 1").select("urn", (F.col("published") + F.when(F.col("role") == "user", 1).otherwise(0)).alias("published"))
    return feeds.reconcile(new, m.where("role != 'system' AND (turn < 6)"), "urn")


@query("k16_keep_predicates")
def _(s, d):
    q = _quads(s, d)
    return feeds.keep_predicates(q, q.where("s LIKE 'file:///src5/%'").select("s"), ["nie:interpretedAs"]).select("s", "p", "o")


@query("k17_orphans")
def _(s, d):
    return feeds.orphans(store.messages(s, d), store.channels(s, d).where("update_interval > 2")).select("urn", "channel")


@query("k17_without_orphans")
def _(s, d):
    return feeds.without_orphans(store.messages(s, d).select("urn", "channel"), store.channels(s, d).where("update_interval > 2"))


@query("q25_feed_list")
def _(s, d):
    return store.channels(s, d).select("urn", "url", "title", feeds.refresh_interval(F.col("update_interval")).alias("minutes"))


@query("d21_debounce")
def _(s, d):
    return feeds.debounce(store.table(s, d, "events"), "user_id", "ts", "30 minutes")


@query("d22_enclosures")
def _(s, d):
    m = store.messages(s, d).select(F.col("channel").alias("message"), "url", F.col("turn").alias("position"))
    return feeds.distinct_enclosures(m)


# Events.


@query("d7_coalesce")
def _(s, d):
    return events.coalesce_batch(store.changes(s, d))


@query("d13_collapse")
def _(s, d):
    kinds = F.create_map(*[F.lit(x) for kv in {"signup": "CREATED", "click": "CHANGED", "view": "ATTRIBUTE_CHANGED", "purchase": "CHANGES_DONE", "error": "DELETED"}.items() for x in kv])
    e = store.table(s, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), F.element_at(kinds, F.col("event_type")).alias("kind"))
    return events.collapse_batch(e)


@query("d8_purge")
def _(s, d):
    c = store.changes(s, d)
    c = c.withColumn("source", F.when(F.col("seq") % 3 == 0, F.concat("source", F.lit("/x"))).otherwise(F.col("source")))
    return events.without_purged(c).select("seq", "kind", "source")


@query("d6_moves")
def _(s, d):
    c = store.changes(s, d).where("kind = 'MOVED'")
    return c.select("seq", events.emitted_moves(F.col("seq") % 2 == 0, F.col("seq") % 3 == 0).alias("kind")).where("kind IS NOT NULL")


# Functions.


@query("f_strings")
def _(s, d):
    t = F.col("text")
    return store.table(s, d, "documents").select(
        "doc_id",
        strings.coalesce_strip(F.when(F.col("doc_id") % 2 == 0, F.lit("  ")), F.col("source")).alias("first"),
        strings.merge("*", F.col("lang"), F.when(F.col("doc_id") % 3 == 0, F.col("source"))).alias("merged"),
        F.md5(strings.normalize(t, 20)).alias("normal"),
        strings.truncate(t, 30).alias("cut"),
        strings.ellipsize(t, 12).alias("short"),
        strings.hex_pairs(F.substring("source", 1, 4).cast("binary")).alias("pairs"),
        strings.seconds_text(F.col("doc_id") * 977).alias("took"),
        F.md5(strings.literal(t)).alias("literal"),
        strings.blank(F.substring(t, 1, 1)).alias("blank"),
    )


@query("f_names")
def _(s, d):
    name = F.concat(F.translate("p_name", " ", "_"), F.element_at(F.array(F.lit(".mp3"), F.lit(".tar.gz"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return store.table(s, d, "part").select("p_partkey", strings.stem(name).alias("stem"), strings.title_of(name).alias("title"), strings.same_stem(name, F.concat(F.upper(strings.stem(name)), F.lit(".CUE"))).alias("same"), strings.extension_changed(name, F.lit("x.mp3")).alias("changed"))


@query("f_keywords")
def _(s, d):
    k = F.concat(F.lit('k"'), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(";"), F.lower("p_brand"), F.lit('"'))
    return store.table(s, d, "part").select("p_partkey", F.array_join(strings.keywords(k), "|").alias("keywords"))


@query("f_dates")
def _(s, d):
    o = store.table(s, d, "orders")
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit("-0530"), F.lit(".250Z")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    p = o.select("o_orderkey", dates.parse(F.concat(at, zone)).alias("p"))
    return p.select("o_orderkey", F.col("p.ms").cast("long").alias("ms"), F.col("p.offset").cast("long").alias("offset_s"), dates.text(F.col("p.ms")).alias("utc"), dates.local_date(F.col("p.ms"), F.col("p.offset")).alias("day"), dates.local_time(F.col("p.ms"), F.col("p.offset")).cast("long").alias("second"))


@query("f_date_guess")
def _(s, d):
    o = store.table(s, d, "orders")
    forms = ("yyyy", "yyyy-MM-dd", "yyyyMMddHHmmss", "yyyyMMddHHmmss'Z'", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.explode(F.array(*[F.date_format("o_orderdate", f) for f in forms]))
    return o.select("o_orderkey", text.alias("text")).select("o_orderkey", "text", dates.guess(F.col("text")).alias("guess"))


@query("f_media")
def _(s, d):
    x = store.table(s, d, "lineitem")
    return x.select(
        "l_orderkey", "l_linenumber",
        F.round(media.gps_decimal(F.col("l_quantity"), F.col("l_linenumber"), F.lit(30.0), F.when(F.col("l_returnflag") == "R", "S").otherwise("N")), 4).alias("gps"),
        media.rational(F.concat_ws("/", F.col("l_linenumber").cast("string"), (F.col("l_partkey") % 4).cast("string"))).alias("ratio"),
        media.orientation(F.col("l_linenumber") + 2).alias("orientation"),
        media.frames_to_seconds(F.col("l_partkey")).alias("seconds"),
        media.resolution(F.col("l_quantity"), F.col("l_linenumber")).alias("dpi"),
    )


@query("f_image_values")
def _(s, d):
    p = store.table(s, d, "part")
    n, text = F.col("p_size") - 1, F.col("p_size").cast("string")
    place = F.concat(text, F.lit(","), text, F.lit(".5"), F.when(F.col("p_partkey") % 2 == 0, "S").otherwise("E"))
    return p.select(
        "p_partkey", media.metering(n).alias("metering"), media.flash(n).alias("flash"), media.flash(n, by_bit=True).alias("flash_bit"), media.white_balance(n % 3).alias("balance"),
        media.fnumber(F.concat(F.when(F.col("p_partkey") % 2 == 0, "f/").otherwise("F"), text)).alias("fnumber"), F.round(media.exposure(F.concat(F.lit("1/"), text)), 6).alias("exposure"),
        F.round(media.altitude(F.col("p_retailprice"), F.col("p_partkey") % 2), 2).alias("altitude"), F.round(media.gps_text(place), 6).alias("gps"), media.region_type(F.element_at(F.array(F.lit("Face"), F.lit("PETS"), F.lit("barcode"), F.lit("x"), F.lit(None)), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("region"),
    )


@query("f_page_description_dates")
def _(s, d):
    forms = ("'('HH:mm EEEE d MMMM yyyy')'", "EEE MMM d HH:mm:ss yyyy", "d MMM yyyy HH:mm:ss '-0600'", "h:mm a MMMM d, yyyy")
    text = F.posexplode(F.array(*[F.date_format("o_orderdate", f) for f in forms]))
    return store.table(s, d, "orders").select("o_orderkey", text.alias("form", "text")).select("o_orderkey", "form", dates.page_description(F.col("text")).alias("iso"))


@query("f_urns")
def _(s, d):
    return store.table(s, d, "part").select("p_partkey", F.concat(F.lit("urn:equipment:"), strings.urn_escape(F.col("p_brand")), F.lit(":"), strings.urn_escape(F.col("p_name")), F.lit(":")).alias("urn"))


@query("g_metadata_priority")
def _(s, d):
    o = store.table(s, d, "orders")
    return o.select("o_orderkey", strings.coalesce_strip(F.when(F.col("o_orderkey") % 3 == 0, F.lit(" ")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), F.col("o_orderstatus")).alias("title"))


@query("f_entity_urns")
def _(s, d):
    p = store.table(s, d, "part")
    date = F.when(F.col("p_size") % 2 == 0, F.lit("2001-02-03T04:05:06Z"))
    maker = F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
    return p.select("p_partkey", urns.album(F.col("p_name"), maker, date).alias("album"), urns.album_disc(F.col("p_name"), maker, date, F.col("p_size")).alias("disc"), urns.equipment(maker, F.col("p_brand")).alias("equipment"), urns.external(F.lit("src"), F.col("p_partkey").cast("string"), maker).alias("external"))


# Policies.


@query("d26_out_of_space")
def _(s, d):
    c = store.table(s, d, "customer")
    return c.select("c_custkey", policy.out_of_space(F.abs("c_acctbal"), F.lit(10_000.0), F.col("c_nationkey") - 1).alias("pause"), policy.throttle(F.col("c_nationkey"), F.col("c_custkey") % 2 == 0).alias("throttle"))


@query("d28_crawl_needed")
def _(s, d):
    c = store.table(s, d, "customer")
    return c.select("c_custkey", policy.crawl_needed(F.col("c_nationkey") % 6 - 2, F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 5).alias("needed"))


@query("d3_root_order")
def _(s, d):
    n = store.table(s, d, "nation")
    return policy.order_roots(n.select(F.concat(F.lit("/"), F.col("n_name")).alias("root"), (F.col("n_regionkey") == 2).alias("priority"), F.col("n_nationkey").alias("added")))


@query("a4_monitor_limit")
def _(s, d):
    t = store.tree(s, d)
    return policy.over_limit(t.select(F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2))).alias("root"), F.regexp_replace("path", "/[^/]*$", "").alias("folder")), 4)


@query("d24_stale_volumes")
def _(s, d):
    v, now = store.volumes(s, d), F.lit("2024-01-15 00:00:00").cast("timestamp")
    away = lambda days: policy.stale(F.col("is_removable"), F.col("unmount_date"), now, days)
    return v.select("urn", away(3).alias("after_3_days"), away(10).alias("after_10_days"), away(0).alias("never"))


@query("d33_network_gate")
def _(s, d):
    n = store.table(s, d, "nation")
    kind = F.element_at(F.array(F.lit("LAN"), F.lit("gprs"), F.lit(None), F.lit("lan")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return n.select("n_name", policy.network_allows(kind).alias("fetch"))


@query("q26_edit_roots")
def _(s, d):
    r = store.table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    edited = policy.edit_list(F.col("names"), ["KENYA", "ATLANTIS"], ["CHINA", "FRANCE"])
    return r.select("n_regionkey", F.array_join(edited, ",").alias("roots"), policy.same_set(F.col("names"), edited).alias("same"))


@query("a13_fallback_types")
def _(s, d):
    mimes = store.table(s, d, "part").select(F.col("p_type").alias("mime"))
    rules = [("10-a", "PROMO *", ["A", "B"]), ("11-b", "*STEEL", []), ("12-c", "*STEEL", ["C"]), ("90-z", "*", ["Z", "A"])]
    table = s.createDataFrame([(o, paths.glob_regex(g), t) for o, g, t in rules], "rule_order string, allow_regex string, types array<string>")
    found = policy.fallback_types(mimes, table)
    return found.select("mime", F.array_join("types", ",").alias("types"), F.array_join("all_types", ",").alias("all_types"))


@query("p21_writers")
def _(s, d):
    e = store.elements(s, d).select(F.col("ie").alias("resource"), F.array("class", F.lit("nie:InformationElement")).alias("types"))
    modules = s.createDataFrame([("nfo:Image", "xmp"), ("nmm:MusicPiece", "audio"), ("nfo:Video", "audio")], "type string, module string")
    return policy.writers(e, modules).select("resource", "module")


@query("d18_not_in_flight")
def _(s, d):
    e = store.elements(s, d).select("url", "doc_id")
    return policy.not_in_flight(e, e.where("doc_id % 50 = 7"), "url")


@query("g_ranked_sources")
def _(s, d):
    o = store.table(s, d, "orders")
    sources = {"xmp": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")), "exif": F.when(F.col("o_orderkey") % 2 == 0, F.lit("  ")).otherwise(F.col("o_orderstatus")), "iptc": F.lit("fallback")}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("source"), v.alias("value")) for k, v in sources.items()]))
    values = o.select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderkey") % 4 == 0, "png").otherwise("jpeg").alias("module"), F.lit("title").alias("field"), rows.alias("s")).select("item", "module", "field", "s.*")
    ranks = s.createDataFrame([("png", "title", "xmp", 0), ("png", "title", "exif", 1), ("png", "title", "iptc", 2), ("jpeg", "title", "iptc", 2), ("jpeg", "title", "exif", 0), ("jpeg", "title", "xmp", 1)], "module string, field string, source string, rank int")
    return policy.ranked(values, ranks)


@query("f_partial_dates")
def _(s, d):
    at, known = F.col("o_orderdate"), F.col("o_orderkey") % 5
    part = lambda k, f: F.when(known >= k, f(at))
    offset = F.element_at(F.array(F.lit(2.0), F.lit(-5.5), F.lit(0.0)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = dates.completed(F.when(F.col("o_orderkey") % 11 != 0, F.year(at)), part(1, F.month), part(2, F.dayofmonth), part(3, F.hour), part(3, F.minute), part(4, F.second), offset)
    return store.table(s, d, "orders").select("o_orderkey", text.alias("date"))


@query("f_formatted_dates")
def _(s, d):
    at = F.col("o_orderdate")
    form = "dd/MM/yyyy HH:mm:ss"
    text = F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.date_format(at, form))
    mail = F.concat(F.date_format(at, "EEE, d MMM yyyy HH:mm:ss "), F.when(F.col("o_orderkey") % 2 == 0, "GMT").otherwise("-0300"))
    return store.table(s, d, "orders").select("o_orderkey", dates.formatted(text, form, "Asia/Kolkata").alias("date"), dates.rfc1123(mail).alias("mail_date"))


@query("f_octal_triplets")
def _(s, d):
    text = F.concat(F.col("c_name"), F.lit("\\303\\230"), F.col("c_mktsegment"), F.lit("\\400\\"))
    return store.table(s, d, "customer").select("c_custkey", strings.octal_triplets(text).alias("text"))


@query("f_list_index")
def _(s, d):
    return store.table(s, d, "nation").select("n_name", strings.index_in(F.initcap("n_name"), ["India", "BRAZIL", "france", "india"]).alias("place"))


@query("f_image_profiles")
def _(s, d):
    p = store.table(s, d, "part")
    mime = F.when(F.col("p_partkey") % 2 == 0, "image/jpeg").otherwise("image/png")
    side = F.when(F.col("p_size") == 7, 120).when(F.col("p_size") == 8, 48).otherwise(F.col("p_size") * F.col("p_size") * 2)
    path = F.concat(F.lit("mwg-rs:Regions/mwg-rs:RegionList"), F.when(F.col("p_size") > 5, F.concat(F.lit("["), F.col("p_size"), F.lit("]"))).otherwise(""), F.lit("/mwg-rs:Area"))
    return p.select("p_partkey", media.image_profile(mime, side, side, F.lit(24)).alias("profile"), media.region_index(path).cast("long").alias("region"))


@query("d4_folders_to_visit")
def _(s, d):
    n = store.table(s, d, "nation").join(store.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    top, inner = F.concat(F.lit("/"), F.col("r_name")), F.concat(F.lit("/"), F.col("r_name"), F.lit("/"), F.col("n_name"))
    deepest = F.explode(F.transform(F.array(F.lit("0"), F.lit("1"), F.lit("2")), lambda k: F.concat(inner, F.lit("/D"), k)))
    folders = n.select(top.alias("path"), F.lit(False).alias("mount")).distinct().unionByName(n.select(inner.alias("path"), (F.col("n_nationkey") % 4 == 1).alias("mount"))).unionByName(n.select(deepest.alias("path"), F.lit(False).alias("mount")))
    outer = n.select(top.alias("root"), (F.col("r_regionkey") != 0).alias("recursive"), (F.col("r_regionkey") == 4).alias("ignored")).distinct()
    nested = n.where("n_nationkey % 7 = 6").select(inner.alias("root"), F.lit(True).alias("recursive"), F.lit(False).alias("ignored"))
    return roots.to_visit(folders, outer.unionByName(nested))


@query("d5_without_ignored")
def _(s, d):
    n = store.table(s, d, "nation").join(store.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    stored = n.select(F.concat(F.lit("/"), F.col("r_name"), F.lit("/"), F.col("n_name")).alias("path"), "n_nationkey")
    configured = n.select(F.concat(F.lit("/"), F.col("r_name")).alias("root"), F.col("r_regionkey").isin(1, 2).alias("ignored"), (F.col("r_regionkey") == 2).alias("preserved")).distinct()
    return roots.without_ignored(stored, configured)


def queries() -> dict[str, Query]:
    return QUERIES | extraction.QUERIES | contents.QUERIES | images.QUERIES | packages.QUERIES | upkeep.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | extraction.SQL | contents.SQL | images.SQL | packages.SQL | upkeep.SQL
