"""Queries of feeds, roots, moves and quads in bulk, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import diff, feeds, policy, tags
from sextant.plans import store


def _urls(s, d, rest: int):
    return store.channels(s, d).where(F.split_part("url", F.lit("/"), F.lit(-1)).cast("long") % 4 == rest).select("url")


def q25_feed_add(s, d):
    c = store.channels(s, d)
    n = F.split_part("url", F.lit("/"), F.lit(-1)).cast("long")
    new = c.select(F.concat(F.lit("urn:new:"), n.cast("string")).alias("urn"), F.when(n % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("http://more/"), (n % 50).cast("string"))).alias("url"), F.lit("new").alias("title"), "update_interval")
    return feeds.add_feeds(c.select("urn", "url", "title", "update_interval"), new).select("urn", "url", "title")


def _enclosures(s, d):
    m = store.messages(s, d)
    return m.select(F.col("urn").alias("message"), F.concat(F.lit("http://media/"), F.md5("urn")).alias("url"))


def q25_feed_delete(s, d):
    left, messages, enclosures = feeds.delete_feeds(store.channels(s, d), store.messages(s, d), _enclosures(s, d), _urls(s, d, 1))
    kinds = ((left.select("urn"), "channel"), (messages.select("urn"), "message"), (enclosures.select(F.col("message").alias("urn")), "enclosure"))
    out = None
    for df, kind in kinds:
        rows = df.select("urn", F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


def k16_insert_or_replace(s, d):
    e = store.elements(s, d)
    quads = e.select(F.lit("g").alias("g"), F.col("ie").alias("s"), F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).alias("o")) for p, c in (("nie:title", "file_name"), ("nie:mimeType", "mime"), ("rdf:type", "class"))])).alias("x")).select("g", "s", "x.p", "x.o")
    new = e.where("doc_id % 3 = 0").select(F.lit("g").alias("g"), F.col("ie").alias("s"), F.lit("nie:title").alias("p"), F.explode(F.array(F.lit("one"), F.lit("two"))).alias("o"))
    return feeds.insert_or_replace(quads, new)


def d27_pause_on_battery(s, d):
    c = store.table(s, d, "customer")
    bit = lambda k: F.col("c_custkey").bitwiseAND(1 << k) > 0
    return c.select("c_custkey", policy.pause_on_battery(bit(0), bit(1), bit(2), bit(3), bit(4)).alias("pause"))


def _roots(s, d):
    n = store.table(s, d, "nation").join(store.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    inner = n.where("n_nationkey % 3 = 0").select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("root"), (F.col("n_nationkey") % 2 == 0).alias("priority"))
    return inner.unionByName(n.where("r_regionkey > 1").select(F.concat(F.lit("/"), "r_name").alias("root"), (F.col("r_regionkey") == 2).alias("priority")).distinct())


def d9_queue_order(s, d):
    return policy.queue_order(store.tree(s, d).select("path", "c_custkey"), _roots(s, d)).select("c_custkey", "root", "priority")


def a9_root_counters(s, d):
    t = store.tree(s, d)
    entries = t.select("path", F.lit(False).alias("is_dir")).unionByName(t.select(F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.lit(True).alias("is_dir")).distinct())
    return policy.root_counters(entries, _roots(s, d), F.col("path").rlike("[37]$|IA$"))


def d12_moves(s, d):
    """Nations' folders move over their neighbours' files; of every third only the folder itself is indexed then."""
    t = store.tree(s, d)
    folders = t.select(F.regexp_replace("path", "/[^/]*$", "").alias("uri"), F.lit(-1).cast("long").alias("c_custkey")).distinct()
    files = t.select(F.col("path").alias("uri"), "c_custkey").unionByName(folders).unionByName(folders.select(F.concat(F.lit("/moved"), "uri").alias("uri"), F.lit(-2).cast("long").alias("c_custkey")))
    n = store.table(s, d, "nation").join(store.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name")
    moves = n.where("n_nationkey % 2 = 0").select(path.alias("old"), F.concat(F.lit("/moved"), path).alias("new"), (F.col("n_nationkey") % 3 != 0).alias("deep"))
    return diff.move_all(files, moves)


def o5_tag_limit(s, d):
    known = store.table(s, d, "part").select(F.concat(F.lit("urn:tag:"), F.col("p_partkey").cast("string")).alias("urn"), F.col("p_name").alias("label"), F.lit("").alias("description"))
    edges = store.table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("subject"), F.concat(F.lit("urn:tag:"), F.col("l_partkey").cast("string")).alias("tag_urn"))
    return tags.limit_reached(tags.list_tags(known, edges))


def p5_without_folder(s, d):
    """Files whose folder isn't in the store."""
    e = store.elements(s, d)
    folders = e.where("sn % 3 <> 1").select("container").distinct()
    return e.join(folders, "container", "left_anti").select("doc_id", "container")


QUERIES = {f.__name__: f for f in (q25_feed_add, q25_feed_delete, k16_insert_or_replace, d27_pause_on_battery, d9_queue_order, a9_root_counters, d12_moves, o5_tag_limit, p5_without_folder)}
_CHANNELS = "c AS (SELECT conv_id, 'urn:channel:' || conv_id AS urn, 'http://feeds/' || conv_id AS url, 'Channel ' || conv_id AS title FROM conversations GROUP BY conv_id)"
_TREE = """t AS (SELECT c_custkey, n_nationkey AS n, n_regionkey AS r, '/' || r_name AS top, '/' || r_name || '/' || n_name AS own, '/' || r_name || '/' || n_name || '/' || c_name AS path
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    h AS (SELECT *, CASE WHEN n % 3 = 0 THEN own WHEN r > 1 THEN top END AS root FROM t)"""
_ELEMENTS = "e AS (SELECT doc_id, 'urn:fileid:' || doc_id AS s, doc_id || '.txt' AS file_name, 'file:///' || source AS container, CAST(substr(source, 4) AS INT) AS sn FROM documents)"
SQL = {
    "q25_feed_add": f"""WITH {_CHANNELS} SELECT urn, url, title FROM c UNION ALL
        SELECT min(n_urn), url, 'new' FROM (SELECT 'urn:new:' || conv_id AS n_urn, 'http://more/' || conv_id % 50 AS url FROM c WHERE conv_id % 3 <> 0) GROUP BY url""",
    "q25_feed_delete": f"""WITH {_CHANNELS}, m AS (SELECT 'urn:message:' || conv_id || ':' || turn AS urn FROM conversations WHERE conv_id % 4 <> 1)
        SELECT urn, 'channel' AS kind FROM c WHERE conv_id % 4 <> 1 UNION ALL SELECT urn, 'message' FROM m UNION ALL SELECT urn, 'enclosure' FROM m""",
    "k16_insert_or_replace": f"""WITH {_ELEMENTS} SELECT 'g' AS g, s, 'nie:title' AS p, unnest(CASE WHEN doc_id % 3 = 0 THEN ['one', 'two'] ELSE [file_name] END) AS o FROM e
        UNION ALL SELECT 'g', s, 'nie:mimeType', (['text/plain', 'image/png', 'audio/mpeg', 'video/mp4', 'application/x-desktop'])[sn % 5 + 1] FROM e
        UNION ALL SELECT 'g', s, 'rdf:type', (['nfo:Document', 'nfo:Image', 'nmm:MusicPiece', 'nfo:Video', 'nfo:Software'])[sn % 5 + 1] FROM e""",
    "d27_pause_on_battery": "SELECT c_custkey, CASE WHEN k % 2 = 0 THEN false WHEN k // 2 % 2 = 1 THEN true WHEN k // 4 % 2 = 1 THEN false WHEN k // 8 % 2 = 0 THEN true ELSE k // 16 % 2 = 1 END AS pause FROM (SELECT *, c_custkey AS k FROM customer)",
    "d9_queue_order": f"WITH {_TREE} SELECT c_custkey, root, CASE WHEN root = own AND n % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END WHEN root = top THEN CASE WHEN r = 2 THEN 0 ELSE 1 END END AS priority FROM h",
    "a9_root_counters": f"""WITH {_TREE}, x AS (SELECT root, path, false AS is_dir FROM h UNION ALL SELECT DISTINCT root, own, true FROM h),
            y AS (SELECT root, is_dir, regexp_matches(path, '[37]$|IA$') AS gone FROM x WHERE root IS NOT NULL),
            roots AS (SELECT '/' || r_name || '/' || n_name AS root FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0 UNION SELECT '/' || r_name FROM region WHERE r_regionkey > 1)
        SELECT root, count(*) FILTER (is_dir AND NOT gone) AS folders, count(*) FILTER (NOT is_dir AND NOT gone) AS files, count(*) FILTER (is_dir AND gone) AS folders_ignored, count(*) FILTER (NOT is_dir AND gone) AS files_ignored
        FROM roots LEFT JOIN y USING (root) GROUP BY root""",
    "d12_moves": f"""WITH {_TREE}, o AS (SELECT DISTINCT own, n FROM t)
        SELECT CASE WHEN n % 2 = 0 THEN '/moved' ELSE '' END || path AS uri, c_custkey FROM t WHERE n % 2 = 1 OR n % 3 <> 0
        UNION ALL SELECT CASE WHEN n % 2 = 0 THEN '/moved' ELSE '' END || own, -1 FROM o UNION ALL SELECT '/moved' || own, -2 FROM o WHERE n % 2 = 1""",
    "o5_tag_limit": "SELECT least(count(*), 512) AS shown, count(*) >= 512 AS reached FROM part",
    "p5_without_folder": f"WITH {_ELEMENTS} SELECT doc_id, container FROM e WHERE sn % 3 = 1",
}
