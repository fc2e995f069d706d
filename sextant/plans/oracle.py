"""DuckDB SQL for the queries of the catalog."""

from __future__ import annotations

from sextant.model import CLASSES, GRAPHS, MIMES


def _pick(values: tuple[str, ...]) -> str:
    return f"(CASE sn % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


def _plain(c: str) -> str:
    return f"strip_accents(lower({c}))"


def _tokens(c: str) -> str:
    return rf"list_filter(string_split_regex({_plain(c)}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND length(w) <= 200)"


def _has(c: str, *terms: str) -> str:
    return " AND ".join(f"list_contains({_tokens(c)}, '{t}')" for t in terms)


def _snippet(c: str, term: str) -> str:
    before = rf"regexp_extract({_plain(c)}, '(?s)^(|.*?[^\p{{L}}\p{{N}}])({term})([^\p{{L}}\p{{N}}]|$)', 1)"
    return f"translate(substr({c}, greatest(length({before}) + 1 - 20, 1), 60), chr(13) || chr(10), '  ')"


ELEMENTS = f"""el AS (
    SELECT doc_id, sn, source AS data_source, 'urn:fileid:' || doc_id AS ie, 'file:///' || source AS container,
           'file:///' || source || '/' || doc_id || '.txt' AS url, doc_id || '.txt' AS file_name,
           {_pick(GRAPHS)} AS graph, {_pick(CLASSES)} AS class, {_pick(MIMES)} AS mime, substr(text, 1, 24) AS title, text
    FROM (SELECT *, CAST(substr(source, 4) AS INT) AS sn FROM documents))"""
VOLUMES = """vol AS (
    SELECT source AS urn, 'file:///' || source AS root_uri, sn % 4 <> 3 AS available, sn % 3 = 0 AS is_removable, sn % 5 = 0 AS is_optical,
           CASE WHEN sn % 4 = 3 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(sn) END AS unmount_date
    FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS sn FROM documents))"""
LABELLED = """hashed AS (SELECT DISTINCT 'urn:fileid:' || doc_id AS ie FROM labels),
edges AS (SELECT DISTINCT 'urn:fileid:' || doc_id AS subject, t AS tag_urn FROM (
    SELECT doc_id, 'urn:tag:quality:' || quality AS t FROM labels UNION ALL SELECT doc_id, 'urn:tag:toxic:' || toxic FROM labels) WHERE t IS NOT NULL),
tags AS (SELECT 'urn:tag:' || n AS urn, n AS label, 'about ' || n AS description
         FROM (SELECT unnest(['quality:0', 'quality:1', 'toxic:0', 'toxic:1', 'unused']) AS n))"""
FEEDS = """channels AS (SELECT 'urn:channel:' || conv_id AS urn, 'http://feeds/' || conv_id AS url, 'Channel ' || conv_id AS title, CAST(count(*) AS INT) - 2 AS update_interval, conv_id
              FROM conversations GROUP BY conv_id),
messages AS (SELECT 'urn:message:' || conv_id || ':' || turn AS urn, 'http://feeds/' || conv_id || '/' || turn % 3 AS url, 'urn:channel:' || conv_id AS channel,
                    substr(text, 1, 20) AS title, turn * 60 AS published, text, role, conv_id, turn FROM conversations)"""
QUADS = """quads AS (
    SELECT g, s, p, o, CASE WHEN regexp_matches(o, '^(urn|file|https?):') THEN 'iri' ELSE 'string' END AS o_type FROM (
        SELECT 'content' AS g, ie AS s, unnest(['rdf:type', 'nie:title', 'nie:mimeType', 'nie:isStoredAs']) AS p, unnest([class, title, mime, url]) AS o FROM el
        UNION ALL
        SELECT 'FileSystem', url, unnest(['nie:interpretedAs', 'nfo:fileName', 'nfo:belongsToContainer']), unnest([ie, file_name, container]) FROM el)
    WHERE o IS NOT NULL)"""
TREE = """tree AS (SELECT c_custkey, '/' || r_name || '/' || n_name || '/' || c_name AS path, n_name, r_name, n_nationkey
         FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
roots AS (SELECT DISTINCT '/' || r_name || '/' || n_name AS root, n_nationkey % 2 = 0 AS recursive, n_nationkey = 9 AS ignored FROM tree WHERE n_nationkey % 3 = 0
          UNION SELECT DISTINCT '/' || r_name, true, false FROM tree WHERE r_name IN ('ASIA', 'EUROPE'))"""
ORDERS = """disk AS (SELECT 'file:///o/' || o_orderkey AS uri, CAST(epoch(o_orderdate) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 0 END AS mtime, 'h' || o_orderpriority AS hash
         FROM orders WHERE o_orderkey % 10 <> 3),
stored AS (SELECT 'file:///o/' || o_orderkey AS uri, CAST(epoch(o_orderdate) AS BIGINT) AS mtime, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS mime,
                  CASE WHEN o_orderkey % 11 = 0 THEN 'old' ELSE 'h' || o_orderpriority END AS hash
           FROM orders WHERE o_orderkey % 10 <> 6),
differs AS (SELECT coalesce(d.uri, s.uri) AS uri,
                   CASE WHEN s.uri IS NULL THEN 'CREATE' WHEN d.uri IS NULL THEN 'DELETE' WHEN d.mtime <> s.mtime THEN 'UPDATE'
                        WHEN s.mime IS NOT NULL AND d.hash IS DISTINCT FROM s.hash THEN 'UPDATE' END AS state
            FROM disk d FULL JOIN stored s ON d.uri = s.uri)"""
CHANGES = """changes AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, ts, '/u/' || user_id AS source, event_type = 'view' AS attributes_only,
    CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'click' THEN 'UPDATED' WHEN 'view' THEN 'UPDATED' WHEN 'purchase' THEN 'MOVED' WHEN 'error' THEN 'DELETED' END AS kind FROM events)"""


def _with(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def _search(class_name: str | None, where: str, show_all: bool = False, columns: str = "ie, url", order: str = "url, ie", tail: str = "") -> str:
    there = "" if show_all else " AND data_source IN (SELECT urn FROM vol WHERE available)"
    of_class = f"class = '{class_name}'" if class_name else "true"
    return _with(ELEMENTS, VOLUMES) + f"SELECT DISTINCT {columns} FROM el WHERE {of_class}{there} AND ({where}) ORDER BY {order} {tail}"


def _rows(columns: str, where: str) -> str:
    return _with(ELEMENTS, VOLUMES) + f"SELECT {columns} FROM el WHERE {where}"


def _date(c: str) -> str:
    return f"strftime(make_timestamp({c} * 1000), '%Y-%m-%dT%H:%M:%S')"


def _took(c: str) -> str:
    return (
        f"CASE WHEN {c} < 1 THEN 'less than one second' ELSE concat_ws(' ', CASE WHEN {c} >= 86400 THEN CAST({c} // 86400 AS VARCHAR) || 'd' END, "
        f"CASE WHEN {c} // 3600 % 24 > 0 THEN lpad(CAST({c} // 3600 % 24 AS VARCHAR), 2, '0') || 'h' END, CASE WHEN {c} // 60 % 60 > 0 THEN lpad(CAST({c} // 60 % 60 AS VARCHAR), 2, '0') || 'm' END, "
        f"CASE WHEN {c} % 60 > 0 THEN lpad(CAST({c} % 60 AS VARCHAR), 2, '0') || 's' END) END"
    )


ESCAPES = "replace(replace(replace(replace(replace({c}, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r'), '\"', '\\\"')"

SQL = {
    "q1_documents_fts": _search(CLASSES[0], _has("text", "the", "and"), tail="LIMIT 50"),
    "q1_documents_all": _search(CLASSES[0], "true", show_all=True, tail="LIMIT 20 OFFSET 5"),
    "q1_documents_detailed": _search(CLASSES[0], _has("text", "that"), columns=f"ie, url, {_snippet('text', 'that')} AS snippet", tail="LIMIT 30"),
    "q2_videos": _search(CLASSES[3], _has("text", "the"), tail="LIMIT 40"),
    "q3_images_or": _search(CLASSES[1], " OR ".join(_has("text", t) for t in ("clown", "idiot", "que"))),
    "q4_music": _search(CLASSES[2], _has("text", "und")),
    "q8_software": _search(CLASSES[4], _has("text", "the"), columns="ie, title", order="title, ie", tail="LIMIT 25"),
    "q10_files": _search(None, _has("text", "with", "from"), tail="LIMIT 60"),
    "q5_artists": f"SELECT 'urn:artist:' || replace(s_name, '#', '%23') AS ie, s_name AS title FROM supplier WHERE {_has('s_name', 'supplier')}",
    "q6_albums": f"SELECT DISTINCT 'urn:album:' || replace(replace(p_name, ' ', '%20'), '#', '%23') || ':' || replace(p_brand, '#', '%23') AS ie, p_name AS title FROM part WHERE {_has('p_type', 'promo')}",
    "q7_feed_messages": _with(FEEDS) + f"SELECT DISTINCT urn AS ie, title FROM messages WHERE {_has('text', 'the')}",
    "q9_software_categories": "SELECT DISTINCT 'urn:software-category:' || split_part(p_type, ' ', 1) AS ie, split_part(p_type, ' ', 1) AS title FROM part",
    "q11_folders": _with(VOLUMES) + "SELECT 'urn:folder:' || urn AS ie, root_uri AS url FROM vol WHERE available AND urn = 'src1'",
    "q12_everything": _with(ELEMENTS, VOLUMES)
    + f"""SELECT uri, min(snippet) AS snippet, min(class) AS class FROM (
        SELECT url AS uri, NULL AS snippet, class, data_source FROM el WHERE {_has("file_name", "that")}
        UNION ALL SELECT url, {_snippet("text", "that")}, class, data_source FROM el WHERE {_has("text", "that")})
      WHERE data_source IN (SELECT urn FROM vol WHERE available) GROUP BY uri""",
    "fts_index_and": _with(ELEMENTS) + f"SELECT ie, count(*) AS hits FROM (SELECT ie, unnest({_tokens('text')}) AS t FROM el) WHERE t IN ('that', 'with') GROUP BY ie HAVING count(DISTINCT t) = 2",
    "fts_stop_words": f"SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS token FROM documents) WHERE token NOT IN ('the', 'and', 'of') GROUP BY token HAVING count(*) >= 50",
    "q13_tag_list": _with(LABELLED) + "SELECT urn, label, description, count(subject) AS n FROM tags LEFT JOIN edges ON urn = tag_urn GROUP BY ALL",
    "q13_tag_list_some": _with(LABELLED) + "SELECT urn, label, description, count(subject) AS n FROM tags LEFT JOIN edges ON urn = tag_urn WHERE label IN ('toxic:1', 'unused', 'no such') GROUP BY ALL",
    "q14_all_tags": _with(LABELLED) + "SELECT subject FROM edges JOIN tags ON urn = tag_urn WHERE label IN ('quality:1', 'toxic:0', 'no such') GROUP BY subject HAVING count(DISTINCT tag_urn) = 2",
    "q14_all_tags_none": _with(LABELLED) + "SELECT subject FROM edges WHERE false",
    "q15_files_of_tag": _with(ELEMENTS, LABELLED) + "SELECT DISTINCT coalesce(url, subject) AS uri FROM edges LEFT JOIN el ON ie = subject WHERE tag_urn = 'urn:tag:toxic:1'",
    "q16_urns_of_files": _with(ELEMENTS, LABELLED) + "SELECT ie AS subject, url AS uri FROM el WHERE url IN ('file:///src0/0.txt', 'file:///src1/1.txt', 'file:///src4/4.txt') AND ie IN (SELECT subject FROM edges WHERE tag_urn = 'urn:tag:toxic:0')",
    "q17_tags_of_file": _with(LABELLED) + "SELECT label FROM edges JOIN tags ON urn = tag_urn WHERE subject = 'urn:fileid:0'",
    "q18_tag_resources": _with(ELEMENTS, LABELLED) + f"SELECT subject, tag_urn FROM edges UNION SELECT ie, 'urn:tag:unused' FROM el WHERE class = '{CLASSES[1]}'",
    "q18_untag_resources": _with(ELEMENTS, LABELLED) + "SELECT subject, tag_urn FROM edges WHERE NOT (tag_urn = 'urn:tag:toxic:0' AND subject IN (SELECT ie FROM el WHERE sn < 10))",
    "q18_remove_tag": _with(LABELLED) + "SELECT subject, tag_urn FROM edges WHERE tag_urn <> 'urn:tag:toxic:0'",
    "k14_insert_tag_if_absent": """WITH known AS (SELECT DISTINCT 'urn:tag:' || p_brand AS urn, p_brand AS label, 'known' AS description FROM part WHERE p_size < 5),
            new AS (SELECT unnest([p_brand, p_brand || '/' || p_size]) AS label, 'urn:new:' || p_partkey AS urn FROM part)
        SELECT urn, label, description FROM known UNION ALL SELECT min(urn), label, 'added' FROM new WHERE label NOT IN (SELECT label FROM known) GROUP BY label""",
    "q19_class_statistics": _with(ELEMENTS) + "SELECT class, count(*) AS n FROM el GROUP BY class",
    "q19_class_statistics_named": _with(ELEMENTS) + "SELECT class, count(*) AS n FROM el WHERE lower(class) LIKE '%doc%' GROUP BY class",
    "q20_counts": _with(ELEMENTS, VOLUMES) + "SELECT count(*) AS files, count(DISTINCT container) AS folders, count(DISTINCT container) FILTER (WHERE data_source IN (SELECT urn FROM vol WHERE available)) AS available_folders FROM el",
    "q21_eta": f"""WITH m AS (SELECT l_suppkey AS miner, sum(l_quantity) AS elapsed, count(*) AS done, count(*) FILTER (WHERE l_returnflag = 'N') AS rest FROM lineitem GROUP BY 1),
        e AS (SELECT miner, CAST(CASE WHEN elapsed > 0 AND done > 0 AND rest > 0 THEN floor(elapsed / done * rest) ELSE 0 END AS BIGINT) AS seconds FROM m)
        SELECT miner, seconds, {_took("seconds")} AS text, max(seconds) OVER () AS longest FROM e""",
    "q22_failures": _with(ELEMENTS) + "SELECT CASE WHEN length(url) > 24 THEN '…' || right(url, 23) ELSE url END AS uri, CASE WHEN length(text) > 24 THEN substr(text, 1, 23) || '…' ELSE text END AS message FROM el WHERE sn % 7 = 2",
    "k20_error_report": _with(ELEMENTS) + "SELECT md5(url) AS key, url AS uri, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '[…]' ELSE text END AS message FROM el WHERE sn = 3 AND doc_id % 2 <> 0",
    "q23_describe": _with(ELEMENTS, QUADS)
    + """SELECT DISTINCT p, o, s AS x, o IN (SELECT s FROM quads) AS is_resource FROM quads
         WHERE s = 'file:///src0/0.txt' OR s IN (SELECT o FROM quads WHERE s = 'file:///src0/0.txt' AND p = 'nie:interpretedAs')""",
    "q24_prefixes": """SELECT DISTINCT iri, CASE WHEN iri LIKE 'http://a.org/n#%' THEN 'a:' || substr(iri, 16) WHEN iri LIKE 'http://b.org/m#%' THEN 'b:' || split_part(iri, '#', -1) ELSE iri END AS short
        FROM (SELECT (['http://a.org/n#', 'http://b.org/m#', 'http://c.org/x#'])[p_partkey % 3 + 1] || p_brand AS iri FROM part)""".replace("substr(iri, 16)", "split_part(iri, '#', -1)"),
    "q27_reset_file": _rows("url AS uri, data_source", "url <> 'file:///src3' AND NOT starts_with(url, 'file:///src3/')"),
    "q28_turtle": _with(ELEMENTS)
    + """SELECT url AS s, '<' || url || '> nfo:belongsToContainer <' || container || '> ; nfo:fileName "' || file_name || '" ; nie:interpretedAs <' || ie || '> .' AS text FROM el WHERE data_source = 'src7'""",
    "q28_json_ld": _with(ELEMENTS) + "SELECT url AS s, url AS id, file_name AS name FROM el WHERE data_source = 'src7'",
    "q28_insert_data": _with(ELEMENTS, QUADS) + f"""SELECT g, 'INSERT DATA {{ GRAPH ' || g || ' {{ <' || s || '> ' || p || ' "' || {ESCAPES.replace("{c}", "o")} || '" }} }}' AS text FROM quads WHERE s LIKE 'file:///src7/%'""".replace("{{", "{").replace("}}", "}"),
    "a11_extractor_statistics": """SELECT event_type AS module, count(*) FILTER (WHERE value <= 50) AS extracted, count(*) FILTER (WHERE value > 50) AS failed, CAST(sum(floor(value)) AS BIGINT) AS seconds,
        100.0 * count(*) / (SELECT count(*) FROM events) AS percent FROM events GROUP BY 1""",
    "s3_content_check": _with(ELEMENTS) + "SELECT url AS path FROM el WHERE container NOT IN (SELECT container FROM el WHERE regexp_full_match(file_name, '1.[.]txt') OR file_name = '7.txt')",
    "s6_store_scan": _with(ELEMENTS, VOLUMES, LABELLED) + "SELECT url, container AS folder, mime, ie IN (SELECT ie FROM hashed) AS has_hash FROM el WHERE data_source = 'src2'",
    "s7_channel_scan": _with(FEEDS) + "SELECT urn, title, greatest(update_interval, 1) AS minutes FROM channels WHERE urn IN ('urn:channel:1', 'urn:channel:2')",
    "s8_volumes": _with(VOLUMES) + "SELECT * FROM vol",
    "s11_sidecars": _with(ELEMENTS) + "SELECT url, regexp_replace(url, '[.]txt$', '.xmp') AS sidecar FROM el WHERE doc_id % 3 = 0",
    "a4_monitor_limit": _with(TREE) + "SELECT '/' || r_name AS root, count(DISTINCT n_name) AS folders, count(DISTINCT n_name) > 4 AS over FROM tree GROUP BY r_name",
    "d24_stale_volumes": _with(VOLUMES)
    + """SELECT urn, coalesce(is_removable AND unmount_date < TIMESTAMP '2024-01-12', false) AS after_3_days, coalesce(is_removable AND unmount_date < TIMESTAMP '2024-01-05', false) AS after_10_days, false AS never FROM vol""",
    "d33_network_gate": "SELECT n_name, n_nationkey % 4 IN (0, 3) AS fetch FROM nation",
    "s12_cue_lookup": _with(ELEMENTS)
    + f"""SELECT url, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(url, '[.]txt$', '.cue') ELSE min(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(url, '[.]txt$', '.cue') END) OVER (PARTITION BY container) END AS cue
          FROM el WHERE class = '{CLASSES[2]}'""",
    "d15_work_list": _with(ELEMENTS, LABELLED) + "SELECT CASE graph WHEN 'Documents' THEN 0 WHEN 'Audio' THEN 1 WHEN 'Video' THEN 2 ELSE 99 END AS rank, ie, url FROM el WHERE ie NOT IN (SELECT ie FROM hashed) ORDER BY rank, ie LIMIT 200",
    "o8_work_list_next_page": _with(ELEMENTS, LABELLED)
    + """SELECT * FROM (SELECT CASE graph WHEN 'Documents' THEN 0 WHEN 'Audio' THEN 1 WHEN 'Video' THEN 2 ELSE 99 END AS rank, ie, url FROM el WHERE ie NOT IN (SELECT ie FROM hashed))
         WHERE (rank, ie) > (0, 'urn:fileid:5') ORDER BY rank, ie LIMIT 50""",
    "a6_remaining_items": _with(ELEMENTS, LABELLED) + "SELECT graph, count(*) AS n FROM el WHERE ie NOT IN (SELECT ie FROM hashed) GROUP BY graph",
    "a12_progress": _with(ELEMENTS, LABELLED) + "SELECT graph, count(h.ie) AS done, count(*) AS total, count(h.ie) / count(*) AS ratio FROM el LEFT JOIN hashed h ON el.ie = h.ie GROUP BY graph",
    "d1_diff": _with(ORDERS) + "SELECT uri, state FROM differs WHERE state IS NOT NULL",
    "a9_diff_counters": _with(ORDERS) + "SELECT state, count(*) AS n FROM differs WHERE state IS NOT NULL GROUP BY state",
    "k1_upsert": _with(ORDERS)
    + """SELECT uri, mtime, hash FROM stored WHERE uri NOT IN (SELECT uri FROM disk) UNION ALL SELECT uri, mtime, hash FROM disk""",
    "k4_recursive_delete": _rows("url, data_source", "NOT starts_with(url, 'file:///src1/')"),
    "k5_delete_files": _rows("url, graph", "graph <> 'Audio'"),
    "k6_move": _with(ELEMENTS) + "SELECT doc_id, 'file:///new/place/' || file_name AS url FROM el WHERE data_source = 'src1'",
    "k7_invalidate": _with(ORDERS) + "SELECT uri, CASE WHEN uri NOT LIKE '%7' THEN hash END AS hash FROM stored",
    "k8_set_attributes": _with(ORDERS) + "SELECT s.uri, coalesce(d.mtime, s.mtime) AS mtime, s.hash FROM stored s LEFT JOIN disk d USING (uri)",
    "k9_mark_volumes": _with(VOLUMES) + "SELECT urn, root_uri, available AND urn NOT IN ('src0', 'src3') AS available, is_removable, is_optical, CASE WHEN urn IN ('src0', 'src3') THEN TIMESTAMP '2024-06-01 00:00:00' ELSE unmount_date END AS unmount_date FROM vol",
    "k10_delete_of_removable": _rows("url AS uri, data_source", "data_source NOT IN (SELECT urn FROM vol WHERE is_removable AND NOT is_optical)"),
    "k11_delete_unmounted_before": _rows("url AS uri, data_source", "data_source NOT IN (SELECT urn FROM vol WHERE unmount_date < TIMESTAMP '2024-01-12 00:00:00')"),
    "k12_insert_hash": _with(ELEMENTS, LABELLED) + "SELECT ie FROM hashed UNION SELECT ie FROM el WHERE graph = 'Video'",
    "k13_drop_content_copy": _with(ELEMENTS, QUADS) + "SELECT g, s, p, o FROM quads WHERE NOT (g = 'content' AND s IN (SELECT ie FROM el WHERE sn = 4))",
    "d25_reconcile_mounts": _with(VOLUMES)
    + """SELECT urn, CASE WHEN CAST(substr(urn, 4) AS INT) % 2 <> 0 THEN CASE WHEN available THEN 'UNMOUNT' ELSE 'NONE' END WHEN NOT available THEN 'MOUNT' ELSE 'NONE' END AS action FROM vol UNION ALL SELECT 'fresh', 'ADD'""",
    "j_longest_root": _with(TREE) + "SELECT path, max_by(root, length(root)) AS root FROM tree JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY path",
    "j_reparent": _with(TREE) + "SELECT r.root, max_by(o.root, length(o.root)) AS parent FROM roots r LEFT JOIN roots o ON starts_with(r.root, o.root || '/') GROUP BY r.root",
    "j_dedupe_roots": _with(TREE) + "SELECT root FROM roots r WHERE NOT EXISTS (SELECT 1 FROM roots o WHERE starts_with(r.root, o.root || '/'))",
    "p16_indexable": _with(TREE)
    + r"""SELECT path, root, coalesce(root IS NOT NULL AND NOT ignored AND (path = root OR recursive OR regexp_replace(path, '/[^/]*$', '') = root)
            AND NOT (regexp_full_match(name, '.*7') OR regexp_full_match(name, 'Customer#0000000.1')) AND NOT starts_with(name, '.'), false) AS indexable
          FROM (SELECT t.path, split_part(t.path, '/', -1) AS name, max_by(r.root, length(r.root)) AS root, max_by(r.recursive, length(r.root)) AS recursive, max_by(r.ignored, length(r.root)) AS ignored
                FROM tree t LEFT JOIN roots r ON path = root OR starts_with(path, root || '/') GROUP BY t.path)""",
    "p14_glob_filter": _with(TREE) + "SELECT path, regexp_full_match(name, '.*1.') OR name LIKE '%99%' AS accept, NOT regexp_full_match(name, '.*1.') AS deny, path = '/ASIA' OR starts_with(path, '/ASIA/') AS under FROM (SELECT path, split_part(path, '/', -1) AS name FROM tree)",
    "p17_parent_indexable": _with(TREE) + "SELECT regexp_replace(path, '/[^/]*$', '') AS folder, NOT bool_or(path LIKE '%5') AS indexable, count(*) FILTER (WHERE path LIKE '%5') AS ignored, count(*) FILTER (WHERE path NOT LIKE '%5') AS found FROM tree GROUP BY 1",
    "p20_rule_dispatch": """SELECT DISTINCT p_type AS mime, CASE WHEN p_type LIKE 'PROMO %' AND p_type NOT LIKE '%BRASS' THEN 'alpha' WHEN p_type LIKE '%STEEL' THEN 'beta' WHEN p_type LIKE 'S%' THEN 'gamma' ELSE 'generic' END AS module
        FROM part WHERE p_type LIKE 'PROMO %' AND p_type NOT LIKE '%BRASS' OR p_type LIKE '%STEEL' OR p_type LIKE 'S%' OR p_type NOT LIKE 'LARGE%'""",
    "o7_priority_queue": _with(CHANGES) + "SELECT seq, CASE WHEN kind = 'DELETED' THEN 0 ELSE 1 END AS priority FROM changes ORDER BY priority, seq LIMIT 100",
    "a10_latest_message": _with(FEEDS) + "SELECT url, urn, published FROM messages QUALIFY row_number() OVER (PARTITION BY url ORDER BY published DESC, turn) = 1",
    "d20_feed_reconcile": _with(FEEDS)
    + """SELECT urn, CASE WHEN turn = 1 THEN 'KEEP' WHEN role = 'system' OR turn >= 6 THEN 'INSERT' WHEN role = 'user' THEN 'UPDATE' ELSE 'REFRESH' END AS action FROM messages WHERE turn <> 1 OR role <> 'system'""",
    "k16_keep_predicates": _with(ELEMENTS, QUADS) + "SELECT s, p, o FROM quads WHERE NOT s LIKE 'file:///src5/%' OR p = 'nie:interpretedAs'",
    "k17_orphans": _with(FEEDS) + "SELECT urn, channel FROM messages WHERE channel NOT IN (SELECT urn FROM channels WHERE update_interval > 2)",
    "k17_without_orphans": _with(FEEDS) + "SELECT urn, channel FROM messages WHERE channel IN (SELECT urn FROM channels WHERE update_interval > 2)",
    "q25_feed_list": _with(FEEDS) + "SELECT urn, url, title, greatest(update_interval, 1) AS minutes FROM channels",
    "d21_debounce": """SELECT user_id, max(ts) + INTERVAL 30 MINUTE AS notified, count(*) AS updates FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
            SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""",
    "d22_enclosures": _with(FEEDS) + "SELECT channel AS message, url, min(turn) AS position FROM messages GROUP BY ALL",
    # The last two entries of a queue are carried, the others are final.
    "d7_coalesce": _with("RECURSIVE " + CHANGES)
    + """, e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, {'k': kind, 's': source, 'd': CASE WHEN kind = 'MOVED' THEN source || '/' || seq ELSE '' END, 'a': attributes_only} AS ev FROM changes),
        q AS (SELECT key, n, [ev] AS queue FROM e WHERE n = 1
              UNION ALL
              SELECT e.key, e.n, CASE
                WHEN len(queue) = 0 OR l.k = 'DELETED' AND e.kind <> 'DELETED' OR l.k IN ('UPDATED', 'MOVED') AND e.kind = 'CREATED' OR l.k = 'UPDATED' AND e.kind = 'MOVED' OR l.k = 'MOVED' AND e.kind = 'UPDATED' THEN list_append(queue, e.ev)
                WHEN l.k IN ('CREATED', 'UPDATED') AND e.kind = 'DELETED' OR l.k = 'UPDATED' AND l.a AND NOT e.attributes_only THEN list_append(queue[:-2], e.ev)
                WHEN l.k = 'CREATED' AND e.kind = 'MOVED' THEN list_append(queue[:-2], {'k': 'CREATED', 's': e.ev.d, 'd': '', 'a': false})
                WHEN l.k = 'MOVED' AND e.kind = 'DELETED' THEN list_append(queue[:-2], {'k': 'DELETED', 's': l.s, 'd': '', 'a': false})
                WHEN l.k = 'MOVED' AND l.s = e.ev.d THEN queue[:-2]
                WHEN l.k = 'MOVED' THEN list_append(queue[:-2], {'k': 'MOVED', 's': l.s, 'd': e.ev.d, 'a': false})
                ELSE queue END
              FROM (SELECT *, queue[-1] AS l FROM q) q JOIN e ON e.key = q.key AND e.n = q.n + 1)
        SELECT key, CAST(pos AS INT) - 1 AS pos, queue[pos].k AS kind, queue[pos].s AS source, queue[pos].d AS destination
        FROM (SELECT key, queue, unnest(range(1, len(queue) + 1)) AS pos FROM q WHERE (key, n) IN (SELECT (key, max(n)) FROM e GROUP BY key))""",
    "d13_collapse": """WITH RECURSIVE e AS (
            SELECT CAST(user_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
                   CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'click' THEN 'CHANGED' WHEN 'view' THEN 'ATTRIBUTE_CHANGED' WHEN 'purchase' THEN 'CHANGES_DONE' WHEN 'error' THEN 'DELETED' END AS kind FROM events
            UNION ALL SELECT CAST(user_id AS VARCHAR), count(*) + 1, 'END' FROM events GROUP BY user_id),
        q AS (SELECT path, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS VARCHAR) AS emitted FROM (SELECT DISTINCT path FROM e)
              UNION ALL
              SELECT q.path, e.n, CASE e.kind WHEN 'ATTRIBUTE_CHANGED' THEN held WHEN 'CREATED' THEN 'CREATED' WHEN 'CHANGED' THEN coalesce(held, 'CHANGED') WHEN 'DELETED' THEN CASE WHEN held = 'CREATED' THEN NULL ELSE 'DELETED' END END,
                     CASE e.kind WHEN 'ATTRIBUTE_CHANGED' THEN e.kind WHEN 'CREATED' THEN CASE WHEN held = 'DELETED' THEN held END WHEN 'CHANGES_DONE' THEN held WHEN 'END' THEN held END
              FROM q JOIN e ON e.path = q.path AND e.n = q.n + 1)
        SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS INT) AS pos, emitted AS kind FROM q WHERE emitted IS NOT NULL""",
    "d8_purge": _with(CHANGES)
    + """, own AS (SELECT seq, kind, source || CASE WHEN seq % 3 = 0 THEN '/x' ELSE '' END AS source FROM changes),
        purges AS (SELECT source AS folder, max(seq) AS purged FROM own WHERE kind IN ('DELETED', 'MOVED') GROUP BY 1)
        SELECT seq, kind, source FROM own e WHERE NOT EXISTS (SELECT 1 FROM purges p WHERE starts_with(e.source, p.folder || '/') AND e.seq < p.purged)""",
    "d6_moves": _with(CHANGES) + "SELECT seq, CASE WHEN seq % 6 = 0 THEN 'MOVED' WHEN seq % 2 = 0 THEN 'DELETED' ELSE 'CREATED' END AS kind FROM changes WHERE kind = 'MOVED' AND (seq % 2 = 0 OR seq % 3 = 0)",
    "f_strings": rf"""SELECT doc_id, source AS first, lang || CASE WHEN doc_id % 3 = 0 THEN '*' || source ELSE '' END AS merged,
        md5(array_to_string(list_slice(string_split(trim(regexp_replace(text, '[^\p{{L}}]+', ' ', 'g')), ' '), 1, 21), ' ')) AS normal,
        CASE WHEN length(text) > 30 THEN substr(text, 1, 27) || '[…]' ELSE text END AS cut, CASE WHEN length(text) > 12 THEN substr(text, 1, 11) || '…' ELSE text END AS short,
        regexp_replace(regexp_replace(hex(substr(source, 1, 4)), '(..)', '\1:', 'g'), ':$', '') AS pairs, {_took("doc_id * 977")} AS took,
        md5({ESCAPES.replace("{c}", "text")}) AS literal, trim(substr(text, 1, 1)) = '' AS blank FROM documents""",
    "f_names": """SELECT p_partkey, stem, replace(stem, '_', ' ') AS title, true AS same, name LIKE '%.mp3' = false AS changed FROM (
        SELECT p_partkey, name, regexp_replace(name, '[.][^.]*$', '') AS stem FROM (SELECT p_partkey, replace(p_name, ' ', '_') || (['.mp3', '.tar.gz', ''])[p_partkey % 3 + 1] AS name FROM part))""",
    "f_keywords": "SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS keywords FROM (SELECT p_partkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT p_partkey, list_append(string_split(p_name, ' '), lower(p_brand)) AS l FROM part))",
    "f_dates": f"""SELECT o_orderkey, ms, offset_s, {_date("ms")} || CASE WHEN ms % 1000 = 0 THEN 'Z' ELSE '.250Z' END AS utc, CAST(floor((ms // 1000 + offset_s) / 86400.0) AS BIGINT) AS day, CAST((ms // 1000 + offset_s) % 86400 AS BIGINT) AS second FROM (
        SELECT o_orderkey, offset_s, (CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) - offset_s) * 1000 + CASE WHEN o_orderkey % 4 = 3 THEN 250 ELSE 0 END AS ms FROM (
            SELECT o_orderkey, o_orderdate, CAST(([0, 7200, -19800, 0])[o_orderkey % 4 + 1] AS BIGINT) AS offset_s FROM orders))""",
    "f_date_guess": """SELECT o_orderkey, text, CASE length(text) WHEN 4 THEN text || '-01-01T00:00:00Z' WHEN 10 THEN text || 'T00:00:00' WHEN 14 THEN iso WHEN 15 THEN iso || 'Z' WHEN 19 THEN iso ELSE text END AS guess FROM (
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, unnest([strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y%m%d%H%M%S'), strftime(o_orderdate, '%Y%m%d%H%M%SZ'),
            strftime(o_orderdate, '%Y:%m:%d %H:%M:%S'), strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')]) AS text FROM orders)""",
    "f_media": """SELECT l_orderkey, l_linenumber, round(CAST(CAST(l_quantity + l_linenumber / 60 + 30.0 / 3600 AS FLOAT) AS DOUBLE) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END, 4) AS gps,
        CASE WHEN l_partkey % 4 <> 0 THEN l_linenumber / (l_partkey % 4) END AS ratio,
        'nfo:orientation-' || (CASE WHEN l_linenumber + 2 <= 8 THEN (['top', 'top-mirror', 'bottom-mirror', 'bottom', 'left-mirror', 'right', 'right-mirror', 'left'])[l_linenumber + 2] ELSE 'top' END) AS orientation,
        l_partkey / 75.0 AS seconds, CASE WHEN l_linenumber = 3 THEN l_quantity * 2.54 ELSE l_quantity END AS dpi FROM lineitem""",
    "f_image_values": """SELECT p_partkey, 'nmm:metering-mode-' || coalesce((['other', 'average', 'center-weighted-average', 'spot', 'multispot', 'pattern', 'partial'])[n + 1], 'other') AS metering,
        CASE WHEN n IN (0, 5, 8, 16, 24, 88) THEN 'nmm:flash-off' ELSE 'nmm:flash-on' END AS flash, CASE WHEN n % 2 = 0 THEN 'nmm:flash-off' ELSE 'nmm:flash-on' END AS flash_bit,
        CASE WHEN n % 3 = 0 THEN 'nmm:white-balance-auto' ELSE 'nmm:white-balance-manual' END AS balance, CAST(p_size AS VARCHAR) AS fnumber, round(1.0::DOUBLE / p_size, 6) AS exposure,
        round(CASE WHEN p_partkey % 2 = 1 THEN -1 ELSE 1 END * CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), 2) AS altitude, round(CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END * (p_size + (p_size + 0.5)::DOUBLE / 60), 6) AS gps,
        CASE p_partkey % 5 WHEN 0 THEN 'nfo:roi-content-face' WHEN 1 THEN 'nfo:roi-content-pet' WHEN 2 THEN 'nfo:roi-content-barcode' WHEN 3 THEN 'nfo:roi-content-undefined' ELSE 'nfo:region-content-undefined' END AS region
        FROM (SELECT *, p_size - 1 AS n FROM part)""",
    "f_page_description_dates": """SELECT o_orderkey, form, CASE WHEN form IN (0, 3) THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:00') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END || CASE form WHEN 2 THEN '-0600' ELSE '+0000' END AS iso
        FROM (SELECT o_orderkey, o_orderdate, unnest([0, 1, 2, 3]) AS form FROM orders)""",
    "f_urns": "SELECT p_partkey, 'urn:equipment:' || replace(p_brand, '#', '%23') || ':' || replace(replace(p_name, ' ', '%20'), '#', '%23') || ':' AS urn FROM part",
    "g_metadata_priority": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS title FROM orders",
    "f_entity_urns": """WITH p AS (SELECT *, replace(replace(p_name, ' ', '%20'), '#', '%23') AS title, replace(p_brand, '#', '%23') AS brand, CASE WHEN p_size % 3 = 0 THEN replace(p_brand, '#', '%23') END AS maker,
            CASE WHEN p_size % 2 = 0 THEN '2001-02-03' END AS day FROM part)
        SELECT p_partkey, concat_ws(':', 'urn:album', title, maker, day) AS album, concat_ws(':', 'urn:album-disc', title, maker, day) || ':Disc' || p_size AS disc,
            'urn:equipment:' || coalesce(maker, '') || ':' || brand || ':' AS equipment, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'urn:ExternalReference:src:' || p_partkey END AS external FROM p""",
    "d26_out_of_space": """SELECT c_custkey, c_nationkey >= 1 AND 100.0 * abs(c_acctbal) / 10000.0 <= c_nationkey - 1 AS pause, least(greatest(c_nationkey / 20.0 + CASE WHEN c_custkey % 2 = 0 THEN 0.25 ELSE 0 END, 0), 1) AS throttle FROM customer""",
    "d28_crawl_needed": """SELECT c_custkey, CASE i WHEN -2 THEN false WHEN -1 THEN c_custkey % 2 <> 0 WHEN 0 THEN true ELSE c_custkey % 5 >= i END AS needed FROM (SELECT *, c_nationkey % 6 - 2 AS i FROM customer)""",
    "d3_root_order": "SELECT '/' || n_name AS root, CASE WHEN n_regionkey = 2 THEN 0 ELSE 1 END AS later, CASE WHEN n_regionkey = 2 THEN -n_nationkey ELSE n_nationkey END AS rank FROM nation",
    "q26_edit_roots": """SELECT n_regionkey, array_to_string(e, ',') AS roots, list_sort(e) = names AS same FROM (
        SELECT n_regionkey, names, list_filter(list_concat(names, list_filter(['KENYA', 'ATLANTIS'], lambda x: NOT list_contains(names, x))), lambda x: x NOT IN ('CHINA', 'FRANCE')) AS e
        FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1))""",
    "a13_fallback_types": """SELECT DISTINCT p_type AS mime, CASE WHEN p_type LIKE 'PROMO %' THEN 'A,B' WHEN p_type LIKE '%STEEL' THEN 'C' ELSE 'Z,A' END AS types,
        'A' || CASE WHEN p_type LIKE 'PROMO %' THEN ',B' ELSE '' END || CASE WHEN p_type LIKE '%STEEL' THEN ',C' ELSE '' END || ',Z' AS all_types FROM part""",
    "p21_writers": _with(ELEMENTS) + "SELECT ie AS resource, CASE class WHEN 'nfo:Image' THEN 'xmp' WHEN 'nmm:MusicPiece' THEN 'audio' WHEN 'nfo:Video' THEN 'audio' END AS module FROM el",
    "d18_not_in_flight": _with(ELEMENTS) + "SELECT url, doc_id FROM el WHERE doc_id % 50 <> 7",
    "g_ranked_sources": """SELECT o_orderkey AS item, module, 'title' AS field, CASE WHEN module = 'png' THEN coalesce(xmp, exif, 'fallback') ELSE coalesce(exif, xmp, 'fallback') END AS value FROM (
        SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'png' ELSE 'jpeg' END AS module, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS xmp, CASE WHEN o_orderkey % 2 <> 0 THEN o_orderstatus END AS exif FROM orders)""",
    "f_partial_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-') || CASE WHEN k >= 1 THEN strftime(o_orderdate, '%m-') ELSE '01-' END || CASE WHEN k >= 2 THEN strftime(o_orderdate, '%dT') ELSE '01T' END
        || CASE WHEN k >= 3 THEN strftime(o_orderdate, '%H:%M:') ELSE '00:00:' END || CASE WHEN k >= 4 THEN strftime(o_orderdate, '%S') ELSE '00' END || CASE WHEN k < 3 THEN '+00:00' ELSE (['+02:00', '-05:00', '+00:00'])[o_orderkey % 3 + 1] END END AS date
        FROM (SELECT *, o_orderkey % 5 AS k FROM orders)""",
    "f_formatted_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+0530') END AS date,
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN '+0000' ELSE '-0300' END AS mail_date FROM orders""",
    "f_octal_triplets": "SELECT c_custkey, c_name || 'Ø' || c_mktsegment || '\\400\\' AS text FROM customer",
    "f_list_index": "SELECT n_name, CAST(CASE n_name WHEN 'INDIA' THEN 0 WHEN 'BRAZIL' THEN 1 WHEN 'FRANCE' THEN 2 ELSE -1 END AS BIGINT) AS place FROM nation",
    "f_image_profiles": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN side <= 480 THEN 'JPEG_SM' WHEN side <= 768 THEN 'JPEG_MED' WHEN side <= 4096 THEN 'JPEG_LRG' END
            ELSE CASE WHEN side = 120 THEN 'PNG_LRG_ICO' WHEN side = 48 THEN 'PNG_SM_ICO' WHEN side <= 160 THEN 'PNG_TN' WHEN side <= 4096 THEN 'PNG_LRG' END END AS profile,
        CAST(CASE WHEN p_size > 5 THEN p_size ELSE -1 END AS BIGINT) AS region FROM (SELECT *, CASE p_size WHEN 7 THEN 120 WHEN 8 THEN 48 ELSE p_size * p_size * 2 END AS side FROM part)""",
    "d4_folders_to_visit": """WITH n AS (SELECT *, '/' || r_name AS top, '/' || r_name || '/' || n_name AS own, n_nationkey % 7 = 6 AS nested FROM nation JOIN region ON n_regionkey = r_regionkey),
            f AS (SELECT own, own AS path, n.* EXCLUDE (own) FROM n UNION ALL SELECT own, own || '/D' || k AS path, n.* EXCLUDE (own) FROM n, (VALUES (0), (1), (2)) v(k))
        SELECT '/' || r_name AS root, '/' || r_name AS path FROM region WHERE r_regionkey <> 4
        UNION ALL SELECT CASE WHEN nested THEN own ELSE top END AS root, path FROM f WHERE nested OR (n_nationkey % 4 <> 1 AND n_regionkey NOT IN (0, 4))""",
    "d5_without_ignored": "SELECT '/' || r_name || '/' || n_name AS path, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 1",
}
