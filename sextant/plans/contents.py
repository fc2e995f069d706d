"""Queries of charsets, deadlines and monitor events, over the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from sextant.functions import charsets
from sextant.functions.tables import map_batches, spread
from sextant.operators import extract, search
from sextant.plans import store
from sextant.streaming import moves

# The charsets that documents are written in by their number, and letters of other scripts for those that need them.
WRITTEN = ("utf_16_le", "utf_16_be", "cp1252", "koi8_r", "cp1251", "iso8859_2", "cp932", "euc_jp", "gb18030", "utf_8")
LATIN = "abcdefghijklmnopqrstuvwxyz"
FREQUENT, RUSSIAN = "etaoinsrhldcumfpgwybvkxjqz", "оеаинтсрвлкмдпуяыьгзбчйхжш"  # by frequency
LETTERS = {
    "koi8_r": (FREQUENT + FREQUENT.upper(), RUSSIAN + RUSSIAN.upper()),
    "cp1251": (FREQUENT + FREQUENT.upper(), RUSSIAN + RUSSIAN.upper()),
    "iso8859_2": ("éèçêóñíäöüßÉÈÇÊÑlzqw", "ęąćłóńśżłźćĘĄĆŁŃłżęś"),
    "cp932": (LATIN, "あうくでいふげはえじかるみのおぱきりさとんぶわにやず"),
    "euc_jp": (LATIN, "あうくでいふげはえじかるみのおぱきりさとんぶわにやず"),
    "gb18030": (LATIN, "的一是不了人我在有他这为之大来以个中上们到说国和地也"),
}


def e_charsets(s, d):
    """How many documents written in each charset come back as they were."""
    docs = spread(store.table(s, d, "documents"), "doc_id").select((F.col("doc_id") % len(WRITTEN)).cast("int").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    for k, charset in enumerate(WRITTEN):
        if charset in LETTERS:
            text = F.when(F.col("k") == k, F.translate("text", *LETTERS[charset])).otherwise(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = text.encode(WRITTEN[k], "ignore")  # what the charset can't hold is not in the file
                out.append((WRITTEN[k], int((charsets.decode(data) or "") == data.decode(WRITTEN[k]))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string()), pa.array([], pa.int64())], names=["charset", "same"])

    found = map_batches(docs.select("k", text.alias("text")), run, "charset string, same long")
    return found.groupBy("charset").agg(F.count("*").alias("n"), (F.sum("same") >= 0.95 * F.count("*")).alias("enough"))


def _endless(data: bytes) -> extract.Found:
    while True:
        pass


def d17_deadline(s, d):
    """Texts, among them a few whose reader never ends."""
    docs = store.elements(s, d)
    mime = F.when(F.col("doc_id") % 400 == 7, "application/x-endless").otherwise("text/plain")
    files = docs.select(F.col("url").alias("path"), mime.alias("mime"), F.encode("text", "UTF-8").alias("content"))
    found = extract.extract(files, deadline=0.5, readers=[("application/x-endless", "Documents", _endless, "endless1")])
    return found.select("path", "hash", F.md5("text").alias("digest"), "error")


QUERIES = {f.__name__: f for f in (e_charsets, d17_deadline)}
SQL = {
    "e_charsets": "SELECT ([" + ", ".join(f"'{c}'" for c in WRITTEN) + f"])[doc_id % {len(WRITTEN)} + 1] AS charset, count(*) AS n, true AS enough FROM documents GROUP BY 1",
    "d17_deadline": """SELECT 'file:///' || source || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 400 = 7 THEN 'endless1' ELSE 'text1' END AS hash, CASE WHEN doc_id % 400 <> 7 THEN md5(text) END AS digest,
        CASE WHEN doc_id % 400 = 7 THEN 'DeadlineExceeded: not done after 0.5 s' END AS error FROM documents""",
}


def monitored(s, d):
    """Monitor events of the driver's event table: purchases are moves in two halves, some alone or too far apart."""
    e = store.table(s, d, "events")
    n, user = F.col("event_id"), F.concat(F.lit("/u"), (F.col("user_id") % 50).cast("string"))
    path = F.concat(user, F.lit("/f"), (n % 97).cast("string"), F.when(n % 5 == 0, ".md").otherwise(".txt"))
    to = F.concat(user, F.when(n % 13 == 0, F.lit("/.git/f")).otherwise(F.lit("/g")), (n % 89).cast("string"), F.when(n % 4 == 0, ".md").otherwise(".txt"))
    name = F.when(n % 31 == 0, F.concat(user, F.lit("/.nomedia"))).otherwise(path)
    kinds = {"signup": "CREATED", "click": "CHANGED", "view": "ATTRIBUTE_CHANGED", "error": "DELETED"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    plain = F.struct((2 * n).alias("seq"), F.col("ts").alias("ts"), name.alias("path"), kind.alias("kind"), F.lit(None).cast("string").alias("cookie"))
    half = lambda k, at, p, what: F.struct((2 * n + k).alias("seq"), at.alias("ts"), p.alias("path"), F.lit(what).alias("kind"), n.cast("string").alias("cookie"))
    out, into = half(0, F.col("ts"), path, "MOVED_OUT"), half(1, F.timestamp_add("SECOND", n % 4, F.col("ts")), to, "MOVED_IN")
    rows = F.when(F.col("event_type") != "purchase", F.array(plain)).when(n % 7 == 0, F.array(out)).when(n % 11 == 0, F.array(into)).otherwise(F.array(out, into))
    return e.select(F.explode(rows).alias("e")).select("e.*", F.lit(False).alias("is_dir"))


def _shown(path, is_dir):
    return ~path.contains("/.git/")


def d6_paired_moves(s, d):
    return moves.paired(monitored(s, d), 2000)


def d6_notified(s, d):
    return moves.notified(moves.paired(monitored(s, d), 2000), _shown, [".nomedia"])


_MONITORED = """e AS (
        SELECT *, '/u' || (user_id % 50) || '/f' || (event_id % 97) || CASE WHEN event_id % 5 = 0 THEN '.md' ELSE '.txt' END AS own, '/u' || (user_id % 50) AS folder,
               '/u' || (user_id % 50) || CASE WHEN event_id % 13 = 0 THEN '/.git/f' ELSE '/g' END || (event_id % 89) || CASE WHEN event_id % 4 = 0 THEN '.md' ELSE '.txt' END AS dest,
               CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'click' THEN 'CHANGED' WHEN 'view' THEN 'ATTRIBUTE_CHANGED' WHEN 'error' THEN 'DELETED' END AS plain FROM events),
    p AS (
        SELECT 2 * event_id AS seq, plain AS kind, CASE WHEN event_id % 31 = 0 THEN folder || '/.nomedia' ELSE own END AS source, NULL AS destination, folder FROM e WHERE event_type <> 'purchase'
        UNION ALL SELECT 2 * event_id, 'DELETED', own, NULL, folder FROM e WHERE event_type = 'purchase' AND (event_id % 7 = 0 OR (event_id % 11 <> 0 AND event_id % 4 = 3))
        UNION ALL SELECT 2 * event_id + 1, 'CREATED', dest, NULL, folder FROM e WHERE event_type = 'purchase' AND event_id % 7 <> 0 AND (event_id % 11 = 0 OR event_id % 4 = 3)
        UNION ALL SELECT 2 * event_id + 1, 'MOVED', own, dest, folder FROM e WHERE event_type = 'purchase' AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 4 <> 3)"""

QUERIES |= {f.__name__: f for f in (d6_paired_moves, d6_notified)}
SQL |= {
    "d6_paired_moves": f"WITH {_MONITORED} SELECT seq, kind, source, destination, false AS is_dir FROM p",
    "d6_notified": f"""WITH {_MONITORED}, q AS (SELECT *, source LIKE '%/.nomedia' AS spoils, source NOT LIKE '%/.git/%' AS there, destination NOT LIKE '%/.git/%' AS stays FROM p)
        SELECT seq, 0 AS pos, CASE kind WHEN 'CREATED' THEN 'DELETED' ELSE 'CRAWL' END AS kind, folder AS source, NULL AS destination, true AS is_dir FROM q WHERE spoils AND kind IN ('CREATED', 'DELETED')
        UNION ALL SELECT seq, 0, CASE kind WHEN 'CHANGED' THEN 'UPDATED' WHEN 'ATTRIBUTE_CHANGED' THEN 'ATTRIBUTES' ELSE kind END, source, NULL, false FROM q WHERE kind <> 'MOVED' AND there AND NOT (spoils AND kind IN ('CREATED', 'DELETED'))
        UNION ALL SELECT seq, 0, CASE WHEN stays THEN 'MOVED' ELSE 'DELETED' END, source, CASE WHEN stays THEN destination END, false FROM q WHERE kind = 'MOVED'
        UNION ALL SELECT seq, 1, 'UPDATED', destination, NULL, false FROM q WHERE kind = 'MOVED' AND stays AND split_part(source, '.', -1) <> split_part(destination, '.', -1)""",
}

# Forms of one word in each language of the documents; the first is searched for.
FORMS = {"en": ("generously", "generous", "generousness"), "de": ("aufeinanderfolge", "aufeinanderfolgend", "aufeinanderfolgenden"), "fr": ("majestueuse", "majestueusement", "majestueux"), "es": ("torpedearon", "torpedear", "torpedeado")}


def fts_stemmed(s, d):
    """Documents with a form of a word put at their end, every seventh with a number instead, searched by another form."""
    docs = spread(store.table(s, d, "documents").where("lang IS NOT NULL"), "doc_id")
    form = F.lit(None).cast("string")
    for lang, forms in FORMS.items():
        form = F.when(F.col("lang") == lang, F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("doc_id") % 3 + 1).cast("int"))).otherwise(form)
    words = F.when(F.col("doc_id") % 7 == 0, F.lit("2024")).otherwise(form)
    texts = docs.select("doc_id", "lang", F.concat_ws(" ", "text", words).alias("text"))
    index = search.stemmed_index(texts, "doc_id", "text", "lang", ignore_numbers=True)
    searches = {forms[0]: ([forms[0]], [lang]) for lang, forms in FORMS.items()} | {"2024": (["2024"], ["en"])}  # there is no number
    return search.search_stems_each(index, searches, "doc_id").select(F.col("search").alias("term"), "doc_id", "hits")


QUERIES["fts_stemmed"] = fts_stemmed
SQL["fts_stemmed"] = "SELECT CASE lang " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in FORMS.items()) + " END AS term, doc_id, CAST(1 AS BIGINT) AS hits FROM documents WHERE doc_id % 7 <> 0 AND lang IN ('en', 'de', 'fr', 'es')"
