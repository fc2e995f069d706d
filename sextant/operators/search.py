"""Full-text and class searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.stemming import stem, stems_of
from sextant.functions.strings import plain, snippet, tokens


def matches(text: Column, terms: list[str], any_term: bool = False) -> Column:
    """Whether a text has all terms, or any of them; no terms: always."""
    if not terms:
        return F.lit(True)
    words = tokens(text)
    wanted = F.array(*[F.lit(plain(t)) for t in terms])
    return F.arrays_overlap(words, wanted) if any_term else F.size(F.array_except(wanted, words)) == 0


def available(elements: DataFrame, volumes: DataFrame, show_all: bool) -> DataFrame:
    """Elements on volumes that are there; all of them with ``show_all``."""
    if show_all:
        return elements
    return elements.join(volumes.where("available").select(F.col("urn").alias("data_source")), "data_source", "left_semi")


def page(df: DataFrame, offset: int = 0, limit: int = -1) -> DataFrame:
    """A negative limit is none."""
    df = df.offset(offset) if offset else df
    return df if limit < 0 else df.limit(limit)


def search_class(
    elements: DataFrame,
    volumes: DataFrame,
    class_name: str | None,
    terms: list[str],
    order: str = "url",
    columns: tuple[str, ...] = ("ie", "url"),
    show_all: bool = False,
    any_term: bool = False,
    offset: int = 0,
    limit: int = 512,
    text: str = "text",
    detailed: bool = False,
    volume_check: bool = True,
) -> DataFrame:
    """Elements of a class with the terms in ``text``, in order, one page of them."""
    found = elements.where(F.col("class") == class_name) if class_name else elements
    if volume_check:
        found = available(found, volumes, show_all)
    found = found.where(matches(F.col(text), terms, any_term))
    shown = [F.col(c) for c in columns] + ([snippet(F.col(text), terms).alias("snippet")] if detailed and terms else [])
    keys = dict.fromkeys((order, *columns))
    return page(found.select(*shown).distinct().orderBy(*keys), offset, limit)


def search_everything(elements: DataFrame, files: DataFrame, volumes: DataFrame, terms: list[str], show_all: bool = False) -> DataFrame:
    """Hits in file names and in contents, one row per uri with one snippet."""
    by_name = available(files, volumes, show_all).where(matches(F.col("file_name"), terms)).select("uri", F.lit(None).cast("string").alias("snippet"), "class")
    by_text = available(elements, volumes, show_all).where(matches(F.col("text"), terms)).select(F.col("url").alias("uri"), snippet(F.col("text"), terms).alias("snippet"), "class")
    return by_name.unionByName(by_text).groupBy("uri").agg(F.min("snippet").alias("snippet"), F.min("class").alias("class")).orderBy("uri")


def inverted_index(elements: DataFrame, key: str = "ie", text: str = "text", only: list[str] | None = None) -> DataFrame:
    """``token, key, n``: postings of all words, or ``only`` of some, which is all that is counted then."""
    words = tokens(F.col(text))
    if only:
        wanted = [plain(t) for t in only]
        words = F.filter(words, lambda w: w.isin(wanted))
    return elements.select(key, F.explode(words).alias("token")).groupBy("token", key).agg(F.count("*").alias("n"))


def stemmed_index(elements: DataFrame, key: str = "ie", text: str = "text", language: str = "lang", ignore_numbers: bool = False) -> DataFrame:
    """``token, key, n``: postings of the stems of all words, by each text's language (unknown ones are English); numbers may be left out."""
    stems = stems_of(tokens(F.col(text)), F.col(language), ignore_numbers)
    return elements.select(key, F.explode(stems).alias("token")).groupBy("token", key).agg(F.count("*").alias("n"))


def search_stems(index: DataFrame, terms: list[str], languages: list[str], key: str = "ie") -> DataFrame:
    """``key, hits`` of the keys that have a form of every term, by the stems that the terms have in any of the languages."""
    return search_stems_each(index, {"": (terms, languages)}, key).select(key, "hits")


def search_stems_each(index: DataFrame, searches: dict[str, tuple[list[str], list[str]]], key: str = "ie") -> DataFrame:
    """``search, key, hits`` of several searches (terms, languages) by their names, in one pass over the index."""
    forms = [(name, i, {stem(plain(t), lang) for lang in languages}) for name, (terms, languages) in searches.items() for i, t in enumerate(terms)]
    rows = [(f, name, i, len(searches[name][0])) for name, i, each in forms for f in sorted(each)]
    pairs = index.sparkSession.createDataFrame(rows, "token string, search string, term int, terms int")
    wanted = index.where(F.col("token").isin(sorted({r[0] for r in rows})))  # other words aren't even counted
    hits = wanted.join(F.broadcast(pairs), "token")  # a few forms of each term
    return hits.groupBy("search", key).agg(F.countDistinct("term").alias("k"), F.sum("n").alias("hits"), F.max("terms").alias("terms")).where("k = terms").select("search", key, "hits")


#: Folders of a written index.
SHELVES = 64


def write_index(index: DataFrame, path: str) -> None:
    """Postings in folders by a hash of the token, sorted by token in each."""
    shelf = F.pmod(F.xxhash64("token"), F.lit(SHELVES))
    index.withColumn("shelf", shelf).repartition("shelf", "token").sortWithinPartitions("shelf", "token").write.mode("overwrite").partitionBy("shelf").parquet(path)


def read_index(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """A written index, of which only the folders and pages of these terms are read."""
    wanted = [plain(t) for t in terms]
    shelves = F.col("shelf").isin(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(SHELVES)) for t in wanted])
    return spark.read.parquet(path).where(shelves & F.col("token").isin(wanted)).drop("shelf")


def search_index(index: DataFrame, terms: list[str], key: str = "ie") -> DataFrame:
    """Keys with all terms, by the postings of these terms only."""
    terms = [plain(t) for t in terms]
    hits = index.where(F.col("token").isin(terms))
    return hits.groupBy(key).agg(F.countDistinct("token").alias("k"), F.sum("n").alias("hits")).where(F.col("k") == len(set(terms))).select(key, "hits")
