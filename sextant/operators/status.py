"""Statistics, resource details and serialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.strings import ellipsize, literal, shorten
from sextant.functions.tables import few


def class_statistics(quads: DataFrame, name: str | None = None) -> DataFrame:
    types = quads.where(F.col("p") == "rdf:type")
    if name:
        types = types.where(F.lower("o").contains(name.lower()))
    return types.groupBy(F.col("o").alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class")


def describe(quads: DataFrame, uri: str) -> DataFrame:
    """``p, o, x, is_resource`` of a resource and of the element it is interpreted as."""
    first = quads.where(F.col("s") == uri).select("s").distinct()
    element = quads.where((F.col("s") == uri) & (F.col("p") == "nie:interpretedAs")).select(F.col("o").alias("s"))
    about = quads.join(first.unionByName(element).distinct(), "s", "left_semi")
    # Only the objects named here are looked up.
    objects = few(about.select("o").distinct())
    resources = quads.select(F.col("s").alias("o")).join(objects, "o", "left_semi").distinct().withColumn("_r", F.lit(True))
    return about.join(resources, "o", "left").select("p", "o", F.col("s").alias("x"), F.col("_r").isNotNull().alias("is_resource")).distinct().orderBy("x", "p", "o")


def failures(errors: DataFrame, longest: int = 40) -> DataFrame:
    return errors.select(ellipsize(F.col("uri"), longest, at_end=False).alias("uri"), ellipsize(F.col("message"), longest).alias("message")).orderBy("uri", "message")


def turtle(quads: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``s, text``: one statement per subject."""
    term = F.when(F.col("o_type") == "iri", F.concat(F.lit("<"), shorten(F.col("o"), prefixes), F.lit(">"))).otherwise(F.concat(F.lit('"'), literal(F.col("o")), F.lit('"')))
    pairs = quads.select("s", F.concat_ws(" ", "p", term).alias("pair"))
    return pairs.groupBy("s").agg(F.concat(F.lit("<"), F.col("s"), F.lit("> "), F.array_join(F.array_sort(F.collect_list("pair")), " ; "), F.lit(" .")).alias("text"))


def json_ld(quads: DataFrame) -> DataFrame:
    """``s, text``: one JSON object per subject, values in arrays."""
    values = quads.groupBy("s", "p").agg(F.array_sort(F.collect_list("o")).alias("os"))
    return values.groupBy("s").agg(F.to_json(F.struct(F.col("s").alias("@id"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "os")))).alias("properties"))).alias("text"))


def insert_data(quads: DataFrame) -> DataFrame:
    """``g, text``: the updates that insert a graph's quads, one line for each."""
    line = F.concat(F.lit("INSERT DATA { GRAPH "), F.col("g"), F.lit(" { <"), F.col("s"), F.lit("> "), F.col("p"), F.lit(' "'), literal(F.col("o")), F.lit('" } }'))
    return quads.select("g", line.alias("text"))


def extractor_statistics(runs: DataFrame) -> DataFrame:
    """Per module: extracted, failed, seconds and share of all."""
    sums = runs.groupBy("module").agg(F.count_if(~F.col("failed")).alias("extracted"), F.count_if("failed").alias("failed"), F.sum("seconds").alias("seconds"))
    total = runs.agg(F.count("*")).scalar()
    return sums.select("module", "extracted", "failed", "seconds", (100.0 * (F.col("extracted") + F.col("failed")) / total).alias("percent"))


def quads_of(table: DataFrame, subject: str, columns: dict[str, str], graph: str) -> DataFrame:
    """A wide table as quads; nulls have none."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for c, p in columns.items()])
    rows = table.select(F.col(subject).alias("s"), F.explode(pairs).alias("po"))
    return rows.where("po.o IS NOT NULL").select(F.lit(graph).alias("g"), "s", "po.p", "po.o", F.when(F.col("po.o").rlike("^(urn|file|https?):"), "iri").otherwise("string").alias("o_type"))
