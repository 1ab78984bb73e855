"""The triple store: typed (subject, attribute, value) rows, of which the values of an attribute are ordered by ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.plans.grouping import spread
from palimpsest.vocabulary import DIRECTORY, IMAGE, LEGACY_ATTRIBUTES, LEGACY_IMAGE, LEGACY_TYPES, NS, RDF, STORED, TYPE, VOLATILE_NS, XSD, ZIP_SEGMENT, ZIP_VOLUME

SCHEMA = "volume string, s string, p string, o string, dt string, seq bigint"
NAMESPACES = {"a": NS, "xsd": XSD, "rdf": RDF, "memory": f"{NS}memory/"}
CONTAINER_TYPES = [ZIP_SEGMENT, ZIP_VOLUME, DIRECTORY]


def set_values(writes: DataFrame) -> DataFrame:
    """The store after ``Set`` in order of seq: a write with ``replace`` drops the earlier values of its attribute.

    ``writes`` has the columns of SCHEMA and ``replace``. Needs one pass: the last replacing seq is a windowed maximum.
    """
    last = F.max(F.when(F.col("replace"), F.col("seq"))).over(Window.partitionBy("s", "p"))
    return writes.withColumn("last", last).where("last IS NULL OR seq >= last").drop("last", "replace")


def get(triples: DataFrame, s=None, p=None, dt: str | None = None) -> DataFrame:
    """(s, p, o): the last value whose datatype is exactly ``dt`` (any if None), for all subjects and attributes or given ones."""
    t = where(triples, s, p)
    t = t.where(F.col("dt") == dt) if dt else t
    return spread(t.select("s", "p", "o", "seq"), "s", "p").groupBy("s", "p").agg(F.max_by("o", "seq").alias("o"))


def where(triples: DataFrame, s=None, p=None, o=None) -> DataFrame:
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name) == value)
    return triples


def types(triples: DataFrame) -> DataFrame:
    """(s, o): the last type of every known subject; a subject without one is a zip segment."""
    subjects = spread(triples.select("s", "p", "o", "seq"), "s").groupBy("s").agg(F.max_by(F.when(F.col("p") == TYPE, F.col("o")), F.when(F.col("p") == TYPE, F.col("seq"))).alias("o"))
    return subjects.withColumn("o", F.coalesce("o", F.lit(ZIP_SEGMENT)))


def get_all(triples: DataFrame, s=None, p=None) -> DataFrame:
    """(s, p, values): all values in order of seq."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "o")))
    return where(triples, s, p).select("s", "p", "o", "seq").repartition("s", "p").groupBy("s", "p").agg(F.transform(ordered, lambda x: x["o"]).alias("values"))


def has_subject(triples: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` whose ``s`` is known."""
    return keys.join(triples, "s", "left_semi")


def has_attribute(triples: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` (s, p) that have a value; types are not defaulted."""
    return keys.join(triples, ["s", "p"], "left_semi")


def has_value(triples: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` (s, p, o) that are in the store by lexical form, whatever the datatype."""
    return keys.join(triples, ["s", "p", "o"], "left_semi")


def query(triples: DataFrame, p: str, o: str | None = None) -> DataFrame:
    """Distinct subjects with the attribute, and the lexical value if given; types are not defaulted."""
    return where(triples, p=p, o=o).select("s").distinct()


def attributes(triples: DataFrame, s=None) -> DataFrame:
    """(s, attributes): map of attribute to its ordered values."""
    return get_all(triples, s).groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "values")))).alias("attributes"))


def subjects_by_prefix(triples: DataFrame, prefix: str) -> DataFrame:
    return triples.where(F.col("s").startswith(prefix)).select("s").distinct()


def delete_subjects(triples: DataFrame, subjects: DataFrame) -> DataFrame:
    return triples.join(subjects, "s", "left_anti")


def clear(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def suppressed(triples: DataFrame) -> DataFrame:
    """Adds ``suppress``: what is not written, since it follows from the container itself.

    All of a subject without type; where it is stored, of segments and containers; and their types.
    """
    is_type = F.col("p") == TYPE
    flags = triples.where(is_type).groupBy("s").agg(F.lit(True).alias("typed"), F.bool_or(F.col("o").isin(CONTAINER_TYPES)).alias("container"))
    drop = F.col("typed").isNull() | ((F.col("p") == STORED) & F.col("container")) | (is_type & F.col("o").isin(CONTAINER_TYPES))
    return triples.join(flags, "s", "left").withColumn("suppress", drop).drop("typed", "container")


def dump(triples: DataFrame, verbose: bool = False) -> DataFrame:
    """What is written: everything not suppressed, and without volatile attributes unless verbose."""
    out = suppressed(triples).where(~F.col("suppress")).drop("suppress")
    return out if verbose else out.where(~F.col("p").startswith(VOLATILE_NS))


def merge(*stores: DataFrame) -> DataFrame:
    """Union of the stores of several volumes, without removing repeated rows."""
    out, *more = stores
    for s in more:
        out = out.unionByName(s)
    return out


def standard_names(triples: DataFrame) -> DataFrame:
    """Attribute and type names of older containers as the standard ones."""
    replace = lambda c, names: F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c], c)
    o = F.when(F.col("p") == TYPE, replace(F.col("o"), LEGACY_TYPES)).otherwise(F.col("o"))
    return triples.withColumn("o", o).withColumn("p", replace(F.col("p"), LEGACY_ATTRIBUTES))


def first_image(triples: DataFrame) -> DataFrame:
    """(s): the least image URN, of the older image type if there is none of the standard one."""
    least = lambda kind: F.min(F.when((F.col("p") == TYPE) & (F.col("o") == kind), F.col("s")))
    return triples.agg(F.coalesce(least(IMAGE), least(LEGACY_IMAGE)).alias("s"))


def compact(urn, names: dict[str, str] | None = None) -> F.Column:
    """``prefix:name`` where a namespace is known; the longest namespace wins."""
    out = F.col(urn) if isinstance(urn, str) else urn
    same = out
    for prefix, ns in sorted((names or NAMESPACES).items(), key=lambda kv: len(kv[1])):
        out = F.when(same.startswith(ns), F.concat(F.lit(f"{prefix}:"), same.substr(F.lit(len(ns) + 1), F.length(same)))).otherwise(out)
    return out
