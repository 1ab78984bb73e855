"""Registered queries of the engine on the driver's tables, each with DuckDB SQL for the same rows.

The engine has no tables of its own, so every operator runs on an adaptation: rows of the driver's tables read as
triples, address-map writes, streams, URNs or volume segments. The adaptations are whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.commands import export_candidates, ingest, load_volumes
from palimpsest.functions import urns, values
from palimpsest.operators import chunks, ranges, triples, volumes
from palimpsest.plans.lineage import shared_folder
from palimpsest.sources import files, turtle, zip_volume
from palimpsest.vocabulary import ABSTRACT_IMAGES, BUILTIN_PREFIX, CHUNK_SIZE, CHUNKS_IN_SEGMENT, CODECS, CODEC_URNS, COMPRESSION, DATA_STREAM, DEFAULT_CHUNK_SIZE, DEFAULT_CHUNKS_PER_BEVY, EFI_READABLE, FILE_PREFIX, IMAGE, IMAGE_STREAMS, LEGACY_IMAGE, LEGACY_NS, MAP, PREFIX, SIZE, SMALL_FILE, STATUS, STORED, TYPE, UNREADABLE, VOLATILE_NS, ZIP_SEGMENT, ZIP_VOLUME

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BASE = f"{PREFIX}demo"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- Triples -----------------------------------------------------------------------------------------------------


def unpivot(df: DataFrame, kind: str, key: str, attributes: dict[str, tuple[str, str]]) -> DataFrame:
    """Triples of a table: subject from kind and key, an attribute for each column."""
    entries = F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o"), F.lit(dt).alias("dt"), F.lit(i).cast("bigint").alias("seq")) for i, (p, (c, dt)) in enumerate(attributes.items(), 1)])
    return df.select(F.lit(BASE).alias("volume"), F.concat(F.lit(f"{BASE}/{kind}/"), F.col(key).cast("string")).alias("s"), F.explode(entries).alias("e")).select("volume", "s", "e.*").where("o IS NOT NULL")


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples.merge(
        unpivot(table(spark, sf_dir, "region"), "region", "r_regionkey", {"name": ("r_name", "string")}),
        unpivot(table(spark, sf_dir, "nation"), "nation", "n_nationkey", {"name": ("n_name", "string"), "region": ("n_regionkey", "integer")}),
        unpivot(table(spark, sf_dir, "customer"), "customer", "c_custkey", {"name": ("c_name", "string"), "nation": ("c_nationkey", "integer"), "segment": ("c_mktsegment", "string")}),
    )


STAR = f"""triples AS (
  SELECT '{BASE}/region/' || r_regionkey AS s, 'name' AS p, r_name AS o, 1 AS seq FROM region
  UNION ALL SELECT '{BASE}/nation/' || n_nationkey, 'name', n_name, 1 FROM nation
  UNION ALL SELECT '{BASE}/nation/' || n_nationkey, 'region', CAST(n_regionkey AS VARCHAR), 2 FROM nation
  UNION ALL SELECT '{BASE}/customer/' || c_custkey, 'name', c_name, 1 FROM customer
  UNION ALL SELECT '{BASE}/customer/' || c_custkey, 'nation', CAST(c_nationkey AS VARCHAR), 2 FROM customer
  UNION ALL SELECT '{BASE}/customer/' || c_custkey, 'segment', c_mktsegment, 3 FROM customer)"""


def order_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as repeated writes of a customer's status."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.lit(BASE).alias("volume"),
        F.concat(F.lit(f"{BASE}/customer/"), F.col("o_custkey").cast("string")).alias("s"),
        F.lit("status").alias("p"),
        F.col("o_orderstatus").alias("o"),
        F.lit("string").alias("dt"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderpriority") == "1-URGENT").alias("replace"),
    )


STATUSES = f"writes AS (SELECT '{BASE}/customer/' || o_custkey AS s, 'status' AS p, o_orderstatus AS o, o_orderkey AS seq, o_orderpriority = '1-URGENT' AS replace FROM orders)"


@query(f"WITH {STAR} SELECT DISTINCT s FROM triples WHERE p = 'region' AND o = '2'")
def triple_query(spark, sf_dir):
    return triples.query(star(spark, sf_dir), "region", "2")


@query(f"WITH {STATUSES} SELECT s, p, arg_max(o, seq) AS o FROM writes GROUP BY s, p")
def triple_get_last(spark, sf_dir):
    return triples.get(order_writes(spark, sf_dir), dt="string")


@query(f"WITH {STATUSES} SELECT s, p, string_agg(o, ',' ORDER BY seq) AS vals FROM writes GROUP BY s, p")
def triple_get_all(spark, sf_dir):
    return triples.get_all(order_writes(spark, sf_dir)).select("s", "p", F.array_join("values", ",").alias("vals"))


def typed_parts(spark: SparkSession, sf_dir: str, kinds: list[str | None]) -> DataFrame:
    """Parts as subjects: a name, and the type that p_size mod the number of kinds picks (None: no type)."""
    p = table(spark, sf_dir, "part").withColumn("kind", F.get(F.array(*[F.lit(k) for k in kinds]), F.col("p_size") % len(kinds)))
    return unpivot(p, "part", "p_partkey", {"name": ("p_name", "string"), TYPE: ("kind", "urn")})


def kind_sql(kinds: list[str | None], of: str = "p_size") -> str:
    return "CASE " + " ".join(f"WHEN {of} % {len(kinds)} = {i} THEN '{k}'" for i, k in enumerate(kinds) if k) + " END"


@query(f"SELECT '{BASE}/part/' || p_partkey AS s, coalesce({kind_sql([None, MAP, IMAGE])}, '{ZIP_SEGMENT}') AS o FROM part")
def triple_default_type(spark, sf_dir):
    return triples.types(typed_parts(spark, sf_dir, [None, MAP, IMAGE]))


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit(f"{BASE}/customer/"), F.col("c_custkey").cast("string")).alias("s"), F.lit("status").alias("p"), F.lit("F").alias("o"))


@query(f"WITH {STATUSES} SELECT '{BASE}/customer/' || c_custkey AS s, 'status' AS p FROM customer WHERE '{BASE}/customer/' || c_custkey IN (SELECT s FROM writes)")
def triple_has(spark, sf_dir):
    store = order_writes(spark, sf_dir)
    return triples.has_attribute(store, triples.has_subject(store, customers(spark, sf_dir).drop("o")))


@query(f"WITH {STATUSES} SELECT '{BASE}/customer/' || c_custkey AS s, 'status' AS p, 'F' AS o FROM customer WHERE '{BASE}/customer/' || c_custkey IN (SELECT s FROM writes WHERE o = 'F')")
def triple_has_value(spark, sf_dir):
    return triples.has_value(order_writes(spark, sf_dir), customers(spark, sf_dir))


@query(f"""WITH {STATUSES}, last AS (SELECT s, max(seq) AS m FROM writes WHERE replace GROUP BY s)
SELECT s, p, o, seq FROM writes LEFT JOIN last USING (s) WHERE m IS NULL OR seq >= m""")
def triple_set_replace(spark, sf_dir):
    return triples.set_values(order_writes(spark, sf_dir)).select("s", "p", "o", "seq")


@query(f"WITH {STAR} SELECT DISTINCT s FROM triples WHERE starts_with(s, '{BASE}/nation/1')")
def triple_prefix(spark, sf_dir):
    return triples.subjects_by_prefix(star(spark, sf_dir), f"{BASE}/nation/1")


@query(f"WITH {STAR}, {STATUSES} SELECT s, p, o FROM triples WHERE s NOT IN (SELECT s FROM writes)")
def triple_delete(spark, sf_dir):
    return triples.delete_subjects(star(spark, sf_dir), order_writes(spark, sf_dir).select("s").distinct()).select("s", "p", "o")


SUPPRESS_KINDS = [None, ZIP_SEGMENT, IMAGE, ZIP_VOLUME]


@query(f"""WITH p AS (SELECT '{BASE}/part/' || p_partkey AS s, p_name, {kind_sql(SUPPRESS_KINDS)} AS kind FROM part)
SELECT s, 'name' AS p, p_name AS o FROM p WHERE kind IS NOT NULL
UNION ALL SELECT s, '{STORED}', '{BASE}' FROM p WHERE kind = '{IMAGE}'
UNION ALL SELECT s, '{TYPE}', kind FROM p WHERE kind = '{IMAGE}'""")
def triple_suppress(spark, sf_dir):
    t = typed_parts(spark, sf_dir, SUPPRESS_KINDS)
    names = t.where("p = 'name'")
    t = triples.merge(t, names.withColumn("p", F.lit(STORED)).withColumn("o", F.lit(BASE)), names.withColumn("p", F.lit(f"{VOLATILE_NS}filename")))
    return triples.dump(t).select("s", "p", "o")


@query(f"""WITH p AS (SELECT '{BASE}/part/' || p_partkey AS s, {kind_sql([LEGACY_IMAGE, None, MAP])} AS kind FROM part)
SELECT coalesce(min(CASE WHEN kind = '{IMAGE}' THEN s END), min(CASE WHEN kind = '{LEGACY_IMAGE}' THEN s END)) AS s FROM p""")
def first_image(spark, sf_dir):
    return triples.first_image(typed_parts(spark, sf_dir, [LEGACY_IMAGE, None, MAP]))


@query(f"WITH {STAR} SELECT s, string_agg(p || '=' || o, ';' ORDER BY p, seq) AS attrs FROM triples GROUP BY s")
def attributes(spark, sf_dir):
    text = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return triples.attributes(star(spark, sf_dir)).select("s", text.alias("attrs"))


@query(f"WITH {STAR} SELECT s, p, o, CASE WHEN p IN ('nation', 'region') THEN 'integer' ELSE 'string' END AS dt FROM triples")
def turtle_round_trip(spark, sf_dir):
    """Written as Turtle and read back; a type is added so that nothing is suppressed, and taken off again."""
    store = star(spark, sf_dir)
    typed = store.select("volume", "s").distinct().select("volume", "s", F.lit(TYPE).alias("p"), F.lit(MAP).alias("o"), F.lit("urn").alias("dt"), F.lit(9).cast("bigint").alias("seq"))
    text = turtle.statements(triples.merge(store, typed)).select(F.lit(BASE).alias("volume"), "value")
    return turtle.of_texts(text).where(F.col("p") != TYPE).select("s", "p", "o", "dt")


@query(f"WITH {STAR} SELECT s, p, o FROM triples WHERE false")
def triple_clear(spark, sf_dir):
    return triples.clear(spark).select("s", "p", "o")


@query(f"""SELECT '<{BASE}/part/' || p_partkey || '>' || chr(10) || '    <{TYPE}> <{MAP}> ;' || chr(10) || '    <name> "' || p_name || '" .' || chr(10) AS value FROM part""")
def turtle_dump(spark, sf_dir):
    return turtle.statements(typed_parts(spark, sf_dir, [MAP]), verbose=True)


@query(f"SELECT '{BASE}/part/' || p_partkey AS s, 'rdf:type' AS p, 'a:Map' AS o FROM part UNION ALL SELECT '{BASE}/part/' || p_partkey, 'name', p_name FROM part")
def names_compact(spark, sf_dir):
    return typed_parts(spark, sf_dir, [MAP]).select("s", triples.compact("p").alias("p"), triples.compact("o").alias("o"))


# --- Values ------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey,
  CASE p_partkey % 6 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN '0x' || to_base(p_partkey, 16) WHEN 2 THEN '0' || to_base(p_partkey, 8) WHEN 3 THEN p_brand WHEN 4 THEN '-' || p_partkey ELSE p_partkey || ' ' END AS lexical,
  CASE p_partkey % 6 WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 4 THEN -p_partkey ELSE p_partkey END AS value FROM part""")
def parse_integer(spark, sf_dir):
    k = F.col("p_partkey")
    forms = [k.cast("string"), F.concat(F.lit("0x"), F.hex(k)), F.concat(F.lit("0"), F.conv(k.cast("string"), 10, 8)), F.col("p_brand"), F.concat(F.lit("-"), k.cast("string")), F.concat(k.cast("string"), F.lit(" "))]
    lexical = F.get(F.array(*forms), (k % 6).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", lexical.alias("lexical")).withColumn("value", values.parse_integer("lexical"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'true' WHEN 'F' THEN '0' ELSE 'yes' END AS lexical,
  CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS value FROM orders""")
def parse_boolean(spark, sf_dir):
    lexical = F.when(F.col("o_orderstatus") == "O", "true").when(F.col("o_orderstatus") == "F", "0").otherwise("yes")
    return table(spark, sf_dir, "orders").select("o_orderkey", lexical.alias("lexical")).withColumn("value", values.parse_boolean("lexical"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR NOT regexp_matches(hex(p_name), '[A-F]') THEN p_name END AS decoded FROM part")
def parse_hex(spark, sf_dir):
    lexical = F.when(F.col("p_partkey") % 2 == 0, F.hex("p_name")).otherwise(F.lower(F.hex("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", values.parse_hex(lexical).cast("string").alias("decoded"))


@query("""SELECT p_partkey, p_partkey * 4096 AS start, CAST(p_size * 4096 AS BIGINT) AS length FROM part
UNION ALL SELECT p_partkey, p_partkey * 4096 + 1048576, CAST(4095 AS BIGINT) FROM part""")
def ram_regex(spark, sf_dir):
    a = F.col("p_partkey") * 4096
    line = "%x-%x : %s\n"
    text = F.concat(
        F.format_string(line, a, a + F.col("p_size") * 4096, F.lit("System RAM")),
        F.format_string("  " + line, a, a + 1, F.lit("Kernel code")),
        F.format_string(line, a + 1048576, a + 1048576 + 4095, F.lit("System RAM")),
        F.format_string(line, a, a + 9, F.lit("Reserved")),
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(values.ram_ranges(text)).alias("r")).select("p_partkey", "r.*")


@query("""SELECT p_partkey, p_size || ['', 'k', 'M', 'g', 'x'][1 + p_partkey % 5] AS arg,
  CASE WHEN p_partkey % 5 < 4 THEN CAST(p_size AS BIGINT) * [1, 1024, 1048576, 1073741824][1 + p_partkey % 5] END AS bytes FROM part""")
def size_suffix(spark, sf_dir):
    arg = F.concat(F.col("p_size").cast("string"), F.get(F.array(*[F.lit(x) for x in ("", "k", "M", "g", "x")]), (F.col("p_partkey") % 5).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", arg.alias("arg")).withColumn("bytes", values.parse_size("arg"))


CODEC_KEYS = [*CODECS, "urn:unknown"]


@query(f"""SELECT p_partkey, {kind_sql([*CODECS.values(), 'unknown'], 'p_partkey')} AS codec,
  coalesce({kind_sql([*(CODEC_URNS[c] for c in CODECS.values()), None], 'p_partkey')}, '') AS urn FROM part""")
def codec_lookup(spark, sf_dir):
    given = F.get(F.array(*[F.lit(k) for k in CODEC_KEYS]), (F.col("p_partkey") % len(CODEC_KEYS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", values.codec_of_urn(given).alias("codec")).withColumn("urn", values.urn_of_codec("codec"))


@query(f"SELECT p_partkey, {kind_sql([STATUS[-i] for i in range(12)] + ['UNKNOWN'], 'p_partkey')} AS status FROM part")
def status_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", values.status_name(-(F.col("p_partkey") % 13)).alias("status"))


@query("""SELECT o_orderkey, CAST((year(o_orderdate) - 1980) * 512 + month(o_orderdate) * 32 + day(o_orderdate) AS INT) AS dos_date,
  date_trunc('day', o_orderdate) + to_seconds(2 * (o_orderkey % 30)) AS stamp FROM orders""")
def dos_times(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", values.dos_date("o_orderdate").cast("int").alias("dos_date"))
    return o.withColumn("stamp", values.dos_timestamp("dos_date", F.col("o_orderkey") % 30))


# --- URNs --------------------------------------------------------------------------------------------------------

REWRITTEN = f"SELECT page_id, regexp_replace(url, '^https?://', CASE page_id % 4 WHEN 0 THEN '{PREFIX}' WHEN 1 THEN '{FILE_PREFIX}/' WHEN 2 THEN '{BUILTIN_PREFIX}' ELSE 'http://' END) AS urn FROM pages"


@query(f"""WITH p AS ({REWRITTEN}) SELECT page_id, CASE page_id % 4 WHEN 0 THEN split_part('{PREFIX}', ':', 1) WHEN 1 THEN 'file' WHEN 2 THEN 'builtin' ELSE '' END AS scheme,
  CASE WHEN page_id % 4 IN (0, 2) THEN split_part(split_part(urn, '://', 2), '/', 1) ELSE '' END AS domain,
  CASE page_id % 4 WHEN 1 THEN substr(urn, 8) WHEN 0 THEN regexp_extract(urn, '^[a-z0-9]+://[^/]*/?(.*)$', 1) ELSE '' END AS path FROM p""")
def urn_parts(spark, sf_dir):
    rest = F.regexp_replace("url", "^https?://", "")
    prefix = F.get(F.array(F.lit(PREFIX), F.lit(f"{FILE_PREFIX}/"), F.lit(BUILTIN_PREFIX), F.lit("http://")), (F.col("page_id") % 4).cast("int"))
    urn = F.concat(prefix, rest)
    return table(spark, sf_dir, "pages").select("page_id", urns.scheme(urn).alias("scheme"), urns.domain(urn).alias("domain"), urns.path(urn).alias("path"))


TAILS = ["", "/../x", "//./y///z", "/../../../..", "/./../a/b/.."]


@query(f"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') || [{', '.join(f"'{t}'" for t in TAILS)}][1 + page_id % 5] AS component FROM pages)
SELECT page_id, component, '{BASE}' || list_reduce(string_split(component, '/'), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x IN ('', '.') THEN a ELSE a || '/' || x END, '') AS urn FROM p""")
def urn_append_normalise(spark, sf_dir):
    tail = F.get(F.array(*[F.lit(t) for t in TAILS]), (F.col("page_id") % 5).cast("int"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^https?://", ""), tail).alias("component"))
    return p.withColumn("urn", urns.append(F.lit(f"{BASE}//\\/"), "component"))


@query("""SELECT page_id, substr(url, length(regexp_extract(url, '^(https?://[^/]+)', 1)) + 1) AS relative,
  CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS other FROM pages""")
def urn_relative(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urns.relative_path(F.regexp_extract("url", "^(https?://[^/]+)", 1), "url").alias("relative"), urns.relative_path(F.lit("https://"), "url").alias("other"))


def escape_sql(x: str) -> str:
    for c in "%" + '!$\\:*?"<>|':
        x = f"replace({x}, '{c}', '%{ord(c):02X}')"
    return x


@query(f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '://', ':/'), '/+$', '') AS rest FROM pages)
SELECT page_id, {escape_sql('rest')} AS member, '{BASE}/' || rest AS urn FROM p""")
def member_name_roundtrip(spark, sf_dir):
    rest = F.regexp_replace(F.regexp_replace("url", "://", ":/"), "/+$", "")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(f"{BASE}/"), rest).alias("given")).withColumn("member", urns.member_name("given", F.lit(BASE)))
    return p.select("page_id", "member", urns.urn_from_member("member", F.lit(BASE)).alias("urn"))


@query("""SELECT 'part' AS kind, p_partkey AS id FROM part WHERE regexp_matches(p_name, '(?is)^.*[aeiou]r?.*e.$')
UNION ALL SELECT 'page', page_id FROM pages WHERE regexp_matches(url, '(?is)^https://.*\\.EXAMPLE\\.(?:com|net)/.*$')""")
def glob_filter(spark, sf_dir):
    a = table(spark, sf_dir, "part").where(urns.glob_match("p_name", "*[aeiou]?(r)*e?")).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    return a.union(table(spark, sf_dir, "pages").where(urns.glob_match("url", "HTTPS://*.example.@(com|net)/*")).select(F.lit("page"), "page_id"))


@query("SELECT page_id, '/' || page_id || '/' || regexp_replace(url, '^https?://', '') AS name FROM pages")
def file_urn_roundtrip(spark, sf_dir):
    name = F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit("/"), F.regexp_replace("url", "^https?://", ""))
    return table(spark, sf_dir, "pages").select("page_id", urns.filename_of(urns.file_urn(name)).alias("name"))


@query("""SELECT page_id, replace(url, '/', '|') AS parts, ends_with(url, 'html') AS html, printf('%05d %s', page_id, url) AS line,
  CASE page_id % 4 WHEN 0 THEN '/' || url WHEN 1 THEN 'C:' || url WHEN 2 THEN chr(92) || url ELSE '/cwd/' || url END AS absolute FROM pages""")
def string_functions(spark, sf_dir):
    given = F.concat(F.get(F.array(F.lit("/"), F.lit("C:"), F.lit("\\"), F.lit("")), (F.col("page_id") % 4).cast("int")), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urns.join(urns.split("url", "/"), "|").alias("parts"), urns.has_ending("url", "html").alias("html"), urns.sprintf("%05d %s", "page_id", "url").alias("line"), urns.absolute(given, "/cwd").alias("absolute"))


# --- Chunks ------------------------------------------------------------------------------------------------------

CHUNK, PER_BEVY = 64, 3


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("urn"), F.col("text").alias("data"))
    return chunks.chunked(docs, CHUNK, PER_BEVY)


CHUNKS = f"""chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS urn, i AS chunk_id, i // {PER_BEVY} AS bevy_id, i % {PER_BEVY} AS chunk_in_bevy, i * {CHUNK} AS "offset",
    substr(text, CAST(i * {CHUNK} + 1 AS BIGINT), {CHUNK}) AS payload, least({CHUNK}, length(text) - i * {CHUNK}) AS length
  FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // {CHUNK} + 1)) AS i FROM documents WHERE length(text) > 0))"""


@query(f"""WITH {CHUNKS} SELECT urn, chunk_id, bevy_id, CAST(chunk_in_bevy AS INT) AS chunk_in_bevy, "offset", CAST(length AS INT) AS length, md5(payload) AS digest, lpad(CAST(bevy_id AS VARCHAR), 8, '0') || '.index' AS member FROM chunks""")
def chunk_plan(spark, sf_dir):
    return doc_chunks(spark, sf_dir).withColumn("digest", F.md5(F.col("payload").cast("binary"))).withColumn("member", chunks.bevy_member(index=True)).drop("payload")


@query(f"""WITH {CHUNKS}, c AS (SELECT *, octet_length(encode(payload)) AS n FROM chunks)
SELECT urn, bevy_id, CAST(chunk_in_bevy AS INT) AS chunk_in_bevy, CAST(sum(n) OVER (PARTITION BY urn, bevy_id ORDER BY chunk_in_bevy) - n AS BIGINT) AS "offset", CAST(n AS BIGINT) AS length FROM c""")
def bevy_index(spark, sf_dir):
    c = doc_chunks(spark, sf_dir).withColumn("stored_length", F.octet_length("payload"))
    return chunks.bevy_index(c, "stored_length")


@query(f"""WITH {CHUNKS}, c AS (SELECT urn, bevy_id, chunk_in_bevy, sum(length) OVER (PARTITION BY urn, bevy_id ORDER BY chunk_in_bevy) AS stop FROM chunks)
SELECT urn, bevy_id, CAST(chunk_in_bevy AS INT) AS chunk_in_bevy, CAST(coalesce(lag(stop) OVER w, 0) AS BIGINT) AS "offset", CAST(stop - coalesce(lag(stop) OVER w, 0) AS BIGINT) AS length
FROM c WINDOW w AS (PARTITION BY urn, bevy_id ORDER BY chunk_in_bevy)""")
def legacy_index(spark, sf_dir):
    ends = chunks.bevy_index(doc_chunks(spark, sf_dir)).select("urn", "bevy_id", "chunk_in_bevy", (F.col("offset") + F.col("length")).alias("end"))
    return chunks.from_legacy_index(ends)


@query("""SELECT doc_id AS request_id, substr(text, CAST(1 + doc_id % 200 AS BIGINT), CAST(100 + doc_id % 57 AS BIGINT)) AS data FROM documents WHERE length(text) > doc_id % 200""")
def range_read(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = docs.select(F.col("doc_id").alias("request_id"), F.col("doc_id").cast("string").alias("urn"), (F.col("doc_id") % 200).alias("offset"), (100 + F.col("doc_id") % 57).alias("length"))
    return chunks.read_ranges(doc_chunks(spark, sf_dir), wanted, CHUNK).select("request_id", "data")


@query(f"""WITH {CHUNKS} SELECT urn, chunk_id, length >= {CHUNK} - 16 AS stored_raw FROM chunks""")
def chunk_raw_rule(spark, sf_dir):
    return doc_chunks(spark, sf_dir).select("urn", "chunk_id", chunks.is_incompressible("length", CHUNK).alias("stored_raw"))


@query(f"SELECT doc_id, CASE WHEN n > 0 AND n < 2000 THEN 'segment' ELSE 'image' END AS choice, CASE WHEN n > 0 AND n < {SMALL_FILE} THEN 'segment' ELSE 'image' END AS usual FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)")
def compression_choice(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"))
    return d.select("doc_id", chunks.storage_choice("n", threshold=2000).alias("choice"), chunks.storage_choice("n").alias("usual"))


@query("SELECT codec, CAST(doc_id AS VARCHAR) AS urn, md5(text) AS digest FROM documents, (SELECT unnest(['zlib', 'deflate', 'snappy', 'lz4', 'stored']) AS codec) WHERE length(text) > 0")
def codec_roundtrip(spark, sf_dir):
    """Every document's bytes chunked, compressed, decompressed and put together, with each codec."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("urn"), F.col("text").cast("binary").alias("data"))
    size, out = 1024, []
    for codec in CODEC_URNS:
        stored = chunks.compress(chunks.chunked(docs, size, PER_BEVY), codec, size).select("urn", "chunk_id", "stored", "is_raw")
        plain = chunks.decompress(stored, codec, size)
        parts = F.array_sort(F.collect_list(F.struct("chunk_id", F.hex("payload").alias("h"))))
        out.append(plain.groupBy("urn").agg(F.md5(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), ""))).alias("digest")).withColumn("codec", F.lit(codec)))
    return triples.merge(*out)


@query("""SELECT doc_id, substr(repeat('UNREADABLEDATA', 40), CAST(1 + doc_id % 14 AS BIGINT), CAST(doc_id % 500 AS BIGINT)) AS data FROM documents""")
def symbolic_read(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", chunks.symbolic("UNREADABLEDATA", F.col("doc_id") * 15, (F.col("doc_id") % 500).cast("int")).alias("data"))


@query(f"""WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS urn, doc_id % 40 AS k, coalesce(length(text), 0) AS n FROM documents)
SELECT urn, k AS chunk_id, k // {PER_BEVY} AS bevy_id, CAST(k % {PER_BEVY} AS INT) AS chunk_in_bevy, n > k * {CHUNK} AS found,
  CASE WHEN n > k * {CHUNK} THEN k % {PER_BEVY} * {CHUNK} END AS "offset", CASE WHEN n > k * {CHUNK} THEN least({CHUNK}, n - k * {CHUNK}) END AS length FROM w""")
def chunk_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("urn"), (F.col("doc_id") % 40).alias("chunk_id"))
    return chunks.chunk_lookup(chunks.bevy_index(doc_chunks(spark, sf_dir)), wanted, PER_BEVY)


GIVEN_CODECS = [CODEC_URNS["zlib"], CODEC_URNS["snappy"], "urn:unknown", None]


@query(f"""SELECT '{BASE}/s/' || p_partkey AS s, CASE p_partkey % 3 WHEN 2 THEN {DEFAULT_CHUNK_SIZE} ELSE p_size * 512 END AS chunk_size, CASE p_partkey % 3 WHEN 2 THEN {DEFAULT_CHUNKS_PER_BEVY} ELSE p_size END AS per_bevy,
  CASE WHEN p_partkey % 3 < 2 THEN p_partkey * 1000 END AS size, {kind_sql(['zlib', 'snappy', None, 'deflate'], 'p_partkey')} AS codec, CASE p_partkey % 4 WHEN 2 THEN 'NOT_IMPLEMENTED' ELSE 'STATUS_OK' END AS status FROM part""")
def stream_parameters(spark, sf_dir):
    """Streams described by standard names, by older ones, or by their type alone."""
    k, number = F.col("p_partkey"), lambda c: c.cast("string")
    name = lambda new, old: F.when(k % 3 == 0, new).when(k % 3 == 1, f"{LEGACY_NS}{old}")
    codec = F.get(F.array(*[F.lit(c) for c in GIVEN_CODECS]), (k % 4).cast("int"))
    given = [(F.lit(TYPE), F.lit(IMAGE_STREAMS[0])), (name(CHUNK_SIZE, "chunk_size"), number(F.col("p_size") * 512)), (name(CHUNKS_IN_SEGMENT, "chunks_in_segment"), number(F.col("p_size"))), (name(SIZE, "size"), number(k * 1000)), (F.lit(COMPRESSION), codec)]
    entries = F.array(*[F.struct(p.alias("p"), o.alias("o"), F.lit(i).cast("bigint").alias("seq")) for i, (p, o) in enumerate(given)])
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit(f"{BASE}/s/"), k.cast("string")).alias("s"), F.explode(entries).alias("e")).select("s", "e.*").where("p IS NOT NULL AND o IS NOT NULL")
    return chunks.parameters(rows, "deflate")


# --- Address maps ------------------------------------------------------------------------------------------------


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes to one map a user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("map_urn"),
        F.pmod(F.floor(F.col("value") * 7), F.lit(500)).cast("bigint").alias("map_offset"),
        (1 + F.col("event_id") % 37).alias("length"),
        ((F.col("event_id") % 5) * 64).alias("target_offset"),
        F.col("event_type").alias("target"),
        F.col("event_id").alias("seq"),
    )


WRITES = """writes AS (SELECT CAST(user_id AS VARCHAR) AS map_urn, CAST(floor(value * 7) AS BIGINT) % 500 AS map_offset, 1 + event_id % 37 AS length,
  (event_id % 5) * 64 AS target_offset, event_type AS target, event_id AS seq FROM events)"""


def overlay_sql(source: str) -> str:
    """Elementary intervals, the last writer of each, then maximal merging."""
    return f"""ends AS (SELECT map_urn, map_offset AS x FROM {source} UNION SELECT map_urn, map_offset + length FROM {source}),
steps AS (SELECT map_urn, x AS lo, lead(x) OVER (PARTITION BY map_urn ORDER BY x) AS hi FROM ends),
tops AS (
  SELECT s.map_urn, lo, hi, arg_max(target, seq) AS target, arg_max(target_offset + lo - map_offset, seq) AS target_offset
  FROM steps s JOIN {source} w ON s.map_urn = w.map_urn AND w.map_offset <= lo AND hi <= w.map_offset + w.length GROUP BY s.map_urn, lo, hi),
breaks AS (
  SELECT *, CASE WHEN lag(hi) OVER o = lo AND lag(target) OVER o = target AND lag(target_offset + hi - lo) OVER o = target_offset THEN 0 ELSE 1 END AS fresh
  FROM tops WINDOW o AS (PARTITION BY map_urn ORDER BY lo)),
marked AS (SELECT *, sum(fresh) OVER (PARTITION BY map_urn ORDER BY lo) AS island FROM breaks),
overlaid AS (SELECT map_urn, min(lo) AS map_offset, max(hi) - min(lo) AS length, min(target_offset) AS target_offset, min(target) AS target FROM marked GROUP BY map_urn, island)"""


@query(f"WITH {WRITES}, {overlay_sql('writes')} SELECT * FROM overlaid")
def map_overlay(spark, sf_dir):
    return ranges.overlay(writes(spark, sf_dir))


@query(f"WITH {WRITES}, {overlay_sql('writes')} SELECT * FROM overlaid")
def map_get_ranges(spark, sf_dir):
    return ranges.get_ranges(ranges.overlay(writes(spark, sf_dir)))


@query(f"WITH {WRITES}, {overlay_sql('writes')} SELECT * FROM overlaid WHERE false")
def map_clear(spark, sf_dir):
    return ranges.clear(ranges.overlay(writes(spark, sf_dir)))


@query("SELECT CAST(doc_id AS VARCHAR) AS map_urn, CAST(0 AS BIGINT) AS map_offset, CAST(n_chars AS BIGINT) AS length, CAST(0 AS BIGINT) AS target_offset, source AS target FROM documents")
def map_whole_stream(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return ranges.whole_stream(d.select(F.col("doc_id").cast("string").alias("map_urn"), "n_chars", F.col("source").alias("target"), F.col("n_chars").cast("bigint").alias("size")))


@query(f"""WITH {WRITES}, {overlay_sql('writes')},
edges AS (SELECT map_urn, map_offset, coalesce(lag(map_offset + length) OVER (PARTITION BY map_urn ORDER BY map_offset), 0) AS stop FROM overlaid
  UNION ALL SELECT map_urn, CAST(600 AS BIGINT), max(map_offset + length) FROM overlaid GROUP BY map_urn)
SELECT * FROM overlaid UNION ALL SELECT map_urn, stop, map_offset - stop, 0, NULL FROM edges WHERE map_offset > stop""")
def map_read_gaps(spark, sf_dir):
    flat = ranges.overlay(writes(spark, sf_dir))
    return ranges.with_gaps(flat, flat.select("map_urn").distinct().withColumn("size", F.lit(600).cast("bigint")))


@query(f"""WITH {WRITES}, {overlay_sql('writes')}, q AS (SELECT event_id, CAST(user_id AS VARCHAR) AS map_urn, (event_id * 7) % 480 AS lo, (event_id * 7) % 480 + 1 + event_id % 90 AS hi FROM events)
SELECT event_id AS request_id, greatest(map_offset, lo) - lo AS out_offset, least(map_offset + length, hi) - greatest(map_offset, lo) AS length, target_offset + greatest(map_offset, lo) - map_offset AS target_offset, target
FROM overlaid JOIN q USING (map_urn) WHERE map_offset < hi AND lo < map_offset + length""")
def map_lookup(spark, sf_dir):
    q = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("map_urn"), ((F.col("event_id") * 7) % 480).alias("offset"), (1 + F.col("event_id") % 90).alias("length"))
    return ranges.lookup(ranges.overlay(writes(spark, sf_dir)), q).drop("map_urn")


@query(f"""WITH {WRITES}, {overlay_sql('writes')} SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY map_urn ORDER BY map_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dense_offset FROM overlaid""")
def map_compact(spark, sf_dir):
    return ranges.compact(ranges.overlay(writes(spark, sf_dir)))


@query(f"""WITH {WRITES} SELECT map_urn, seq, map_offset, length, CAST(sum(length) OVER (PARTITION BY map_urn ORDER BY seq) - length AS BIGINT) AS target_offset FROM writes""")
def map_write_append(spark, sf_dir):
    return ranges.appended(writes(spark, sf_dir).drop("target_offset", "target"))


@query(f"WITH {WRITES} SELECT map_urn, max(map_offset + length) AS size FROM writes GROUP BY map_urn")
def map_size(spark, sf_dir):
    return ranges.size(writes(spark, sf_dir))


@query(f"""WITH {WRITES}, f AS (SELECT map_urn, target, min(seq) AS first FROM writes GROUP BY map_urn, target)
SELECT map_urn, target, CAST(row_number() OVER (PARTITION BY map_urn ORDER BY first) - 1 AS INT) AS target_id FROM f""")
def target_numbering(spark, sf_dir):
    return ranges.number_targets(writes(spark, sf_dir))


@query(f"""WITH {WRITES}, w AS (SELECT map_urn, map_offset, length, CASE WHEN target = 'error' THEN map_offset ELSE target_offset END AS target_offset, CASE WHEN target = 'error' THEN '{UNREADABLE}' ELSE target END AS target, seq FROM writes),
{overlay_sql('w')} SELECT * FROM overlaid""")
def unreadable_merge(spark, sf_dir):
    return ranges.overlay(ranges.mark_unreadable(writes(spark, sf_dir), "target = 'error'"))


@query(f"WITH {WRITES}, {overlay_sql('writes')} SELECT map_urn, map_offset, length, target_offset, target FROM overlaid")
def map_codec(spark, sf_dir):
    """Maps packed to records and target lists, and unpacked again."""
    w = writes(spark, sf_dir)
    flat = ranges.overlay(w).join(ranges.number_targets(w), ["map_urn", "target"])
    return files.decode_map(files.encode_map(flat)).select("map_urn", "map_offset", "length", "target_offset", "target")


@query(f"""WITH {WRITES}, {overlay_sql('writes')} SELECT map_urn, map_offset AS vaddr, length AS memsz,
  CAST(64 + 56 * count(*) OVER (PARTITION BY map_urn) + sum(length) OVER (PARTITION BY map_urn ORDER BY map_offset) - length AS BIGINT) AS file_offset FROM overlaid""")
def elf_layout(spark, sf_dir):
    return ranges.elf_layout(ranges.overlay(writes(spark, sf_dir)))


@query("""WITH RECURSIVE seg AS (SELECT o_custkey AS dump, o_orderkey AS vaddr, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey // 2 END AS paddr, o_orderkey * 10 AS off, 1 + o_orderkey % 7 AS memsz,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey % 4 <> 1),
ram AS (SELECT o_custkey AS dump, o_orderkey // 2 AS start, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey // 2) - 1 AS k FROM orders WHERE o_orderkey % 2 = 0),
walk AS (
  SELECT dump, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS map_offset, CAST(NULL AS BIGINT) AS target_offset, CAST(NULL AS BIGINT) AS length FROM (SELECT DISTINCT dump FROM seg)
  UNION ALL
  SELECT w.dump, s.rn, CASE WHEN r.start IS NOT NULL AND (s.paddr = 0 OR s.paddr = r.start) THEN w.k + 1 ELSE w.k END,
    CASE WHEN r.start IS NOT NULL AND (s.paddr = 0 OR s.paddr = r.start) THEN s.paddr END, s.off, s.memsz
  FROM walk w JOIN seg s ON s.dump = w.dump AND s.rn = w.rn + 1 LEFT JOIN ram r ON r.dump = w.dump AND r.k = w.k)
SELECT dump, map_offset, target_offset, length FROM walk WHERE map_offset IS NOT NULL""")
def kcore_pairing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    memsz = 1 + k % 7
    seg = o.select(F.col("o_custkey").alias("dump"), k.alias("vaddr"), F.when(k % 3 == 0, 0).otherwise(F.expr("o_orderkey DIV 2")).alias("paddr"), memsz.alias("memsz"), F.when(k % 4 != 1, memsz).otherwise(-1).alias("filesz"), (k * 10).alias("off"))
    ram = o.where(k % 2 == 0).select(F.col("o_custkey").alias("dump"), F.expr("o_orderkey DIV 2").alias("start"))
    return ranges.pair_kcore(seg, ram)


EFI_TYPES = [*EFI_READABLE, "EfiReservedMemoryType", "EfiUnusableMemory", "EfiMemoryMappedIO"]


@query(f"""SELECT type, CAST(sum(length) AS BIGINT) AS total, count(*) AS n FROM (SELECT {kind_sql(EFI_TYPES, 'event_id')} AS type, CAST(floor(value) AS BIGINT) AS length FROM events WHERE event_type <> 'view')
WHERE type IN ({', '.join(f"'{t}'" for t in EFI_READABLE)}) GROUP BY type""")
def efi_readable_total(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.get(F.array(*[F.lit(t) for t in EFI_TYPES]), (F.col("event_id") % len(EFI_TYPES)).cast("int"))
    records = e.select(F.when(F.col("event_type") == "view", "other").otherwise("efi").alias("kind"), kind.alias("type"), F.floor("value").cast("bigint").alias("length"))
    return ranges.readable_total(records, EFI_READABLE)


# --- Volumes -----------------------------------------------------------------------------------------------------


def stream_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as streams: abstract images whose data stream is the part of half the key; others are concrete; some point at themselves."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit(f"{BASE}/s/"), c.cast("string"))
    kind = F.when(k % 3 == 0, MAP).when(k % 7 == 0, IMAGE_STREAMS[0]).when(k % 11 == 0, ZIP_SEGMENT).otherwise(ABSTRACT_IMAGES[1])
    nxt = F.when(kind == ABSTRACT_IMAGES[1], F.when(k % 10 == 1, name(k)).otherwise(name(F.expr("p_partkey DIV 2"))))
    rows = p.select(name(k).alias("s"), F.array(F.struct(F.lit(TYPE).alias("p"), kind.alias("o")), F.struct(F.lit(DATA_STREAM).alias("p"), nxt.alias("o")), F.struct(F.lit(STORED).alias("p"), F.when(kind == ZIP_SEGMENT, BASE).alias("o"))).alias("e"))
    return rows.select(F.lit(BASE).alias("volume"), "s", F.posexplode("e").alias("seq", "x")).select("volume", "s", "x.p", "x.o", F.lit("urn").alias("dt"), F.col("seq").cast("bigint").alias("seq")).where("o IS NOT NULL")


@query(f"""WITH RECURSIVE g AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'map' WHEN p_partkey % 7 = 0 THEN 'image' WHEN p_partkey % 11 = 0 THEN 'segment' ELSE 'delegate' END AS kind,
    CASE WHEN p_partkey % 10 = 1 THEN p_partkey ELSE p_partkey // 2 END AS nxt FROM part),
walk AS (SELECT k, k AS stream, kind, nxt, 0 AS hops FROM g UNION ALL SELECT w.k, w.nxt, g.kind, g.nxt, w.hops + 1 FROM walk w LEFT JOIN g ON g.k = w.nxt WHERE w.kind = 'delegate' AND w.hops < 17)
SELECT '{BASE}/s/' || k AS s, arg_max(coalesce(kind, 'not_found'), hops) FILTER (kind IS DISTINCT FROM 'delegate') AS kind FROM walk GROUP BY k HAVING bool_or(kind IS DISTINCT FROM 'delegate')
UNION ALL SELECT '{BASE}/s/' || k, 'not_found' FROM walk GROUP BY k HAVING bool_and(kind IS NOT DISTINCT FROM 'delegate')""")
def resolve_stream(spark, sf_dir):
    return volumes.resolve(stream_graph(spark, sf_dir)).select("s", "kind")


@query("""WITH RECURSIVE s AS (SELECT conv_id % 16 AS series, conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn) AS rn FROM conversations),
walk AS (SELECT series, conv_id, turn, rn, n AS used, 0 AS part FROM s WHERE rn = 1
  UNION ALL SELECT s.series, s.conv_id, s.turn, s.rn, CASE WHEN w.used >= 3000 THEN s.n ELSE w.used + s.n END, CASE WHEN w.used >= 3000 THEN w.part + 1 ELSE w.part END FROM walk w JOIN s ON s.series = w.series AND s.rn = w.rn + 1)
SELECT series, conv_id, turn, part FROM walk""")
def volume_split(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 16).alias("series"), "conv_id", "turn", F.length("text").alias("size"))
    return volumes.split_parts(c, ["conv_id", "turn"], "size", 3000, "series")


@query("SELECT source AS volume, count(*) AS members, CAST(sum(length(text)) AS BIGINT) AS size FROM documents GROUP BY source")
def volume_merge(spark, sf_dir):
    """Two overlapping groups of volumes: a volume in both is taken once."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("volume"), "doc_id", F.length("text").alias("size"))
    merged = volumes.add_volumes(d.where("volume < 'src2'"), d)
    return merged.groupBy("volume").agg(F.count("*").alias("members"), F.sum("size").cast("bigint").alias("size"))


@query(f"""WITH p AS (SELECT 'https' || substr(url, length(url)) AS t, '{PREFIX}' || regexp_replace(url, '^https?://', '') AS s FROM pages)
SELECT DISTINCT s, {escape_sql("regexp_extract(s, '^[a-z0-9]+://([^/]*)', 1)").replace('%2F', '%2F')} || '/' || {escape_sql("regexp_extract(s, '^[a-z0-9]+://[^/]*/?(.*)$', 1)")} AS target FROM p WHERE regexp_matches(s, '(?is)^.*example.*/(en|de)/.*$')""")
def export_plan(spark, sf_dir):
    """Pages as images, some also as maps; each is exported once."""
    s = F.concat(F.lit(PREFIX), F.regexp_replace("url", "^https?://", ""))
    kinds = F.when(F.col("page_id") % 2 == 0, F.array(F.lit(IMAGE), F.lit(MAP))).otherwise(F.array(F.lit(IMAGE)))
    t = table(spark, sf_dir, "pages").select(s.alias("s"), F.lit(TYPE).alias("p"), F.explode(kinds).alias("o"))
    return export_candidates(t, "*example*/@(en|de)/*")


@query("SELECT conv_id || '/' || turn AS member, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest, true AS crc_ok FROM conversations")
def zip_members(spark, sf_dir):
    """Every conversation turn as a member of zip volumes, written and read back; checksums are verified while reading."""
    zip_volume.register(spark)
    path = folder(spark, "volumes")
    member = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = table(spark, sf_dir, "conversations").select(member.alias("member"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    rows.write.format("zip_volume").option("path", path).option("urn", BASE).mode("append").save()
    back = spark.read.format("zip_volume").option("path", path).load()
    return back.where(~F.col("member").isin("container.description", "version.txt", "information.turtle")).select("member", "size", F.md5("payload").alias("digest"), "crc_ok")


@query("""SELECT CAST(doc_id AS VARCHAR) AS name, md5(text) AS digest, CASE WHEN octet_length(encode(text)) < 2000 THEN 'segment' ELSE 'image' END AS kind FROM documents WHERE length(text) > 0""")
def ingest_round_trip(spark, sf_dir):
    """Every document as a file taken into zip volumes, small ones as segments, others as chunked streams, and read back by its metadata."""
    path = folder(spark, "ingest")
    files = table(spark, sf_dir, "documents").where("length(text) > 0").select(F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("data"))
    ingest(files, path, BASE, "snappy", chunk_size=512, per_bevy=8, threshold=2000)
    found = load_volumes(spark, path)
    name = F.regexp_extract("urn", "^.*/([0-9]+)$", 1)
    small = found.scan().where(F.col("urn").rlike(f"^{BASE}/[0-9]+$")).select(name.alias("name"), F.md5("payload").alias("digest"), F.lit("segment").alias("kind"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", F.hex("payload").alias("h"))))
    whole = F.md5(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")))
    return small.union(found.chunks().groupBy("urn").agg(whole.alias("digest")).select(name, "digest", F.lit("image")))
