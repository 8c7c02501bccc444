"""Registered queries of sources and sinks: each writes files of its own below the shared folder and reads them back; and of streams and services."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronica.operators import codes, vectors
from chronica.plans.graph_queries import _edges
from chronica.session import files_folder, table
from chronica.sources import external, markup, readers
from chronica.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
PATTERNS = [("ring|band", "ring"), ("widget", "widget"), ("^(?:red|blue|green)", "coloured"), ("bolt|nut", "fastener")]
SCOPE = {"profiles": {"narrow": ["kidney"], "wide": ["kidney", "heart"]}, "groups": {"kidney": ["N18", "N17"], "heart": ["I50"]}, "seeds": {"dosing": ["loop diuretic", "dose"], "fluid": ["oedema"]}}


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as compressed CSV, read back as text with numbers from text."""
    path = files_folder(spark, "csv")
    readers.write_csv(table(spark, folder, "customer"), path, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    rows = readers.read_text_csv(spark, path, ["c_custkey", "c_name", "c_acctbal"])
    return rows.select("c_custkey", "c_name", readers.as_number(F.col("c_acctbal")).alias("balance"))


def filtered_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of one priority from a CSV file; the filter is part of the scan."""
    path = files_folder(spark, "csv")
    o = table(spark, folder, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    readers.write_csv(o, path, ["o_orderkey", "o_orderpriority", "day"])
    rows = readers.read_text_csv(spark, path, ["o_orderkey", "o_orderpriority", "day"], F.col("o_orderpriority") == "2-HIGH")
    return rows.select("o_orderkey", readers.as_time(F.col("day")).alias("day"))


def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Nested profiles as JSON lines and back."""
    path, p = files_folder(spark, "json"), table(spark, folder, "profiles")
    readers.write_json_lines(p, path)
    back = readers.read_json_lines(spark, path, p.schema, strict=True)
    return back.select("dose_id", F.size(F.coalesce("visits", F.array().cast(p.schema["visits"].dataType))).cast("bigint").alias("n_visits"), F.try_element_at("demographics", F.lit("gender")).alias("gender"))


def json_array(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as one JSON array, read with only one region's rows."""
    path, n = files_folder(spark, "array"), table(spark, folder, "nation")  # a table of fixed size
    n.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("split")))).alias("value")).write.text(path)
    return readers.read_json_array(spark, path, "n_nationkey int, n_name string, split string", "1").drop("split")


def keyed_json(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as JSON objects keyed by number, and back."""
    path = files_folder(spark, "keyed")
    readers.write_keyed_json(table(spark, folder, "supplier"), path, "s_suppkey", F.struct("s_name", "s_nationkey"))
    return readers.read_keyed_json(spark, path, "struct<s_name:string,s_nationkey:int>").select("key", "value.s_name", "value.s_nationkey")


def triples_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path, e = files_folder(spark, "tsv"), _edges(spark, folder)
    readers.write_triples(e.unionByName(e), path)
    return readers.read_edges(spark, path)


def pipes_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as pipe-separated lines without quoting, some of them short."""
    path, p = files_folder(spark, "pipes"), table(spark, folder, "part")
    line = F.when(F.col("p_partkey") % 10 == 0, F.concat_ws("|", "p_partkey", "p_name")).otherwise(F.concat_ws("|", "p_partkey", F.concat(F.lit('"'), "p_name"), "p_brand", F.lit("")))
    p.select(line.alias("value")).write.text(path)
    return readers.read_pipes(spark, path, ["code", "name", "brand"])


def crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    """Brands to categories from a CSV file; the first line of a brand wins, its category is cut at the comma."""
    path, p = files_folder(spark, "crosswalk"), table(spark, folder, "part")
    rows = p.select(F.col("p_brand").alias("code"), F.concat("p_type", F.lit(", "), "p_name").alias("category"), "p_partkey")
    readers.write_csv(rows.repartitionByRange(1, "p_partkey").sortWithinPartitions("p_partkey"), path, ["code", "category"])  # a code table is one file
    return readers.read_crosswalk(spark, path)


def pattern_table(spark: SparkSession, folder: str) -> DataFrame:
    """Part names classed by an ordered file of patterns."""
    path = files_folder(spark, "patterns")
    lines = ["# ordered: the first match wins", "", *[f"{a}\t{b}" for a, b in PATTERNS]]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    label = codes.first_pattern(F.col("p_name"), readers.read_patterns(spark, path))
    return table(spark, folder, "part").groupBy(F.coalesce(label, F.lit("none")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def names_of_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Nations of one region, from a CSV dictionary."""
    path = files_folder(spark, "names")
    readers.write_csv(table(spark, folder, "nation"), path, ["n_nationkey", "n_name", "n_regionkey"])
    return readers.read_names(spark, path, "n_nationkey", "n_name", "n_regionkey", "2")


def term_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Brands with their part types between pipes; comments and empty lists are skipped."""
    path = files_folder(spark, "terms")
    by = table(spark, folder, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), " | ").alias("t"))
    listed = F.when(F.col("p_brand") == "Brand#11", " | ").otherwise(F.col("t"))
    by.select(F.when(F.col("p_brand") == "Brand#12", "# a comment").otherwise(F.col("p_brand")).alias("a"), listed.alias("b")).write.csv(path)
    return readers.read_term_lists(spark, path).select("concept", F.array_join("terms", ",").alias("terms"))


def eligible_events(spark: SparkSession, folder: str) -> DataFrame:
    """Decision records marked eligible whose dose is plausible, from a CSV file."""
    path = files_folder(spark, "events")
    rows = table(spark, folder, "cohort").select("hadm_id", "via_ed", "dose_mg", "anchor_age")
    readers.write_csv(rows, path, ["hadm_id", "via_ed", "dose_mg", "anchor_age"])
    out = readers.read_events_csv(spark, path, ["hadm_id", "via_ed", "dose_mg", "anchor_age"], "via_ed", {"dose_mg": (5, 200), "anchor_age": (18, 90)}, ["hadm_id"])
    return out.select("hadm_id", readers.as_number(F.col("dose_mg")).alias("dose_mg"))


def scope_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes_of, seeds = readers.scope_tables(spark, SCOPE)
    return codes_of.unionByName(seeds.select(F.lit("seed").alias("profile"), F.col("theme").alias("group"), F.col("term").alias("code")))


def manifest_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as a manifest: those that stand twice, and those of an unknown type."""
    m = table(spark, folder, "part").where("p_size <= 3").select(F.col("p_name").alias("name"), F.col("p_type").alias("access"))
    return readers.manifest_faults(m, "name", "access", ["PROMO", "ECONOMY"])


def locked_files(spark: SparkSession, folder: str) -> DataFrame:
    """A written file against a manifest, and the manifest with its hash filled in."""
    path = files_folder(spark, "locked")
    spark.createDataFrame([("abc",)], "value string").coalesce(1).write.text(path)
    manifest = spark.createDataFrame([("missing.txt", "00"), ("none.txt", None)], "name string, sha256 string")
    present = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(None).cast("string").alias("sha256"))
    whole = manifest.unionByName(present)
    states = readers.verify_locked(spark, path, whole)
    found = readers.relocked(whole, states).join(states.select("name", "state"), "name")
    return found.select("state", F.coalesce("sha256", F.lit("none")).alias("sha256"))


def pending_units(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose last log entry isn't good, or that have none."""
    units = table(spark, folder, "orders").select("o_orderkey")
    l = table(spark, folder, "lineitem")
    log = l.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("at")).agg(F.max("l_returnflag").alias("f"))
    return readers.pending(units, log.select("o_orderkey", "at", (F.col("f") != "R").alias("ok")), "o_orderkey")


def review_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Nations with blank columns for a reviewer, written and read back."""
    path = files_folder(spark, "review")
    readers.write_review(table(spark, folder, "nation"), path, ["n_nationkey", "n_name"], ["is_right", "note"])
    return readers.read_text_csv(spark, path, ["n_nationkey", "n_name", "is_right", "note"])


def cached_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Names embedded in two batches through a cache: the second embeds only what the first has not."""
    path, schema = files_folder(spark, "cache"), "text string, vec array<float>"
    names = table(spark, folder, "part").select("p_name", "p_size")
    for batch, rows in (("1", names.where("p_size <= 25")), ("2", names)):
        known = readers.read_cache(spark, path, schema)
        fresh = vectors.embedded(rows, "p_name", vectors.hash_embedder(16), known).join(known.select("text"), "text", "left_anti")
        readers.extend_cache(fresh, path, batch)
    return readers.read_cache(spark, path, schema).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).cast("bigint").alias("size"))


def catalogue_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A paged catalogue, behind an injected getter."""

    def get(query: str, page: int) -> tuple[list[tuple[str, str]], bool]:
        return [(f"{query}{n}", f"g{n % 3}") for n in range(10 * page - 10, 10 * page + 1)], page < 5

    return spark.createDataFrame(readers.paged(get, "id"), "id string, grp string")


def journal_markup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages as journal articles, taken apart into headings, paragraphs and lists."""
    d = table(spark, folder, "documents").where("kind is not null and lang is not null")
    xml = F.concat(
        F.lit("<article><body><sec><title>"), "kind", F.lit(" <xref>1</xref></title><p>in <b>"), "lang", F.lit("</b></p><sec><title>Size</title><list><list-item><p>"), F.col("n_chars").cast("string"), F.lit("</p></list-item></list></sec></sec></body></article>"),
    )
    return markup.blocks(d.select("doc_id", xml.alias("x")), "doc_id", "x").select("source_id", "seq", "kind", "level", "text")


def label_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Part facts as label sections, a blank one left out."""
    s = F.array(F.struct(F.col("p_type").alias("title"), F.col("p_name").alias("text")), F.struct(F.col("p_brand").alias("title"), F.lit(" ").alias("text")))
    return markup.label_json_blocks(table(spark, folder, "part").select("p_partkey", s.alias("s")), "p_partkey", "s")


def service_units(spark: SparkSession, folder: str) -> DataFrame:
    """Nations sent through a client that refuses one region."""

    def client():
        def ask(text: str) -> str:
            if text.endswith("3"):
                raise ValueError("refused")
            return text.lower()

        return ask

    n = table(spark, folder, "nation").select("n_nationkey", F.concat("n_name", "n_regionkey").alias("ask"))
    out = external.run_units(n, "n_nationkey", "ask", client, wait=0.0)
    return out.select("unit", "ok", "reply", "error")


def reply_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of replies in three forms."""
    p = table(spark, folder, "part")
    one = F.struct(F.col("p_name").alias("entity1"), F.lit("is a").alias("relationship"), F.col("p_type").alias("entity2"))
    keyed = F.concat(F.lit('```json\n{"output": '), F.to_json(F.array(one)), F.lit("}\n```"))
    listed = F.to_json(F.array(F.array("p_name", F.lit("is a"), "p_type"), F.array("p_name", F.lit(""), "p_type")))
    reply = F.when(F.col("p_partkey") % 3 == 0, keyed).when(F.col("p_partkey") % 3 == 1, listed).otherwise("no triples")
    return external.parsed_triples(p.select("p_partkey", reply.alias("reply")), "p_partkey", "reply").select("unit", "head", "relation", "tail")


def reply_schedules(spark: SparkSession, folder: str) -> DataFrame:
    """Doses of replies, cut to four, filled and clamped."""
    l = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity") * 20 - 100)).alias("doses"))
    reply = F.when(F.col("l_orderkey") % 5 == 0, "none").otherwise(F.to_json(F.struct("doses")))
    s = external.schedule_in(reply)
    return l.select("l_orderkey", F.round(F.aggregate(s, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size(s).cast("bigint").alias("slots")).where("total is not null")


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by six-hour window and type, as a stream: windows that are closed an hour after the last event."""
    out = windows.windowed_counts(windows.parquet_stream(spark, folder, "events"), "ts", ["event_type"], "value", "6 hours")
    done = windows.run_to_files(out, spark, "stream")
    return done.select(F.col("from_time").cast("timestamp_ntz").alias("from_time"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users with at most twelve hours between events, as a stream."""
    out = windows.sessions(windows.parquet_stream(spark, folder, "events"), "ts", ["user_id"], "12 hours")
    done = windows.run_to_files(out, spark, "stream")
    return done.select("user_id", F.col("from_time").cast("timestamp_ntz").alias("from_time"), "n")


def stream_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """One event of each user and type within the watermark of a stream that is read in one go."""
    out = windows.first_seen(windows.parquet_stream(spark, folder, "events"), "ts", ["user_id", "event_type"])
    return windows.run_to_files(out.select("user_id", "event_type"), spark, "stream")


SQL = {
    "csv_round_trip": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_acctbal AS balance FROM customer",
    "filtered_scan": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day FROM orders WHERE o_orderpriority = '2-HIGH'",
    "json_round_trip": "SELECT dose_id, coalesce(len(visits), 0)::BIGINT AS n_visits, demographics['gender'] AS gender FROM profiles",
    "json_array": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1",
    "keyed_json": "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name, s_nationkey FROM supplier",
    "triples_round_trip": "SELECT DISTINCT s_name AS head, 'in' AS relation, 'NATION_' || s_nationkey AS tail FROM supplier UNION SELECT 'NATION_' || n_nationkey, 'part of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "pipes_round_trip": "SELECT CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_partkey % 10 = 0 THEN p_name ELSE '\"' || p_name END AS name, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS brand FROM part",
    "crosswalk": "SELECT p_brand AS code, arg_min(p_type, p_partkey) AS category FROM part GROUP BY 1",
    "pattern_table": """SELECT CASE WHEN regexp_matches(p_name, '(?i)ring|band') THEN 'ring' WHEN regexp_matches(p_name, '(?i)widget') THEN 'widget' WHEN regexp_matches(p_name, '(?i)^(red|blue|green)') THEN 'coloured'
      WHEN regexp_matches(p_name, '(?i)bolt|nut') THEN 'fastener' ELSE 'none' END AS class, count(*) AS n FROM part GROUP BY 1""",
    "names_of_codes": "SELECT CAST(n_nationkey AS VARCHAR) AS code, lower(n_name) AS name FROM nation WHERE n_regionkey = 2",
    "term_lists": "SELECT lower(p_brand) AS concept, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS terms FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') GROUP BY 1",
    "eligible_events": "SELECT hadm_id, dose_mg FROM cohort WHERE via_ed AND coalesce(dose_mg BETWEEN 5 AND 200, true) AND coalesce(anchor_age BETWEEN 18 AND 90, true)",
    "scope_codes": "SELECT * FROM (VALUES ('narrow', 'kidney', 'N18'), ('narrow', 'kidney', 'N17'), ('wide', 'kidney', 'N18'), ('wide', 'kidney', 'N17'), ('wide', 'heart', 'I50'), ('seed', 'dosing', 'loop diuretic'), ('seed', 'dosing', 'dose'), ('seed', 'fluid', 'oedema')) t(profile, \"group\", code)",
    "manifest_faults": "SELECT p_name AS name, 'repeated' AS fault FROM part WHERE p_size <= 3 GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT p_name, 'unknown access' FROM part WHERE p_size <= 3 AND p_type NOT IN ('PROMO', 'ECONOMY')",
    "locked_files": "SELECT 'missing' AS state, '00' AS sha256 UNION ALL SELECT 'missing', 'none' UNION ALL SELECT 'locked_now', sha256('abc' || chr(10))",
    "pending_units": """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, arg_max(f, l_linenumber) AS f FROM l GROUP BY 1)
      SELECT o_orderkey FROM orders LEFT JOIN b ON l_orderkey = o_orderkey WHERE coalesce(f, 'R') = 'R'""",
    "review_sheet": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, '' AS is_right, '' AS note FROM nation",
    "cached_vectors": "SELECT DISTINCT p_name AS text, 1::BIGINT AS n, 16::BIGINT AS size FROM part",
    "catalogue_pages": "SELECT 'id' || n AS id, 'g' || (n % 3) AS grp FROM range(51) t(n)",
    "journal_markup": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, kind, lang, n_chars FROM documents WHERE kind IS NOT NULL AND lang IS NOT NULL)
      SELECT source_id, 0 AS seq, 'heading' AS kind, 1 AS level, trim(kind) AS text FROM d UNION ALL SELECT source_id, 1, 'paragraph', 0, 'in ' || trim(lang) FROM d
      UNION ALL SELECT source_id, 2, 'heading', 2, 'Size' FROM d UNION ALL SELECT source_id, 3, 'list', 0, CAST(n_chars AS VARCHAR) FROM d""",
    "label_blocks": "SELECT p_partkey AS source_id, 0 AS seq, 'heading' AS kind, 1 AS level, p_type AS text FROM part UNION ALL SELECT p_partkey, 1, 'paragraph', 0, p_name FROM part UNION ALL SELECT p_partkey, 2, 'heading', 1, p_brand FROM part",
    "service_units": "SELECT CAST(n_nationkey AS VARCHAR) AS unit, n_regionkey <> 3 AS ok, CASE WHEN n_regionkey <> 3 THEN lower(n_name || n_regionkey) END AS reply, CASE WHEN n_regionkey = 3 THEN 'refused' END AS error FROM nation",
    "reply_triples": "SELECT CAST(p_partkey AS VARCHAR) AS unit, p_name AS head, 'is a' AS relation, p_type AS tail FROM part WHERE p_partkey % 3 < 2",
    "reply_schedules": """WITH l AS (SELECT l_orderkey, list_sort(list(l_quantity * 20 - 100))[1:4] AS d FROM lineitem GROUP BY 1)
      SELECT l_orderkey, round(list_sum(list_transform(d, lambda x: least(400.0, greatest(0.0, x)))), 4) AS total, 4::BIGINT AS slots FROM l WHERE l_orderkey % 5 <> 0""",
    "stream_windows": """SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS from_time, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
      HAVING time_bucket(INTERVAL 6 HOUR, min(ts), TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_sessions": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM m)
      SELECT user_id, min(ts) AS from_time, count(*) AS n FROM s GROUP BY user_id, g HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
}

QUERIES: list[Query] = [
    csv_round_trip, filtered_scan, json_round_trip, json_array, keyed_json, triples_round_trip, pipes_round_trip, crosswalk, pattern_table, names_of_codes, term_lists, eligible_events,
    scope_codes, manifest_faults, locked_files, pending_units, review_sheet, cached_vectors, catalogue_pages, journal_markup, label_blocks, service_units, reply_triples, reply_schedules,
    stream_windows, stream_sessions, stream_first_seen,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
