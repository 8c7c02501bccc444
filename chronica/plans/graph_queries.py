"""Registered queries of the code, split, set, graph, entity, text and vector operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronica.functions import scalars as X
from chronica.operators import codes, graph, model, resolve, sampling, sets, text, vectors
from chronica.session import table

Query = Callable[[SparkSession, str], DataFrame]
LADDER = [1.0, 5.0, 10.0, 20.0, 25.0, 40.0, 50.0]
PATTERNS = [("ring|band", "ring"), ("widget", "widget"), ("^(?:red|blue|green)", "coloured"), ("bolt|nut", "fastener")]
TERMS = [
    ("furosemide", "furosemide"), ("furosemide", "furosémide"), ("bumetanide", "bumetanide"), ("kidney", "kidney"), ("kidney", "chronic kidney disease"),
    ("oedema", "resistant oedema"), ("oedema", "leg swelling"), ("potassium", "potassium"), ("weight", "weight"), ("weight", "weight gain"),
]
SHARES = [("train", 0.7), ("dev", 0.15), ("test", 0.15)]


def ladder_filter(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem")
    kept = l.where(X.on_ladder(F.col("l_quantity"), LADDER) & X.is_multiple(F.col("l_quantity"), 5.0))
    return kept.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))


def plausible_rows(spark: SparkSession, folder: str) -> DataFrame:
    kept = table(spark, folder, "lineitem").where(X.plausible({"l_quantity": (5, 45), "l_discount": (0.01, 0.09), "l_extendedprice": (1000, 80000)}))
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def right_closed_bins(spark: SparkSession, folder: str) -> DataFrame:
    b = X.right_closed_bin(F.col("o_totalprice"), [0, 1e5, 2e5, 4e5], ["low", "mid", "high"])
    return table(spark, folder, "orders").groupBy(F.coalesce(b, F.lit("out")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def case_tiers(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("o_orderpriority")
    tier = F.when(p.startswith("1"), "first").when(p.startswith("2") & (F.col("o_totalprice") > 200000), "second").when(p.isNull(), "none").otherwise("rest")
    return table(spark, folder, "orders").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def filtration_rates(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("state")
    rate = X.filtration_rate(s["creatinine_mg_dl"], s["age"], s["sex"] == "F")
    rows = table(spark, folder, "dose_records").select("dose_id", F.round(rate, 4).alias("rate")).distinct()
    return rows.where("rate is not null")


def enrich_left(spark: SparkSession, folder: str) -> DataFrame:
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    wide = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    years = F.year("o_orderdate") - 1990
    return wide.groupBy("r_name", years.cast("bigint").alias("years")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def prefix_backoff(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", X.code(F.col("p_brand")).alias("code"))
    lookup = spark.createDataFrame([("BRAND#", "other"), ("BRAND#1", "tens"), ("BRAND#2", "twenties"), ("BRAND#25", "last")], "prefix string, category string")
    return codes.longest_prefix(parts, "code", lookup, "prefix", "category").select("p_partkey", "category", F.col("prefix_length").cast("bigint").alias("prefix_length"))


def first_match_class(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select("p_partkey", codes.first_pattern(F.col("p_name"), PATTERNS, "small").alias("class"))
    return names.groupBy(F.coalesce("class", F.lit("none")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def versioned_prefix_flag(spark: SparkSession, folder: str) -> DataFrame:
    flag = codes.prefix_flag(F.col("p_brand"), F.col("p_type"), {"ECONOMY": ["Brand#1"], "PROMO": ["Brand#2", "Brand#3"]})
    return table(spark, folder, "part").groupBy("p_type").agg(F.count_if(flag).alias("n"), F.bool_or(flag).alias("any"))


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_split(o, "o_orderkey", ["o_orderpriority"], SHARES, 2026)


def temporal_split(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    late = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    return sampling.temporal_split(o, "o_orderkey", late, ["o_orderpriority"], [("train", 0.8), ("dev", 0.2), ("test", 0.0)], 2026).select("o_orderkey", "split")


def quota_sample(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.quota_sample(o, "o_orderkey", "o_orderpriority", {"1-URGENT": 75, "2-HIGH": 25}, 7)


def split_leakage(spark: SparkSession, folder: str) -> DataFrame:
    s = stratified_split(spark, folder).join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return sampling.shared_between(s, "o_custkey", "split").select("o_custkey", F.array_join("splits", ",").alias("splits"))


def _order_sets(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return sets.entity_sets(l.join(p, "l_partkey"), ["l_orderkey"], "p_brand")


def cooccurrence_topk(spark: SparkSession, folder: str) -> DataFrame:
    return sets.companions(_order_sets(spark, folder), 5).withColumn("rank", F.col("rank").cast("bigint"))


def distinct_sets(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return sets.equal_sets(sets.entity_sets(e, ["user_id", "day"], "event_type")).select(F.array_join("items", ",").alias("items"), "n")


def jaccard_knn(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("id"), "event_type")
    out = sets.nearest_sets(sets.entity_sets(e, ["id"], "event_type"), "id", 3)
    return out.select("id", "neighbour", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def near_dup_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct visit sets of more than 10 items, less those that differ from an earlier one in fewer than 5."""
    empty = F.array().cast("array<string>")
    names = F.concat(*[F.coalesce(F.col(c), empty) for c in ("conditions", "procedures", "drugs")])
    items = F.sort_array(F.array_distinct(F.filter(F.transform(names, X.normalised), lambda x: x != "")))
    # Names are never fewer than their distinct forms, so most visits are left out before any name is written in its normal form.
    rows = table(spark, folder, "visits").where(F.size(names) > 10).select("hadm_id", items.alias("items")).where(F.size("items") > 10)
    distinct = rows.groupBy("items").agg(F.min("hadm_id").alias("hadm_id"))
    # A visit may have several rows with unequal lists, so a visit's sets follow each other by their items: the order must be unique.
    place = F.row_number().over(Window.partitionBy("hadm_id").orderBy("items"))
    ordered = distinct.select("items", F.struct("hadm_id", place.alias("place")).alias("at"))
    return sets.drop_near_sets(ordered, "at", 5, 10).select(F.col("at.hadm_id").alias("ord"), F.size("items").alias("n"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers, nations and regions as a graph, with its order."""
    s = table(spark, folder, "supplier").select(F.col("s_name").alias("head"), F.lit("in").alias("relation"), F.concat(F.lit("NATION_"), "s_nationkey").alias("tail"))
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.concat(F.lit("NATION_"), "n_nationkey").alias("head"), F.lit("part of").alias("relation"), F.col("r_name").alias("tail"))
    return s.unionByName(n)


def merge_edges(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus")
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    e = l.join(p, "l_partkey").select(
        F.when(F.col("l_returnflag") == "R", F.upper("p_name")).otherwise(F.col("p_name")).alias("head"), F.lit("is a").alias("relation"), F.col("p_type").alias("tail"),
        F.col("l_linestatus").alias("flow"),
    )
    return graph.merge_edges(e, "flow").select(F.lower("head").alias("head"), "relation", "tail", F.array_join("sources", ",").alias("sources"), "n")


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "supplier").select(F.col("s_name").alias("source"), F.concat(F.lit("NATION_"), F.col("s_suppkey") % 25).alias("target"))
    return graph.shortest_paths(_edges(spark, folder), pairs, 3, 5)


def shortest_paths_3hop(spark: SparkSession, folder: str) -> DataFrame:
    return _paths(spark, folder).select("source", "target", F.array_join("nodes", ">").alias("nodes"))


def path_triples(spark: SparkSession, folder: str) -> DataFrame:
    return graph.triples_along(_paths(spark, folder), _edges(spark, folder)).groupBy("head", "relation", "tail").agg(F.count(F.lit(1)).alias("n"), F.min("hop").cast("bigint").alias("least_hop"))


def path_score_topk(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_discount", "l_tax")
    score = F.round(0.8 * F.col("l_discount") + 0.2 * F.col("l_tax"), 6)
    rows = l.groupBy("l_suppkey", "l_orderkey").agg(F.max(score).alias("score"))
    return graph.top_share(rows, ["l_suppkey"], "score", "l_orderkey", 0.3)


def canonical_names(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select(
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("The "), F.col("p_name"), F.lit("s"))).when(F.col("p_partkey") % 5 == 0, F.initcap("p_name")).otherwise(F.col("p_name")).alias("item")
    )
    return resolve.canonical_by_name(names.groupBy("item").agg(F.count(F.lit(1)).alias("count")), "item", "count")


def protect_names(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.keep_protected(canonical_names(spark, folder), ["Small Ring", "Red Widget"])


def sentence_units(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"), X.word_count(F.col("text")).alias("n_words_found"))


def chunk_passages(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(text.chunks(text.sentences(F.col("text")), 150)).alias("n", "chunk"))
    return d.select("doc_id", "n", X.word_count(F.col("chunk")).alias("words"))


def quantity_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return text.quantity_mentions(table(spark, folder, "documents"), "doc_id", "text")


def dedupe_texts(spark: SparkSession, folder: str) -> DataFrame:
    return text.equal_texts(table(spark, folder, "documents"), "doc_id", "text")


def term_links(spark: SparkSession, folder: str) -> DataFrame:
    return text.term_links(table(spark, folder, "documents"), "doc_id", "text", TERMS)


def linked_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of a dictionary table in the passages, the longest match winning."""
    # A table of constants, as one from Python rows would start a Python worker a core for ten of them.
    terms = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("concept"), F.lit(t).alias("term")) for c, t in TERMS])))
    return text.linked_terms(table(spark, folder, "documents"), "doc_id", "text", terms, 4)


def cosine_search(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    out = vectors.search(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return out.select("query", "row", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def mmr_select(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("label", "vec_id", "embedding", F.get("embedding", F.lit(0)).alias("relevance"))
    return vectors.diverse(e, "label", "vec_id", "embedding", "relevance")


def vectors_above(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a query vector and any other with a cosine of at least 0.2."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return vectors.pairs_above(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 0.2).select("query", "row", F.round("cosine", 6).alias("cosine"))


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """How much the first vector of each label is like the centroid of the label's even ones."""
    e = table(spark, folder, "embeddings").where("label is not null")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    out = vectors.centroid_likeness(e.where("vec_id % 2 = 0"), "label", "embedding", first, "q")
    return out.select("label", F.round("likeness", 6).alias("likeness"))


def paired_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Part names against their types, each through an encoder of its own."""
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    out = vectors.paired_scores(p, "p_name", "p_type", lambda: vectors.hash_embedder(32), lambda: vectors.hash_embedder(32))
    return out.select("p_partkey", F.round("score", 6).alias("score"))


def met_walks(spark: SparkSession, folder: str) -> DataFrame:
    """Walks of at most four edges between suppliers and nations, met half way."""
    pairs = table(spark, folder, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_name").alias("source"), F.concat(F.lit("NATION_"), F.col("s_suppkey") % 25).alias("target"))
    out = graph.meeting_paths(_edges(spark, folder), pairs, 4, 20)
    return out.select("source", "target", F.array_join("nodes", ">").alias("nodes"), F.array_join("relations", ">").alias("relations"))


def top_values(spark: SparkSession, folder: str) -> DataFrame:
    from chronica.operators import report

    return report.value_counts(table(spark, folder, "part"), F.col("p_name"), "name", 3, 10)


def table_units(spark: SparkSession, folder: str) -> DataFrame:
    """Made-up tables of parts as units behind their header, and what their header says of the basis."""
    t = F.concat("p_brand", F.lit("\nGive "), "p_name", F.lit(". Then stop.\n\nOnce, e.g. "), F.col("p_size").cast("string"), F.lit(" mg."))
    cell = F.concat(F.lit("Stage: 4 | "), F.when(F.col("p_size") % 2 == 0, "Daily dose: ").otherwise("Dose: "), F.col("p_size").cast("string"))
    p = table(spark, folder, "part")
    return p.select("p_partkey", F.posexplode(text.table_units(t)).alias("n", "unit"), F.coalesce(text.header_basis(cell), F.lit("dose")).alias("basis"))


def searched_ridge(spark: SparkSession, folder: str) -> DataFrame:
    """The penalty of a ridge regression chosen by its error on dev."""
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")
    fit = lambda rows, penalty: model.fit_ridge(rows, ["l_quantity", "l_discount"], ["l_returnflag"], "l_extendedprice", penalty)
    _, table_of = model.grid_search(l.where("l_orderkey % 5 > 1"), l.where("l_orderkey % 5 = 1"), fit, [0.1, 10.0, 1000.0], "l_extendedprice")
    return table_of.select("setting", F.round("mae", 1).alias("mae"), "is_best")


def folds_of_ridge(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of a ridge regression in three folds."""
    l = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 3).alias("fold"), "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")
    fit = lambda rows: model.fit_ridge(rows, ["l_quantity", "l_discount"], ["l_returnflag"], "l_extendedprice", 1.0)
    return model.cross_validated(l, "fold", 3, fit, "l_extendedprice").withColumn("mae", F.round("mae", 1))


def vector_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Complete-linkage clusters of the vectors of each label."""
    e = table(spark, folder, "embeddings")
    return resolve.cluster_within(e, "label", "vec_id", "embedding", 0.25, "complete")


def silhouette_search(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds of average linkage with the silhouette each reaches on a sample of 1,000 vectors."""
    return resolve.threshold_search(table(spark, folder, "embeddings"), "vec_id", "embedding", steps=8, sample=1_000)


def ridge_errors(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
    fitted = model.fit_ridge(l.where("l_orderkey % 5 <> 0"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"], "l_extendedprice", 1.0)
    test = fitted.transform(l.where("l_orderkey % 5 = 0"))
    return test.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("l_extendedprice"))), 2).alias("mae"))


_SETS = """sets AS (SELECT l_orderkey, list_sort(list_distinct(list(p_brand))) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""
_SPLIT = """h AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('2026:' || o_orderkey), o_orderkey) - 1 AS r,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders{})"""
_CUT = "CASE WHEN r < round_even(n * {0}, 0) THEN 'train' WHEN r < round_even(n * {0}, 0) + round_even(n * {1}, 0) THEN 'dev' ELSE 'test' END"
_NAMES = """raw AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'The ' || p_name || 's' WHEN p_partkey % 5 = 0
    THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE p_name END AS item FROM part),
  c AS (SELECT item, count(*) AS n, regexp_replace(trim(regexp_replace(lower(item), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) ', '') AS k FROM raw GROUP BY item),
  t AS (SELECT *, CASE WHEN k LIKE '%s' AND k NOT LIKE '%ss' AND length(k) > 3 AND substr(k, 1, length(k) - 1) IN (SELECT k FROM c) THEN substr(k, 1, length(k) - 1) ELSE k END AS g FROM c),
  m AS (SELECT item, g, first_value(item) OVER (PARTITION BY g ORDER BY n DESC, item) AS canonical FROM t)"""
_GRAPH = """e AS (SELECT s_name AS a, 'NATION_' || s_nationkey AS b, 'in' AS rel FROM supplier UNION ALL
  SELECT 'NATION_' || n_nationkey, r_name, 'part of' FROM nation JOIN region ON n_regionkey = r_regionkey),
 s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), p AS (SELECT s_name AS src, 'NATION_' || (s_suppkey % 25) AS dst FROM supplier),
 one AS (SELECT src, dst, [src, b] AS nodes, b AS last FROM p JOIN s ON s.a = src),
 two AS (SELECT src, dst, list_append(nodes, b) AS nodes, b AS last FROM one JOIN s ON s.a = last WHERE NOT list_contains(nodes, b)),
 three AS (SELECT src, dst, list_append(nodes, b) AS nodes, b AS last FROM two JOIN s ON s.a = last WHERE NOT list_contains(nodes, b)),
 hit AS (SELECT * FROM one WHERE last = dst UNION ALL SELECT * FROM two WHERE last = dst UNION ALL SELECT * FROM three WHERE last = dst),
 best AS (SELECT *, min(len(nodes)) OVER (PARTITION BY src, dst) AS least FROM hit),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY array_to_string(nodes, chr(31))) AS rn FROM best WHERE len(nodes) = least)"""

_SENT = "text"
for _a in text.ABBREVIATIONS:
    _SENT = f"replace({_SENT}, '{_a}', '{_a.replace('.', chr(1))}')"
_PARTS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({_SENT}, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2) || '|\\n+'), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '')"
_Q = text.QUANTITY.replace("'", "''")
_FLAT = "regexp_replace(text, '([0-9]),([0-9]{3})\\b', '\\1\\2', 'g')"
_BOUND = "CASE lower(c) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.BOUNDS.items()) + " ELSE '=' END"
_TERMS = ", ".join(f"('{t}', '{c}')" for c, t in TERMS)
_ANY = "|".join(sorted((t for _, t in TERMS), key=lambda t: (-len(t), t)))

SQL = {
    "sentence_units": f"SELECT doc_id, len({_PARTS})::INT AS n_sentences, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))::INT END AS n_words_found FROM documents WHERE text IS NOT NULL",
    "quantity_mentions": f"""WITH d AS (SELECT doc_id, {', '.join(f"regexp_extract_all({_FLAT}, '{_Q}', {k}) AS a{k}" for k in range(1, 6))} FROM documents WHERE text IS NOT NULL),
      u AS (SELECT doc_id, unnest(range(len(a2)))::INT AS n, unnest(a1) AS c, unnest(a2) AS l, unnest(a3) AS h, lower(unnest(a4)) AS u, lower(unnest(a5)) AS b FROM d),
      x AS (SELECT *, CASE u WHEN 'g' THEN 1000.0 WHEN 'mg' THEN 1.0 ELSE 0.001 END::DOUBLE AS f, replace(regexp_replace(regexp_replace(coalesce(b, ''), '\\s+|per|\\ba\\b', '', 'g'), '^/', ''), 'hour', 'h') AS basis FROM u)
      SELECT doc_id, n, {_BOUND} AS comparator, CASE WHEN basis = '' THEN 'dose' ELSE basis END AS basis, l::DOUBLE * f AS low_mg, coalesce(TRY_CAST(nullif(h, '') AS DOUBLE), l::DOUBLE) * f AS high_mg FROM x""",
    "term_links": f"""WITH t(term, concept) AS (VALUES {_TERMS}), h AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '(?i)\\b({_ANY})\\b', 1))) AS term FROM documents)
      SELECT doc_id, concept, count(*) AS n FROM h JOIN t USING (term) GROUP BY ALL""",
    "linked_terms": f"""WITH t(term, concept) AS (VALUES {_TERMS}), d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
      s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d), r AS (SELECT doc_id, s, s + n AS e, array_to_string(w[s:s + n - 1], ' ') AS run FROM s, range(1, 5) k(n) WHERE s + n - 1 <= len(w)),
      h AS (SELECT doc_id, s, e, concept, term FROM r JOIN t ON r.run = t.term)
      SELECT doc_id, concept, term, count(*) AS n FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.doc_id = h.doc_id AND g.s <= h.s AND g.e >= h.e AND g.e - g.s > h.e - h.s AND g.concept <> h.concept) GROUP BY ALL""",
    "ladder_filter": "SELECT l_quantity, count(*) AS n FROM lineitem WHERE l_quantity IN (1, 5, 10, 20, 25, 40, 50) AND l_quantity % 5 = 0 GROUP BY 1",
    "plausible_rows": """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE coalesce(l_quantity BETWEEN 5 AND 45, true)
      AND coalesce(l_discount BETWEEN 0.01 AND 0.09, true) AND coalesce(l_extendedprice BETWEEN 1000 AND 80000, true) GROUP BY 1""",
    "right_closed_bins": """SELECT CASE WHEN o_totalprice > 0 AND o_totalprice <= 1e5 THEN 'low' WHEN o_totalprice > 1e5 AND o_totalprice <= 2e5 THEN 'mid'
      WHEN o_totalprice > 2e5 AND o_totalprice <= 4e5 THEN 'high' ELSE 'out' END AS bin, count(*) AS n FROM orders GROUP BY 1""",
    "case_tiers": """SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'first' WHEN o_orderpriority LIKE '2%' AND o_totalprice > 200000 THEN 'second'
      WHEN o_orderpriority IS NULL THEN 'none' ELSE 'rest' END AS tier, count(*) AS n FROM orders GROUP BY 1""",
    "filtration_rates": """WITH x AS (SELECT DISTINCT dose_id, state.creatinine_mg_dl AS c, state.age AS a, state.sex = 'F' AS f FROM dose_records)
      SELECT dose_id, round(142 * pow(least(c / CASE WHEN f THEN 0.7 ELSE 0.9 END, 1), CASE WHEN f THEN -0.241 ELSE -0.302 END) * pow(greatest(c / CASE WHEN f THEN 0.7 ELSE 0.9 END, 1), -1.2)
        * pow(0.9938, a) * CASE WHEN f THEN 1.012 ELSE 1 END, 4) AS rate FROM x WHERE c > 0 AND a IS NOT NULL""",
    "enrich_left": """SELECT r_name, year(o_orderdate) - 1990 AS years, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey
      LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "prefix_backoff": """WITH t(p, category) AS (VALUES ('BRAND#', 'other'), ('BRAND#1', 'tens'), ('BRAND#2', 'twenties'), ('BRAND#25', 'last'))
      SELECT p_partkey, arg_max(category, length(p)) AS category, max(length(p)) AS prefix_length FROM part LEFT JOIN t ON starts_with(upper(replace(replace(p_brand, '.', ''), ' ', '')), p) GROUP BY p_partkey""",
    "first_match_class": """SELECT CASE WHEN regexp_matches(p_name, '(?i)small') THEN 'none' WHEN regexp_matches(p_name, '(?i)ring|band') THEN 'ring' WHEN regexp_matches(p_name, '(?i)widget') THEN 'widget'
      WHEN regexp_matches(p_name, '(?i)^(red|blue|green)') THEN 'coloured' WHEN regexp_matches(p_name, '(?i)bolt|nut') THEN 'fastener' ELSE 'none' END AS class, count(*) AS n FROM part GROUP BY 1""",
    "versioned_prefix_flag": """SELECT p_type, count(*) FILTER (f) AS n, bool_or(f) AS any FROM (SELECT p_type, (p_type = 'ECONOMY' AND p_brand LIKE 'Brand#1%')
      OR (p_type = 'PROMO' AND (p_brand LIKE 'Brand#2%' OR p_brand LIKE 'Brand#3%')) AS f FROM part) GROUP BY 1""",
    "stratified_split": f"WITH {_SPLIT.format('')} SELECT o_orderkey, o_orderpriority, {_CUT.format(0.7, 0.15)} AS split FROM h",
    "temporal_split": f"""WITH {_SPLIT.format(" WHERE o_orderdate < TIMESTAMP '2000-01-01'")} SELECT o_orderkey, CASE WHEN r < round_even(n * 0.8, 0) THEN 'train' ELSE 'dev' END AS split FROM h
      UNION ALL SELECT o_orderkey, 'test' FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'""",
    "quota_sample": """SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7:' || o_orderkey), o_orderkey)
      <= CASE o_orderpriority WHEN '1-URGENT' THEN 75 WHEN '2-HIGH' THEN 25 ELSE 0 END""",
    "split_leakage": f"""WITH {_SPLIT.format('')}, s AS (SELECT o_custkey, {_CUT.format(0.7, 0.15)} AS split FROM h JOIN orders USING (o_orderkey))
      SELECT o_custkey, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""",
    "cooccurrence_topk": f"""WITH {_SETS}, i AS (SELECT l_orderkey, unnest(items) AS item FROM sets), p AS (SELECT a.item, b.item AS other, count(*) AS n FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.item <> b.item GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, other) AS rank FROM p QUALIFY rank <= 5""",
    "distinct_sets": """WITH s AS (SELECT user_id, ts::DATE AS day, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS items FROM events GROUP BY 1, 2) SELECT items, count(*) AS n FROM s GROUP BY 1""",
    "jaccard_knn": """WITH s AS (SELECT user_id * 100 + day(ts) AS id, list_sort(list_distinct(list(event_type))) AS items FROM events GROUP BY 1),
      x AS (SELECT a.id, b.id AS neighbour, len(list_intersect(a.items, b.items))::DOUBLE / len(list_distinct(list_concat(a.items, b.items))) AS s FROM s a JOIN s b ON a.id <> b.id WHERE len(list_intersect(a.items, b.items)) > 0)
      SELECT id, neighbour, round(s, 6) AS similarity, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) AS rank FROM x QUALIFY rank <= 3""",
    "merge_edges": """WITH e AS (SELECT lower(p_name) AS h, p_type AS t, l_linestatus AS f FROM lineitem JOIN part ON l_partkey = p_partkey)
      SELECT h AS head, 'is a' AS relation, t AS tail, array_to_string(list_sort(list_distinct(list(f))), ',') AS sources, count(*) AS n FROM e GROUP BY h, t""",
    "shortest_paths_3hop": f"WITH {_GRAPH} SELECT src AS source, dst AS target, array_to_string(nodes, '>') AS nodes FROM ranked WHERE rn <= 5",
    "path_triples": f"""WITH {_GRAPH}, u AS (SELECT nodes, unnest(range(len(nodes) - 1)) AS hop FROM ranked WHERE rn <= 5)
      SELECT e.a AS head, e.rel AS relation, e.b AS tail, count(*) AS n, min(hop) AS least_hop FROM u JOIN e ON least(e.a, e.b) = least(nodes[hop + 1], nodes[hop + 2]) AND greatest(e.a, e.b) = greatest(nodes[hop + 1], nodes[hop + 2]) GROUP BY ALL""",
    "path_score_topk": """WITH s AS (SELECT l_suppkey, l_orderkey, max(round(0.8::DOUBLE * l_discount + 0.2::DOUBLE * l_tax, 6)) AS score FROM lineitem GROUP BY ALL)
      SELECT l_suppkey, l_orderkey, score FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_orderkey) <= greatest(1, round_even(count(*) OVER (PARTITION BY l_suppkey) * 0.3, 0))""",
    "canonical_names": f"WITH {_NAMES} SELECT item, canonical FROM m",
    "protect_names": f"""WITH {_NAMES}, p AS (SELECT canonical, count(*) AS k, min(item) AS first FROM m WHERE item IN ('Small Ring', 'Red Widget') GROUP BY 1)
      SELECT item, CASE WHEN item IN ('Small Ring', 'Red Widget') THEN item WHEN k = 1 THEN first ELSE m.canonical END AS canonical FROM m LEFT JOIN p USING (canonical)""",
    "dedupe_texts": "SELECT substr(sha256(text), 1, 24) AS text_key, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "vectors_above": """SELECT a.vec_id AS query, b.vec_id AS row, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
      WHERE a.vec_id % 20 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2""",
    "centroids": """WITH x AS (SELECT label, unnest(range(len(embedding))) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL AND vec_id % 2 = 0),
      m AS (SELECT label, n, avg(x) AS x FROM x GROUP BY ALL), c AS (SELECT label, list(x ORDER BY n) AS c FROM m GROUP BY label), q AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings WHERE label IS NOT NULL GROUP BY label)
      SELECT q.label, round(coalesce(greatest(0.0, least(1.0, list_cosine_similarity(c, q::DOUBLE[]))), 0.0)::DOUBLE, 6) AS likeness FROM q LEFT JOIN c USING (label)""",
    "met_walks": """WITH e AS (SELECT s_name AS a, 'NATION_' || s_nationkey AS b, 'in' AS rel FROM supplier UNION ALL SELECT 'NATION_' || n_nationkey, r_name, 'part of' FROM nation JOIN region ON n_regionkey = r_regionkey),
      s AS (SELECT a, b, rel AS r FROM e UNION ALL SELECT b, a, '-' || rel FROM e), p AS (SELECT DISTINCT s_name AS src, 'NATION_' || (s_suppkey % 25) AS dst FROM supplier WHERE s_suppkey % 10 = 0),
      w1 AS (SELECT src, dst, [src, b] AS n, [r] AS r FROM p JOIN s ON a = src),
      w2 AS (SELECT src, dst, list_append(n, b) AS n, list_append(w1.r, s.r) AS r FROM w1 JOIN s ON a = n[2] WHERE n[2] <> dst AND NOT list_contains(n, b)),
      w3 AS (SELECT src, dst, list_append(n, b) AS n, list_append(w2.r, s.r) AS r FROM w2 JOIN s ON a = n[3] WHERE n[3] <> dst AND NOT list_contains(n, b)),
      w4 AS (SELECT src, dst, list_append(n, b) AS n, list_append(w3.r, s.r) AS r FROM w3 JOIN s ON a = n[4] WHERE n[4] <> dst AND NOT list_contains(n, b)),
      f AS (SELECT DISTINCT * FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4) WHERE n[len(n)] = dst)
      SELECT src AS source, dst AS target, array_to_string(n, '>') AS nodes, array_to_string(r, '>') AS relations FROM f
      QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY len(n), array_to_string(n, chr(31)), array_to_string(r, chr(31))) <= 20""",
    "top_values": "SELECT coalesce(p_name, 'null') AS name, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 3) AS percent FROM part GROUP BY 1 ORDER BY n DESC, name LIMIT 10",
    "table_units": """WITH u AS (SELECT p_partkey, p_size, unnest([0, 1, 2]) AS n, unnest([p_brand || ' || Give ' || p_name || '.', p_brand || ' || Then stop.', p_brand || ' || Once, e.g. ' || p_size || ' mg.']) AS unit FROM part)
      SELECT p_partkey, n::INT AS n, unit, CASE WHEN p_size % 2 = 0 THEN 'day' ELSE 'dose' END AS basis FROM u""",
    "cosine_search": """WITH x AS (SELECT a.vec_id AS query, b.vec_id AS row, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
      SELECT query, row, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY round(c, 12) DESC, row) AS rank FROM x QUALIFY rank <= 5""",
}

QUERIES: list[Query] = [
    ladder_filter, plausible_rows, right_closed_bins, case_tiers, filtration_rates, enrich_left, prefix_backoff, first_match_class, versioned_prefix_flag,
    stratified_split, temporal_split, quota_sample, split_leakage, cooccurrence_topk, distinct_sets, jaccard_knn, near_dup_sets, merge_edges,
    shortest_paths_3hop, path_triples, path_score_topk, canonical_names, protect_names, sentence_units, chunk_passages, quantity_mentions, dedupe_texts,
    term_links, linked_terms, cosine_search, mmr_select, vectors_above, centroids, paired_texts, met_walks, top_values, table_units, searched_ridge, folds_of_ridge, vector_clusters, silhouette_search, ridge_errors,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
