"""Registered queries of retrieval, graph, term and report operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronica.functions import scalars as X
from chronica.operators import codes, graph, report, resolve, retrieval, sampling, terms, text
from chronica.plans.graph_queries import _GRAPH, _edges
from chronica.session import table
from chronica.sources import external, vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    k, target = F.col("s_suppkey"), F.concat(F.lit("NATION_"), F.col("s_suppkey") % 25)
    return table(spark, folder, "supplier").select(
        (k % 10).alias("episode"), F.col("s_name").alias("source"), target.alias("target"), (k % 3).alias("from_visit"), (k % 2).alias("to_visit"),
        F.concat(F.lit("Supplier in "), target, F.lit(" part of EUROPE")).alias("query"),
    )


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    edges = _edges(spark, folder).withColumn("flow", F.when(F.col("relation") == "in", "supply").otherwise("geo"))
    return retrieval.retrieve(edges, _pairs(spark, folder), "query", "flow", 0.5)


def retrieved_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The best paths of each episode, as risk and as protective evidence."""
    return _kept(spark, folder).select("episode", "aspect", F.array_join("nodes", ">").alias("nodes"), F.array_join("sources", ",").alias("sources"), "score")


def retrieval_report(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.retrieval_report(_kept(spark, folder))


def path_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.overlap_of_paths(_kept(spark, folder))


def endpoint_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.endpoint_pairs(_kept(spark, folder))


def probe_report(spark: SparkSession, folder: str) -> DataFrame:
    """What adding regions as nodes does to the paths from suppliers to nations."""
    edges = _edges(spark, folder)
    wide = edges.withColumn("tail", F.when(F.col("relation") == "part of", F.concat(F.lit("cluster:"), "tail")).otherwise(F.col("tail")))
    pairs = _pairs(spark, folder).select("source", "target")
    base = graph.shortest_paths(edges.where("relation = 'in'"), pairs, 3, 5)
    return retrieval.probe_report(base, graph.shortest_paths(wide, pairs, 3, 5), pairs, "cluster:")


def rank_probe(spark: SparkSession, folder: str) -> DataFrame:
    """What adding regions as nodes does to the paths that are kept."""
    edges = _edges(spark, folder).withColumn("flow", F.col("relation"))
    wide = edges.withColumn("tail", F.when(F.col("relation") == "part of", F.concat(F.lit("cluster:"), "tail")).otherwise(F.col("tail")))
    base = retrieval.retrieve(edges.where("relation = 'in'"), _pairs(spark, folder), "query", "flow", 0.5)
    return retrieval.rank_report(base, retrieval.retrieve(wide, _pairs(spark, folder), "query", "flow", 0.5), "cluster:")


def supported_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Kept paths of each episode picked until they hold the words of its first pair, with how the picking ended."""
    from chronica.operators import vectors

    sentence = retrieval.path_sentence(F.col("triples"), F.col("nodes"))
    rows = _kept(spark, folder).where("aspect = 'risk'").select("episode", F.array_join("nodes", ">").alias("path"), sentence.alias("sentence"))
    vec = vectors.embedded(rows, "sentence", vectors.hash_embedder(32))
    asked = _pairs(spark, folder).groupBy("episode").agg(F.min("query").alias("hypothesis"))
    pool = rows.join(vec, F.col("sentence") == F.col("text")).join(asked, "episode").withColumn("q", F.col("vec"))
    out = retrieval.supported_paths(pool, "episode", "path", "sentence", "vec", "q", "hypothesis", lambda: retrieval.word_overlap, enough=0.8)
    return retrieval.selection_report(out)


def loop_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with a passage that names a loop diuretic."""
    return retrieval.mentions_any(table(spark, folder, "documents"), "source_id", "text", "furosemid|bumetanid|torsemid|torasemid")


def open_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Part types of which a supplier has delivered every large brand."""
    p = table(spark, folder, "part")
    has = table(spark, folder, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("episode"), F.col("p_brand").alias("concept"))
    needs = p.where("p_size >= 49").select(F.col("p_type").alias("cluster"), F.col("p_brand").alias("concept"))
    return retrieval.open_nodes(needs, has)


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("source_id is not null")
    return d.select(F.col("doc_id").alias("mention_id"), F.col("source_id").alias("cluster"), "source", F.get("section_path", F.lit(0)).alias("concept"), F.col("lang").alias("term"), F.when(F.col("kind") == "table", "accepted").otherwise("open").alias("status"))


def property_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and edges of topics and sources, as one table."""
    m = _mentions(spark, folder)
    concepts, clusters, edges = retrieval.property_graph(m.select("mention_id", "cluster", "source"), m.where("concept is not null").select("mention_id", "concept", "term", "status"))
    none = F.lit(None).cast("string")
    return (
        concepts.select(F.lit("concept").alias("part"), F.col("id").alias("a"), F.col("name").alias("b"), none.alias("c"))
        .unionByName(clusters.select(F.lit("cluster").alias("part"), F.col("id").alias("a"), F.array_join("sources", ",").alias("b"), F.col("n").cast("string").alias("c")))
        .unionByName(edges.select(F.lit("edge").alias("part"), F.col("from").alias("a"), F.col("to").alias("b"), F.col("term").alias("c")))
    )


def graph_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.graph_vocabulary(_edges(spark, folder))


def described_types(spark: SparkSession, folder: str) -> DataFrame:
    """Part types with their three most ordered names."""
    l = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("hits"))
    rows = table(spark, folder, "part").join(l, "p_partkey", "left").select(F.col("p_type").alias("concept"), F.col("p_name").alias("term"), "hits")
    return retrieval.described(rows, "concept", "term", 3, "hits")


def cluster_shape(spark: SparkSession, folder: str) -> DataFrame:
    return report.cluster_shape(_mentions(spark, folder), "cluster", "source")


def weighted_precision(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem")
    out = report.weighted_precision(l.where("l_orderkey % 7 = 0"), l, ["l_returnflag", "l_linestatus"], F.col("l_quantity") > 10)
    return out.select("labelled", F.round("precision", 9).alias("precision"))


def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    u = F.to_json(F.struct((F.col("o_orderkey") % 1000).alias("prompt_tokens"), (F.col("o_custkey") % 100).alias("completion_tokens")))
    return report.usage_totals(table(spark, folder, "orders").select(u.alias("usage")), "usage", 0.25, 1.25).withColumn("cost", F.round("cost", 6))


def corpus_shape(spark: SparkSession, folder: str) -> DataFrame:
    out = report.corpus_shape(table(spark, folder, "documents").where("source is not null"), "source", "n_words", "kind", ["paragraph", "list", "table"])
    return out


def cell_sample(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    rows = o.where("o_orderpriority <> '1-URGENT' or o_orderkey % 100 = 0")
    return sampling.cell_balanced(rows, "o_orderkey", "o_orderpriority", 500, 11)


def bare_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Part names with qualifiers put at their end, and without them again."""
    tail = F.when(F.col("p_partkey") % 3 == 0, " (finding) [D], NOS").when(F.col("p_partkey") % 3 == 1, ", unspecified").otherwise("")
    t = terms.bare_term(F.concat("p_name", tail))
    return table(spark, folder, "part").select("p_partkey", t.alias("term"), terms.is_usable(F.split("p_name", " ")[0]).alias("usable"))


def plain_terms(spark: SparkSession, folder: str) -> DataFrame:
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("re:\\b("), "p_name", F.lit(")s?\\b"))).otherwise(F.col("p_name"))
    return table(spark, folder, "part").select("p_partkey", terms.plain_term(t).alias("term"))


def glyphs(spark: SparkSession, folder: str) -> DataFrame:
    """Passages with two characters replaced in one source, as their hash."""
    d = table(spark, folder, "documents").where("text is not null")
    fixed = terms.with_glyphs(F.col("text"), F.col("source"), {"guideline": {"é": "e", "–": "-"}})
    return d.select("doc_id", F.md5(fixed).alias("hash"))


def left_out_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Topics and made-up headings, and whether their sections hold content."""
    d = table(spark, folder, "documents").select(F.explode("section_path").alias("h")).where("h is not null").distinct()
    both = d.unionByName(d.select(F.concat(F.lit("3.1 References to "), "h").alias("h"))).unionByName(d.select(F.concat(F.lit("Funding: "), "h").alias("h")))
    return both.select("h", terms.is_left_out(F.col("h")).alias("left_out"), terms.is_footnote(F.concat(F.lit("AB = "), "h", F.lit("; CD = x"))).alias("footnote"))


def condition_facts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each condition is named in the passages."""
    d = table(spark, folder, "documents").where("text is not null")
    facts = terms.condition_facts(F.col("text"), F.array_join("section_path", " > "))
    return d.select(F.explode(facts).alias("f")).groupBy("f.name", "f.sign", "f.value").agg(F.count(F.lit(1)).alias("n"))


def search_queries(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("t"), F.sort_array(F.collect_set(F.when(F.col("p_size") > 45, F.col("p_name")))).alias("c"))
    return by.select("p_brand", terms.search_query(F.slice("t", 1, 3), F.slice("c", 1, 2), "diuretics[mh]").alias("query"))


def search_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units from brands and the brands ordered with them."""
    from chronica.operators import sets
    from chronica.plans.graph_queries import _order_sets

    mates = sets.companions(_order_sets(spark, folder), 5).select(F.col("item").alias("name"), "other", "rank")
    names = table(spark, folder, "part").where("p_brand < 'Brand#3'").select(F.col("p_brand").alias("name")).distinct().withColumn("terms", F.array("name"))
    themes = table(spark, folder, "part").groupBy(F.col("p_type").alias("theme")).agg(F.sort_array(F.collect_set("p_brand")).alias("terms"))
    out = terms.search_units(names, mates, themes, 5, 2, 3)
    return out.select("key", "kind", *[F.array_join(c, "|").alias(c) for c in ("concepts", "terms", "others")])


def junk_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rules = [("number", r"^[0-9. ]+$"), ("short", r"^.{0,3}$"), ("sized", r"(?i)small|large")]
    name = F.when(F.col("p_partkey") % 11 == 0, "").when(F.col("p_partkey") % 11 == 1, "12.5").when(F.col("p_partkey") % 11 == 2, "abc").otherwise(F.col("p_name"))
    return table(spark, folder, "part").groupBy(F.coalesce(graph.junk_reason(name, rules), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def simple_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and suppliers of a nation joined by orders, one edge per pair, the earliest."""
    l = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = l.select((F.col("o_custkey") % 40).cast("string").alias("head"), F.col("l_returnflag").alias("relation"), (F.col("l_suppkey") % 40).cast("string").alias("tail"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return graph.simple_graph(e, "ord", ["R"])


def gated_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Parts allowed by two key sets, under each way of combining them."""
    p = table(spark, folder, "part")
    a, b, none = p.where("p_size < 20").select("p_partkey"), p.where("p_type = 'PROMO'").select("p_partkey"), p.where("false").select("p_partkey")
    modes = [("both", b), ("either", b), ("left", b), ("left_if_right_empty", none)]
    parts = [graph.gate(a, right, "p_partkey", mode).agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("total")).select(F.lit(mode).alias("mode"), "n", "total") for mode, right in modes]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def item_pairs(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "part").groupBy("p_size").agg(F.collect_set("p_type").alias("items"))
    return graph.item_pairs(s, "items", [["x", "z", "y"]])


def code_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose code a table doesn't know, by version."""
    p = table(spark, folder, "part").select("p_type", X.code(F.col("p_brand")).alias("code"))
    lookup = spark.createDataFrame([("BRAND#1", "tens"), ("BRAND#25", "last")], "prefix string, category string")
    return codes.misses(codes.longest_prefix(p, "code", lookup, "prefix", "category"), "code", "category", ["p_type"])


def first_code_wins(spark: SparkSession, folder: str) -> DataFrame:
    """A lookup from brands to the first part's name, cut at its first blank."""
    p = table(spark, folder, "part").select("p_brand", F.replace("p_name", F.lit(" "), F.lit(", ")).alias("name"), "p_partkey")
    return codes.first_wins(p, "p_brand", "name", "p_partkey")


def one_to_one_join(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the sum of their lines; either side has an order once."""
    from chronica.operators import model

    l = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return model.one_to_one(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), l, "o_orderkey")


def names_by_code(spark: SparkSession, folder: str) -> DataFrame:
    """Part names of one type and brand go to the most frequent; names known by both ways are composed."""
    p = table(spark, folder, "part")
    items = p.groupBy(F.col("p_name").alias("item")).agg(F.count(F.lit(1)).alias("count"))
    table_of = p.select(F.upper("p_name").alias("name"), F.col("p_type").alias("code"))
    by_code = resolve.canonical_by_code(items, "item", "count", table_of, "name", "code")
    return resolve.compose(by_code, resolve.keep_protected(by_code, ["Small Ring", "small ring"]))


def grounded_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Made-up triples over passages: why each is kept or not."""
    d = table(spark, folder, "documents").where("text is not null and doc_id % 2 = 0")
    head = F.when(F.col("doc_id") % 6 == 0, "furosemide").when(F.col("doc_id") % 6 == 2, "urine").otherwise("")
    t = d.select("doc_id", "text", head.alias("head"), F.lit("lowers").alias("relation"), F.when(F.col("doc_id") % 10 == 0, "potassium").otherwise("dose").alias("tail"))
    return external.grounded(t, "text", ["furosemide", "oedema"]).groupBy("reason", F.coalesce("anchor", F.lit("none")).alias("anchor")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary_names(spark: SparkSession, folder: str) -> DataFrame:
    """One name per brand: the first of a promoted part, else the first of all, of two sizes of part."""
    p = table(spark, folder, "part").withColumn("half", F.when(F.col("p_size") <= 25, "ENG").otherwise("FRE"))
    return vocabulary.preferred_names(p, "p_brand", "p_name", "p_partkey", F.col("p_type") == "PROMO", "half", ["ENG"])


def vocabulary_types(spark: SparkSession, folder: str) -> DataFrame:
    out = vocabulary.codes_of_types(table(spark, folder, "part"), "p_brand", "p_type", ["PROMO", "ECONOMY"])
    return out.select("p_brand", F.array_join("types", ",").alias("types"))


def vocabulary_tree(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.codes_in_tree(table(spark, folder, "part"), "p_brand", "p_type", "p_name", "PROMO", ["Small", "small", "red", "Red"])


def vocabulary_index(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted names in another writing, with the code of the first part of that name."""
    p = table(spark, folder, "part")
    wanted = p.where("p_size > 10").select(F.concat(F.upper("p_name"), F.lit("!")).alias("wanted"))
    return vocabulary.code_index(p, "p_brand", "p_name", "p_partkey", wanted, "wanted")


def vocabulary_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Relations between parts of an order, by the reason for which they stay or go."""
    l = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")
    rows = l.select(
        F.col("l_partkey").alias("c1"), F.col("l_suppkey").cast("bigint").alias("c2"), F.col("l_returnflag").alias("rel"), F.when(F.col("l_linenumber") == 1, "first").otherwise("").alias("rela"),
        F.col("l_linestatus").alias("sab"), F.when(F.col("l_linenumber") == 7, "Y").otherwise("N").alias("sup"),
    )
    keep = table(spark, folder, "part").where("p_size <= 40").select(F.col("p_partkey").alias("c"))
    _, reasons = vocabulary.reduced_relations(rows, "c1", "c2", "rel", "rela", "sab", "sup", keep, "c", ["O"], ["R"], {"A": "accepted"})
    return reasons


def child_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the nations of each region."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    names = n.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    rel = n.select(F.col("n_nationkey").alias("head"), F.lit("isa").alias("relation"), F.col("n_regionkey").alias("tail"))
    return vocabulary.child_terms(names, rel, r.select("r_regionkey"), "r_regionkey")


def passage_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as blocks: the first line of an order is a heading, the fourth one below it."""
    level = F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_linenumber") == 4, 2).otherwise(0)
    b = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").cast("string").alias("text")).withColumn("level", level)
    out = text.under_headings(b, "l_orderkey", "l_linenumber", "level", "text", 2)
    return out.select("l_orderkey", "l_linenumber", F.array_join("section_path", ">").alias("path"))


def masked_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Passages with their doses masked, and cleaned, as hashes."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.md5(text.masked_doses(F.col("text"))).alias("masked"), F.md5(text.clean(F.col("text"))).alias("cleaned"))


def term_context(spark: SparkSession, folder: str) -> DataFrame:
    """The first mention of potassium with five words on either side."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", text.context(F.col("text"), "potassium", 5).alias("context")).where("context is not null")


_KEPT = f"""WITH {_GRAPH}, h AS (SELECT src, dst, nodes, unnest(range(len(nodes) - 1)) AS hop FROM ranked WHERE rn <= 5),
  t AS (SELECT h.src, h.dst, h.nodes, string_agg(e.rel, ' ') AS rels, list_sort(list_distinct(list(CASE WHEN e.rel = 'in' THEN 'supply' ELSE 'geo' END))) AS sources
    FROM h JOIN e ON least(e.a, e.b) = least(nodes[hop + 1], nodes[hop + 2]) AND greatest(e.a, e.b) = greatest(nodes[hop + 1], nodes[hop + 2]) GROUP BY ALL),
  w AS (SELECT *, list_distinct(regexp_extract_all(lower(array_to_string(nodes, ' ') || ' ' || rels), '[a-z0-9]+')) AS words FROM t),
  q AS (SELECT s_suppkey % 10 AS episode, s_name AS src, 'NATION_' || (s_suppkey % 25) AS dst, s_suppkey % 3 AS from_visit, s_suppkey % 2 AS to_visit,
    list_distinct(regexp_extract_all(lower('Supplier in NATION_' || (s_suppkey % 25) || ' part of EUROPE'), '[a-z0-9]+')) AS wanted FROM supplier),
  m AS (SELECT episode, src, dst, nodes, sources, from_visit, to_visit, len(list_intersect(wanted, words))::DOUBLE / len(list_distinct(list_concat(wanted, words))) AS s FROM q JOIN w USING (src, dst)),
  u AS (SELECT *, 'risk' AS aspect, round(0.7::DOUBLE * s + (1 - 0.7::DOUBLE) * 0.5::DOUBLE, 9) AS score FROM m UNION ALL SELECT *, 'protective', round(0.7::DOUBLE * s + (1 - 0.7::DOUBLE) * (1 - 0.5::DOUBLE), 9) FROM m),
  kept AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY episode, aspect ORDER BY score DESC, array_to_string(nodes, chr(31))) <= greatest(1, round_even(count(*) OVER (PARTITION BY episode, aspect) * 0.3::DOUBLE, 0)))
"""
_P = {"egfr": "(?i)\\b(?:e?GFR|CrCl|creatinine clearance)\\s*(<=|>=|<|>|≤|≥|of|below|above)?\\s*([0-9]+(?:\\.[0-9]+)?)", "ckd_stage": "(?i)\\b(?:CKD\\s*)?stage()\\s*([1-5])\\b", "nyha": "(?i)\\bNYHA\\s*(?:class\\s*)?()(IV|III|II|I)\\b", "age": "(?i)\\baged?\\s*(<=|>=|<|>|≤|≥|of|below|above)?\\s*([0-9]+(?:\\.[0-9]+)?)"}
_SCOPE = "d AS (SELECT doc_id, concat_ws(' || ', array_to_string(section_path, ' > '), text) AS t FROM documents WHERE text IS NOT NULL)"
_FACTS = " UNION ALL ".join(
    [f"SELECT doc_id, '{n}' AS name, lower(unnest(regexp_extract_all(t, '{p}', 1))) AS sign, upper(unnest(regexp_extract_all(t, '{p}', 2))) AS value FROM d" for n, p in _P.items()]
    + [f"SELECT doc_id, '{n}', '', '' FROM d WHERE regexp_matches(t, '(?i){p}')" for n, p in terms.FLAGS.items()]
)
_DIRECT = """WITH p AS (SELECT DISTINCT s_name, s_nationkey AS f, (s_suppkey % 25)::INT AS t FROM supplier),
  x AS (SELECT s_name, f = t AS direct, f <> t AND a.n_regionkey = b.n_regionkey AS via FROM p JOIN nation a ON a.n_nationkey = f JOIN nation b ON b.n_nationkey = t)"""
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_HEAD = "(SELECT doc_id, text, CASE WHEN doc_id % 6 = 0 THEN 'furosemide' WHEN doc_id % 6 = 2 THEN 'urine' ELSE '' END AS h, CASE WHEN doc_id % 10 = 0 THEN 'potassium' ELSE 'dose' END AS t FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0)"

SQL = {
    "retrieved_paths": _KEPT + "SELECT episode, aspect, array_to_string(nodes, '>') AS nodes, array_to_string(sources, ',') AS sources, score FROM kept",
    "retrieval_report": _KEPT + """SELECT what, value, count(*) AS n FROM (SELECT 'hops' AS what, CAST(len(nodes) - 1 AS VARCHAR) AS value FROM kept UNION ALL SELECT 'aspect', aspect FROM kept
      UNION ALL SELECT 'window', CASE WHEN from_visit = to_visit THEN 'single_visit' ELSE 'between_visits' END FROM kept UNION ALL SELECT 'source', unnest(sources) FROM kept) GROUP BY ALL""",
    "path_overlap": _KEPT + "SELECT count(*) FILTER (k > 1) AS in_both, count(*) AS distinct_paths FROM (SELECT episode, nodes, count(DISTINCT aspect) AS k FROM kept GROUP BY episode, nodes)",
    "endpoint_pairs": _KEPT + ", e2 AS (SELECT DISTINCT episode, unnest([nodes[1], nodes[len(nodes)]]) AS n FROM kept) SELECT x.episode, x.n AS a, y.n AS b FROM e2 x JOIN e2 y ON x.episode = y.episode AND x.n < y.n",
    "probe_report": _DIRECT + " " + " UNION ALL ".join(
        f"SELECT '{w}' AS what, {e}::BIGINT AS n FROM x" for w, e in (
            ("pairs", "count(*)"), ("connected_base", "count(*) FILTER (direct)"), ("connected_combined", "count(*) FILTER (direct OR via)"), ("paths_base", "count(*) FILTER (direct)"),
            ("paths_combined", "count(*) FILTER (direct OR via)"), ("paths_through", "count(*) FILTER (via)"), ("newly_connected", "count(*) FILTER (via)"), ("shorter", "0 * count(*)"), ("all_through", "0 * count(*)"),
        )
    ),
    "loop_clusters": "SELECT DISTINCT source_id FROM documents WHERE regexp_matches(text, '(?i)furosemid|bumetanid|torsemid|torasemid')",
    "open_clusters": """WITH n AS (SELECT DISTINCT p_type AS c, p_brand AS b FROM part WHERE p_size >= 49), h AS (SELECT DISTINCT l_suppkey AS e, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
      SELECT e AS episode, c AS cluster FROM h JOIN n USING (b) GROUP BY e, c HAVING count(*) = (SELECT count(*) FROM n m WHERE m.c = n.c)""",
    "property_graph": """WITH m AS (SELECT doc_id, source_id AS k, source, section_path[1] AS concept, lang, kind = 'table' AS ok FROM documents WHERE source_id IS NOT NULL)
      SELECT DISTINCT 'concept' AS part, 'concept:' || lower(trim(concept)) AS a, lower(trim(concept)) AS b, NULL::VARCHAR AS c FROM m WHERE ok AND concept IS NOT NULL
      UNION ALL SELECT 'cluster', 'cluster:' || k, array_to_string(list_sort(list_distinct(list(source))), ','), CAST(count(*) AS VARCHAR) FROM m GROUP BY k
      UNION ALL (SELECT DISTINCT 'edge', 'concept:' || lower(trim(concept)), 'cluster:' || k, lang FROM m WHERE ok AND concept IS NOT NULL)""",
    "graph_vocabulary": "SELECT s_name AS name FROM supplier UNION SELECT 'NATION_' || s_nationkey FROM supplier UNION SELECT 'NATION_' || n_nationkey FROM nation UNION SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT 'in' FROM supplier UNION SELECT 'part of' FROM nation",
    "described_types": """WITH l AS (SELECT l_partkey AS p_partkey, count(*) AS hits FROM lineitem GROUP BY 1),
      t AS (SELECT p_type AS c, lower(p_name) AS low, min(p_name) AS t, max(coalesce(hits, 0)) AS h FROM part LEFT JOIN l USING (p_partkey) WHERE lower(p_name) <> lower(p_type) GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY h DESC, length(t), low) AS rn FROM t)
      SELECT p_type AS concept, concat_ws('; ', p_type, (SELECT string_agg(t, '; ' ORDER BY rn) FROM r WHERE r.c = p_type AND rn <= 3)) AS text FROM (SELECT DISTINCT p_type FROM part)""",
    "cluster_shape": """SELECT count(*) AS clusters, count(*) FILTER (n > 1) AS multi_member, count(*) FILTER (k > 1) AS multi_source, max(n) AS largest, count(*) FILTER (n = 1) AS singletons
      FROM (SELECT count(*) AS n, count(DISTINCT source) AS k FROM documents WHERE source_id IS NOT NULL GROUP BY source_id)""",
    "weighted_precision": """WITH p AS (SELECT l_returnflag, l_linestatus, count(*) AS k, avg(CASE WHEN l_quantity > 10 THEN 1.0 ELSE 0.0 END) AS p FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY ALL), n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
      SELECT sum(k)::BIGINT AS labelled, round(sum(p * n) / sum(n), 9) AS precision FROM p JOIN n USING (l_returnflag, l_linestatus)""",
    "usage_totals": "SELECT count(*) AS replies, sum(o_orderkey % 1000)::BIGINT AS tokens_in, sum(o_custkey % 100)::BIGINT AS tokens_out, round((sum(o_orderkey % 1000)::DOUBLE * 0.25::DOUBLE + sum(o_custkey % 100)::DOUBLE * 1.25::DOUBLE) / 1e6, 6) AS cost FROM orders",
    "corpus_shape": """SELECT source, count(*) AS passages, count(*) FILTER (kind = 'paragraph') AS n_paragraph, count(*) FILTER (kind = 'list') AS n_list, count(*) FILTER (kind = 'table') AS n_table, count(n_words) AS with_words,
      quantile_cont(n_words::DOUBLE, 0.1) AS p10, quantile_cont(n_words::DOUBLE, 0.5) AS p50, quantile_cont(n_words::DOUBLE, 0.9) AS p90 FROM documents WHERE source IS NOT NULL GROUP BY source""",
    "cell_sample": """WITH r AS (SELECT o_orderkey, o_orderpriority, md5('11:' || o_orderkey) AS h FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderkey % 100 = 0),
      k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS rn, (SELECT 500 // count(DISTINCT o_orderpriority) FROM r) AS share FROM r),
      o AS (SELECT *, row_number() OVER (ORDER BY h, o_orderkey) AS ln FROM k WHERE rn > share)
      SELECT o_orderkey, o_orderpriority FROM k WHERE rn <= share UNION ALL SELECT o_orderkey, o_orderpriority FROM o WHERE ln <= 500 - (SELECT count(*) FROM k WHERE rn <= share)""",
    "bare_terms": "SELECT p_partkey, p_name AS term, regexp_matches(w, '^[A-Z][A-Z0-9]{1,5}$') OR (length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 3 AND length(w) >= 5) AS usable FROM (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS w FROM part)",
    "plain_terms": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || 's' ELSE p_name END AS term FROM part",
    "glyphs": "SELECT doc_id, md5(CASE WHEN source = 'guideline' THEN replace(replace(text, 'é', 'e'), '–', '-') ELSE text END) AS hash FROM documents WHERE text IS NOT NULL",
    "left_out_sections": """WITH d AS (SELECT DISTINCT h FROM (SELECT unnest(section_path) AS h FROM documents) WHERE h IS NOT NULL)
      SELECT h, false AS left_out, true AS footnote FROM d UNION ALL SELECT '3.1 References to ' || h, true, true FROM d UNION ALL SELECT 'Funding: ' || h, true, true FROM d""",
    "condition_facts": f"WITH {_SCOPE}, f AS ({_FACTS}) SELECT name, sign, value, count(*) AS n FROM (SELECT DISTINCT doc_id, name, coalesce(sign, '') AS sign, value FROM f) GROUP BY ALL",
    "search_queries": """WITH b AS (SELECT p_brand, list_sort(list_distinct(list(p_type)))[1:3] AS t, list_sort(list_distinct(list(p_name) FILTER (p_size > 45)))[1:2] AS c FROM part GROUP BY 1),
      q AS (SELECT p_brand, '(' || array_to_string(list_transform(t, lambda x: '"' || x || '"[tiab]'), ' OR ') || ')' AS q, c FROM b)
      SELECT p_brand, CASE WHEN len(coalesce(c, [])) > 0 THEN '(' || q || ' AND (' || array_to_string(list_transform(c, lambda x: '"' || x || '"[tiab]'), ' OR ') || '))' ELSE q END || ' AND diuretics[mh]' AS query FROM q""",
    "search_units": """WITH sets AS (SELECT l_orderkey, list_distinct(list(p_brand)) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey), i AS (SELECT l_orderkey, unnest(items) AS item FROM sets),
      m AS (SELECT a.item AS name, b.item AS other, row_number() OVER (PARTITION BY a.item ORDER BY count(*) DESC, b.item) AS rank FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.item <> b.item GROUP BY a.item, b.item QUALIFY rank <= 5),
      n AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand < 'Brand#3'),
      o AS (SELECT name, list(other ORDER BY rank) AS o FROM m GROUP BY name), k AS (SELECT name, list(other ORDER BY rank) AS o FROM m WHERE other IN (SELECT name FROM n) GROUP BY name)
      SELECT 'concept::' || name AS key, 'concept' AS kind, array_to_string(list_concat([name], coalesce(o, [])), '|') AS concepts, name AS terms, '' AS others FROM n LEFT JOIN o USING (name)
      UNION ALL SELECT 'seed::' || p_type, 'seed_theme', array_to_string(list_sort(list_distinct(list(p_brand))), '|'), array_to_string(list_sort(list_distinct(list(p_brand)))[1:6], '|'), '' FROM part GROUP BY p_type
      UNION ALL (SELECT 'set::' || name, 'concept_set', array_to_string(list_concat([name], k.o), '|'), name, array_to_string(k.o[1:3], '|') FROM n JOIN k USING (name) WHERE len(k.o) >= 2 ORDER BY len(k.o) DESC, name LIMIT 5)""",
    "junk_reasons": """SELECT CASE WHEN p_partkey % 11 = 0 THEN 'blank' WHEN p_partkey % 11 = 1 THEN 'number' WHEN p_partkey % 11 = 2 THEN 'short' WHEN length(p_name) <= 3 THEN 'short' WHEN regexp_matches(p_name, '(?i)small|large') THEN 'sized' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1""",
    "simple_graph": """SELECT CAST(o_custkey % 40 AS VARCHAR) AS head, l_returnflag AS relation, CAST(l_suppkey % 40 AS VARCHAR) AS tail, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE o_custkey % 40 <> l_suppkey % 40 AND l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY least(head, tail), greatest(head, tail) ORDER BY ord, head, relation, tail) = 1""",
    "gated_codes": " UNION ALL ".join(f"SELECT '{m}' AS mode, count(*) AS n, sum(p_partkey)::BIGINT AS total FROM part WHERE {c}" for m, c in (("both", "p_size < 20 AND p_type = 'PROMO'"), ("either", "p_size < 20 OR p_type = 'PROMO'"), ("left", "p_size < 20"), ("left_if_right_empty", "p_size < 20"))),
    "item_pairs": "SELECT DISTINCT a.p_type AS a, b.p_type AS b FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_type < b.p_type UNION SELECT * FROM (VALUES ('x', 'z'), ('x', 'y'), ('y', 'z'))",
    "code_misses": "SELECT p_type, count(*) AS n, count(*) FILTER (miss) AS missed, count(DISTINCT CASE WHEN miss THEN p_brand END) AS codes_missed FROM (SELECT p_type, p_brand, NOT starts_with(p_brand, 'Brand#1') AND NOT starts_with(p_brand, 'Brand#25') AS miss FROM part) GROUP BY 1",
    "first_code_wins": "SELECT p_brand, split_part(arg_min(p_name, p_partkey), ' ', 1) AS name FROM part GROUP BY 1",
    "one_to_one_join": "SELECT o_orderkey, o_custkey, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "names_by_code": f"""WITH i AS (SELECT p_name AS item, count(*) AS n, {_NORM.format('p_name')} AS k FROM part GROUP BY p_name), c AS (SELECT {_NORM.format('p_name')} AS k, min(p_type) AS code FROM part GROUP BY 1),
      m AS (SELECT item, first_value(item) OVER (PARTITION BY code ORDER BY n DESC, item) AS canonical FROM i JOIN c USING (k)),
      g AS (SELECT canonical, count(*) AS k, min(item) AS f FROM m WHERE item IN ('Small Ring', 'small ring') GROUP BY 1),
      p AS (SELECT item, CASE WHEN item IN ('Small Ring', 'small ring') THEN item WHEN k = 1 THEN f ELSE m.canonical END AS canonical FROM m LEFT JOIN g USING (canonical))
      SELECT m.item, coalesce(p.canonical, m.canonical) AS canonical FROM m LEFT JOIN p ON p.item = m.canonical""",
    "grounded_triples": f"""WITH x AS (SELECT *, h = 'furosemide' AS exact, contains(lower(text), h) OR h = 'furosemide' AS hp, contains(lower(text), t) AS tp FROM {_HEAD})
      SELECT CASE WHEN h = '' THEN 'blank' WHEN NOT hp THEN 'head not in text' WHEN NOT tp THEN 'tail not in text' WHEN NOT exact THEN 'no concept' ELSE 'kept' END AS reason, CASE WHEN exact THEN 'exact' ELSE 'none' END AS anchor, count(*) AS n FROM x GROUP BY ALL""",
    "vocabulary_names": "SELECT p_brand, coalesce(arg_min(p_name, p_partkey) FILTER (p_type = 'PROMO'), arg_min(p_name, p_partkey)) AS p_name FROM part WHERE p_size <= 25 GROUP BY 1",
    "vocabulary_types": "SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS types FROM part WHERE p_type IN ('PROMO', 'ECONOMY') GROUP BY 1",
    "vocabulary_tree": "SELECT DISTINCT p_brand FROM part WHERE p_type = 'PROMO' AND (p_name LIKE 'Small%' OR p_name LIKE 'small%' OR p_name LIKE 'red%' OR p_name LIKE 'Red%')",
    "vocabulary_index": f"SELECT {_NORM.format('p_name')} AS name, arg_min(p_brand, p_partkey) AS code FROM part WHERE {_NORM.format('p_name')} IN (SELECT {_NORM.format('p_name')} FROM part WHERE p_size > 10) GROUP BY 1",
    "vocabulary_relations": """WITH k AS (SELECT p_partkey AS c FROM part WHERE p_size <= 40) SELECT CASE WHEN l_linenumber = 7 THEN 'suppressed' WHEN l_linestatus <> 'O' THEN 'source' WHEN l_returnflag = 'R' THEN 'relation' WHEN l_partkey = l_suppkey THEN 'self'
      WHEN l_partkey NOT IN (SELECT c FROM k) OR l_suppkey NOT IN (SELECT c FROM k) THEN 'gate' ELSE 'kept' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""",
    "child_terms": "SELECT n_regionkey AS r_regionkey, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "masked_texts": """SELECT doc_id, md5(regexp_replace(text, '(?i)\\b[0-9]+(?:\\.[0-9]+)?(?:\\s*(?:-|–|to)\\s*[0-9]+(?:\\.[0-9]+)?)?\\s*(?:mcg|µg|mg|g)\\b', '<dose>', 'g')) AS masked,
      md5(trim(regexp_replace(replace(text, '\u00ad', ''), '\\s+', ' ', 'g'))) AS cleaned FROM documents WHERE text IS NOT NULL""",
    "term_context": """SELECT doc_id, regexp_extract(text, '(?is)((?:\\S+\\s+){0,5}\\S*\\bpotassium\\b\\S*(?:\\s+\\S+){0,5})', 1) AS context FROM documents WHERE regexp_matches(text, '(?i)\\bpotassium\\b')""",
    "passage_paths": """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(min(l_partkey) AS VARCHAR) AS t FROM lineitem GROUP BY ALL), h AS (SELECT l_orderkey, max(t) FILTER (l_linenumber = 1) AS a, max(t) FILTER (l_linenumber = 4) AS b FROM l GROUP BY 1)
      SELECT l_orderkey, l_linenumber, concat_ws('>', CASE WHEN l_linenumber > 1 THEN a END, CASE WHEN l_linenumber > 4 THEN b END) AS path FROM l JOIN h USING (l_orderkey) WHERE l_linenumber NOT IN (1, 4)""",
}

QUERIES: list[Query] = [
    retrieved_paths, retrieval_report, path_overlap, endpoint_pairs, probe_report, rank_probe, supported_selection, loop_clusters, open_clusters, property_graph, graph_vocabulary, described_types,
    cluster_shape, weighted_precision, usage_totals, corpus_shape, cell_sample, bare_terms, plain_terms, glyphs, left_out_sections, condition_facts, search_queries, search_units,
    junk_reasons, simple_graph, gated_codes, item_pairs, code_misses, first_code_wins, one_to_one_join, names_by_code, grounded_triples, vocabulary_names, vocabulary_types,
    vocabulary_tree, vocabulary_index, vocabulary_relations, child_terms, passage_paths, masked_texts, term_context,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
