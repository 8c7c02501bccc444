"""Paths between concepts as evidence: retrieving, scoring, selecting and reporting them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.functions.scalars import jaccard
from chronica.operators.graph import shortest_paths, top_share, triples_along

Support = Callable[[str, str], float]


def token_set(text: Column) -> Column:
    """The distinct words of a text: runs of letters a to z and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def path_sentence(triples: Column, nodes: Column) -> Column:
    """A path as sentences, one per triple; its nodes where it has none."""
    spoken = F.array_join(F.transform(triples, lambda t: F.concat_ws(" ", t.head, t.relation, t.tail)), ". ")
    return F.concat(F.when(F.size(F.coalesce(triples, F.array())) > 0, spoken).otherwise(F.array_join(nodes, " ")), F.lit("."))


def path_parts(triples: Column, nodes: Column) -> Column:
    """The nodes of a path and then its relations."""
    return F.concat(nodes, F.transform(triples, lambda t: t.relation))


def retrieve(
    edges: DataFrame, pairs: DataFrame, query: str, source_of: str, severity: float, alpha: float = 0.7, beta: float = 0.7,
    hops: int = 3, most: int = 5, share: float = 0.3, refine: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The best paths of each episode under two aspects: (episode, aspect, source, target, nodes, sources, score, from_visit, to_visit).

    ``pairs`` has episode, source, target, from_visit and to_visit, and the episode's ``query`` text; ``edges`` has head, relation, tail and ``source_of``. All shortest paths
    of at most ``hops`` edges are found once per distinct pair, whatever the number of episodes that ask for it; they are spoken as a text and compared with the query by their words. Risk
    is alpha * similarity + (1 - alpha) * severity, protective beta * similarity + (1 - beta) * (1 - severity). The best ``share`` of each
    episode and aspect stays, at least one, ties by nodes. ``refine``, if given, scores the pool of both aspects anew before they are cut again.
    """
    distinct = pairs.select("source", "target").distinct()
    paths = shortest_paths(edges.select("head", "tail"), distinct, hops, most)
    along = triples_along(paths, edges.select("head", "relation", "tail", source_of), [source_of])
    spoken = along.groupBy("source", "target", "nodes").agg(
        F.array_sort(F.collect_list(F.struct("hop", "head", "relation", "tail"))).alias("triples"), F.sort_array(F.collect_set(source_of)).alias("sources")
    )
    spoken = spoken.select("source", "target", "nodes", "triples", "sources", token_set(path_sentence(F.col("triples"), F.col("nodes"))).alias("words"))
    asked = pairs.select("episode", "source", "target", "from_visit", "to_visit", token_set(F.col(query)).alias("wanted"))
    met = asked.join(spoken, ["source", "target"])
    likeness = jaccard(F.col("wanted"), F.col("words"))
    aspects = F.array(
        F.struct(F.lit("risk").alias("aspect"), F.round(alpha * likeness + (1 - alpha) * severity, 9).alias("score")),
        F.struct(F.lit("protective").alias("aspect"), F.round(beta * likeness + (1 - beta) * (1 - severity), 9).alias("score")),
    )
    scored = met.select("episode", "source", "target", "nodes", "triples", "sources", "from_visit", "to_visit", F.inline(aspects)).withColumn("path", F.array_join("nodes", "\u001f"))
    kept = top_share(scored, ["episode", "aspect"], "score", "path", share)
    if refine is not None:
        kept = top_share(refine(kept), ["episode", "aspect"], "score", "path", share)
    return kept.select("episode", "aspect", "source", "target", "nodes", "triples", "sources", "score", "from_visit", "to_visit")


def retrieval_report(kept: DataFrame) -> DataFrame:
    """(what, value, n): kept paths by number of hops, by source of an edge, by aspect and by window of visits."""
    window = F.when(F.col("from_visit").isNull(), "stand_in").when(F.col("from_visit") == F.col("to_visit"), "single_visit").otherwise("between_visits")
    one = F.array(
        F.struct(F.lit("hops").alias("what"), (F.size("nodes") - 1).cast("string").alias("value")),
        F.struct(F.lit("aspect").alias("what"), F.col("aspect").alias("value")), F.struct(F.lit("window").alias("what"), window.alias("value")),
    )
    every = F.concat(one, F.transform("sources", lambda s: F.struct(F.lit("source").alias("what"), s.alias("value"))))
    return kept.select(F.inline(every)).groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))


def select_supported(
    sentences: list[str], vectors: np.ndarray, query: np.ndarray, hypothesis: str, support: Support,
    balance: float = 0.7, enough: float = 0.5, least_gain: float = 0.02, most: int = 8, least: int = 1,
) -> tuple[list[int], list[float], str]:
    """Picks by maximal marginal relevance until they support a hypothesis: (indices, support after each, why it ended).

    It ends with ``enough`` once the support of the picks together reaches it, with ``no_gain`` if a pick adds less than
    ``least_gain``, both not before ``least`` picks; with ``most``, or ``exhausted``, or ``empty``.
    """
    n = len(sentences)
    if not n:
        return [], [], "empty"
    relevance = vectors @ query
    likeness = np.zeros(n)
    picks: list[int] = []
    given: list[float] = []
    while len(picks) < min(most, n):
        gain = balance * relevance - (1 - balance) * (likeness if picks else 0.0)
        gain[picks] = -np.inf
        best = int(np.argmax(gain))
        alike = vectors @ vectors[best]
        likeness = np.maximum(likeness, alike) if picks else alike
        picks.append(best)
        given.append(support(" ".join(sentences[i] for i in picks), hypothesis))
        if len(picks) >= least:
            if given[-1] >= enough:
                return picks, given, "enough"
            if given[-1] - (given[-2] if len(given) > 1 else 0.0) < least_gain:
                return picks, given, "no_gain"
    return picks, given, "most" if len(picks) >= most else "exhausted"


def word_overlap(premise: str, hypothesis: str) -> float:
    """A support scorer without a model: the share of the hypothesis' words that stand in the premise."""
    words = set(hypothesis.lower().split())
    return len(words & set(premise.lower().split())) / len(words) if words else 0.0


def supported_paths(
    pool: DataFrame, key: str, row_id: str, sentence: str, vector: str, query: str, hypothesis: str, support: Callable[[], Support], **limits: float
) -> DataFrame:
    """(key, picked, pool, support, stop) of ``select_supported`` over each key's pool, in the order of ``row_id``.

    A pool is what retrieval left of one episode and aspect; one task holds it. ``support`` makes the scorer, once per task.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i", ignore_index=True)
        unit = np.array(group["v"].tolist(), dtype="float64")
        picks, given, stop = select_supported(group["s"].tolist(), unit, np.array(group["q"].iloc[0], dtype="float64"), group["h"].iloc[0], support(), **limits)
        return pd.DataFrame({"k": [group["k"].iloc[0]], "picked": [[group["i"].iloc[i] for i in picks]], "pool": [len(group)], "support": [given], "stop": [stop]})

    kinds = {c: pool.schema[c].dataType.simpleString() for c in (key, row_id)}
    small = pool.select(F.col(key).alias("k"), F.col(row_id).alias("i"), F.col(sentence).alias("s"), F.col(vector).alias("v"), F.col(query).alias("q"), F.col(hypothesis).alias("h"))
    out = small.groupBy("k").applyInPandas(choose, f"k {kinds[key]}, picked array<{kinds[row_id]}>, pool bigint, support array<double>, stop string")
    return out.withColumnRenamed("k", key)


def selection_report(selected: DataFrame) -> DataFrame:
    """Medians of pool and picks, the median of the last support, and how often each reason ended it: (what, value)."""
    last = F.element_at("support", -1)
    one = selected.agg(
        F.count(F.lit(1)).cast("double").alias("episodes"), F.percentile("pool", F.lit(0.5)).alias("pool_median"), F.percentile(F.size("picked"), F.lit(0.5)).alias("picked_median"),
        F.round(F.percentile(F.when(F.size("support") > 0, last), F.lit(0.5)), 4).alias("support_median"),
    )
    flat = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in one.columns])))
    stops = selected.groupBy("stop").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return flat.unionByName(stops.select(F.concat(F.lit("stop_"), "stop").alias("what"), "value"))


def overlap_of_paths(kept: DataFrame) -> DataFrame:
    """How many paths of an episode stand under both aspects, and how many distinct ones there are."""
    by = kept.groupBy("episode", F.array_join("nodes", "\u001f").alias("p")).agg(F.count_distinct("aspect").alias("k"))
    return by.agg(F.count_if(F.col("k") > 1).alias("in_both"), F.count(F.lit(1)).alias("distinct_paths"))


def mentions_any(members: DataFrame, cluster: str, text: str, pattern: str) -> DataFrame:
    """Clusters of which a member's text matches a pattern, without regard to case."""
    return members.where(F.col(text).rlike(f"(?i){pattern}")).select(cluster).distinct()


def endpoint_pairs(kept: DataFrame) -> DataFrame:
    """(episode, a, b): every unordered pair of the ends of an episode's kept paths; the ends of one episode are a few dozen."""
    ends = kept.select("episode", F.explode(F.array(F.get("nodes", F.lit(0)), F.element_at("nodes", -1))).alias("n"))
    sets = ends.groupBy("episode").agg(F.sort_array(F.collect_set("n")).alias("s"))
    first = sets.select("episode", "s", F.posexplode("s").alias("i", "a"))
    return first.select("episode", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))


def through(nodes: Column, prefix: str) -> Column:
    """Whether a path has a node whose name starts with ``prefix``."""
    return F.exists(nodes, lambda n: n.startswith(prefix))


def blocked_nodes(needs: DataFrame, has: DataFrame) -> DataFrame:
    """(episode, cluster): clusters closed to an episode, as it lacks a concept they need. ``needs`` (cluster, concept), ``has`` (episode, concept)."""
    wanted = needs.select("cluster", "concept").distinct()
    sizes = wanted.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    met = has.select("episode", "concept").distinct().join(wanted, "concept").groupBy("episode", "cluster").agg(F.count(F.lit(1)).alias("k"))
    # A cluster of which an episode has nothing is closed too; only those it has a part of need a row here.
    return met.join(sizes, "cluster").where("k < n").select("episode", "cluster")


def open_nodes(needs: DataFrame, has: DataFrame) -> DataFrame:
    """(episode, cluster): clusters whose needed concepts the episode has all."""
    wanted = needs.select("cluster", "concept").distinct()
    sizes = wanted.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    met = has.select("episode", "concept").distinct().join(wanted, "concept").groupBy("episode", "cluster").agg(F.count(F.lit(1)).alias("k"))
    return met.join(sizes, "cluster").where("k = n").select("episode", "cluster")


def probe_report(base: DataFrame, combined: DataFrame, pairs: DataFrame, prefix: str) -> DataFrame:
    """(what, n): how paths between pairs change when nodes named by ``prefix`` are added.

    ``base`` and ``combined`` have source, target, nodes; ``pairs`` source and target.
    """
    keys = ["source", "target"]
    summary = lambda df, p: df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{p}n"), F.min(F.size("nodes")).alias(f"{p}len"), F.count_if(through(F.col("nodes"), prefix)).alias(f"{p}via")
    )
    both = pairs.select(*keys).distinct().join(summary(base, "b_"), keys, "left").join(summary(combined, "c_"), keys, "left")
    has_b, has_c = F.col("b_n").isNotNull(), F.col("c_n").isNotNull()
    parts = {
        "pairs": F.count(F.lit(1)), "connected_base": F.count_if(has_b), "connected_combined": F.count_if(has_c), "paths_base": F.coalesce(F.sum("b_n"), F.lit(0)),
        "paths_combined": F.coalesce(F.sum("c_n"), F.lit(0)), "paths_through": F.coalesce(F.sum("c_via"), F.lit(0)), "newly_connected": F.count_if(~has_b & has_c),
        "shorter": F.count_if(F.coalesce(F.col("c_len") < F.col("b_len"), F.lit(False))), "all_through": F.count_if(F.coalesce(has_b & (F.col("c_via") == F.col("c_n")), F.lit(False))),
    }
    one = both.agg(*[c.alias(n) for n, c in parts.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).cast("bigint").alias("n")) for n in parts])))


def rank_report(base: DataFrame, combined: DataFrame, prefix: str) -> DataFrame:
    """(what, n) of kept paths with and without added nodes: episodes with an added node, paths through one, base paths that stayed."""
    keys = ["episode", "aspect", F.array_join("nodes", "\u001f").alias("p")]
    b = base.select(*keys).distinct()
    c = combined.select(*keys, through(F.col("nodes"), prefix).alias("t")).distinct()
    joined = b.withColumn("in_b", F.lit(True)).join(c.withColumn("in_c", F.lit(True)), ["episode", "aspect", "p"], "full")
    one = joined.agg(
        F.count_if(F.col("in_b").isNotNull()).alias("base_paths"), F.count_if(F.col("in_b").isNotNull() & F.col("in_c").isNotNull()).alias("base_paths_kept"),
        F.count_if(F.coalesce("t", F.lit(False))).alias("paths_through"), F.count_distinct(F.when(F.coalesce("t", F.lit(False)), F.col("episode"))).alias("episodes_through"),
        F.count_distinct("episode").alias("episodes"),
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("n")) for n in one.columns])))


def property_graph(mentions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concept nodes (id, name), cluster nodes (id, n, sources) and edges (from, to, term) of accepted links.

    ``mentions`` has mention_id, cluster, source; ``links`` concept, term, mention_id and status.
    """
    accepted = links.where("status = 'accepted'")
    name = F.lower(F.trim("concept"))
    concepts = accepted.select(F.concat(F.lit("concept:"), name).alias("id"), name.alias("name")).distinct()
    clusters = mentions.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("source")).alias("sources"))
    clusters = clusters.select(F.concat(F.lit("cluster:"), "cluster").alias("id"), "n", "sources")
    edges = accepted.join(mentions.select("mention_id", "cluster"), "mention_id").select(
        F.concat(F.lit("concept:"), name).alias("from"), F.concat(F.lit("cluster:"), "cluster").alias("to"), "term"
    )
    return concepts, clusters, edges.distinct()


def graph_vocabulary(edges: DataFrame) -> DataFrame:
    """Every distinct name in a graph, node or relation: (name)."""
    return edges.select(F.explode(F.array("head", "relation", "tail")).alias("name")).where("trim(name) <> ''").distinct()


def described(terms: DataFrame, concept: str, term: str, most: int, counts: str | None = None) -> DataFrame:
    """(concept, text): each concept followed by its ``most`` best terms: the most matched ones if ``counts`` names a column, then the shortest.

    Terms equal but for case count once, and the concept's own name isn't repeated.
    """
    rows = terms.where(F.lower(term) != F.lower(concept))
    hits = F.coalesce(F.col(counts), F.lit(0)) if counts else F.lit(0)
    once = rows.groupBy(concept, F.lower(term).alias("d_low")).agg(F.min(term).alias("d_term"), F.max(hits).alias("d_hits"))
    best = once.groupBy(concept).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("d_hits")).alias("h"), F.length("d_term").alias("n"), F.col("d_low").alias("l"), F.col("d_term").alias("t")))), 1, most).alias("b"))
    every = terms.select(concept).distinct().join(best, concept, "left")
    return every.select(concept, F.concat_ws("; ", F.array(concept), F.transform("b", lambda x: x.t)).alias("text"))
