"""Entity resolution: spellings to canonical names, code groups, clusters of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.functions.scalars import normalised


def article_free(text: Column) -> Column:
    """A normalised name without a leading article."""
    return F.regexp_replace(normalised(text), "^(?:the|a|an) ", "")


def singulars(name: Column) -> Column:
    """Candidates for the singular of a name: ies to y, ses to sis, a final s dropped."""
    return F.filter(
        F.array(
            F.when(name.endswith("ies") & (F.length(name) > 4), F.regexp_replace(name, "ies$", "y")),
            F.when(name.endswith("ses") & (F.length(name) > 4), F.regexp_replace(name, "ses$", "sis")),
            F.when(name.endswith("s") & ~name.endswith("ss") & (F.length(name) > 3), F.regexp_replace(name, "s$", "")),
        ),
        lambda x: x.isNotNull(),
    )


def canonical_by_name(items: DataFrame, item: str, count: str) -> DataFrame:
    """(item, canonical): items of one normalised name, plurals with their singulars, go to the most frequent spelling.

    Ties go to the least spelling. A plural merges only into a singular that stands in the items.
    """
    named = items.select(F.col(item).alias("i"), F.col(count).alias("c"), article_free(F.col(item)).alias("n"))
    names = named.select("n").distinct()
    tried = names.select("n", F.explode(singulars(F.col("n"))).alias("s"))
    merged = tried.join(names.select(F.col("n").alias("s")), "s", "left_semi").groupBy("n").agg(F.min("s").alias("to"))
    keyed = named.join(merged, "n", "left").select("i", "c", F.coalesce("to", "n").alias("k"))
    best = keyed.groupBy("k").agg(F.min_by("i", F.struct((-F.col("c")).alias("c"), "i")).alias("canonical"))
    return keyed.join(best, "k").select(F.col("i").alias(item), "canonical")


def canonical_by_code(items: DataFrame, item: str, count: str, codes: DataFrame, name: str, code: str) -> DataFrame:
    """(item, canonical): items whose normalised name has the same code go to the most frequent of them."""
    table = codes.groupBy(normalised(F.col(name)).alias("n")).agg(F.min(code).alias("code"))
    keyed = items.select(F.col(item).alias("i"), F.col(count).alias("c"), normalised(F.col(item)).alias("n")).join(table, "n")
    best = keyed.groupBy("code").agg(F.min_by("i", F.struct((-F.col("c")).alias("c"), "i")).alias("canonical"))
    return keyed.join(best, "code").select(F.col("i").alias(item), "canonical")


def compose(first: DataFrame, second: DataFrame, item: str = "item") -> DataFrame:
    """Two mappings (item, canonical) one after the other."""
    then = second.select(F.col(item).alias("canonical"), F.col("canonical").alias("c_next"))
    return first.join(then, "canonical", "left").select(item, F.coalesce("c_next", "canonical").alias("canonical"))


def keep_protected(mapping: DataFrame, protected: list[str], item: str = "item") -> DataFrame:
    """A mapping in which protected names stay themselves.

    A cluster with one protected name takes it as its canonical name; in one with several each
    protected name stands for itself and the others keep the old canonical name.
    """
    is_p = F.col(item).isin(protected)
    by = mapping.where(is_p).groupBy("canonical").agg(F.count(F.lit(1)).alias("p_n"), F.min(item).alias("p_first"))
    joined = mapping.join(by, "canonical", "left")
    name = F.when(is_p, F.col(item)).when(F.col("p_n") == 1, F.col("p_first")).otherwise(F.col("canonical"))
    return joined.select(item, name.alias("canonical"))


def agglomerate(vectors: np.ndarray, threshold: float, linkage: str = "average", weights: np.ndarray | None = None) -> np.ndarray:
    """Labels of bottom-up clustering by cosine distance until the closest clusters are ``threshold`` apart.

    For one bounded block of vectors: quadratic in their number. Ties go to the least indices. ``weights`` says how many equal points
    each vector stands for. Each row remembers its nearest other, so a merge looks at rows, not at pairs.
    """
    n = len(vectors)
    labels = np.arange(n)
    if n < 2:
        return labels
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms == 0, 1, norms)
    gap = np.round(1 - unit @ unit.T, 12)
    np.fill_diagonal(gap, np.inf)
    size = np.ones(n) if weights is None else np.asarray(weights, dtype="float64").copy()
    near = gap.argmin(axis=1)
    least = gap[labels, near]
    while True:
        i = int(np.argmin(least))
        j = int(near[i])
        if not least[i] <= threshold:
            break
        i, j = min(i, j), max(i, j)
        merged = np.maximum(gap[i], gap[j]) if linkage == "complete" else (gap[i] * size[i] + gap[j] * size[j]) / (size[i] + size[j])
        gap[i], gap[:, i] = merged, merged
        gap[i, i] = np.inf
        gap[j], gap[:, j] = np.inf, np.inf
        size[i] += size[j]
        labels[labels == j] = i
        stale = np.flatnonzero((near == i) | (near == j) | (gap[:, i] < least))
        for k in {*stale.tolist(), i, j}:
            near[k] = int(gap[k].argmin())
            least[k] = gap[k, near[k]]
    return np.unique(labels, return_inverse=True)[1]


def cluster_within(rows: DataFrame, key: str, row_id: str, vector: str, threshold: float, linkage: str = "average", most: int = 20_000) -> DataFrame:
    """Clusters of the vectors of each key: (key, row_id, cluster, canonical), clusters numbered from 0 in each key by their least id.

    Bottom-up clustering by cosine distance with average or complete linkage, until the closest clusters are ``threshold`` apart.
    The canonical row of a cluster is the one nearest to its centroid, ties by id. Null vectors take no part. Equal vectors of a key
    merge before all others, at distance zero, so they are collapsed to one with a weight: a key's state follows its distinct vectors. More
    than ``most`` of those in one key raise, as the linkage of all of them is not defined by parts.
    """
    kept = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(row_id).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    distinct = kept.groupBy("k", "v").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, row_id)}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > most:
            raise ValueError(f"a key has {len(group)} different vectors, more than {most}")
        group = group.sort_values("i", ignore_index=True)
        points = np.array(group["v"].tolist(), dtype="float64")
        weight = group["n"].to_numpy(dtype="float64")
        labels = agglomerate(points, threshold, linkage, weight)
        order = {label: n for n, label in enumerate(dict.fromkeys(labels.tolist()))}
        best = {}
        for label in order:
            at = np.flatnonzero(labels == label)
            centre = np.average(points[at], axis=0, weights=weight[at])
            best[label] = group["i"].iloc[at[int(np.argmin(np.round(np.linalg.norm(points[at] - centre, axis=1), 12)))]]
        return pd.DataFrame({"k": group["k"], "v": group["v"], "cluster": [order[x] for x in labels.tolist()], "canonical": [best[x] for x in labels.tolist()]})

    found = distinct.groupBy("k").applyInPandas(run, f"k {kinds[key]}, v array<double>, cluster bigint, canonical {kinds[row_id]}")
    joined = kept.join(found, kept["k"].eqNullSafe(found["k"]) & (kept["v"] == found["v"]))
    return joined.select(kept["k"].alias(key), kept["i"].alias(row_id), "cluster", "canonical")


def silhouette(vectors: np.ndarray, labels: np.ndarray) -> float:
    """The mean silhouette by cosine distance; a point alone in its cluster counts 0."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms == 0, 1, norms)
    gap = 1 - unit @ unit.T
    np.fill_diagonal(gap, 0.0)
    names, at = np.unique(labels, return_inverse=True)
    member = np.eye(len(names))[at]
    sizes = member.sum(axis=0)
    sums = gap @ member
    own = sums[np.arange(len(at)), at] / np.maximum(1, sizes[at] - 1)
    means = sums / sizes
    means[np.arange(len(at)), at] = np.inf
    other = means.min(axis=1)
    score = np.where(sizes[at] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
    return float(score.mean())


def threshold_search(rows: DataFrame, row_id: str, vector: str, low: float = 0.05, high: float = 0.37, steps: int = 32, sample: int = 4_000, fallback: float = 0.2) -> DataFrame:
    """(threshold, clusters, silhouette, is_best): average linkage at evenly spaced thresholds, scored on a sample.

    The sample are the ``sample`` vectors that come first by a hash of their id: a documented bound, as the score of a threshold needs all pairs
    of the sample. Each threshold is one task. The first of the best scores is marked; without any score ``fallback`` is added and
    marked. A threshold that leaves one cluster, or as many as vectors, has no score.
    """
    spark = rows.sparkSession
    first = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(row_id), row_id).limit(sample).select(F.col(row_id).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    points = np.array([r["v"] for r in first.orderBy("i").collect()], dtype="float64")  # at most ``sample`` vectors
    shared = spark.sparkContext.broadcast(points)

    def score(batches):
        for batch in batches:
            out = []
            for t in batch["threshold"]:
                labels = agglomerate(shared.value, float(t), "average") if len(shared.value) > 2 else np.zeros(len(shared.value))
                n = len(np.unique(labels))
                out.append((t, n, round(silhouette(shared.value, labels), 4) if 2 <= n <= len(labels) - 1 else None))
            yield pd.DataFrame(out, columns=["threshold", "clusters", "silhouette"])

    grid = spark.createDataFrame([(float(round(t, 4)),) for t in np.linspace(low, high, steps)], "threshold double").repartition(steps)
    table = grid.mapInPandas(score, "threshold double, clusters bigint, silhouette double").collect()  # a row per step
    scored = [r for r in table if r["silhouette"] is not None]
    best = max(scored, key=lambda r: (r["silhouette"], -r["threshold"]))["threshold"] if scored else fallback
    out = [(r["threshold"], r["clusters"], r["silhouette"], r["threshold"] == best) for r in table]
    if not scored:
        out.append((fallback, None, None, True))
    return spark.createDataFrame(out, "threshold double, clusters bigint, silhouette double, is_best boolean")
