"""Vector search in blocks, diverse selection, embedding behind an interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronica.functions.scalars import cosine, dot
from chronica.session import cut


Embedder = Callable[[list[str]], np.ndarray]


def _in_blocks(queries: DataFrame, rows: DataFrame, row_id: str, vector: str, block: int, keep: Callable, most: int | None = None) -> DataFrame:
    """(query, row, cosine) of all pairs that ``keep``, a function of the matrix of cosines, marks; of each query and block only the ``most`` best."""
    q, r = queries.where(F.col(vector).isNotNull()), rows.where(F.col(vector).isNotNull())
    nq, nr = max(1, -(-q.count() // block)), max(1, -(-r.count() // block))
    side = lambda df, n: df.select(F.col(row_id).alias("i"), F.col(vector).alias("v"), F.pmod(F.xxhash64(row_id), F.lit(n)).alias("own"))
    qs = side(q, nq).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).select("i", "v", F.col("own").alias("qb"), F.col("other").alias("rb"))
    rs = side(r, nr).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select("i", "v", F.col("other").alias("qb"), F.col("own").alias("rb"))

    def unit(v: pd.Series) -> np.ndarray:
        m = np.array(v.tolist(), dtype="float64").reshape(len(v), -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "row": [], "cosine": []})
        b = b.sort_values("i", ignore_index=True)
        s = unit(a["v"]) @ unit(b["v"]).T
        s[a["i"].to_numpy()[:, None] == b["i"].to_numpy()[None, :]] = -np.inf
        good = keep(s) & np.isfinite(s)
        if most is None:
            x, y = np.nonzero(good)
            return pd.DataFrame({"query": a["i"].to_numpy()[x], "row": b["i"].to_numpy()[y], "cosine": s[x, y]})
        k = min(most, s.shape[1])
        best = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query": np.repeat(a["i"].to_numpy(), k), "row": b["i"].to_numpy()[best].ravel(), "cosine": np.take_along_axis(s, best, 1).ravel()})
        return out[np.take_along_axis(good, best, 1).ravel()]

    return qs.groupBy("qb", "rb").cogroup(rs.groupBy("qb", "rb")).applyInPandas(compare, "query bigint, row bigint, cosine double")


def search(queries: DataFrame, rows: DataFrame, row_id: str, vector: str, most: int, block: int = 2048) -> DataFrame:
    """For each query vector the ``most`` rows of greatest cosine, itself left out: (query, row, cosine, rank).

    Both sides are cut into blocks of about ``block`` vectors by a hash of their id; every pair of
    a query block and a row block is one small task of one matrix product, from which only the best
    of each query go on. So all queries meet all rows, and no task holds either side. Null vectors
    take no part; a zero vector has cosine 0; ties go to the lesser id.
    """
    near = _in_blocks(queries, rows, row_id, vector, block, lambda s: s > -np.inf, most)
    order = Window.partitionBy("query").orderBy(F.round("cosine", 12).desc(), "row")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def select_diverse(vectors: np.ndarray, relevance: np.ndarray, balance: float, most: int, least_gain: float) -> list[int]:
    """Indices picked by maximal marginal relevance: relevance against likeness to what is picked.

    Stops after ``most`` picks, or when the best gain falls below ``least_gain``. Ties go to the first.
    """
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms == 0, 1, norms)
    picked: list[int] = []
    likeness = np.zeros(len(vectors))
    while len(picked) < min(most, len(vectors)):
        gain = balance * relevance - (1 - balance) * likeness
        gain[picked] = -np.inf
        best = int(np.argmax(gain))
        if picked and gain[best] < least_gain:
            break
        picked.append(best)
        likeness = np.maximum(likeness, unit @ unit[best])
    return picked


def diverse(rows: DataFrame, key: str, row_id: str, vector: str, relevance: str, most: int = 10, balance: float = 0.7, least_gain: float = 0.05) -> DataFrame:
    """The rows picked by maximal marginal relevance of each key: (key, row_id, pick), pick from 1.

    All rows of a key are candidates. Every round scores each row against what its key has picked so far and takes the best of each key,
    combined before the shuffle, so no task holds a key; only the picks, at most ``most`` vectors a key, go to the next round.
    A key ends when its best gain falls below ``least_gain``, but not before its first pick. Ties go to the greater relevance, then the lesser id. Null vectors take no part, null relevance counts 0.
    """
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = F.transform(F.col(vector), lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))
    base = rows.where(F.col(vector).isNotNull()).select(
        F.col(key).alias("k"), F.col(row_id).alias("i"), unit.alias("u"), F.coalesce(F.col(relevance).cast("double"), F.lit(0.0)).alias("s")
    )
    picks: DataFrame | None = None
    for n in range(1, most + 1):
        if picks is None:
            scored = base.select("k", "i", "u", "s", F.col("s").alias("gain"))
        else:
            held = picks.where("live").select(F.col("k").alias("p_k"), "ids", "us")
            met = base.join(held, F.col("k").eqNullSafe(F.col("p_k"))).where(~F.array_contains("ids", F.col("i")))
            alike = F.array_max(F.transform("us", lambda p: dot(F.col("u"), p)))
            scored = met.select("k", "i", "u", "s", F.round(balance * F.col("s") - (1 - balance) * F.greatest(alike, F.lit(0.0)), 12).alias("gain"))
        best = scored.groupBy("k").agg(F.min_by(F.struct("i", "u", "gain"), F.struct((-F.col("gain")).alias("g"), (-F.col("s")).alias("r"), "i")).alias("b"))
        if picks is None:
            picks = cut(best.select("k", F.array("b.i").alias("ids"), F.array("b.u").alias("us"), F.lit(True).alias("live")))
            continue
        new = best.select(F.col("k").alias("b_k"), "b")
        joined = picks.join(new, F.col("k").eqNullSafe(F.col("b_k")), "left")
        more = F.col("live") & F.coalesce(F.col("b.gain") >= least_gain, F.lit(False))
        picks = cut(joined.select(
            "k", F.when(more, F.array_append("ids", F.col("b.i"))).otherwise(F.col("ids")).alias("ids"), F.when(more, F.array_append("us", F.col("b.u"))).otherwise(F.col("us")).alias("us"), more.alias("live"),
        ))
    return picks.select(F.col("k").alias(key), F.posexplode("ids").alias("n", row_id)).select(key, row_id, (F.col("n") + 1).alias("pick"))


def hash_embedder(size: int = 64) -> Embedder:
    """An embedder without a model: signed counts of hashed words, for tests and offline work."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1 if h & 1 << 20 else -1
        return out

    return embed


def embedded(texts: DataFrame, text: str, embed: Embedder, known: DataFrame | None = None) -> DataFrame:
    """(text, vec) for each distinct text; those in ``known`` (text, vec) are not embedded again."""
    distinct = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    todo = distinct.join(known.select("text"), "text", "left_anti") if known is not None else distinct

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embed(batch.tolist()).astype("float32")))

    fresh = todo.select("text", vectors("text").alias("vec"))
    return fresh if known is None else known.select("text", "vec").join(distinct, "text", "left_semi").unionByName(fresh)


def pairs_above(queries: DataFrame, rows: DataFrame, row_id: str, vector: str, least: float, block: int = 2048) -> DataFrame:
    """(query, row, cosine) of a stated set of query vectors and all rows whose cosine is at least ``least``, themselves left out.

    In blocks like ``search``; every pair above the threshold comes out.
    """
    return _in_blocks(queries, rows, row_id, vector, block, lambda s: s >= least)


def centroid_likeness(parts: DataFrame, key: str, vector: str, queries: DataFrame, query: str) -> DataFrame:
    """(key, likeness): cosine of the centroid of each key's known parts and the key's query vector, within 0 and 1; 0 where no part is known.

    Parts are averaged position by position, combined before the shuffle.
    """
    places = parts.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.posexplode(vector).alias("n", "x"))
    means = places.groupBy("k", "n").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = means.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda p: p.x).alias("c"))
    met = queries.select(F.col(key).alias("q_k"), F.col(query).alias("q")).join(centre, F.col("q_k") == F.col("k"), "left")
    like = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("c"), F.col("q"))))
    return met.select(F.col("q_k").alias(key), F.coalesce(F.when(F.col("c").isNotNull() & F.col("q").isNotNull(), like), F.lit(0.0)).alias("likeness"))


def paired_scores(rows: DataFrame, first: str, second: str, embed_first: Callable[[], Embedder], embed_second: Callable[[], Embedder], name: str = "score") -> DataFrame:
    """``rows`` with the cosine of two texts, each embedded by its own encoder, made once per task; null where a text is null."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        one, two = embed_first(), embed_second()
        for a, b in batches:
            known = (a.notna() & b.notna()).to_numpy()
            out = np.full(len(a), np.nan)
            if known.any():
                x, y = one(a[known].tolist()), two(b[known].tolist())
                size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                out[known] = np.where(size > 0, (x * y).sum(axis=1) / np.where(size > 0, size, 1), 0.0)
            yield pd.Series(out)

    value = score(F.col(first), F.col(second))
    return rows.withColumn(name, F.when(F.col(first).isNotNull() & F.col(second).isNotNull(), value))
