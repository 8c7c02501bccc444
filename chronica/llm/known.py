"""Attributes as known at event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.operators.shards import HotGroups, running_max


def as_known_at(
    events: DataFrame,
    versions: DataFrame,
    entity: list[str],
    time: str,
    carried: list[str],
    shard: Column,
    inclusive: Column | None = None,
    most_rows: int = 500_000,
) -> DataFrame:
    """Each event with the last version of its entity known before it.

    ``events`` and ``versions`` share the columns ``entity`` and ``time``, of one type. Gives the
    columns of ``events`` and, for the last version strictly before the event (or at it too, where
    ``inclusive``, a condition on the event's columns, holds), known_at and ``carried``; null if
    nothing was known. Versions of the same time are ordered by ``carried``, the greatest last.
    Events with a null time keep null attributes; versions with a null time are never known. Null
    entities match each other. Repeated events stay, repeated versions change nothing. Empty
    tables give what they can: no events no rows, no versions null attributes.

    ``shard`` is a number, a function of ``time`` that never falls as time rises. An entity of more than
    ``most_rows`` is cut by it into shards of about equal numbers of rows; each shard gets the last version before it as carry-in, by
    a running maximum over one row per shard, and is then merged by itself. A version in an earlier
    shard is earlier in time, so the cut never changes what is known.
    """
    keys = [f"k{i}" for i in range(len(entity))]
    named = [F.col(c).alias(k) for c, k in zip(entity, keys)]
    at = F.struct(F.col(time).alias("known_at"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(carried)])
    known = versions.where(F.col(time).isNotNull()).select(*named, F.col(time).alias("t"), F.lit(1).alias("kind"), at.alias("v"), shard.alias("shard"))
    after = F.lit(0) if inclusive is None else F.when(inclusive, 2).otherwise(0)
    rest = [c for c in events.columns if c not in entity and c != time]
    event = F.struct(F.lit(1).alias("e"), *[F.col(c).alias(f"e{i}") for i, c in enumerate(rest)])
    asked = events.select(*named, F.col(time).alias("t"), after.alias("kind"), shard.alias("shard"), event.alias("event"))
    both = asked.unionByName(known, allowMissingColumns=True)
    merged = running_max(both, keys, [F.col("t"), F.col("kind")], "v", "seen", F.col("shard"), most_rows)
    found = F.when(F.col("t").isNotNull(), F.col("seen"))
    merged = merged.where("event is not null").select(*keys, "t", "event", found.alias("known"))
    back = {**{c: F.col(k) for c, k in zip(entity, keys)}, time: F.col("t"), **{c: F.col(f"event.e{i}") for i, c in enumerate(rest)}}
    return merged.select(
        *[back[c].alias(c) for c in events.columns], "known.known_at", *[F.col(f"known.v{i}").alias(c) for i, c in enumerate(carried)]
    )


def was_known(
    pairs: DataFrame, keys: list[str], asked: str, known: str, inclusive: Column | None = None, most_rows: int = 500_000
) -> DataFrame:
    """``as_known_at`` for rows that hold both an event and a version: (keys, known_at).

    Each row of an entity asks at the time ``asked`` and tells a time ``known`` at which something was known of it, both
    of one numeric type. Per entity the rows are first reduced to the earliest of both, combined before the shuffle: what was
    known at all is known at the earliest asking if its first version is. The event and the version of an entity then
    go through the same merge, without another exchange. Entities with a null ``asked`` or without any ``known`` are left out.
    ``inclusive`` is a condition on the keys.
    """
    first = pairs.groupBy(*keys).agg(F.min(asked).alias("w_asked"), F.min(known).alias("w_known")).where("w_asked is not null and w_known is not null")
    after = F.lit(0) if inclusive is None else F.when(inclusive, 2).otherwise(0)
    nothing = F.lit(None).cast(pairs.schema[known].dataType)
    both = first.select(*keys, F.inline(F.array(
        F.struct(F.col("w_asked").alias("t"), after.alias("kind"), nothing.alias("v")), F.struct(F.col("w_known").alias("t"), F.lit(1).alias("kind"), F.col("w_known").alias("v")),
    )))
    hot = HotGroups(both, keys, most_rows, largest=2)
    merged = running_max(both, keys, [F.col("t"), F.col("kind")], "v", "known_at", F.col("t"), hot=hot)
    return merged.where("kind <> 1").select(*keys, "known_at")


def concept_times(profiles: DataFrame) -> DataFrame:
    """Every time a concept has in a profile: (dose_id, index_t0, concept, known_text).

    The time in a visit is the concept's stamp there, or the visit's admission time if it has none.
    Concepts without either have no time. Null lists and maps are empty; blank stamps are none.
    """
    visits = profiles.select("dose_id", "index_t0", F.explode("visits").alias("v"))
    empty = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(*[F.coalesce(F.col(f"v.{c}"), empty) for c in ("conditions", "procedures", "drugs")]))
    rows = visits.select("dose_id", "index_t0", F.explode(names).alias("concept"), F.col("v.concept_times").alias("m"), F.col("v.admittime").alias("a"))
    stamp = F.trim(F.try_element_at("m", F.col("concept")))
    admitted = F.trim("a")
    return rows.where(F.col("concept").isNotNull()).select(
        "dose_id", "index_t0", "concept", F.when(stamp != "", stamp).when(admitted != "", admitted).alias("known_text")
    )
