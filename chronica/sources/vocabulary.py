"""Reductions of a pipe-separated medical vocabulary: semantic types, tree numbers, names, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.functions.scalars import normalised


def codes_of_types(rows: DataFrame, code: str, kind: str, allowed: list[str]) -> DataFrame:
    """Codes with their sorted types, of those allowed."""
    return rows.where(F.col(kind).isin(allowed)).groupBy(code).agg(F.sort_array(F.collect_set(kind)).alias("types"))


def codes_in_tree(rows: DataFrame, code: str, name: str, value: str, attribute: str, prefixes: list[str] | None) -> DataFrame:
    """Codes that have a tree number, any or one with a prefix."""
    kept = rows.where(F.col(name) == attribute)
    if prefixes is not None:
        match = F.lit(False)
        for p in prefixes:
            match = match | F.col(value).startswith(p)
        kept = kept.where(match)
    return kept.select(code).distinct()


def preferred_names(rows: DataFrame, code: str, term: str, order: str, preferred: Column, language: str, languages: list[str]) -> DataFrame:
    """One name per code: the first preferred one in ``order``, else the first of all."""
    kept = rows.where(F.col(language).isin(languages) & (F.trim(term) != ""))
    return kept.groupBy(code).agg(F.min_by(term, F.struct(F.when(preferred, 0).otherwise(1).alias("p"), F.col(order).alias("o"))).alias(term))


def code_index(rows: DataFrame, code: str, term: str, order: str, wanted: DataFrame, name: str) -> DataFrame:
    """Normalised wanted names with the code of their first term in ``order``: (name, code)."""
    keys = wanted.select(normalised(F.col(name)).alias("name")).distinct()
    named = rows.select(normalised(F.col(term)).alias("name"), F.col(code).alias("code"), F.col(order).alias("o"))
    return named.join(keys, "name", "left_semi").groupBy("name").agg(F.min_by("code", "o").alias("code"))


def relation_label(general: Column, specific: Column, names: dict[str, str]) -> Column:
    """The specific relation where there is one, else the name of the general code, else the code."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.nullif(F.trim(specific), F.lit("")), F.try_element_at(table, general), general)


def reduced_relations(
    rows: DataFrame, first: str, second: str, general: str, specific: str, source: str, suppressed: str, keep: DataFrame, code: str, sources: list[str], dropped: list[str], names: dict[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (head, relation, tail), read from the second code to the first, and rows by reason.

    A row goes for the first reason that holds: suppressed, source, relation, self, gate.
    """
    a = keep.select(F.col(code).alias(first), F.lit(True).alias("k1")).distinct()
    b = keep.select(F.col(code).alias(second), F.lit(True).alias("k2")).distinct()
    joined = rows.join(a, first, "left").join(b, second, "left")
    reason = (
        F.when(~F.coalesce(F.col(suppressed), F.lit("N")).isin("N", ""), "suppressed")
        .when(~F.coalesce(F.col(source).isin(sources), F.lit(False)), "source")
        .when(F.col(general).isin(dropped), "relation")
        .when(F.col(first) == F.col(second), "self")
        .when(F.col("k1").isNull() | F.col("k2").isNull(), "gate")
        .otherwise("kept")
    )
    marked = joined.withColumn("reason", reason)
    label = relation_label(F.col(general), F.col(specific), names)
    edges = marked.where("reason = 'kept'").select(F.col(second).alias("head"), label.alias("relation"), F.col(first).alias("tail")).distinct()
    return edges, marked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def child_terms(names: DataFrame, relations: DataFrame, roots: DataFrame, root: str) -> DataFrame:
    """(root, name): names of the direct children of each root code; ``names`` is (code, name), ``relations`` (head, relation, tail)."""
    children = relations.where("relation = 'isa'").select(F.col("tail").alias(root), F.col("head").alias("code"))
    return roots.select(root).distinct().join(children, root).join(names, "code").select(root, "name").distinct()
