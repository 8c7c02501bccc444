"""Readers and writers: all-text CSV, pipe-separated vocabulary files, JSON lines, locked files, resumable units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronica.operators.codes import first_wins


def read_text_csv(spark: SparkSession, path: str, columns: list[str], keep: Column | None = None, sep: str = ",") -> DataFrame:
    """A CSV file with a header, as text: the given columns, blanks kept as empty text, an optional filter."""
    header = spark.read.option("sep", sep).csv(path, header=True, inferSchema=False, enforceSchema=False)
    rows = header.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])
    return rows if keep is None else rows.where(keep)


def as_number(text: Column) -> Column:
    """A number, or null where the text is none."""
    return F.trim(text).try_cast("double")


def as_time(text: Column) -> Column:
    """A wall-clock time, or null where the text is none."""
    return F.trim(text).try_cast("timestamp_ntz")


def read_pipes(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A pipe-separated file without header or quoting; the first columns get the given names, short lines nulls."""
    parts = spark.read.text(path).select(F.split("value", r"\|", -1).alias("p"))
    return parts.select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(names)])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; blank and broken lines are skipped, or raise if ``strict``."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Three tab-separated columns; lines of another width are dropped."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p")).where(F.size("p") == 3)
    return parts.select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("head", "relation", "tail"))])


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """(code, category) by position; of a repeated code the first line wins; a category is cut at its first comma."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    named = rows.toDF("code", "category", *[f"c{i}" for i in range(2, len(rows.columns))])
    # One file of a code table is read in order by its rows' ids.
    return first_wins(named.withColumn("ord", F.monotonically_increasing_id()), "code", "category", "ord")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Compressed CSV with a header and the columns in the given order."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, compression="gzip")


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines, nested values kept."""
    df.write.mode("overwrite").json(path)


def write_triples(df: DataFrame, path: str) -> None:
    """Distinct tab-separated triples."""
    df.select(F.concat_ws("\t", "head", "relation", "tail").alias("value")).distinct().write.mode("overwrite").text(path)


def verify_locked(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Files against a manifest (name, sha256): state is ok, locked_now, changed or missing."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    joined = manifest.join(files, "name", "left")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "locked_now").when(F.col("sha256") == F.col("found"), "ok").otherwise("changed")
    return joined.select("name", F.coalesce("found", "sha256").alias("sha256"), state.alias("state"))


def pending(units: DataFrame, log: DataFrame, unit: str) -> DataFrame:
    """Units whose last entry in an append-only log (unit, at, ok) is not good, or that have none."""
    last = log.groupBy(unit).agg(F.max_by("ok", "at").alias("ok")).where("ok")
    return units.join(last.select(unit), unit, "left_anti")


def settings(base: dict, local: dict) -> dict:
    """Settings with local overrides, merged level by level."""
    out = dict(base)
    for k, v in local.items():
        out[k] = settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, split: str | None = None, split_column: str = "split") -> DataFrame:
    """Files that each hold one JSON array of rows, optionally only the rows of a split. A file is read by one task, as an array can't be cut."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows if split is None else rows.where(F.col(split_column) == split)


def read_keyed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of one JSON object each, from keys to values of ``schema``, as (key, value)."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.explode(F.from_json("value", f"map<string,{schema}>")))


def write_keyed_json(df: DataFrame, path: str, key: str, value: Column) -> None:
    """One JSON object a line, from the key to the value; lines keep the rows apart, so nothing is gathered."""
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), value)).alias("value")).write.mode("overwrite").text(path)


def read_patterns(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(pattern, class) in the order of the lines of a small tab-separated file; comments (``#``) and blank lines are skipped."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    rows = [x.split("\t") for text in lines for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    return [(r[0].strip(), r[1].strip()) for r in rows if len(r) > 1]


def read_names(spark: SparkSession, path: str, code: str, name: str, level: str | None = None, wanted: str | None = None) -> DataFrame:
    """A dictionary (code, name) with names in lower case, optionally only of one level; blank names go."""
    columns = [code, name] + ([level] if level else [])
    rows = read_text_csv(spark, path, columns, F.col(level) == wanted if level else None)
    return rows.select(F.trim(code).alias("code"), F.lower(F.trim(name)).alias("name")).where("name <> ''").distinct()


def read_term_lists(spark: SparkSession, path: str) -> DataFrame:
    """(concept, terms) of a CSV file whose second column lists terms between pipes; comments, a header and concepts without terms are skipped."""
    rows = spark.read.csv(path, header=False, inferSchema=False, schema="concept string, listed string", mode="PERMISSIVE")
    concept = F.trim("concept")
    terms = F.filter(F.transform(F.split(F.coalesce("listed", F.lit("")), r"\|"), lambda t: F.trim(t)), lambda t: t != "")
    kept = rows.where(F.coalesce((concept != "") & ~concept.startswith("#") & (concept != "concept"), F.lit(False)))
    return kept.select(F.lower(concept).alias("concept"), terms.alias("terms")).where(F.size("terms") > 0)


def read_events_csv(spark: SparkSession, path: str, columns: list[str], eligible: str, bounds: dict[str, tuple[float, float]], order: list[str]) -> DataFrame:
    """Rows of a CSV file that are marked eligible and within their bounds (a missing number is not out of them), sorted."""
    rows = read_text_csv(spark, path, columns, F.lower(F.trim(eligible)).isin("true", "1"))
    inside = F.lit(True)
    for c, (low, high) in bounds.items():
        inside = inside & F.coalesce(as_number(F.col(c)).between(low, high), F.lit(True))
    return rows.where(inside).orderBy(*order)


def scope_tables(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """(profile, group, code) and (theme, term) of a nested scope: profiles name groups, groups list codes, seeds list terms by theme.

    A profile with a group that isn't there raises.
    """
    groups = config.get("groups", {})
    rows = []
    for profile, named in config.get("profiles", {}).items():
        for group in named:
            if group not in groups:
                raise ValueError(f"profile {profile} names the unknown group {group}")
            rows += [(profile, group, str(code)) for code in groups[group]]
    seeds = [(theme, term) for theme, terms in config.get("seeds", {}).items() for term in terms]
    return spark.createDataFrame(rows, "profile string, group string, code string"), spark.createDataFrame(seeds, "theme string, term string")


def load_settings(files: list[str], environment: dict[str, str], prefix: str = "CHRONICA_") -> dict:
    """Settings of YAML files, later ones over earlier ones, missing files passed over; environment variables over all of them.

    ``PREFIX_A__B`` sets b below a.
    """
    import os

    import yaml

    out: dict = {}
    for name in files:
        if os.path.exists(name):
            with open(name, encoding="utf-8") as text:
                out = settings(out, yaml.safe_load(text) or {})
    for name, value in sorted(environment.items()):
        if name.startswith(prefix):
            nested: dict | str = value
            for key in reversed(name[len(prefix) :].lower().split("__")):
                nested = {key: nested}
            out = settings(out, nested)
    return out


def manifest_faults(manifest: DataFrame, name: str, access: str, allowed: list[str]) -> DataFrame:
    """(name, fault) of entries that stand twice or have an unknown kind of access; empty for a good manifest."""
    twice = manifest.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name, F.lit("repeated").alias("fault"))
    unknown = manifest.where(~F.coalesce(F.col(access).isin(allowed), F.lit(False))).select(name, F.lit("unknown access").alias("fault")).distinct()
    return twice.unionByName(unknown)


def relocked(manifest: DataFrame, states: DataFrame) -> DataFrame:
    """A manifest with the hashes of files that had none, from ``verify_locked``; a changed file keeps its old hash."""
    fresh = states.where("state = 'locked_now'").select("name", F.col("sha256").alias("m_new"))
    return manifest.join(fresh, "name", "left").select(*[F.coalesce("sha256", "m_new").alias("sha256") if c == "sha256" else F.col(c) for c in manifest.columns])


def write_review(df: DataFrame, path: str, columns: list[str], human: list[str]) -> None:
    """A CSV file for reviewers: the given columns and blank ones to fill in."""
    df.select(*columns, *[F.lit(None).cast("string").alias(c) for c in human]).write.mode("overwrite").csv(path, header=True)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a cache of finished batches holds; an empty or missing cache gives an empty table."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/batch=*")
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def extend_cache(df: DataFrame, path: str, batch: str) -> None:
    """Add a batch to a cache. Spark moves a batch's files into place only once all of them are written, so a broken batch leaves nothing to read."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def paged(get, query: str, most_pages: int = 10_000) -> list[tuple[str, str]]:
    """(id, group) of a paged catalogue: ``get(query, page)`` gives the rows of a page and whether there is another; ids come once, in order."""
    seen: dict[str, str] = {}
    for page in range(1, most_pages + 1):
        rows, more = get(query, page)
        for row_id, group in rows:
            seen.setdefault(row_id, group)
        if not more:
            break
    return list(seen.items())
