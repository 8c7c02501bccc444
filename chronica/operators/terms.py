"""Terms, sections, conditions named in a text, and the units of a literature search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands at the end of a vocabulary name without being part of it.
QUALIFIERS = r"(?i)(?:\s*(?:\([^)]*\)|\[[^\]]*\]|,?\s*\bNOS|,?\s*\bunspecified))+\s*$"
ACRONYM = r"^[A-Z][A-Z0-9]{1,5}$"
#: Sections of a publication that hold no content.
NO_CONTENT = (
    "references?", "bibliography", "acknowledge?ments?", "disclosures?", "conflicts? of interest", "funding", "authors?(?:'s?)?(?: contributions| information)?",
    "abbreviations(?: and acronyms)?", "supplementary (?:material|data)", "appendix", "declaration of (?:competing )?interests?",
)


def bare_term(term: Column) -> Column:
    """A name without the qualifiers at its end, however many there are."""
    return F.trim(F.regexp_replace(F.trim(term), QUALIFIERS, ""))


def is_usable(term: Column, least: int = 3, least_single: int = 5) -> Column:
    """Whether a term is worth looking for: an acronym, several words, or a word of ``least_single`` letters; at least ``least`` letters in all others."""
    letters = F.length(F.regexp_replace(term, "[^A-Za-z]", ""))
    return F.coalesce(term.rlike(ACRONYM) | ((letters >= least) & (F.contains(F.trim(term), F.lit(" ")) | (F.length(term) >= least_single))), F.lit(False))


def plain_term(term: Column) -> Column:
    """The words of a term; of one written as a pattern (``re:``) what is left without its marks."""
    bare = F.trim(F.regexp_replace(F.substring(term, 4, 1_000_000), r"\\b|[\\()\[\]?*+^$|]", ""))
    return F.when(term.startswith("re:"), bare).otherwise(term)


def with_glyphs(text: Column, source: Column, glyphs: dict[str, dict[str, str]]) -> Column:
    """A text with the wrongly encoded characters of its source replaced; other sources stay as they are."""
    out = F.when(F.lit(False), text)
    for name, table in glyphs.items():
        out = out.when(source == name, reduce(lambda c, ab: F.replace(c, F.lit(ab[0]), F.lit(ab[1])), table.items(), text))
    return out.otherwise(text)


def is_left_out(heading: Column) -> Column:
    """Whether a heading opens a section without content, such as references, numbered or not."""
    return F.coalesce(heading.rlike(r"(?i)^\W*(?:\d+(?:\.\d+)*\.?\s*)?(?:" + "|".join(NO_CONTENT) + r")\b"), F.lit(False))


def is_footnote(text: Column) -> Column:
    """Whether a paragraph is a note below a table: nothing but grades of evidence, or two or more parts of which four fifths explain a short form."""
    parts = F.filter(F.transform(F.split(text, r"[;.](?:\s+|$)"), lambda p: F.trim(p)), lambda p: p != "")
    grades = F.forall(parts, lambda p: p.rlike(r"(?i)^\W*(?:[a-z]\s*)?(?:class of recommendation|level of evidence)\W*$"))
    explained = F.size(F.filter(parts, lambda p: F.contains(p, F.lit("=")) & (F.length(F.trim(F.split(p, "=")[0])) <= 40)))
    return F.coalesce((F.size(parts) > 0) & (grades | ((F.size(parts) >= 2) & (explained >= 0.8 * F.size(parts)))), F.lit(False))


_N = r"[0-9]+(?:\.[0-9]+)?"
_SIGN = r"(<=|>=|<|>|≤|≥|of|below|above)?"
#: Conditions with a value, as a pattern of (comparison, value).
VALUED = {
    "egfr": rf"(?i)\b(?:e?GFR|CrCl|creatinine clearance)\s*{_SIGN}\s*({_N})",
    "ckd_stage": r"(?i)\b(?:CKD\s*)?stage()\s*([1-5])\b",
    "nyha": r"(?i)\bNYHA\s*(?:class\s*)?()(IV|III|II|I)\b",
    "age": rf"(?i)\baged?\s*{_SIGN}\s*({_N})",
}
#: Conditions that a text names or doesn't.
FLAGS = {
    "loop_naive": r"\bnaive\b|not (?:previously )?(?:receiving|taking|on) (?:a )?loop", "loop_exposed": r"already (?:on|receiving|taking)|home dose|(?:previous|daily) oral dose|oral maintenance",
    "paediatric": r"\bpa?ediatric|\bchildren\b|\binfants?\b|\bneonat", "older_adults": r"\belderly\b|older adults|geriatric",
    "acute_hf": r"acute (?:decompensated )?heart failure|\bA[HD]HF\b|\bAHF\b|acute pulmonary o?edema", "chronic_hf": r"chronic heart failure|\bHF[rp]EF\b|\bCHF\b",
    "cirrhosis": r"cirrho|\bascites\b", "aki": r"\bAKI\b|acute kidney injury|acute renal failure", "ckd": r"\bCKD\b|chronic kidney disease|renal (?:impairment|insufficiency)",
    "nephrotic": r"nephrotic", "dialysis": r"dialysis",
}


def condition_facts(text: Column, section: Column) -> Column:
    """The conditions a passage names in its section path or text: a sorted array of (name, sign, value), each once."""
    scope = F.concat_ws(" || ", section, text)
    fact = lambda name: lambda s, v: F.struct(F.lit(name).alias("name"), F.lower(s).alias("sign"), F.upper(v).alias("value"))
    parts = []
    for name, pattern in VALUED.items():
        signs, values = (F.regexp_extract_all(scope, F.lit(pattern), k) for k in (1, 2))
        parts.append(F.zip_with(signs, values, fact(name)))
    flags = [F.when(scope.rlike(f"(?i){p}"), F.struct(F.lit(n).alias("name"), F.lit("").alias("sign"), F.lit("").alias("value"))) for n, p in FLAGS.items()]
    parts.append(F.filter(F.array(*flags), lambda x: x.isNotNull()))
    return F.sort_array(F.array_distinct(F.concat(*parts)))


def search_query(terms: Column, companions: Column, anchor: str | None = None) -> Column:
    """A boolean search over titles and abstracts: any of the terms, any of the companions if there are some, and the anchor."""
    any_of = lambda a: F.array_join(F.transform(a, lambda t: F.concat(F.lit('"'), t, F.lit('"[tiab]'))), " OR ")
    body = F.concat(F.lit("("), any_of(terms), F.lit(")"))
    both = F.when(F.size(F.coalesce(companions, F.array().cast("array<string>"))) > 0, F.concat(F.lit("("), body, F.lit(" AND ("), any_of(companions), F.lit("))"))).otherwise(body)
    return F.concat(both, F.lit(f" AND {anchor}")) if anchor else both


def search_units(names: DataFrame, companions: DataFrame, themes: DataFrame, most_sets: int, least: int = 3, shown: int = 6) -> DataFrame:
    """(key, kind, concepts, terms, others): what to search for, of three kinds.

    ``names`` (name, terms) gives one unit per concept with its companions; ``themes`` (theme, terms) one per theme; and the ``most_sets``
    names with most companions among the names, ``least`` of them or more, ties by name, one each as a set with ``shown`` companions. ``companions`` has name,
    other, rank.
    """
    by = companions.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x.other).alias("others"))
    known = companions.join(names.select(F.col("name").alias("other")).distinct(), "other", "left_semi")
    in_scope = known.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x.other).alias("others"))
    none = F.array().cast("array<string>")
    first = F.slice(F.coalesce("others", none), 1, 20)
    concept = names.join(by, "name", "left").select(
        F.concat(F.lit("concept::"), "name").alias("key"), F.lit("concept").alias("kind"), F.concat(F.array("name"), first).alias("concepts"), "terms", none.alias("others")
    )
    theme = themes.select(F.concat(F.lit("seed::"), "theme").alias("key"), F.lit("seed_theme").alias("kind"), F.col("terms").alias("concepts"), F.slice("terms", 1, 6).alias("terms"), none.alias("others"))
    ranked = names.join(in_scope, "name").where(F.size("others") >= least).orderBy(F.size("others").desc(), "name").limit(most_sets)
    sets = ranked.select(
        F.concat(F.lit("set::"), "name").alias("key"), F.lit("concept_set").alias("kind"), F.concat(F.array("name"), first).alias("concepts"), "terms", F.slice("others", 1, shown).alias("others")
    )
    return concept.unionByName(theme).unionByName(sets)
