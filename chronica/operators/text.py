"""Documents to sentences, chunks, quantities and term links."""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "vs.", "i.v.", "et al.", "approx.", "Fig.", "Figs.", "No.", "ca.", "cf.", "etc.", "Dr.", "min.", "max.")
HIDDEN = "\u0001"


def sentences(text: Column) -> Column:
    """Sentences of a text; abbreviations don't end one; blank ones go."""
    safe = text
    for a in ABBREVIATIONS:
        safe = F.replace(safe, F.lit(a), F.lit(a.replace(".", HIDDEN)))
    parts = F.transform(F.split(safe, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(F.translate(s, HIDDEN, ".")))
    return F.filter(parts, lambda s: s != "")


def clean(text: Column) -> Column:
    """Ligatures spelled out, soft hyphens dropped, white space collapsed."""
    out = text
    for a, b in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("­", "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def chunks(units: Column, most_words: int = 400) -> Column:
    """Consecutive units packed into chunks of at most ``most_words`` words; a longer unit stands alone."""
    words = lambda s: F.size(F.split(F.trim(s), r"\s+"))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def add(state: Column, unit: Column) -> Column:
        n = words(unit)
        fits = (state.n + n <= most_words) & (state.n > 0)
        first = state.n == 0
        done = F.when(fits | first, state.done).otherwise(F.array_append(state.done, state.open))
        joined = F.when(fits, F.concat(state.open, F.lit(" "), unit)).otherwise(unit)
        return F.struct(done.alias("done"), joined.alias("open"), F.when(fits, state.n + n).otherwise(n).alias("n"))

    return F.aggregate(units, empty, add, lambda s: F.when(s.n > 0, F.array_append(s.done, s.open)).otherwise(s.done))


#: Units of a dose and what they are in milligrams.
DOSE_UNITS = {"mg": 1.0, "g": 1000.0, "mcg": 0.001, "µg": 0.001}
#: Words before a dose that make it a bound.
BOUNDS = {
    "above": ">", "over": ">", ">": ">", "below": "<", "under": "<", "<": "<", "up to": "<=", "at most": "<=", "no more than": "<=", "maximum of": "<=", "maximum": "<=", "not exceed": "<=",
    "<=": "<=", "≤": "<=", "at least": ">=", "minimum of": ">=", "minimum": ">=", ">=": ">=", "≥": ">=",
}
_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
#: One dose: (bound), (low), (high), (unit), (basis). Concentrations such as mg/dL are none.
QUANTITY = (
    r"(?i)(?:(" + "|".join(sorted(BOUNDS, key=lambda b: (-len(b), b))) + r")\s*)?\b" + _NUMBER + r"(?:\s*(?:-|–|—|to)\s*" + _NUMBER + r")?\s*(mcg|µg|mg|g)\b(?:(\s*/\s*(?:kg|h|hour|day|dose)\b(?:\s*/\s*(?:h|hour|day)\b)?|\s+(?:per|a)\s+(?:kg|hour|day|dose)\b))?"
)
#: The same for Java, which passes quickly over places where neither a bound nor a number starts; the parts of a match are read from it alone.
_FAST = "(?=[0-9" + "".join(sorted({c for b in BOUNDS for c in (b[0].lower(), b[0].upper())})) + "])" + QUANTITY


def _without_thousands(text: Column) -> Column:
    return F.regexp_replace(text, r"([0-9]),([0-9]{3})\b", "$1$2")


def quantities(text: Column) -> Column:
    """Doses named in a text, as an array of (comparator, basis, low_mg, high_mg) in the order of the text; null names none.

    A bound before the number makes a comparator, else it is ``=``; the basis is what stands after the unit, such as kg, h,
    day or kg/h, else dose. Separators of thousands are dropped first.
    """
    found = F.regexp_extract_all(_without_thousands(text), F.lit(_FAST), 0)
    sign = F.create_map(*[F.lit(x) for kv in BOUNDS.items() for x in kv])
    scale = F.create_map(*[F.lit(x) for kv in DOSE_UNITS.items() for x in kv])

    def dose(hit: Column) -> Column:
        bound, first, second, unit, basis = (F.regexp_extract(hit, QUANTITY, k) for k in range(1, 6))
        factor = F.element_at(scale, F.lower(unit))
        low = first.cast("double") * factor
        basis = F.replace(F.regexp_replace(F.regexp_replace(F.lower(basis), r"\s+|per|\ba\b", ""), "^/", ""), F.lit("hour"), F.lit("h"))
        return F.struct(
            F.coalesce(F.try_element_at(sign, F.lower(bound)), F.lit("=")).alias("comparator"), F.when(basis == "", "dose").otherwise(basis).alias("basis"), low.alias("low_mg"),
            F.when(second == "", low).otherwise(second.try_cast("double") * factor).alias("high_mg"),
        )

    return F.transform(found, dose)


def quantities_in(text: str) -> list[tuple[str, str, float, float]]:
    """``quantities`` of one text outside of Spark."""
    out = []
    for m in re.finditer(QUANTITY, re.sub(r"([0-9]),([0-9]{3})\b", r"\1\2", text)):
        scale = DOSE_UNITS[m.group(4).lower()]
        low = float(m.group(2)) * scale
        basis = re.sub(r"\s+|per|\ba\b", "", (m.group(5) or "").lower()).removeprefix("/").replace("hour", "h")
        out.append((BOUNDS.get((m.group(1) or "").lower(), "="), basis or "dose", low, float(m.group(3)) * scale if m.group(3) else low))
    return out


def quantity_mentions(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per dose named in a text: (doc_id, n, comparator, basis, low_mg, high_mg). Null texts name none. Whole texts are read, in the JVM."""
    return docs.select(doc_id, F.posexplode(quantities(F.col(text))).alias("n", "q")).select(doc_id, "n", "q.*")


def masked_doses(text: Column) -> Column:
    """A text with its doses replaced by a mark."""
    return F.regexp_replace(text, r"(?i)\b\d+(?:\.\d+)?(?:\s*(?:-|–|to)\s*\d+(?:\.\d+)?)?\s*(?:mcg|µg|mg|g)\b", "<dose>")


def equal_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Each distinct text as its key, least document id and number of documents."""
    key = F.substring(F.sha2(F.col(text), 256), 1, 24)
    return docs.where(F.col(text).isNotNull()).groupBy(key.alias("text_key")).agg(F.min(doc_id).alias("first_id"), F.count(F.lit(1)).alias("n"))


def term_links(docs: DataFrame, doc_id: str, text: str, terms: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, concept, n): how often each concept's terms stand in a text as whole words, longest match first.

    ``terms`` is a dictionary of (concept, term). One pattern of all terms, longest first, is run
    once over each text, so a term inside a longer one doesn't count.
    """
    by = sorted({t.lower(): c for c, t in terms}.items(), key=lambda x: (-len(x[0]), x[0]))
    pattern = r"(?i)\b(" + "|".join(re.escape(t) for t, _ in by) + r")\b"
    concept = F.create_map(*[F.lit(x) for t, c in by for x in (t, c)])
    hits = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), 1), lambda h: F.element_at(concept, F.lower(h)))
    return docs.select(doc_id, F.explode(hits).alias("concept")).groupBy(doc_id, "concept").agg(F.count(F.lit(1)).alias("n"))


def linked_terms(docs: DataFrame, doc_id: str, text: str, terms: DataFrame, most_words: int = 5, most_terms: int = 100_000) -> DataFrame:
    """(doc_id, concept, term, n): terms of a dictionary of any size that stand in a text as whole words, the longest match winning.

    ``terms`` (concept, term) is joined by equality with the runs of one to ``most_words`` words that begin with the first word of a term, so
    neither a pattern nor a list grows with it; terms of more words match nothing. Words are runs of letters, digits and marks on letters, without
    regard to case. A match inside a longer one of another concept doesn't count. Matches are compared inside their text only, each with those that
    start fewer than ``most_words`` words before it, as no other is long enough to hold it. Null texts hold none.

    A dictionary of at most ``most_terms`` terms is sent to every task, and only matches are shuffled; which way is taken never changes the rows.
    """
    words = lambda c: F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{M}\p{N}]+"), "")
    split = terms.select("concept", "term", words(F.col("term")).alias("l_words"))
    known = split.select("concept", "term", F.array_join("l_words", " ").alias("l_run"), F.get("l_words", F.lit(0)).alias("l_first")).where("l_run <> ''").distinct()
    # A local table from Python has no known size, so adaptive execution would shuffle every run before it sees how few terms there are.
    sent = F.broadcast if known.limit(most_terms + 1).count() <= most_terms else lambda df: df
    each = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("l_doc"), words(F.col(text)).alias("w"))
    # The outer form, else the words are split once more by a filter for texts without any; these go in the join.
    at = each.select("l_doc", "w", F.posexplode_outer("w").alias("s", "first"))
    ahead = at.select("l_doc", "s", "first", F.slice("w", F.col("s") + 1, most_words).alias("ahead"))  # never the whole text with every word of it
    starts = ahead.join(sent(known.select("l_first").distinct()), F.col("first") == F.col("l_first"), "left_semi")
    run = lambda n: F.when(F.size("ahead") >= n, F.struct((F.col("s") + n).alias("e"), F.array_join(F.slice("ahead", 1, n), " ").alias("run")))
    runs = starts.select("l_doc", "s", F.explode(F.array(*[run(n) for n in range(1, most_words + 1)])).alias("r")).where("r is not null")
    hits = runs.join(sent(known.drop("l_first")), F.col("r.run") == F.col("l_run")).select("l_doc", "concept", "term", "s", F.col("r.e").alias("e"))
    near = Window.partitionBy("l_doc").orderBy("s").rangeBetween(1 - most_words, 0)
    beside = hits.withColumn("h", F.collect_set(F.struct("concept", "s", "e")).over(near))
    longer = F.exists("h", lambda y: (y.e >= F.col("e")) & (y.e - y.s > F.col("e") - F.col("s")) & (y.concept != F.col("concept")))
    return beside.where(~longer).groupBy(F.col("l_doc").alias(doc_id), "concept", "term").agg(F.count(F.lit(1)).alias("n"))


def context(text: Column, term: str, words: int = 15) -> Column:
    """A term's first mention with at most so many words on either side."""
    pattern = rf"(?is)((?:\S+\s+){{0,{words}}}\S*\b{re.escape(term)}\b\S*(?:\s+\S+){{0,{words}}})"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def under_headings(blocks: DataFrame, source: str, order: str, level: str, text: str, deepest: int = 6) -> DataFrame:
    """Text blocks with the path of headings above them, as an array; headings themselves go.

    ``level`` is 0 for text and 1 to ``deepest`` for headings. A heading ends those at and below
    its own level.
    """
    w = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows, names = blocks, []
    for k in range(1, deepest + 1):
        mark = F.when(F.col(level) == k, F.struct(F.col(order).alias("o"), F.col(text).alias("t")))
        rows = rows.withColumn(f"h_{k}", F.last(mark, ignorenulls=True).over(w))
        rows = rows.withColumn(f"h_cut_{k}", F.last(F.when((F.col(level) < k) & (F.col(level) > 0), F.col(order)), ignorenulls=True).over(w))
        live = F.col(f"h_{k}").isNotNull() & (F.col(f"h_cut_{k}").isNull() | (F.col(f"h_{k}.o") > F.col(f"h_cut_{k}")))
        names.append(F.when(live, F.col(f"h_{k}.t")))
    path = F.filter(F.array(*names), lambda x: x.isNotNull())
    return rows.where(F.col(level) == 0).select(*blocks.columns, path.alias("section_path"))


def table_units(passage: Column) -> Column:
    """The units of a table passage: each sentence of each line after the first, behind the first line as its header; a table of one line is its own unit."""
    lines = F.filter(F.split(passage, "\n"), lambda x: F.trim(x) != "")
    head = F.get(lines, F.lit(0))
    rest = F.flatten(F.transform(F.slice(lines, 2, 1_000_000), sentences_of))
    return F.when(F.size(rest) > 0, F.transform(rest, lambda s: F.concat(head, F.lit(" || "), s))).otherwise(F.array(passage))


def sentences_of(line: Column) -> Column:
    """``sentences`` as a function of one element of an array."""
    return sentences(line)


def header_basis(passage: Column, words: str = r"per day|/day|daily|a day|24 ?h") -> Column:
    """``day`` where the header of a table cell, the text before its colon, speaks of a day; else null."""
    cell = F.element_at(F.split(passage, r"\|"), -1)
    return F.when(F.contains(cell, F.lit(":")) & F.split(cell, ":")[0].rlike(f"(?i){words}"), "day")
