"""Finding the unit a quantity was recorded in, and converting it to the common unit."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Powers of ten of metric prefixes, by spelling.
PREFIXES = {
    "k": 3, "kilo": 3, "d": -1, "deci": -1, "c": -2, "centi": -2, "m": -3, "milli": -3,
    "u": -6, "µ": -6, "micro": -6, "n": -9, "nano": -9,
}
#: Spelling of a root, then its base dimensions with exponents and its power of ten.
ROOTS = {
    "g": ({"g": 1}, 0), "gram": ({"g": 1}, 0), "grams": ({"g": 1}, 0), "gramme": ({"g": 1}, 0),
    "grammes": ({"g": 1}, 0), "kilo": ({"g": 1}, 3), "kilos": ({"g": 1}, 3),
    "lb": ({"lb": 1}, 0), "lbs": ({"lb": 1}, 0), "pound": ({"lb": 1}, 0), "pounds": ({"lb": 1}, 0), "#": ({"lb": 1}, 0),
    "oz": ({"oz": 1}, 0), "ounce": ({"oz": 1}, 0), "ounces": ({"oz": 1}, 0),
    "m": ({"m": 1}, 0), "metre": ({"m": 1}, 0), "metres": ({"m": 1}, 0), "meter": ({"m": 1}, 0), "meters": ({"m": 1}, 0),
    "in": ({"in": 1}, 0), "inch": ({"in": 1}, 0), "inches": ({"in": 1}, 0), '"': ({"in": 1}, 0), "''": ({"in": 1}, 0),
    "ft": ({"ft": 1}, 0), "foot": ({"ft": 1}, 0), "feet": ({"ft": 1}, 0), "'": ({"ft": 1}, 0),
    "L": ({"L": 1}, 0), "l": ({"L": 1}, 0), "litre": ({"L": 1}, 0), "litres": ({"L": 1}, 0),
    "liter": ({"L": 1}, 0), "liters": ({"L": 1}, 0), "cc": ({"L": 1}, -3), "ccm": ({"L": 1}, -3),
    "mol": ({"mol": 1}, 0), "mole": ({"mol": 1}, 0), "moles": ({"mol": 1}, 0), "M": ({"mol": 1, "L": -1}, 0),
    "Pa": ({"Pa": 1}, 0), "pascal": ({"Pa": 1}, 0), "pascals": ({"Pa": 1}, 0),
    "mmHg": ({"mmHg": 1}, 0), "mm Hg": ({"mmHg": 1}, 0), "torr": ({"mmHg": 1}, 0),
    "C": ({"degC": 1}, 0), "degC": ({"degC": 1}, 0), "deg C": ({"degC": 1}, 0), "celsius": ({"degC": 1}, 0),
    "deg celsius": ({"degC": 1}, 0), "degrees celsius": ({"degC": 1}, 0), "centigrade": ({"degC": 1}, 0),
    "F": ({"degF": 1}, 0), "degF": ({"degF": 1}, 0), "deg F": ({"degF": 1}, 0), "fahr": ({"degF": 1}, 0),
    "fahrenheit": ({"degF": 1}, 0), "deg fahrenheit": ({"degF": 1}, 0), "degrees fahrenheit": ({"degF": 1}, 0),
    "K": ({"K": 1}, 0), "kelvin": ({"K": 1}, 0), "kelvins": ({"K": 1}, 0),
    "%": ({"%": 1}, 0), "pct": ({"%": 1}, 0), "percent": ({"%": 1}, 0), "per cent": ({"%": 1}, 0),
    "fraction": ({"fraction": 1}, 0),
    "bpm": ({"beat": 1, "min": -1}, 0), "beat": ({"beat": 1}, 0), "beats": ({"beat": 1}, 0),
    "min": ({"min": 1}, 0), "minute": ({"min": 1}, 0), "mins": ({"min": 1}, 0), "h": ({"h": 1}, 0), "hr": ({"h": 1}, 0), "hour": ({"h": 1}, 0),
}
#: Roots that take a metric prefix.
PREFIXED = {"g", "m", "L", "mol", "Pa", "M"}
#: What a bedside reading can be, in the common unit of its quantity.
BEDSIDE = {
    "temperature": (30.0, 45.0), "weight": (20.0, 350.0), "height": (100.0, 230.0),
    "systolic pressure": (45.0, 300.0), "glucose": (30.0, 800.0), "oxygen share": (15.0, 100.0),
    "urine volume": (5.0, 3000.0), "pulse": (15.0, 300.0), "breaths": (3.0, 80.0),
}

Canonical = tuple[tuple[tuple[str, int], ...], int]


class _Trie:
    """Spellings, walked one character at a time without regard to case."""

    def __init__(self, spellings: Iterable[str]):
        self.top: dict = {}
        for word in spellings:
            node = self.top
            for ch in word.lower():
                node = node.setdefault(ch, {})
            node.setdefault("", []).append(word)

    def at(self, text: str, i: int) -> Iterable[tuple[int, str]]:
        """All (end, spelling) that start at ``i``."""
        node = self.top
        while True:
            for word in node.get("", ()):
                yield i, word
            if i >= len(text) or text[i].lower() not in node:
                return
            node = node[text[i].lower()]
            i += 1


_PREFIX, _ROOT, _EXPONENT = _Trie(PREFIXES), _Trie(ROOTS), _Trie(["2", "3", "^2", "^3", "-1", "^-1", "²", "³", "⁻¹"])
_POWER = {"2": 2, "3": 3, "^2": 2, "^3": 3, "-1": -1, "^-1": -1, "²": 2, "³": 3, "⁻¹": -1}
#: Separators between factors and the sign they give to the exponent of the next one.
_JOINS = (("/", -1), (" / ", -1), (" per ", -1), ("per ", -1), ("·", 1), ("*", 1), (".", 1), (" ", 1))


def decompositions(text: str) -> dict[Canonical, float]:
    """Every reading of a unit string as prefixes, roots and exponents, with its cost.

    Dynamic programming from the end of the string: ``best[i]`` maps the dimensions and scale of
    the suffix from ``i`` to the least cost. A segment costs 1, a spelling in another case 0.5.
    """
    n = len(text)
    best: list[dict[Canonical, float]] = [{} for _ in range(n + 1)]
    best[n] = {((), 0): 0.0}

    def factor(i: int, sign: int) -> dict[Canonical, float]:
        out: dict[Canonical, float] = {}
        starts = [(i, 0, 0.0)] + [
            (j, PREFIXES[p], 0.5 * (text[i:j] != p)) for j, p in _PREFIX.at(text, i) if j > i
        ]
        for j, ten, cost in starts:
            for k, root in _ROOT.at(text, j):
                if k == j or (j > i and root not in PREFIXED and len(root) < 4):
                    continue
                if root == "M" and text[j:k] != root:
                    continue  # a small m is a metre or milli, never molar
                dims, scale = ROOTS[root]
                if root == "%" and i > 0 and j == i:
                    senses = [(dims, scale), ({"L": -1}, 1)]  # a mass before %: per 100 mL
                else:
                    senses = [(dims, scale)]
                ends = [(k, 1)] + [(e, _POWER[x]) for e, x in _EXPONENT.at(text, k) if e > k]
                for e, power in ends:
                    for d, s in senses:
                        for (rest, rest_ten), c in best[e].items():
                            total = dict(rest)
                            for base, x in d.items():
                                total[base] = total.get(base, 0) + x * power * sign
                            key = (tuple(sorted((b, x) for b, x in total.items() if x)), rest_ten + (ten + s) * power * sign)
                            price = c + cost + 1 + 0.5 * (text[j:k] != root)
                            if price < out.get(key, 99.0):
                                out[key] = price
        return out

    for i in range(n - 1, -1, -1):
        if i == 0:
            best[0] = factor(0, 1)
        elif text[i] == "%":
            best[i] = factor(i, 1)
        for join, sign in _JOINS:
            if text.lower().startswith(join, i) and (i > 0 or sign < 0):
                for key, price in factor(i + len(join), sign).items():
                    if price < best[i].get(key, 99.0):
                        best[i][key] = price
    return best[0]


class UnitNames:
    """Which unit of a quantity a text names."""

    def __init__(self, units: list[tuple[str, str]]):
        """``units``: (quantity, unit code) pairs. The codes are read by the same decomposition."""
        self.codes: dict[str, dict[Canonical, str]] = {}
        for quantity, code in units:
            readings = decompositions(code)
            if readings:
                self.codes.setdefault(quantity, {}).setdefault(min(readings, key=readings.get), code)
        self.seen: dict[tuple[str, str], str | None] = {}

    def named(self, text: str | None, quantity: str | None, most_words: int = 4) -> str | None:
        """The code of the first unit of ``quantity`` that ``text`` names; digits don't count.

        The words are tried in spans, longer ones first; the prior of a decomposition is one where
        its dimensions are those of a unit of the quantity, else zero, so ``m`` is a metre for a
        height and ``MD`` or ``F/U`` is no unit for a temperature.
        """
        if not text or quantity not in self.codes:
            return None
        key = (text, quantity)
        if key not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[key] = self._named(text, self.codes[quantity], most_words)
        return self.seen[key]

    @staticmethod
    def _named(text: str, codes: dict[Canonical, str], most_words: int) -> str | None:
        bare = re.sub(r"[°º]\s*", " deg ", re.sub(r"[0-9]+(?:[.,][0-9]+)*", " ", text))
        words = [w for w in (x.rstrip(".,;:") for x in re.split(r"[\s()\[\]]+", bare)) if w]
        for i in range(len(words)):
            for j in range(min(len(words), i + most_words), i, -1):
                span = " ".join(words[i:j])
                if len(span) > 40:
                    continue
                fit = [(c, codes[x]) for x, c in decompositions(span).items() if x in codes]
                if fit:
                    return min(fit)[1]
        return None


#: A number that isn't the tail of a word or of another number.
NUMBER = r"(?<![A-Za-z0-9.,])([0-9]+(?:[.,][0-9]+)?)"
FEET = r"(?i)^\s*([0-9]+)\s*(?:ft|feet|foot|')\s*([0-9]+(?:[.,][0-9]+)?)\s*(?:in|inch|inches|\"|'')?\s*$"


def to_common_units(
    df: DataFrame,
    items: DataFrame,
    units: DataFrame,
    keep: list[str],
    bedside: dict[str, tuple[float, float]] | None = None,
    item: str = "itemid",
    text: str = "value",
    number: str = "valuenum",
) -> DataFrame:
    """The numbers of ``df`` with the unit each was recorded in, and in their common unit.

    Gives the columns ``keep`` and quantity, number, from_unit, common_unit, common_value for the
    rows of an item with a quantity that hold a number, in ``number`` or else in ``text``. The unit
    is the one the text names; else the one the item declares or is labelled with, unless the
    number can't be a bedside reading in it but can be in another unit of the quantity; with
    neither, the first unit, the common one before the others, in which it can be one. If there is
    none, from_unit and common_value are null. Null, blank and very long texts name no unit unless
    one stands in them; repeated rows stay; NaN is no number; an empty table gives an empty table.

    ``items`` (itemid, label, quantity, unitname) and ``units`` (quantity, unit_code, is_common,
    mul_to_common, add_to_common) are definition tables of a fixed size; they are read on the
    driver. There is no shuffle: item facts come by a broadcast of those definitions, and only
    texts that hold more than a number go to Python, as shapes with their numbers masked.
    """
    ranges = BEDSIDE if bedside is None else bedside
    known = [r.asDict() for r in units.select("quantity", "unit_code", "is_common", "mul_to_common", "add_to_common").collect()]
    names = UnitNames([(u["quantity"], u["unit_code"]) for u in known])
    facts = []
    for r in items.select("itemid", "label", "quantity", "unitname").where("quantity is not null").collect():
        own = [u for u in known if u["quantity"] == r["quantity"]]
        declared = names.named(r["unitname"], r["quantity"]) or names.named(r["label"], r["quantity"])
        own.sort(key=lambda u: (u["unit_code"] != declared, not u["is_common"]))
        common = next((u["unit_code"] for u in own if u["is_common"]), None)
        low, high = ranges.get(r["quantity"], (float("-inf"), float("inf")))
        choices = [(u["unit_code"], float(u["mul_to_common"]), float(u["add_to_common"])) for u in own]
        facts.append((r["itemid"], r["quantity"], declared, common, float(low), float(high), choices))
    schema = "u_item string, u_quantity string, u_declared string, u_common string, u_low double, u_high double, u_choices array<struct<code:string,mul:double,add:double>>"
    small = F.broadcast(df.sparkSession.createDataFrame(facts, schema))

    @F.pandas_udf("string")
    def named_in(shape: pd.Series, quantity: pd.Series) -> pd.Series:
        return pd.Series([names.named(s, q) for s, q in zip(shape, quantity)], dtype=object)

    named = named_in.asNondeterministic()  # a filter on the unit must not name it a second time

    value = F.when(~F.isnan(number), F.col(number))
    dotted = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    feet = F.regexp_extract(text, FEET, 1)
    written = F.when(feet != "", feet.try_cast("double") * 12 + dotted(F.regexp_extract(text, FEET, 2))).otherwise(
        dotted(F.regexp_extract(text, NUMBER, 1))
    )
    rows = df.select(*keep, F.col(item).alias("u_key"), F.col(text).alias("u_text"), F.coalesce(value, written).alias("u_number"))
    rows = rows.where("u_number is not null").join(small, F.col("u_key") == F.col("u_item"))
    more = F.regexp_replace("u_text", r"[0-9]+([.,][0-9]+)*", "0")
    shape = F.when(~F.trim(more).isin("", "0"), more)
    rows = rows.withColumn("u_shape", shape)
    rows = rows.withColumn("u_named", F.when(F.col("u_shape").isNotNull(), named("u_shape", "u_quantity")))
    fits = F.get(
        F.filter("u_choices", lambda u: (F.col("u_number") * u.mul + u.add).between(F.col("u_low"), F.col("u_high"))), F.lit(0)
    )
    code = F.coalesce("u_named", fits.code, "u_declared")
    chosen = F.get(F.filter("u_choices", lambda u: u.code == F.col("from_unit")), F.lit(0))
    return rows.withColumn("from_unit", code).select(
        *keep,
        F.col("u_quantity").alias("quantity"),
        F.col("u_number").alias("number"),
        "from_unit",
        F.col("u_common").alias("common_unit"),
        (F.col("u_number") * chosen.mul + chosen.add).alias("common_value"),
    )
