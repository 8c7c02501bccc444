"""Operators for training data against brute force, with nulls, ties, repeats, hot groups and empty tables."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import combinations

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronica.llm import cooccurrence, known, mixing, nearest, packing, residue, splits
from chronica.llm.tokens import token_count


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, n) for n in range(1001, 1060)] + [(n, n + 1) for n in range(2000, 2080)] + [(7, 7), (None, 3), (4, None), (1000, 1001)]
    df = spark.createDataFrame([(*e, "x") for e in edges], "a bigint, b bigint, node string")
    for most in (10, 10**6):
        assert {r["node"]: r["component"] for r in splits.components(df, "a", "b", most).collect()} == union_find(edges)
    assert splits.components(df.where("false"), "a", "b").count() == 0


def test_splits(spark):
    rng = random.Random(6)
    rows, n = [], 0
    for e in range(900):
        size = 200 if e == 0 else rng.choice([1, 1, 1, 2, 3, 8])
        for _ in range(size):
            rows.append((f"r{n}", None if e % 50 == 49 else e, rng.choice(["a", "a", "b", None, "odd"]), "clash"))
            n += 1
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "id string, e bigint, s string, g_key string")
    out = splits.split_by_entity(df, "id", "e", "s", ["a", "b"], [("train", 7.0), ("dev", 1.5), ("test", 1.5)]).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["e"] if r["e"] is not None else r["id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    for stratum in ("a", "b"):
        mine = [r["split"] for r in out if r["s"] == stratum]
        assert abs(mine.count("train") / len(mine) - 0.7) < 0.03
    assert splits.split_by_entity(df.where("false"), "id", "e", "s", ["a"], [("train", 1.0)]).count() == 0


def test_splits_keep_records_without_any_id(spark):
    df = spark.createDataFrame([("r1", 1, "a"), ("r2", None, "a"), (None, None, "a"), (None, None, "b"), (None, 1, None)], "id string, e bigint, s string")
    out = splits.split_by_entity(df, "id", "e", "s", ["a", "b"], [("train", 0.5), ("test", 0.5)]).collect()
    assert len(out) == 5 and all(r["split"] for r in out)


def test_pairs(spark):
    rng = random.Random(7)
    names = [f"Item  {n}" for n in range(12)]
    rows = [(rng.choice([None, *map(str, range(150))]), *[rng.choice([None, [], rng.choices([*names, " ITEM 1 ", "", None, "  "], k=rng.randrange(6))]) for _ in range(2)], "clash", 1) for _ in range(400)]
    df = spark.createDataFrame(rows, "h string, x array<string>, y array<string>, items string, w int")
    sets = {}
    for h, x, y, *_ in rows:
        if h is not None:
            sets.setdefault(h, set()).update(" ".join(i.split()).lower() for i in (x or []) + (y or []) if i and i.strip())
    single, both = Counter(), Counter()
    for s in sets.values():
        single.update(s)
        both.update(combinations(sorted(s), 2))
    out = cooccurrence.pair_counts(df, "h", ["x", "y"], 5).collect()
    assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in out} == {p: n for p, n in both.items() if n >= 5}
    assert all(r["n_a"] == single[r["item_a"]] and r["n_b"] == single[r["item_b"]] and r["n_records"] == len(sets) for r in out)
    assert cooccurrence.pair_counts(df.where("false"), "h", ["x", "y"]).count() == 0


def test_nearest(spark):
    rng = random.Random(8)
    left = [(rng.choice(["hot", "hot", "b", None]), rng.choice(["i", "j"]), rng.choice([None, rng.randrange(500)]), f"l{n}") for n in range(150)]
    right = [(rng.choice(["hot", "hot", "b", None]), rng.choice(["i", "j"]), rng.choice([None, *[rng.randrange(500) for _ in range(9)]]), n % 380) for n in range(400)]
    ldf = spark.createDataFrame([(*r, 1) for r in left], "e string, k string, time bigint, lid string, part int")
    rdf = spark.createDataFrame([(*r, 1) for r in right], "e string, k string, time bigint, rid bigint, l int")
    want = []
    for e, k, t, i in left:
        near = [(abs(u - t), u, r) for f, m, u, r in right if t is not None and u is not None and e is not None and (f, m) == (e, k) and abs(u - t) <= 6]
        if near:
            want.append((i, min(near)[2]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = nearest.nearest_in_time(ldf, rdf, ["e", "k"], "time", "lid", "rid", 6).collect()
            assert sorted((r["lid"], r["rid"]) for r in got) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert nearest.nearest_in_time(ldf, rdf.where("false"), ["e", "k"], "time", "lid", "rid", 6).count() == 0


def test_known_at(spark):
    rng = random.Random(9)
    versions = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, float(rng.randrange(200))]), rng.randrange(9)) for _ in range(300)]
    events = [(rng.choice(["hot", "b", "none", None]), rng.choice([None, float(rng.randrange(200))]), n, n % 2 == 0) for n in range(120)]
    vdf = spark.createDataFrame([(*v, "x") for v in versions], "e string, t double, v int, shard string")
    edf = spark.createDataFrame([(*v, "x") for v in events], "e string, t double, n int, upto boolean, k0 string")
    want = {}
    for e, t, n, upto in events:
        seen = [(u, v) for f, u, v in versions if f == e and t is not None and u is not None and (u < t or (upto and u == t))]
        want[n] = max(seen)[1] if seen else None
    for most in (10, 10**6):
        out = known.as_known_at(edf, vdf, ["e"], "t", ["v"], F.floor(F.col("t") / 10), F.col("upto"), most)
        assert out.columns == ["e", "t", "n", "upto", "k0", "known_at", "v"]
        assert {r["n"]: r["v"] for r in out.collect()} == want
    assert known.as_known_at(edf.where("false"), vdf, ["e"], "t", ["v"], F.floor(F.col("t"))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_best_fit(counts):
    runs = packing.best_fit_runs(counts, 50)
    fill, given_out = Counter(), Counter()
    for size, rank, container, n in runs:
        assert rank == given_out[size]
        given_out[size] += n
        for c in range(container, container + n):
            fill[c] += size
    assert given_out == Counter(counts)
    assert all(n <= 50 for n in fill.values())
    assert sorted(fill) == list(range(len(fill)))
    least = -(-sum(s * n for s, n in counts.items()) // 50)
    assert len(fill) <= max(least, 1) * 2


def test_pack_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 25), (4, 10), (5, 7), (5, 7), (6, 3)], "id bigint, z bigint")
    out = packing.pack(df, "id", "z", [("ten", 10)]).collect()
    fill = Counter()
    for r in out:
        if r["container"] is not None:
            fill[r["container"]] += r["piece_size"]
    assert sorted(fill.values()) == [5, 7, 10, 10, 10, 10] or sum(fill.values()) == 52
    assert max(fill.values()) <= 10 and len(fill) <= 6
    assert {r["id"]: r["container"] for r in out if r["id"] in (1, 2)} == {1: None, 2: None}
    assert sum(r["piece_size"] for r in out if r["id"] == 3) == 25
    assert packing.pack(df.where("false"), "id", "z", [("ten", 10)]).count() == 0


def test_raking_and_mixing(spark):
    rng = random.Random(10)
    rows = [(n, rng.choice(["big", "big", "big", "small", "none", None]), rng.choice(["en", "EN", "de-DE", None]), rng.choice([None, "t"]), rng.choice([None, 0, rng.randrange(1, 400)]), 1) for n in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, src string, lang string, topic string, z bigint, times int")
    out = mixing.mix(df, "id", "src", mixing.language(F.col("lang")), F.col("topic"), "z", [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)])
    got = out.groupBy("src").agg(F.sum("z").alias("z"), F.max("copy").alias("c")).collect()
    total = sum(r["z"] for r in got)
    assert {r["src"]: round(r["z"] / total, 2) for r in got} == {"big": 0.56, "small": 0.44}
    assert all(r["c"] <= {"big": 1, "small": 3}[r["src"]] for r in got)
    assert mixing.mix(df.where("false"), "id", "src", F.col("lang"), F.col("topic"), "z", [("big", 1.0, 1)]).count() == 0


RESIDUE = [
    "Dear {{name}}, your result is ready.", "Start at ____ mg/h.", "Reviewed by [INSERT ward HERE].", "Allergies: XX.", "Weight: None kg", "Give undefined mg of null over NaN hours.", "Dose advice: [object Object] per day.",
    "Lorem ipsum dolor sit amet magna.", "Insert content here.", "[type summary]", "Hier steht noch Blindtext.", "TODO: write section on dosing.", "test test 1 test",
    "Error 404: page not found.", "502 Bad Gateway", "Your session has expired.", "Loading... if nothing happens, activate active scripting.", "Fehler 404: Die angeforderte Seite wurde nicht gefunden.", "Request timed out.",
    "Please enable JavaScript to view this page.", "This site requires cookies and scripts to work properly.", "Ce site nécessite l'activation des scripts.", "<noscript>Scripts must be switched on to read the label</noscript>",
    "x " * 30000 + "The server is undergoing maintenance.",
]
REAL = [
    None, "", "   \n", "The undefined lesion on ultrasound was left alone.", "The result was null: no difference.", "Allergies: none known.", "A new script is required before discharge; the patient can enable reminders on the phone.",
    "The request for a chest film timed out of the four-hour window.", "Doses on the ladder {20, 40, 80} mg were grouped [20, 40].", "Dummy injections [sham arm] were matched; sample text messages reminded people.",
    "The saline lock served as a placeholder until the line was placed.", "EGFR = 142 x min(Scr/k, 1)^a x max(Scr/k, 1)^{-1.2} was applied.", "Page 404 of the ward manual lists the infusion rates.", "Pump error 42 cleared after a restart.",
    "<html><body><p>Repeat urea in 4 hours.</p></body></html>", "Home | Search | Contact", "The first dose went in at 9:30, 4 hours after ...", "The template for the stent was measured twice; insert the catheter to 12 cm.", "Cost was $9 per vial and <9 mL/min was the cut-off.",
    "Access to the arm was denied by the patient, so the server at lunch kept the tray.", "The service was unavailable on the weekend, so a chest film waited.", "word " * 30000,
]


def test_residue(spark):
    filler = [(f"Furosemide {n} mg was given and the weight fell.",) for n in range(300)]
    rows = [(n, t, "clash") for n, t in enumerate([*RESIDUE, *REAL, *(t for (t,) in filler)])]
    df = spark.createDataFrame(rows, "id int, text string, is_residue string")
    got = {r["id"]: r["is_residue"] for r in residue.residue(df, "id", "text").collect()}
    assert [t for n, t in enumerate(RESIDUE) if not got[n]] == []
    assert [t for n, t in enumerate(REAL) if got[n + len(RESIDUE)]] == []
    assert residue.residue(df.where("false"), "id", "text").count() == 0


def test_the_index_loses_nothing_the_checks_find(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").collect()]
    plain = [any(m.end() > m.start() for c in residue.CHECKS.values() for m in c.finditer(t)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["is_residue"] for r in residue.residue(df, "id", "text").collect()}
    assert [got[n] for n in range(len(texts))] == plain


def test_the_index_equals_the_checks_on_all_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(16)

    @F.pandas_udf("boolean")
    def plain(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and any(m.end() > m.start() for c in residue.CHECKS.values() for m in c.finditer(t)) for t in texts], dtype=bool)

    want = {r["doc_id"] for r in docs.where(plain("text")).collect()}
    got = {r["doc_id"] for r in residue.residue(docs, "doc_id", "text").where("is_residue").collect()}
    assert want and got == want


def samples(pattern):
    """Texts that a regular expression matches: together they take every branch of every alternation."""

    def of(tree):
        out = [""]
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                some = [chr(arg)]
            elif name == "BRANCH":
                some = [x for b in arg[1] for x in of(b)]
            elif name == "SUBPATTERN":
                some = of(arg[3])
                groups[arg[0]] = some[0]
            elif name in ("MAX_REPEAT", "POSSESSIVE_REPEAT", "MIN_REPEAT"):
                some = [x * n for n in ({max(arg[0], 1)} if arg[1] > 9 else {arg[0], max(arg[0], 1)}) for x in of(arg[2])]
            elif name == "IN":
                some = [next(c for c in " a5.bx[<*-:–" + "".join(map(chr, range(33, 256))) if re.match(one_of(arg), c))]
            elif name == "GROUPREF":
                some = [groups[arg]]
            elif name == "NOT_LITERAL":
                some = ["a"]
            else:
                some = [""]  # assertions
            n = max(len(out), len(some))
            out = [out[k % len(out)] + some[k % len(some)] for k in range(n)] if len(out) > 1 and len(some) > 1 else [a + b for a in out for b in some]
        return out

    def one_of(items):
        kinds = {"CATEGORY_WORD": r"\w", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_WORD": r"\W", "CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_SPACE": r"\S"}
        parts = []
        for op, arg in items:
            parts.append({"NEGATE": lambda: "^", "LITERAL": lambda: re.escape(chr(arg)), "RANGE": lambda: f"{re.escape(chr(arg[0]))}-{re.escape(chr(arg[1]))}", "CATEGORY": lambda: kinds[str(arg)]}[str(op)]())
        return "[" + "".join(parts) + "]"

    groups = {}
    return of(re._parser.parse(pattern, re.M))


def test_every_alternative_of_the_checks_is_reached(spark):
    rng = random.Random(11)
    texts = []
    for family, check in residue.CHECKS.items():
        for s in samples(check.pattern):
            text = f"The dose was held.\n{s}\nUrine was clear."
            if check.search(text) and not re.search(r"\b(\w+) \1 \1\b", s):  # a stammer alone is none
                texts.append((family, s, text))
    assert {f for f, *_ in texts} == set(residue.CHECKS) and len(texts) > 300
    for _ in range(3):  # whatever the weights are
        index = residue.ResidueIndex({t: rng.choice([0.05, 1.0, 9.0]) for t in residue.VOCABULARY}, 0.55)
        assert [s for _, s, t in texts if not index.matches(t)] == []
    df = spark.createDataFrame([(n, t) for n, (*_, t) in enumerate(texts)], "id int, text string")
    kept = {r["id"] for r in residue.residue(df, "id", "text").where("not is_residue").collect()}
    assert [texts[n][1] for n in sorted(kept)] == []


def test_spreadsheet_errors_bare_marks_and_runs(spark):
    texts = ["Weight #REF! kg.", "Dose: #N/A", "#VALUE! noted", "#NAME? noted", "#DIV/0! noted", "Route: NoneType.", "TODO", "et, et, et, et", "sed magna sed magna", "Error404: gone"]
    df = spark.createDataFrame(list(enumerate([*texts, *(f"Furosemide {n} mg was given." for n in range(300))])), "id int, text string")
    got = {r["id"] for r in residue.residue(df, "id", "text").where("is_residue").collect()}
    assert got == set(range(len(texts)))


def test_scripts_beside_something_off_are_no_demand(spark):
    texts = ["Two scripts were sent. The drip is off.", "The pump alarm is blocked. Cookies were eaten."]
    df = spark.createDataFrame(list(enumerate([*texts, *(f"Furosemide {n} mg was given." for n in range(300))])), "id int, text string")
    assert residue.residue(df, "id", "text").where("is_residue").count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("Furosemide 40 mg",), ("",), (None,), ("<|endoftext|>",), ("a" * 20000,)], "t string")
    out = [r[0] for r in df.select(token_count("t")).collect()]
    assert out[0] > 3 and out[1] == 0 and out[2] is None and out[3] > 1 and out[4] > 100


def test_an_ordered_chain_takes_few_levels(spark):
    n, tasks = 20_000, 40
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    levels = []
    out = splits.components(edges, "a", "b", n // tasks, levels).agg(F.count(F.lit(1)).alias("n"), F.max("component").alias("c")).first()
    assert (out["n"], out["c"]) == (n + 1, 0)
    assert 1 < len(levels) <= 2 * math.log2(tasks) + 1 and all(b < 0.8 * a for a, b in zip(levels, levels[1:]))


def one_by_one(shapes, shares):
    """Every group in turn, largest first, to the split with the largest need."""
    want = [Fraction(x).limit_denominator(10**9) for x in shares]
    want = [x / sum(want) for x in want]
    strata = range(len(shapes[0][0])) if shapes else []
    total = [sum(c[s] * n for c, n in shapes) for s in strata]
    have = [[0] * len(total) for _ in shares]
    out = []
    for c, n in shapes:
        given_out = [0] * len(shares)
        for _ in range(n):
            need = lambda k: sum(c[s] * (want[k] - Fraction(have[k][s], total[s])) for s in strata if c[s])
            k = max(range(len(shares)), key=lambda k: (need(k), -k))
            given_out[k] += 1
            for s in strata:
                have[k][s] += c[s]
        out.append(given_out)
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 3)).filter(any), st.integers(1, 70), max_size=6), st.sampled_from([[0.7, 0.15, 0.15], [0.5, 0.5], [1.0], [0.9, 0.0, 0.1]]))
def test_classes_are_given_out_as_groups_one_by_one(counts, shares):
    shapes = sorted(((list(c), n) for c, n in counts.items()), key=lambda x: (-sum(x[0]), x[0]))
    assert splits._assign(shapes, shares) == one_by_one(shapes, shares)
