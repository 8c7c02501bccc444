"""Decisions, records, retrieval, terms and clusters on hand-made rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronica import session
from chronica.operators import decisions, records, report, resolve, retrieval, sampling, terms, text, vectors
from chronica.sources import readers

T0 = dt.datetime(2150, 1, 1)
H = dt.timedelta(hours=1)


def test_matching_orders_at_the_edges(spark):
    targets = spark.createDataFrame([("a", T0 + 24 * H, 40.0), ("b", T0, None), (None, T0, 1.0), ("c", T0, 9.999)], "k string, at timestamp_ntz, d double")
    rows = [("a", T0, 40.0004, 1), ("a", T0 + 23 * H, 40.0, 2), ("a", T0 + 23 * H, 39.9995, 3), ("a", T0 + 24 * H, 40.0, 4), ("a", T0 + 23.5 * H, 41.0, 5), ("a", None, 40.0, 6), ("c", T0 - 5 * H, 10.0, 7), ("c", T0 - 25 * H, 9.999, 8)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, m double, i int")
    out = decisions.matching_latest(targets, df, "k", "at", "t", "d", "m", "i", 24, 2e-3)
    assert {r["k"]: (r["i"], round(r["gap_hours"], 3)) for r in out.collect()} == {"a": (3, 1.0), "c": (7, 5.0)}
    assert decisions.matching_latest(targets, df.where("false"), "k", "at", "t", "d", "m", "i", 24, 2e-3).count() == 0


def test_first_filled_and_given(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    one, two = spark.createDataFrame([("a", " "), ("b", "x")], "k string, v string"), spark.createDataFrame([("a", "y"), ("b", "z")], "k string, v string")
    out = decisions.first_filled(rows, "k", [("one", one), ("two", two)], "v", "place")
    assert {r["k"]: (r["place"], r["place_source"]) for r in out.collect()} == {"a": ("y", "two"), "b": ("x", "one"), "c": ("", "none"), None: ("", "none")}
    texts = ["Administered", "Not Administered", "administered in another location", "knot administered", None, "", "x" * 20000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(decisions.given(F.col("t"), "administered")).collect()]
    assert got == [True, False, True, True, False, False, False]


def test_day_boundaries(spark):
    targets = spark.createDataFrame([("a", T0 + 5 * H), ("b", T0 + 5 * H), ("c", None)], "k string, at timestamp_ntz")
    rows = spark.createDataFrame([("a", T0 + H, 1.0, 1), ("a", T0 - H, 2.0, 2), ("b", T0 - 400 * 24 * H, 3.0, 3), ("c", T0, 4.0, 4)], "k string, t timestamp_ntz, v double, i int")
    out = decisions.latest_before_day(targets, rows, "k", "at", "t", "v", "i", 365)
    assert {r["k"]: r["last_value"] for r in out.collect()} == {"a": 2.0, "b": None, "c": None}
    assert {r["k"] for r in decisions.has_by_day(targets, rows.where("i <> 2"), "k", "at", "t").collect()} == {"a", "b"}


def test_stages_bands_rates_and_status(spark):
    row = spark.range(1).select(
        decisions.stage(F.lit(45.0)), decisions.stage(F.lit(None).cast("double")), decisions.stage(F.lit(-1.0)), decisions.dose_band(F.lit(20.0005), decisions.BANDS_1, decisions.LAST_1),
        decisions.dose_band(F.lit(61.0), decisions.BANDS_2, decisions.LAST_2), decisions.rate_per_weight(F.lit(240.0), F.lit(80.0), F.lit(30.0), 6.0), decisions.rate_per_weight(F.lit(240.0), F.lit(80.0), F.lit(-1.0), 6.0),
        decisions.rate_per_weight(F.lit(1.0), F.lit(0.0), F.lit(1.0), 6.0), decisions.code_status(F.lit("DNR / DNI")), decisions.code_status(F.lit("Comfort measures, DNR")), decisions.code_status(F.lit(None).cast("string")),
    ).first()
    assert tuple(row) == ("G3a", "missing", "missing", "le20", "ge80", 0.5, None, None, "dnr_dni", "cmo", "unknown")


def test_records_show_only_what_was_before(spark):
    rows = [("s", "e1", T0, 10.0, 1, "x"), ("s", "e1", T0 + 50 * H, 20.0, 2, "x"), ("s", "e2", T0 + 48 * H, 30.0, 1, "y"), ("s", "e3", T0 + 48 * H, 40.0, 1, "z"), ("t", "e4", T0, 5.0, 1, "w"), ("t", "e5", None, 5.0, 1, "w"), (None, "e6", T0, 1.0, 1, "w")]
    df = spark.createDataFrame(rows, "s string, e string, t timestamp_ntz, d double, i int, u string")
    out = {r["record_id"]: r for r in records.build_records(df, "s", "e", "t", "d", "i", ["u"]).collect()}
    assert set(out) == {"s_e1", "s_e2", "s_e3", "t_e4"}
    assert [(p["episode"], p["n_doses"], p["total"], p["truncated_at_t0"], p["days_before"], p["state"]["u"]) for p in out["s_e2"]["prior"]] == [("e1", 1, 10.0, True, 2.0, "x")]
    assert out["s_e1"]["prior"] == [] and out["t_e4"]["prior"] == []
    assert records.build_records(df.where("false"), "s", "e", "t", "d", "i", ["u"]).count() == 0


def test_similar_records_one_per_subject(spark):
    pool = [("p1", 1, ["a", "b"], "F", 50.0), ("p2", 1, ["a", "b"], "M", 50.0), ("p3", 2, ["a", "b"], "F", None), ("p4", 3, ["a"], "F", 50.0), ("p5", 4, ["z"], "F", 50.0), ("p6", 5, [], "F", 50.0)]
    schema = "id string, s int, c array<string>, sex string, age double"
    out = records.similar_records(spark.createDataFrame([("q", 9, ["a", "b"], "F", 50.0), ("n", 9, [], None, None)], schema), spark.createDataFrame(pool, schema), "id", "s", "c", "sex", ["age"], 3)
    assert [(r["id"], r["neighbour"], r["similarity"]) for r in out.orderBy("rank").collect()] == [("q", "p1", 1.0), ("q", "p3", 1.0), ("q", "p4", 0.5)]
    flags = spark.createDataFrame([(True, "0", 0.0), (None, "yes", 2.0)], "a boolean, b string, c double").select(*[records.is_set(F.col(c)) for c in "abc"]).collect()
    assert [tuple(r) for r in flags] == [(True, False, False), (False, True, True)]


def test_selection_stops():
    v = np.eye(4)
    q = np.array([0.9, 0.8, 0.7, 0.6])
    words = ["alpha", "beta", "gamma", "delta"]
    assert retrieval.select_supported(words, v, q, "alpha beta", retrieval.word_overlap, enough=0.9) == ([0, 1], [0.5, 1.0], "enough")
    assert retrieval.select_supported(words, v, q, "alpha zeta", retrieval.word_overlap, enough=0.9)[2] == "no_gain"
    assert retrieval.select_supported(words, v, q, "zeta", retrieval.word_overlap, least=4)[2] == "no_gain"
    assert retrieval.select_supported(words, v, q, "alpha", retrieval.word_overlap, enough=2.0, least_gain=-1.0, most=2)[2] == "most"
    assert retrieval.select_supported(words[:1], v[:1], q, "beta", retrieval.word_overlap, least_gain=-1.0)[2] == "exhausted"
    assert retrieval.select_supported([], v[:0], q, "x", retrieval.word_overlap) == ([], [], "empty")


def test_selected_pools_and_their_report(spark):
    rows = [("e", n, w, [float(k == n) for k in range(3)], [0.9, 0.8, 0.7], "alpha beta") for n, w in enumerate(("alpha", "beta", "gamma"))] + [("f", 0, "gamma", [1.0, 0.0, 0.0], [0.9, 0.8, 0.7], "alpha")]
    pool = spark.createDataFrame(rows, "k string, i int, s string, v array<double>, q array<double>, h string")
    out = retrieval.supported_paths(pool, "k", "i", "s", "v", "q", "h", lambda: retrieval.word_overlap, enough=0.9)
    assert {r["k"]: (r["picked"], r["stop"]) for r in out.collect()} == {"e": ([0, 1], "enough"), "f": ([0], "no_gain")}
    assert dict(map(tuple, retrieval.selection_report(out).collect())) == {"episodes": 2.0, "pool_median": 2.0, "picked_median": 1.5, "support_median": 0.5, "stop_enough": 1.0, "stop_no_gain": 1.0}


def test_blocked_and_open_nodes(spark):
    needs = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c1", "b"), ("c2", "a")], "cluster string, concept string")
    has = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "episode int, concept string")
    assert {tuple(r) for r in retrieval.open_nodes(needs, has).collect()} == {(1, "c2"), (2, "c1"), (2, "c2")}
    assert {tuple(r) for r in retrieval.blocked_nodes(needs, has).collect()} == {(1, "c1")}


def test_rank_report(spark):
    schema = "episode int, aspect string, nodes array<string>"
    base = spark.createDataFrame([(1, "risk", ["a", "b"]), (1, "risk", ["a", "c"]), (2, "risk", ["a", "b"])], schema)
    wide = spark.createDataFrame([(1, "risk", ["a", "b"]), (1, "risk", ["a", "cluster:x", "c"]), (2, "risk", ["a", "b"])], schema)
    assert dict(map(tuple, retrieval.rank_report(base, wide, "cluster:").collect())) == {"base_paths": 3, "base_paths_kept": 2, "paths_through": 1, "episodes_through": 1, "episodes": 2}


def test_terms(spark):
    texts = [("Renal failure (disorder) [D], NOS",), ("AKI",), (None,), ("unspecified",), ("NOSE",)]
    df = spark.createDataFrame(texts, "t string")
    assert [r[0] for r in df.select(terms.bare_term(F.col("t"))).collect()] == ["Renal failure", "AKI", None, "", "NOSE"]
    words = ["AKI", "kidney", "abc", "a b", "ab cd", "1 2", None]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(terms.is_usable(F.col("w"))).collect()] == [True, True, False, False, True, False, False]
    facts = spark.createDataFrame([("In CKD stage 4 with eGFR <30 or NYHA class iii, not on a loop", "Dosing > Elderly"), (None, None), ("", "")], "t string, s string")
    out = [{tuple(f) for f in r[0]} for r in facts.select(terms.condition_facts(F.col("t"), F.col("s"))).collect()]
    assert out == [{("ckd_stage", "", "4"), ("egfr", "<", "30"), ("nyha", "", "III"), ("loop_naive", "", ""), ("older_adults", "", ""), ("ckd", "", "")}, set(), set()]
    notes = ["AKI = acute kidney injury; CKD = chronic kidney disease.", "Class of recommendation; level of evidence", "Give 40 mg; then 80 mg.", "", None]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in notes], "n string").select(terms.is_footnote(F.col("n"))).collect()] == [True, True, False, False, False]


def brute_linkage(points, threshold, linkage):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    gap = np.round(1 - unit @ unit.T, 12)
    groups = [[n] for n in range(len(points))]
    while len(groups) > 1:
        join = (lambda a, b: gap[np.ix_(a, b)].max()) if linkage == "complete" else (lambda a, b: gap[np.ix_(a, b)].mean())
        d, i, j = min((round(join(a, b), 10), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d > threshold:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_clusters_equal_brute_force_with_copies(spark, linkage):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 6))
    points = np.vstack([base, base[:7], base[:3]])
    rows = [(1, n, [float(x) for x in p]) for n, p in enumerate(points)] + [(2, 100, [1.0] * 6), (None, 101, [1.0] * 6), (2, 102, None)]
    df = spark.createDataFrame(rows, "k int, i int, v array<double>")
    out = resolve.cluster_within(df, "k", "i", "v", 0.6, linkage).collect()
    got = {}
    for r in out:
        if r["k"] == 1:
            got.setdefault(r["cluster"], set()).add(r["i"])
    assert {frozenset(g) for g in got.values()} == brute_linkage(points, 0.6, linkage)
    assert {(r["k"], r["i"]) for r in out if r["k"] != 1} == {(2, 100), (None, 101)}
    assert all(r["canonical"] in got[r["cluster"]] for r in out if r["k"] == 1)
    assert resolve.cluster_within(df.where("false"), "k", "i", "v", 0.6).count() == 0


def test_threshold_search(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(4)
    rows = [(n, [float(x) for x in centres[n % 4] + rng.normal(scale=0.05, size=4)]) for n in range(80)]
    out = resolve.threshold_search(spark.createDataFrame(rows, "i int, v array<double>"), "i", "v", steps=6).collect()
    best = [r for r in out if r["is_best"]]
    assert len(out) == 6 and len(best) == 1 and best[0]["clusters"] == 4 and best[0]["silhouette"] > 0.9
    empty = resolve.threshold_search(spark.createDataFrame([], "i int, v array<double>"), "i", "v", steps=2).collect()
    assert [r["threshold"] for r in empty if r["is_best"]] == [0.2]


def test_cell_balance(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(n, rng.choice(["big"] * 20 + ["small", None])) for n in range(900)], "i int, c string")
    out = sampling.cell_balanced(df, "i", "c", 300, 3)
    n = {r["c"]: r["count"] for r in out.groupBy("c").count().collect()}
    have = {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}
    assert sum(n.values()) == 300 and n["small"] == have["small"] and n[None] == have[None]
    assert sampling.cell_balanced(df, "i", "c", 5000, 3).count() == 900 and sampling.cell_balanced(df.where("false"), "i", "c", 5, 3).count() == 0


def test_settings_folders_and_pages(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("llm:\n  model: small\n  calls: 3\n")
    (tmp_path / "b.yaml").write_text("llm:\n  calls: 5\n")
    got = readers.load_settings([str(tmp_path / f) for f in ("a.yaml", "b.yaml", "none.yaml")], {"CHRONICA_LLM__MODEL": "large", "OTHER": "x"})
    assert got == {"llm": {"model": "large", "calls": 5}}
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "t.csv").write_text("x\n")
    (tmp_path / "data" / "t.csv.gz").write_text("x\n")
    assert session.table_file(str(tmp_path / "data"), "t").endswith(".csv.gz")
    assert session.locate(spark, None, "NO_SUCH_VARIABLE", [str(tmp_path / "*")], ["t"]) == str(tmp_path / "data")
    with pytest.raises(FileNotFoundError):
        session.locate(spark, str(tmp_path), "NO_SUCH_VARIABLE", [], ["t"])
    with pytest.raises(ValueError):
        readers.scope_tables(spark, {"profiles": {"p": ["g"]}, "groups": {}})
    assert report.cluster_shape(spark.createDataFrame([], "c string, s string"), "c", "s").first()["clusters"] == 0


def test_linked_terms_longest_wins(spark):
    terms_of = spark.createDataFrame([("kidney", "kidney"), ("ckd", "chronic kidney disease"), ("ckd", "CKD"), ("weight", "weight"), ("drug", "furosémide")], "concept string, term string")
    docs = spark.createDataFrame([(1, "Chronic kidney  disease; the kidney, CKD."), (2, "overweight"), (3, None), (4, ""), (5, "Furosémide " * 3000)], "id int, t string")
    out = {(r["id"], r["concept"], r["term"]): r["n"] for r in text.linked_terms(docs, "id", "t", terms_of, 3).collect()}
    assert out == {(1, "ckd", "chronic kidney disease"): 1, (1, "kidney", "kidney"): 1, (1, "ckd", "CKD"): 1, (5, "drug", "furosémide"): 3000}


def test_linked_terms_shuffle_matches_only(spark):
    terms_of = spark.createDataFrame([("kidney", "kidney"), ("ckd", "chronic kidney disease"), ("ill", "disease"), ("ill", "Disease"), ("b", "a a"), ("a", "a")], "concept string, term string")
    docs = spark.createDataFrame([(1, "Chronic kidney disease, kidney"), (2, "disease chronic"), (3, "no match here"), (4, None), (5, " , "), (6, "a a a b a")], "id int, t string")
    out = text.linked_terms(docs, "id", "t", terms_of, 3)
    got = {(r["id"], r["concept"], r["term"]): r["n"] for r in out.collect()}
    assert got == {(1, "ckd", "chronic kidney disease"): 1, (1, "kidney", "kidney"): 1, (2, "ill", "disease"): 1, (2, "ill", "Disease"): 1, (6, "b", "a a"): 2, (6, "a", "a"): 1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # no run of words is shuffled before it is found
    shuffled = text.linked_terms(docs, "id", "t", terms_of, 3, most_terms=1)
    assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, out.collect()))


def test_diverse_rows_equal_the_sequential_picks(spark):
    rng = np.random.default_rng(7)
    rows = [(k, 10 * k + n, [float(x) for x in rng.normal(size=5)], float(rng.random())) for k in range(3) for n in range(10)] + [(9, 99, [0.0] * 5, None), (9, 98, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, i int, v array<double>, s double")
    got = {}
    for r in vectors.diverse(df, "k", "i", "v", "s", 4, 0.7, -1.0).orderBy("pick").collect():
        got.setdefault(r["k"], []).append(r["i"])
    for k in range(3):
        mine = [r for r in rows if r[0] == k]
        picks = vectors.select_diverse(np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), 0.7, 4, -1.0)
        assert got[k] == [mine[n][1] for n in picks]
    assert got[9] == [99]


def test_pairs_above_and_centroids(spark):
    rng = np.random.default_rng(8)
    points = [(n, [float(x) for x in rng.normal(size=4)]) for n in range(40)] + [(40, None), (41, [0.0] * 4)]
    df = spark.createDataFrame(points, "i bigint, v array<double>")
    unit = {n: np.array(v) / (np.linalg.norm(v) or 1) for n, v in points if v is not None}
    want = {(a, b) for a in unit for b in unit if a % 4 == 0 and a != b and unit[a] @ unit[b] >= 0.6}
    assert {(r["query"], r["row"]) for r in vectors.pairs_above(df.where("i % 4 = 0"), df, "i", "v", 0.6, block=7).collect()} == want
    parts = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [-1.0, 0.0]), ("b", None)], "k string, v array<double>")
    asked = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [1.0, 0.0]), ("c", [1.0, 0.0]), ("a", None)], "k string, q array<double>")
    out = [(r["k"], round(r["likeness"], 6)) for r in vectors.centroid_likeness(parts, "k", "v", asked, "q").collect()]
    assert sorted(out) == [("a", 0.0), ("a", 1.0), ("b", 0.0), ("c", 0.0)]


def test_cache_keeps_finished_batches(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "text string, n int"
    assert readers.read_cache(spark, path, schema).count() == 0
    readers.extend_cache(spark.createDataFrame([("a", 1)], schema), path, "1")
    readers.extend_cache(spark.createDataFrame([("b", 2)], schema), path, "2")
    (tmp_path / "cache" / "_temporary").mkdir()
    assert {tuple(r) for r in readers.read_cache(spark, path, schema).select("text", "n").collect()} == {("a", 1), ("b", 2)}
