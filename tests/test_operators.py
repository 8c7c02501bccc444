"""Boundary cases of the general operators on hand-made rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronica.functions import ids, scalars, times
from chronica.operators import codes, graph, history, model, ranks, resolve, sampling, sets, shards, temporal, text, vectors
from chronica.sources import readers

T0 = dt.datetime(2150, 1, 1)
H = dt.timedelta(hours=1)


def test_numbers_of_ids(spark):
    written = ["10013634", " 10006478", "id:10017663", "\t010037322", "10018517.0", "1.0021968E7", "0010014968", "10022044 ", "10 022 044", "10,004,145", "S-10032757", "", None, "none", "9" * 30]
    out = [r[0] for r in spark.createDataFrame([(w,) for w in written], "s string").select(ids.number_of(F.col("s"))).collect()]
    assert out == [10013634, 10006478, 10017663, 10037322, 10018517, 10021968, 10014968, 10022044, 10022044, 10004145, 10032757, None, None, None, None]


def test_times_do_not_shift_with_the_zone(spark):
    df = spark.createDataFrame([("2150-03-08 02:30:00.5",), ("2150-03-08T02:30",), ("2150-03-08",), ("soon",), (None,)], "s string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        out = df.select(times.micros(times.parse_stamp(F.col("s"))), times.second_text(times.parse_stamp(F.col("s")))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r[0] for r in out] == [5685993000500000, 5685993000000000, 5685984000000000, None, None]
    assert [r[1] for r in out][:2] == ["2150-03-08 02:30:00"] * 2


def test_as_of_strict_inclusive_ties_and_hot_keys(spark):
    rows = [("k", T0, 1.0, 1), ("k", T0 + H, 2.0, 2), ("k", T0 + H, 3.0, 3), ("k", T0 + 2 * H, None, 4), ("k", None, 9.0, 5), ("j", T0, 7.0, 6)]
    right = spark.createDataFrame(rows, "k string, at timestamp_ntz, v double, i int")
    left = spark.createDataFrame([("k", T0 + H, "x"), ("k", T0, "y"), ("k", T0 + 30 * H, "z"), ("k", None, "n"), ("m", T0, "m")], "k string, t timestamp_ntz, seen string")
    for most in (2, 10**6):
        got = {r["seen"]: r["as_of_value"] for r in temporal.value_as_of(left, right, "k", "t", "at", "v", "i", strict=True, shard_hours=1, most_rows=most).collect()}
        assert got == {"x": 1.0, "y": None, "z": 3.0, "n": None, "m": None}
        got = {r["seen"]: r["as_of_value"] for r in temporal.value_as_of(left, right, "k", "t", "at", "v", "i", shard_hours=1, most_rows=most).collect()}
        assert got == {"x": 3.0, "y": 1.0, "z": 3.0, "n": None, "m": None}


def test_running_max_is_the_same_with_and_without_shards(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("v"))
    for before in (False, True):
        a, b = (shards.running_max(df, ["k"], [F.col("t")], "v", "m", F.floor(F.col("t") / 50), most, before) for most in (10, 10**6))
        assert sorted(a.collect()) == sorted(b.collect())


def test_windows_after_a_row(spark):
    df = spark.createDataFrame([("k", T0, 1.0), ("k", T0 + H, 2.0), ("k", T0 + 2 * H, 2.0), ("k", T0 + 9 * H, 5.0)], "k string, t timestamp_ntz, v double")
    out = temporal.sum_after(df, ["k"], "t", "v", 2, "s").orderBy("t").collect()
    assert [r["s"] for r in out] == [4.0, 2.0, None, None]
    out = temporal.raised_within(df, ["k"], "t", "v", 1, "up").orderBy("t").collect()
    assert [r["up"] for r in out] == [True, False, False, False]


def test_prior_rows_do_not_see_their_own_time(spark):
    df = spark.createDataFrame([("k", 1, 5.0), ("k", 1, 6.0), ("k", 2, 1.0)], "k string, t bigint, v double")
    out = history.with_prior(df, "k", "t", {"n": F.count(F.lit(1)), "m": F.max("v")}).orderBy("t", "v").collect()
    assert [(r["n"], r["m"]) for r in out] == [(0, None), (0, None), (2, 6.0)]


def test_codes(spark):
    table = spark.createDataFrame([("E11", "first, cut", 1), ("E11", "second", 2), ("E119", "long", 3)], "c string, v string, o int")
    lookup = codes.first_wins(table, "c", "v", "o")
    assert {tuple(r) for r in lookup.collect()} == {("E11", "first"), ("E119", "long")}
    found = codes.longest_prefix(spark.createDataFrame([("E1192",), ("E112",), ("E1",), (None,)], "x string"), "x", lookup, "c", "v")
    assert {r["x"]: r["v"] for r in found.collect()} == {"E1192": "long", "E112": "first", "E1": None, None: None}


def test_sharded_rank_is_dense(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    out = ranks.sharded_rank(df, ["g"], [F.col("id")], F.pmod(F.xxhash64("id"), F.lit(16)), "n")
    assert [r[0] for r in out.where("g = 1").select("n").orderBy("n").collect()] == list(range(500))
    assert ranks.sharded_rank(df.where("false"), ["g"], [F.col("id")], F.lit(0)).count() == 0


def test_split_shares_and_folds(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 2).alias("s"))
    out = sampling.stratified_split(df, "id", ["s"], [("train", 0.7), ("dev", 0.15), ("test", 0.15)], 1)
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(n.values()) == 1000 and abs(n["train"] - 700) <= 2 and abs(n["dev"] - 150) <= 2


def brute_near(rows, apart, least):
    kept = []
    for o, items in sorted(rows):
        if not any(len(items) > least and len(k) > least and len(set(items) ^ set(k)) < apart for _, k in kept):
            kept.append((o, items))
    return {o for o, _ in kept}


def test_near_sets_are_dropped_greedily(spark):
    rng = np.random.default_rng(4)
    base = [sorted({f"i{x:02d}" for x in rng.choice(30, 12)}) for _ in range(8)]
    rows, seen = [], set()
    for n in range(120):
        items = set(base[n % 8])
        for x in rng.choice(30, rng.integers(0, 4)):
            items ^= {f"i{x:02d}"}
        if (key := tuple(sorted(items))) and key not in seen:
            seen.add(key)
            rows.append((n, list(key)))
    df = spark.createDataFrame(rows, "o int, items array<string>")
    assert {r["o"] for r in sets.drop_near_sets(df, "o", 5, 5).collect()} == brute_near(rows, 5, 5)
    assert sets.drop_near_sets(df.where("false"), "o").count() == 0


def test_near_sets_of_any_size_meet(spark):
    rng = np.random.default_rng(8)
    rows, seen = [], set()
    while len(rows) < 150:
        items = tuple(sorted({f"i{x}" for x in rng.choice(9, rng.integers(1, 8), replace=False)}))
        if items not in seen:
            seen.add(items)
            rows.append((len(rows), list(items)))
    df = spark.createDataFrame(rows, "o int, items array<string>")
    for apart, least in ((5, 0), (2, 1), (3, 3), (1, 0)):
        assert {r["o"] for r in sets.drop_near_sets(df, "o", apart, least).collect()} == brute_near(rows, apart, least)
    far = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "d"]), (3, ["e", "f", "g"])], "o int, items array<string>")
    assert {r["o"] for r in sets.drop_near_sets(far, "o", 5, 0).collect()} == {1, 3}


def test_near_candidates_hold_all_near_pairs_and_few_others(spark):
    rng = np.random.default_rng(9)
    rows, seen = [], set()
    while len(rows) < 600:  # ten items in most sets, the others in few
        items = tuple(sorted({f"c{x}" for x in range(10) if rng.random() < 0.75} | {f"r{x}" for x in rng.choice(80, rng.integers(3, 6))}))
        if items not in seen:
            seen.add(items)
            rows.append((len(rows), list(items)))
    df = spark.createDataFrame(rows, "o int, items array<string>")
    large = df.where("size(items) > 8")
    got = {(r["a"], r["b"]) for r in sets.near_candidates(large, "o", 5, 8).collect()}
    kept = [(o, set(i)) for o, i in rows if len(i) > 8]
    near = {(a, b) for n, (a, x) in enumerate(kept) for b, y in kept[n + 1 :] if len(x ^ y) < 5}
    assert near and near <= got and len(got) < 3 * len(near) + 100


def test_paths_and_edges(spark):
    edges = spark.createDataFrame([("a", "r", "b", 1), ("b", "r", "a", 2), ("b", "r", "c", 3), ("a", "r", "d", 4), ("d", "r", "c", 5), ("c", "r", "c", 6), ("c", "noise", "e", 7)], "head string, relation string, tail string, o int")
    simple = graph.simple_graph(edges, "o", ["noise"])
    assert simple.count() == 4
    paths = graph.shortest_paths(simple, spark.createDataFrame([("a", "c"), ("a", "e"), ("a", "a")], "source string, target string"))
    assert sorted(r["nodes"] for r in paths.collect()) == [["a", "b", "c"], ["a", "d", "c"]]
    merged = graph.merge_edges(spark.createDataFrame([("A x", "r", "b", "f"), ("a  X", "R", "b", "g"), ("z", "r", "z", "f"), ("", "r", "q", "f")], "head string, relation string, tail string, s string"), "s")
    assert [(r["sources"], r["n"]) for r in merged.collect()] == [(["f", "g"], 2)]


def test_names_are_resolved(spark):
    df = spark.createDataFrame([("The Loop Diuretics", 2), ("loop diuretic", 5), ("Loop diuretic", 5), ("bus", 1), ("glass", 3)], "item string, n int")
    assert dict(map(tuple, resolve.canonical_by_name(df, "item", "n").collect())) == {
        "The Loop Diuretics": "Loop diuretic", "loop diuretic": "Loop diuretic", "Loop diuretic": "Loop diuretic", "bus": "bus", "glass": "glass",
    }
    points = np.array([[1, 0], [0.99, 0.1], [0, 1], [0, 0.9], [-1, 0]])
    assert resolve.agglomerate(points, 0.2).tolist() == resolve.agglomerate(points, 0.2, "complete").tolist() == [0, 0, 1, 1, 2]


def test_text(spark):
    df = spark.createDataFrame([("See Dr. A. Give 20-40 mg/day, e.g. at night! Above 1,500 mg?\nok",)], "t string")
    assert df.select(text.sentences(F.col("t"))).first()[0] == ["See Dr. A.", "Give 20-40 mg/day, e.g. at night!", "Above 1,500 mg?", "ok"]
    assert text.quantities_in("Give 20-40 mg/day or above 1,500 mg, 2 g per kg; 5 mL") == [("=", "day", 20.0, 40.0), (">", "dose", 1500.0, 1500.0), ("=", "kg", 2000.0, 2000.0)]
    units = spark.createDataFrame([(["a b", "c d e", "f", "g " * 9],), ([],)], "u array<string>")
    assert [r[0] for r in units.select(text.chunks(F.col("u"), 5)).collect()] == [["a b c d e", "f", "g " * 9], []]
    blocks = spark.createDataFrame([("s", 1, 1, "A"), ("s", 2, 2, "B"), ("s", 3, 0, "x"), ("s", 4, 1, "C"), ("s", 5, 0, "y")], "src string, n int, lvl int, t string")
    out = text.under_headings(blocks, "src", "n", "lvl", "t").orderBy("n").collect()
    assert [r["section_path"] for r in out] == [["A", "B"], ["C"]]


def test_diverse_selection():
    v = np.array([[1.0, 0], [1, 0.01], [0, 1]])
    assert vectors.select_diverse(v, np.array([1.0, 0.99, 0.8]), 0.7, 2, 0.05) == [0, 2]


def test_embedding_reuses_known_texts(spark):
    embed = vectors.hash_embedder(8)
    known = spark.createDataFrame([("a", [9.0] * 8)], "text string, vec array<float>")
    out = {r["text"]: r["vec"] for r in vectors.embedded(spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "t string"), "t", embed, known).collect()}
    assert set(out) == {"a", "b"} and out["a"] == [9.0] * 8


def test_key_checks(spark):
    one, two = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    assert model.one_to_one(one, one, "k").count() == 1
    with pytest.raises(ValueError):
        model.one_to_one(one, two, "k")
    with pytest.raises(ValueError):
        model.check_columns(["x", "label"], {"x"}, {"label"})


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,z\n1,"a, b",\n,q,3\n')
    out = readers.read_text_csv(spark, str(tmp_path / "a.csv"), ["x", "z"]).collect()
    assert [tuple(r) for r in out] == [("1", ""), ("", "3")]
    (tmp_path / "p.rrf").write_text('C1|"quoted|T1|\nC2|x\n')
    assert [tuple(r) for r in readers.read_pipes(spark, str(tmp_path / "p.rrf"), ["a", "b", "c"]).collect()] == [("C1", '"quoted', "T1"), ("C2", "x", None)]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nbroken\n\n{"a": 2}\n')
    assert readers.read_json_lines(spark, str(tmp_path / "j.jsonl"), "a int").where("a is not null").count() == 2
    (tmp_path / "c.csv").write_text("code,cat\nA,one\nA,two\nB,\"x, y\"\n")
    assert {tuple(r) for r in readers.read_crosswalk(spark, str(tmp_path / "c.csv")).collect()} == {("A", "one"), ("B", "x")}
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b")], "head string, relation string, tail string")
    readers.write_triples(edges, str(tmp_path / "t"))
    assert [tuple(r) for r in readers.read_edges(spark, str(tmp_path / "t")).collect()] == [("a", "r", "b")]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "d.txt").write_bytes(b"abc")
    manifest = spark.createDataFrame([("d.txt", None), ("e.txt", "00")], "name string, sha256 string")
    assert {r["name"]: r["state"] for r in readers.verify_locked(spark, str(tmp_path / "docs"), manifest).collect()} == {"d.txt": "locked_now", "e.txt": "missing"}
    log = spark.createDataFrame([("u", 1, True), ("v", 1, True), ("v", 2, False)], "unit string, at int, ok boolean")
    assert [r[0] for r in readers.pending(spark.createDataFrame([("u",), ("v",), ("w",)], "unit string"), log, "unit").orderBy("unit").collect()] == ["v", "w"]
    assert readers.settings({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_scalars(spark):
    row = spark.createDataFrame([(40.0000009, 30.0)], "a double, b double").select(
        scalars.on_ladder(F.col("a"), [20.0, 40.0]), scalars.snap(F.col("b"), [20.0, 40.0]), scalars.right_closed_bin(F.col("b"), [0, 30, 60], ["low", "high"]), scalars.number_in(F.lit(">60 mL")),
        scalars.jaccard(F.array(F.lit(1)), F.array().cast("array<int>")),
    ).first()
    assert tuple(row) == (True, 20.0, "low", 60.0, 0.0)


def test_streaming_windows(spark, tmp_path):
    from chronica.streaming.windows import windowed_counts

    rows = spark.createDataFrame([("k", T0, 1.0), ("k", T0 + H / 2, 2.0), ("k", T0 + 3 * H, 4.0)], "k string, t timestamp_ntz, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "t", ["k"], "v", "1 hour").writeStream.outputMode("complete").format("memory").queryName("w_out").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["total"]) for r in spark.table("w_out").collect()) == [(1, 4.0), (2, 3.0)]
