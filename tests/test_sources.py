"""Vocabulary reductions, markup, external units, profiles and walks on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from chronica.operators import graph, profiles
from chronica.sources import external, markup, vocabulary


def test_vocabulary(spark):
    keep = spark.createDataFrame([("C1",), ("C2",), ("C3",)], "cui string")
    rel = spark.createDataFrame(
        [("C1", "C2", "RN", "isa", "A", "N"), ("C1", "C2", "RN", "isa", "A", None), ("C1", "C1", "RO", "", "A", "N"), ("C1", "C9", "RO", "", "A", "N"), ("C1", "C3", "SIB", "", "A", "N"), ("C1", "C3", "RO", "", "Z", "N"), ("C1", "C3", "RO", " ", "A", "Y"), ("C3", "C1", "RB", "", "A", "N")],
        "c1 string, c2 string, rel string, rela string, sab string, sup string",
    )
    edges, reasons = vocabulary.reduced_relations(rel, "c1", "c2", "rel", "rela", "sab", "sup", keep, "cui", ["A"], ["SIB"], {"RB": "broader"})
    assert {tuple(r) for r in edges.collect()} == {("C2", "isa", "C1"), ("C1", "broader", "C3")}
    assert dict(map(tuple, reasons.collect())) == {"kept": 3, "self": 1, "gate": 1, "relation": 1, "source": 1, "suppressed": 1}
    names = spark.createDataFrame([("C1", "later", 1, "N", "ENG"), ("C1", "best", 2, "Y", "ENG"), ("C2", "eau", 3, "Y", "FRE")], "cui string, str string, o int, p string, lat string")
    assert [tuple(r) for r in vocabulary.preferred_names(names, "cui", "str", "o", F.col("p") == "Y", "lat", ["ENG"]).collect()] == [("C1", "best")]
    assert [tuple(r) for r in vocabulary.code_index(names, "cui", "str", "o", spark.createDataFrame([("BEST!",)], "n string"), "n").collect()] == [("best", "C1")]


def test_markup(spark):
    journal = "<article><body><sec><title>Dosing <xref>1</xref></title><p>Give <b>40</b> mg<xref>2</xref>.</p><sec><title>Kidney</title><list><list-item><p>less</p></list-item></list><table-wrap><table><tr><th>Stage</th><th>Dose</th></tr><tr><td>G4</td><td>80</td></tr></table></table-wrap></sec></sec></body></article>"
    docs = spark.createDataFrame([("a", journal), ("b", "<broken"), ("c", None)], "id string, x string")
    out = [(r["kind"], r["level"], r["text"]) for r in markup.blocks(docs, "id", "x").orderBy("seq").collect()]
    assert out == [("heading", 1, "Dosing"), ("paragraph", 0, "Give 40 mg."), ("heading", 2, "Kidney"), ("list", 0, "less"), ("table", 0, "Stage: G4; Dose: 80")]
    label = "<document><section><title>Use</title><text><paragraph>Oral.</paragraph></text></section></document>"
    assert markup.label_sections(label) == [("heading", 1, "Use"), ("paragraph", 0, "Oral.")]
    labels = spark.createDataFrame([("l", [("Use", "Oral."), ("Empty", " ")])], "id string, s array<struct<title:string,text:string>>")
    assert [r["text"] for r in markup.label_json_blocks(labels, "id", "s").orderBy("seq").collect()] == ["Use", "Oral.", "Empty"]


def test_rate_limiter_waits_for_the_window():
    now = [0.0]
    limiter = external.RateLimiter(2, 10, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        limiter.acquire()
    assert now[0] == 10
    limiter.penalise()
    limiter.acquire()
    assert now[0] == 20


def test_retries_end():
    tries = []
    with pytest.raises(ValueError):
        external.with_retries(lambda: tries.append(1) or int("x"), 3, 0, lambda s: None)
    assert len(tries) == 3


def test_units_and_replies(spark):
    units = spark.createDataFrame([("u1", "ok"), ("u2", "bad")], "unit string, ask string")

    def client():
        def ask(text):
            if text == "bad":
                raise ValueError("refused")
            return '```json\n{"relations": [{"subject": "furosemide", "predicate": "treats", "object": "oedema"}, ["a", "b"], ["x", "y", "z"]]}\n```'

        return ask

    out = {r["unit"]: r for r in external.run_units(units, "unit", "ask", client).collect()}
    assert out["u1"]["ok"] and not out["u2"]["ok"] and out["u2"]["error"] == "refused"
    replies = spark.createDataFrame([("u1", out["u1"]["reply"]), ("u2", None), ("u3", "no json")], "unit string, reply string")
    triples = external.parsed_triples(replies, "unit", "reply")
    assert {tuple(r)[2:] for r in triples.collect()} == {("furosemide", "treats", "oedema"), ("x", "y", "z")}
    marked = external.grounded(triples.withColumn("t", F.lit("Furosemide lowers x.")), "t", ["oedema"])
    assert {r["head"]: r["reason"] for r in marked.collect()} == {"furosemide": "kept", "x": "tail not in text"}
    doses = spark.createDataFrame([('{"doses": [40, -1, null, 900, 5]}',), ('{"doses": [20]}',), ("?",)], "r string").select(external.schedule_in(F.col("r"))).collect()
    assert [r[0] for r in doses] == [[40.0, 0.0, 0.0, 400.0], [20.0, 0.0, 0.0, 0.0], None]


def test_profiles(spark):
    v = "array<struct<number:int,is_index:boolean,conditions:array<string>,procedures:array<string>,drugs:array<string>,concept_times:map<string,string>>>"
    rows = [("p", "2150-01-05T10:00:00", [
        (1, False, ["old", "a"], None, ["d"], {}), (2, True, ["old", "new", "chronic"], ["x", "y"], ["d", "e"], {"x": "2150-01-05 09:00:00", "y": "2150-01-05T11:00:00", "d": "2150-01-05", "e": "2150-01-04"}),
    ]), ("q", "2150-01-05T10:00:00", [])]
    df = spark.createDataFrame(rows, f"dose_id string, index_t0 string, visits {v}")
    assert {tuple(r)[1:] for r in profiles.index_cut(df, ["chronic"]).collect()} == {("conditions", "old"), ("conditions", "chronic"), ("procedures", "x"), ("drugs", "e")}
    pairs = {(r["a"], r["b"]) for r in profiles.consecutive_pairs(df).collect()}
    assert ("a", "new") in pairs and ("d", "old") in pairs and ("old", "old") not in pairs and len(pairs) == 3 * 7 - 2 - 1


def test_walks_meet(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("c", "s", "b"), ("c", "t", "d"), ("a", "u", "d")], "head string, relation string, tail string")
    pairs = spark.createDataFrame([("a", "c"), ("a", "zz")], "source string, target string")
    out = {(tuple(r["nodes"]), tuple(r["relations"])) for r in graph.meeting_paths(edges, pairs).collect()}
    assert out == {(("a", "b", "c"), ("r", "-s")), (("a", "d", "c"), ("u", "-t"))}
    sets = spark.createDataFrame([(["b", "a"],), (["a", "b", "c"],)], "s array<string>")
    assert {tuple(r) for r in graph.item_pairs(sets, "s", [["x", "y"]]).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("x", "y")}
