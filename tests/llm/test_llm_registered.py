"""The registered queries of this folder against their SQL, and properties where SQL can't give them."""

import pytest
from helpers import DATA, rows_of, sql_rows

from chronica.llm import queries as Q
from chronica.llm import sql


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, DATA)
    if name in sql.oracle_sql():
        assert rows_of(df) == sql_rows(sql.oracle_sql()[name])
    else:
        assert df.columns and df.count() >= 0


def test_every_pair_comes_out(spark):
    """The SQL of p3_pairs without its floor."""
    whole = sql.P3_PAIRS.replace("HAVING count(*) >= 5", "")
    assert whole != sql.P3_PAIRS
    got = rows_of(Q.queries()["p3_every_pair"](spark, DATA))
    assert got == sql_rows(whole)
    assert sum(got[1].values()) > Q.p3_pairs(spark, DATA).count()


def test_splits_keep_persons_together(spark):
    rows = Q.p1_splits(spark, DATA).collect()
    by = {}
    for r in rows:
        by.setdefault(r["person"], set()).add(r["split"])
    assert all(len(s) == 1 for p, s in by.items() if p is not None)
    assert len(rows) == spark.read.parquet(f"{DATA}/cohort.parquet").count()


def test_packs_hold(spark):
    caps = dict(Q._capacities(spark, DATA))
    rows = Q.p8_pack(spark, DATA).collect()
    fill, sizes = {}, {}
    for r in rows:
        if r["container"] is not None:
            fill[r["pack_name"], r["container"]] = fill.get((r["pack_name"], r["container"]), 0) + r["piece_size"]
        sizes.setdefault((r["pack_name"], r["doc_id"]), []).append(r["piece_size"])
    assert all(n <= caps[p] for (p, _), n in fill.items())
    whole = {r["doc_id"]: r["tokens"] for r in Q._sizes(spark, DATA).select("doc_id", "tokens").collect()}
    for (p, d), parts in sizes.items():
        assert sum(x or 0 for x in parts) == (whole[d] or 0)
        assert len(parts) == 1 or whole[d] > caps[p]
    for p, cap in caps.items():
        used = [n for (q, _), n in fill.items() if q == p]
        least = -(-sum(used) // cap)
        assert len(used) <= 1.05 * least + 1


def test_shares_are_met(spark):
    rows = {r["source"]: r for r in Q.p9_shares(spark, DATA).collect()}
    live = {s: r for s, r in rows.items() if r["tokens"]}
    scale = sum(r["target_share"] for r in live.values())
    for r in live.values():
        assert r["repeats_used"] <= r["max_repeats"]
        assert abs(r["share_reached"] - r["target_share"] / scale) < 0.03
