import datetime as dt
import random

from chronica.operators.intervals import periods_and_gaps

T0 = dt.datetime(2150, 3, 1)
SCHEMA = "who string, item string, a timestamp_ntz, b timestamp_ntz, what string, shard int, k0 int"


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def brute(rows):
    groups = {}
    for w, i, a, b in rows:
        if a is not None and b is not None and b > a:
            groups.setdefault((w, i), []).append((a, b))
    out = set()
    for (w, i), spans in groups.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(w, i, "period", a, b) for a, b in merged}
        out |= {(w, i, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(w, i, at(a), at(b), "x", 1, 2) for w, i, a, b in rows], SCHEMA)
    out = periods_and_gaps(df, ["who", "item"], "a", "b", **more)
    assert out.columns == ["who", "item", "what", "from_time", "to_time"]
    minutes = lambda t: int((t - T0).total_seconds() / 60)
    got = [(r[0], r[1], r[2], minutes(r[3]), minutes(r[4])) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_touching_nested_null_and_repeated(spark):
    rows = [("p", "x", 0, 10), ("p", "x", 10, 20), ("p", "x", 2, 5), ("p", "x", 30, 40), ("p", "x", 30, 40), ("p", "x", None, 9), ("p", "x", 50, None), ("p", "x", 60, 60), (None, "x", 1, 2), (None, "x", 5, 6)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, [("p", "x", None, None)]) == set()


def test_hot_entity_in_many_shards(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        a = rng.randrange(0, 60 * 24 * 30)
        rows.append((rng.choice(["hot", "hot", "hot", "b", None]), "x", a, a + rng.choice([5, 30, 60, 60 * 24 * 3])))
    for most in (10, 10**6):
        assert run(spark, rows, shard_micros=6 * 3600 * 10**6, most_rows=most) == brute(rows)
