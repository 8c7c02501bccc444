"""Calls to outside services behind injected clients: rate limit, retries, units of work that can be resumed."""

from __future__ import annotations

import json
import random
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[str], str]


class RateLimiter:
    """At most ``calls`` in any ``seconds``; one per task, so external calls run on few partitions."""

    def __init__(self, calls: int, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.seconds, self.clock, self.sleep = calls, seconds, clock, sleep
        self.made: deque[float] = deque()

    def acquire(self) -> None:
        """Wait until a call is free."""
        while True:
            now = self.clock()
            while self.made and now - self.made[0] >= self.seconds:
                self.made.popleft()
            if len(self.made) < self.calls:
                self.made.append(now)
                return
            self.sleep(self.seconds - (now - self.made[0]))

    def penalise(self) -> None:
        """Use up the window, after the service refused a call."""
        now = self.clock()
        self.made = deque([now] * self.calls)


def with_retries(call: Callable[[], Any], tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The result of a call, tried again after growing pauses."""
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n + 1 == tries:
                raise
            sleep(wait * 2**n * (1 + random.random() / 4))


def run_units(units: DataFrame, unit: str, request: str, client: Callable[[], Client], partitions: int = 2, calls: int = 60, seconds: float = 60.0, wait: float = 1.0) -> DataFrame:
    """(unit, ok, reply, error) for each unit: its request sent through a client made once per task.

    An error is an answer too: the row says so and ``readers.pending`` brings the unit back.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, limit = client(), RateLimiter(calls, seconds)
        for batch in batches:
            rows = []
            for u, r in zip(batch["u"], batch["r"]):
                limit.acquire()
                try:
                    rows.append((u, True, with_retries(lambda r=r: ask(r), wait=wait), None))
                except Exception as error:  # noqa: BLE001
                    rows.append((u, False, None, str(error)[:200]))
            yield pd.DataFrame(rows, columns=["unit", "ok", "reply", "error"])

    few = units.select(F.col(unit).cast("string").alias("u"), F.col(request).alias("r")).repartition(partitions)
    return few.mapInPandas(work, "unit string, ok boolean, reply string, error string")


#: The keys under which a reply may hold its rows, and the names of a triple's parts, in the order they are tried.
ROWS_UNDER = ("triples", "relationships", "output", "result", "data")
HEADS, RELATIONS, TAILS = ("head", "subject", "entity1"), ("relation", "predicate", "relationship"), ("tail", "object", "entity2")


def triples_in(reply: str | None) -> list[tuple[str, str, str]]:
    """Triples of a reply: a list, or the list under a known key or else the first list of an object; fenced text too.

    A row is a list of three, of whatever kind, or an object that names all three parts. Rows with a blank part go.
    """
    if not reply:
        return []
    try:
        data = json.loads(re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", reply))
    except ValueError:
        return []
    if isinstance(data, dict):
        lists = [data[k] for k in ROWS_UNDER if isinstance(data.get(k), list)] + [v for v in data.values() if isinstance(v, list)]
        data = lists[0] if lists else []
    out = []
    for row in data if isinstance(data, list) else []:
        if isinstance(row, dict):
            row = [next((row[k] for k in names if row.get(k)), None) for names in (HEADS, RELATIONS, TAILS)]
        if isinstance(row, list) and len(row) == 3 and all(x is not None and str(x).strip() for x in row):
            out.append(tuple(str(x).strip() for x in row))
    return out


def parsed_triples(replies: DataFrame, unit: str, reply: str) -> DataFrame:
    """(unit, n, head, relation, tail) of all replies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, n, *t) for u, r in zip(batch["u"], batch["r"]) for n, t in enumerate(triples_in(r))]
            yield pd.DataFrame(rows, columns=["unit", "n", "head", "relation", "tail"])

    rows = replies.select(F.col(unit).cast("string").alias("u"), F.col(reply).alias("r"))
    return rows.mapInPandas(run, "unit string, n int, head string, relation string, tail string")


def grounded(triples: DataFrame, text: str, concepts: list[str]) -> DataFrame:
    """``triples`` with reason: kept, or why not. Both ends must stand in the text or be a concept; one must be a concept.

    Columns head, tail and ``text``; anchor says whether a concept was met exactly or inside an end.
    """
    low = lambda c: F.lower(F.trim(c))
    known = [c.lower() for c in concepts]
    exact = lambda c: low(F.col(c)).isin(known)
    inside = lambda c: F.exists(F.array(*[F.lit(k) for k in known]), lambda k: F.contains(low(F.col(c)), k))
    present = lambda c: F.contains(F.lower(F.col(text)), low(F.col(c))) | exact(c)
    anchor = F.when(exact("head") | exact("tail"), "exact").when(inside("head") | inside("tail"), "inside")
    reason = (
        F.when((F.trim("head") == "") | (F.trim("tail") == ""), "blank")
        .when((F.length("head") > 80) | (F.length("tail") > 80), "too long")
        .when(~present("head"), "head not in text").when(~present("tail"), "tail not in text").when(anchor.isNull(), "no concept").otherwise("kept")
    )
    return triples.withColumn("anchor", anchor).withColumn("reason", F.coalesce(reason, F.lit("blank")))


def schedule_in(reply: Column, slots: int = 4, most: float = 400.0) -> Column:
    """A reply's list of doses under ``doses``: cut or filled with 0 to ``slots``, clamped to 0..``most``; null if it is no JSON list."""
    given = F.from_json(F.regexp_replace(reply, r"^\s*```(?:json)?\s*|\s*```\s*$", ""), "struct<doses:array<double>>").doses
    filled = F.slice(F.concat(given, F.array_repeat(F.lit(0.0), slots)), 1, slots)
    return F.when(given.isNotNull(), F.transform(filled, lambda x: F.least(F.lit(most), F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0))))))


def payload(fields: list[Column]) -> Column:
    """A JSON object of the fields that are not null."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
