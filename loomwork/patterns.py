"""Row patterns over ordered events, as a table function with a partitioned table argument.

A pattern is a row of steps such as "down+ up+": a step takes rows whose value is below (down), above (up) or equal to (same) the one before,
once, or as often as they come with a +. A match begins at the row before its first step's first row, is as long as it can be, and
the next one may begin at its last row. An automaton reads a partition row by row and holds one thread for each step, the one that began first, so a
partition of any size streams through. The columns of the result follow from the pattern and from the table's own types.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from loomwork.tables import load


def parsed(pattern: str) -> list[tuple[str, bool]]:
    """(kind, whether it repeats) of each step."""
    steps = [(step.removesuffix("+"), step.endswith("+")) for step in pattern.split()]
    if not steps or any(kind not in ("down", "up", "same") for kind, _ in steps):
        raise ValueError(f"a pattern is made of down, up and same, each with or without +: {pattern!r}")
    return steps


class Matches:
    """Matches in a stream of (id, value) in order; a null value ends whatever has begun."""

    def __init__(self, steps: list[tuple[str, bool]]):
        self.steps = steps
        #: by step: number of the first row, its id, rows so far, id at the end of each step begun
        self.threads: dict[int, tuple[int, object, int, list]] = {}
        self.row, self.last, self.before = 0, None, None

    def _takes(self, i: int, kind: str | None) -> bool:
        return i < len(self.steps) and self.steps[i][0] == kind

    def _done(self) -> Iterator[tuple]:
        """The match whose last step has just ended, if any; threads that began inside it go."""
        thread = self.threads.get(len(self.steps) - 1)
        if thread:
            self.threads = {i: t for i, t in self.threads.items() if t[0] >= self.row - 1}
            yield thread[1], thread[3], thread[2]

    def add(self, id_, value) -> Iterator[tuple]:
        """(first id, id at the end of each step, number of rows) of matches that ended before this row."""
        kind = None
        if value is not None and self.before is not None:
            kind = "down" if value < self.before else "up" if value > self.before else "same"
        final = len(self.steps) - 1
        if final in self.threads and not (self.steps[final][1] and self._takes(final, kind)):
            yield from self._done()
        new: dict[int, tuple[int, object, int, list]] = {}

        def keep(i: int, thread: tuple[int, object, int, list]) -> None:
            if i not in new or thread[0] < new[i][0]:
                new[i] = thread

        for i, (first, first_id, rows, ends) in self.threads.items():
            if self.steps[i][1] and self._takes(i, kind):
                keep(i, (first, first_id, rows + 1, [*ends[:-1], id_]))
            if self._takes(i + 1, kind):
                keep(i + 1, (first, first_id, rows + 1, [*ends, id_]))
        if self._takes(0, kind):
            keep(0, (self.row - 1, self.last, 2, [id_]))
        self.threads = new
        self.row, self.last, self.before = self.row + 1, id_, value

    def close(self) -> Iterator[tuple]:
        yield from self._done()


@F.udtf
class MatchRows:
    """MatchRows(table of (key, id, value) partitioned by key and ordered, pattern): (key, first_id, rows, <n>_<kind>_ends for each step)."""

    @staticmethod
    def analyze(table: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        key, id_, _ = table.dataType.fields
        schema = StructType().add(key.name, key.dataType).add("first_id", id_.dataType).add("rows", LongType())
        for i, (kind, _) in enumerate(parsed(pattern.value)):
            schema = schema.add(f"{i + 1}_{kind}_ends", id_.dataType)
        return AnalyzeResult(schema)

    def __init__(self):
        self.matches = None

    def eval(self, row, pattern: str):
        if self.matches is None:
            self.key, self.matches = row[0], Matches(parsed(pattern))
        for first, ends, n in self.matches.add(row[1], row[2]):
            yield self.key, first, n, *ends

    def terminate(self):
        if self.matches is not None:
            for first, ends, n in self.matches.close():
                yield self.key, first, n, *ends


def dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a user's values fall, by one event or more, and then rise."""
    e = load(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", "value", "ts")
    rows = e.select("user_id", "event_id", F.when(~F.isnan("value"), F.col("value")).alias("value"), "ts")
    # what orders the rows names them too, so the function has its three columns
    rows = rows.select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    found = MatchRows(rows.asTable().partitionBy("user_id").orderBy("at"), F.lit("down+ up+"))
    return found.select("user_id", F.col("first_id.event_id").alias("first_event"), F.col("1_down_ends.event_id").alias("lowest_event"), F.col("2_up_ends.event_id").alias("last_event"), "rows")


QUERIES = {"dips": dips}
ORACLES = {
    "dips": """
with e as (select user_id, ts, event_id, value, row_number() over w as i, sign(value - lag(value) over w) as s from (select * replace (case when not isnan(value) then value end as value) from events where user_id is not null)
           window w as (partition by user_id order by ts nulls first, event_id nulls first)),
r as (select *, i - row_number() over (partition by user_id, s order by i) as run from e where s is not null),
runs as (select user_id, s, min(i) as a, max(i) as z from r group by user_id, s, run)
select d.user_id, f.event_id as first_event, b.event_id as lowest_event, l.event_id as last_event, u.z - d.a + 2 as rows
from runs d join runs u on u.user_id = d.user_id and d.s = -1 and u.s = 1 and u.a = d.z + 1
join e f on f.user_id = d.user_id and f.i = d.a - 1 join e b on b.user_id = d.user_id and b.i = d.z join e l on l.user_id = d.user_id and l.i = u.z""",
}
