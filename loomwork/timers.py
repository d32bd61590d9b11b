"""State of one's own with event-time timers: a funnel over a stream of events.

Each view opens a funnel: it is at step 2 once the same user clicks after it, and at step 3 once they buy after that click, both
within `within` seconds of the view. Its row is given out when the watermark says that no event of this time can come any more.

State is held for users of neighbouring ids together, USERS at most however large the table is, as each key costs several calls to the state store
in a batch. Their events wait in one value, packed. A timer stands for the oldest hour (of `within` seconds) that waits: when it and the one after it
are over, the funnels of all hours that are over by then are closed at once and their events dropped, and the timer of the next one is set. So the
state holds the last two hours and what has come since the watermark, and a batch's events may come in any order. Later events are dropped by the watermark.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from loomwork.streams import dealt_by_time, in_batches
from loomwork.tables import load

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
USERS = 64
ROW = "user_id long, view_id long, step long, click_id long, purchase_id long"


def funnels(views: list[tuple[int, int]], clicks: list[tuple[int, int]], purchases: list[tuple[int, int]], within: int) -> list[tuple]:
    """(view, step, click, purchase) of each view; all are (microseconds, id) in order."""
    out = []
    for at, view in views:
        end, click, purchase = at + within * 1_000_000, None, None
        i = bisect_right(clicks, (at, view))
        if i < len(clicks) and clicks[i][0] <= end:
            click = clicks[i]
            i = bisect_right(purchases, click)
            if i < len(purchases) and purchases[i][0] <= end:
                purchase = purchases[i]
        out.append((view, 1 + (click is not None) + (purchase is not None), click and click[1], purchase and purchase[1]))
    return out


class Funnel(StatefulProcessor):
    KINDS = ("view", "click", "purchase")

    def __init__(self, within: int):
        self.within = within

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "events binary, due long")

    def held(self) -> tuple[list[tuple[int, int, int, int]], int | None]:
        """(user, microseconds, id, kind) of the events that wait, and the hour that the timer stands for."""
        found = self.waiting.get()
        if found is None:
            return [], None
        flat = array("q", bytes(found[0]))
        return list(zip(*(flat[i::4] for i in range(4)), strict=True)), found[1]

    def hold(self, events: list[tuple[int, int, int, int]], due: int) -> None:
        self.waiting.update((array("q", chain.from_iterable(events)).tobytes(), due))

    def hour(self, us: int) -> int:
        return us // (self.within * 1_000_000)

    def over(self, hour: int) -> int:
        """The milliseconds at which the hour and the one after it are over."""
        return (hour + 2) * self.within * 1000

    def wake(self, hour: int) -> None:
        self.handle.registerTimer(self.over(hour) - 1)  # a timer goes off once the watermark is beyond it

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["user_id"], r["us"], r["event_id"], r["kind"]) for r in rows]
        events, due = self.held()
        first = self.hour(min(us for _, us, _, _ in new))
        if due is None or first < due:
            self.wake(first)
            due = first
        self.hold(events + new, due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, events = timerValues.getCurrentWatermarkInMs(), sorted(self.held()[0])
        is_over = lambda us: self.over(self.hour(us)) <= now
        left = [e for e in events if not is_over(e[1])]
        if left:
            due = self.hour(min(us for _, us, _, _ in left))
            self.wake(due)
            self.hold(left, due)
        else:
            self.waiting.clear()
        for user, found in groupby(events, key=itemgetter(0)):
            views, clicks, purchases = of = [], [], []
            for _, us, i, kind in found:
                if kind or is_over(us):
                    of[kind].append((us, i))
            for view, step, click, purchase in funnels(views, clicks, purchases, self.within):
                yield Row(user_id=user, view_id=view, step=step, click_id=click, purchase_id=purchase)


def funnel(stream: DataFrame, within: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Of a stream (user_id, event_id, event_type, ts); rows with a null in one of these open and continue nothing."""
    rows = stream.where(F.col("event_type").isin(*Funnel.KINDS)).dropna(subset=["user_id", "event_id", "ts"]).withWatermark("ts", late)
    kind = F.array_position(F.lit(list(Funnel.KINDS)), F.col("event_type")) - 1
    users = F.shiftright("user_id", USERS.bit_length() - 1)
    keyed = rows.select(users.alias("users"), "user_id", "event_id", kind.alias("kind"), "ts", F.unix_micros("ts").alias("us")).groupBy("users")
    return keyed.transformWithState(Funnel(within), ROW, "Append", "EventTime")


def closed_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From view to click to purchase within an hour, over five batches, each after a restart from the checkpoint."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").cast(T.TimestampType()).alias("ts"))
    return in_batches(dealt_by_time(e), funnel, spark_sql_streaming_noDataMicroBatches_enabled="true", spark_sql_streaming_stateStore_providerClass=ROCKS)


QUERIES = {"stream_closed_funnels": closed_funnels}
ORACLES = {
    "stream_closed_funnels": """
with e as (select * from events where user_id is not null and event_id is not null and ts is not null and event_type in ('view', 'click', 'purchase')),
mark as (select date_trunc('milliseconds', max(ts)) - interval 10 minute as t from e),
v as (select * from e where event_type = 'view' and time_bucket(interval 1 hour, ts) + interval 2 hour <= (select t from mark)),
c as (select v.user_id, v.event_id as view_id, v.ts, min((c.ts, c.event_id)) as click from v left join e c
      on c.event_type = 'click' and c.user_id = v.user_id and (c.ts, c.event_id) > (v.ts, v.event_id) and c.ts <= v.ts + interval 1 hour group by all),
p as (select c.user_id, view_id, click, min((p.ts, p.event_id)) as purchase from c left join e p
      on p.event_type = 'purchase' and p.user_id = c.user_id and (p.ts, p.event_id) > c.click and p.ts <= c.ts + interval 1 hour group by all)
select user_id, view_id, cast(1 + (click[2] is not null)::int + (purchase[2] is not null)::int as bigint) as step, click[2] as click_id, purchase[2] as purchase_id from p""",
}
