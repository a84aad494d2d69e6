"""Streams against their batch twins."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from test_claims import REQUEST, random_requests, sequential
from tarmaq.operators.sessions import lapsed, sessions
from tarmaq.streaming import CLOSING, drain, open_files, read_files
from tarmaq.streaming.claims import drain_claims
from tarmaq.streaming.holds import lapsed_holds
from tarmaq.streaming.timers import HoldTimers, lapsed_at_limit
from tarmaq.streaming.windows import stream_sessions, tumbling_counts

BASE = datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def make_events(spark, folder, days=4, parts=range(4)):
    """Four files in time order."""
    rows = [(i, BASE + timedelta(minutes=(37 * i) % (days * 1440)), 0 if i % 3 else i % 7,
             ("view", "purchase", "click")[i % 3]) for i in range(600)]
    rows.sort(key=lambda r: r[1])
    for part in parts:
        piece = spark.createDataFrame(rows[part * 150:(part + 1) * 150], EVENT)
        piece.coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(rows, EVENT)


def closing(spark):
    return spark.createDataFrame([(-1, CLOSING, -1, kind) for kind in ("view", "purchase")], EVENT)


def stream(spark, folder, target):
    schema = spark.createDataFrame([], EVENT).schema
    return open_files(spark, folder, schema, target, files_per_trigger=1)


def of(df, kind):
    return df.filter(F.col("event_type") == kind)


def test_holds(spark, rows, tmp_path):
    folder, target = str(tmp_path / "events"), str(tmp_path / "target")
    events = make_events(spark, folder)
    source = stream(spark, folder, target)
    got = drain(lapsed_holds(of(source, "view"), of(source, "purchase"), "user_id", "event_id", "ts", 30), target,
                closing(spark))
    batch = lapsed(of(events, "view"), of(events, "purchase"), "user_id", "ts", 30).filter("not paid")
    assert rows(got, "event_id") == rows(batch, "event_id") and batch.count() > 0


def test_holds_by_timers(spark, rows, tmp_path):
    folder, target = str(tmp_path / "events"), str(tmp_path / "target")
    events = make_events(spark, folder)
    source = stream(spark, folder, target)
    got = drain(lapsed_at_limit(of(source, "view"), of(source, "purchase"), "user_id", "event_id", "ts", 30), target,
                closing(spark))
    batch = lapsed(of(events, "view"), of(events, "purchase"), "user_id", "ts", 30).filter("not paid")
    assert rows(got, "event_id", "user_id", "held_at") == rows(batch, "event_id", "user_id", "ts") and batch.count() > 0


def test_a_hold_comes_when_its_own_limit_has_passed(spark, tmp_path):
    """Limit 30 minutes, no delay: known once an event is later than that, long before two slots are over."""
    folder, target = str(tmp_path / "events"), str(tmp_path / "target")

    def run(*rows):
        data = [(i, BASE + timedelta(minutes=m), u, kind) for i, m, u, kind in rows]
        spark.createDataFrame(data, EVENT).coalesce(1).write.mode("append").parquet(folder)
        source = read_files(spark, folder, spark.createDataFrame([], EVENT).schema)
        out = lapsed_at_limit(of(source, "view"), of(source, "purchase"), "user_id", "event_id", "ts", 30, "0 seconds")
        return sorted(r.event_id for r in drain(out, target).collect())

    assert run((1, 0, 1, "view"), (2, 1, 2, "view"), (3, 29, 3, "purchase")) == []
    assert run((4, 30, 1, "purchase"), (5, 31, 1, "view"), (6, 32, 4, "purchase")) == [2]  # 1 was paid at its limit
    assert run((7, 62, 4, "purchase")) == [2, 5]


def test_counts(spark, rows, tmp_path):
    folder, target = str(tmp_path / "events"), str(tmp_path / "target")
    events = make_events(spark, folder)
    got = drain(tumbling_counts(stream(spark, folder, target), "ts", "1 day", ["event_type"]), target, closing(spark))
    want = events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz"), "event_type").count()
    assert rows(got) == rows(want)


def test_sessions_go_on_after_a_restart(spark, rows, tmp_path):
    folder, target = str(tmp_path / "events"), str(tmp_path / "target")
    make_events(spark, folder, parts=range(2))
    first = drain(stream_sessions(stream(spark, folder, target), "user_id", "ts", 60), target).count()
    events = make_events(spark, folder, parts=range(2, 4))
    for _ in range(2):  # a second run of a closed stream changes nothing
        got = drain(stream_sessions(stream(spark, folder, target), "user_id", "ts", 60), target, closing(spark))
        assert rows(got) == rows(sessions(events, "user_id", "ts", 60)) and 0 < first < got.count()


def test_claims_in_arrival_order(spark, tmp_path):
    requests = random_requests(7, orders=40)
    requests.sort(key=lambda r: (r[4], r[0]))
    orders = list(dict.fromkeys(r[0] for r in requests))
    folder = str(tmp_path / "requests")
    for part in range(3):  # three files, requests in time order across them
        mine = set(orders[part * 14:(part + 1) * 14])
        piece = spark.createDataFrame([r for r in requests if r[0] in mine], REQUEST)
        piece.coalesce(1).write.mode("append").parquet(folder)
    seats = spark.createDataFrame([(f"F{f}", s // 4 + 1, s % 4 + 1, None)
                                   for f in range(3) for s in range(12)],
                                  "flight_id string, s_row int, s_column int, order_id string")
    schema = spark.createDataFrame([], REQUEST).schema
    decided = drain_claims(read_files(spark, folder, schema, files_per_trigger=1), seats, str(tmp_path / "target"))
    assert {r.order_id for r in decided.filter("accepted").collect()} == sequential(requests)
    assert decided.count() == len(orders)


def test_claims_go_on_after_a_restart(spark, tmp_path):
    """Seats given away before stay taken; the seat table is not looked at again."""
    folder, target = str(tmp_path / "requests"), str(tmp_path / "target")
    seats = [("F", 1, c, None if c < 4 else "X") for c in (1, 2, 3, 4)]
    frame = spark.createDataFrame(seats, "flight_id string, s_row int, s_column int, order_id string")
    schema = spark.createDataFrame([], REQUEST).schema
    asked = [[("A", "F", 1, 1, BASE), ("B", "F", 1, 4, BASE)],
             [("C", "F", 1, 1, BASE), ("C", "F", 1, 2, BASE), ("D", "F", 1, 2, BASE), ("E", "F", 9, 9, BASE)],
             [("G", "F", 1, 3, BASE + timedelta(hours=1)), ("H", "F", 1, 3, BASE), ("I", "F", 1, 2, BASE)]]
    for part, table in zip(asked, (frame, frame.limit(0), frame)):
        spark.createDataFrame(part, REQUEST).coalesce(1).write.mode("append").parquet(folder)
        decided = drain_claims(read_files(spark, folder, schema), table, target)
    assert {r.order_id: (r.seats, r.accepted) for r in decided.collect()} == {
        "A": (1, True), "B": (1, False), "C": (2, False), "D": (1, True), "E": (1, False),
        "G": (1, False), "H": (1, True), "I": (1, False)}


def test_a_call_reads_and_writes_the_state_once():
    """However many events it brings; one timer is enough for all limits that the watermark has passed."""
    class Value:
        calls, held = 0, None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

        def clear(self):
            self.calls, self.held = self.calls + 1, None

    class Handle:
        def __init__(self):
            self.state, self.timers = Value(), []

        def getValueState(self, name, schema):
            return self.state

        def registerTimer(self, ms):
            self.timers.append(ms)

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    handle, processor, minute = Handle(), HoldTimers("bigint", 30), 60_000_000
    processor.init(handle)
    events = [{"hold": k, "micros": k * minute} for k in range(1000)] + [{"hold": None, "micros": 500 * minute}]
    assert list(processor.handleInputRows((7,), iter(events), At(0))) == []
    assert handle.state.calls == 2 and handle.timers == [30 * 60_000]
    out = list(processor.handleExpiredTimer((7,), At(600 * 60_000 + 1), At(30 * 60_000)))
    assert handle.state.calls == 4 and handle.timers[1:] == [601 * 60_000]
    assert [r.hold_id for r in out] == [*range(470), *range(501, 571)] and out[1].held_at == datetime(1970, 1, 1, 0, 1)
    list(processor.handleExpiredTimer((7,), At(2000 * 60_000), At(601 * 60_000)))
    assert handle.state.held is None and len(handle.timers) == 2
