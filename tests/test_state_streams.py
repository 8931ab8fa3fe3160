"""Streams with state give the batch operators' rows, also after a restart."""

from pyspark.sql import functions as F

from glintfield.operators import catalog, folds
from glintfield.streaming import state

SCHEMA = "user_id bigint, event_id bigint, move double, wanted boolean"


def events(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 400")
    move = F.when(F.col("event_id") % 11 != 0, F.round((F.col("value") - 50) / 100, 3))
    return rows.select((F.col("user_id") % 5).alias("user_id"), "event_id", move.alias("move"), (F.col("value") > 50).alias("wanted"))


def test_streams_go_on_from_their_checkpoints(spark, tmp_path):
    state.prepared(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    all_events = events(spark)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    walk = state.with_state(stream, "user_id", state.BoundedWalk(["event_id"], 0.5, 0.0, 1.0), SCHEMA + ", value double")
    edges = state.with_state(stream, "user_id", state.FallingEdges(["event_id"]), SCHEMA)
    for low, high in ((0, 150), (150, 400)):  # the second part arrives after the first run has ended
        all_events.where(f"event_id >= {low} AND event_id < {high}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        walked, fell = state.drained(walk, f"{tmp_path}/walk"), state.drained(edges, f"{tmp_path}/edges")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    batch = folds.bounded_walk(all_events, "user_id", ["event_id"], start=0.5, low=0.0, high=1.0)
    pick = lambda df: sorted((r.user_id, r.event_id, round(r.value, 9)) for r in df.select("user_id", "event_id", "value").collect())
    assert pick(walked) == pick(batch) and len(pick(batch)) == all_events.count()
    want = catalog.falling_edges(all_events, "user_id", "event_id", "wanted").select("event_id")
    assert sorted(r.event_id for r in fell.collect()) == sorted(r.event_id for r in want.collect())


class Held:
    """A state store and timers of one key."""

    def __init__(self):
        self.value, self.timers = None, []

    getValueState = lambda self, *_: self
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    listTimers = lambda self: list(self.timers)
    getCurrentProcessingTimeInMs = lambda self: 1000

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_silent_user_is_forgotten():
    import pandas as pd

    held, walk = Held(), state.BoundedWalk(["at"], 0.5, 0.0, 1.0, forget_ms=50)
    walk.init(held)
    rows = lambda: list(walk.handleInputRows((1,), iter([pd.DataFrame({"at": [2, 1], "move": [0.25, 0.125]})]), held))[0]["value"].tolist()
    assert rows() == [0.625, 0.875] and rows() == [1.0, 1.0] and held.timers == [1050]
    assert list(walk.handleExpiredTimer((1,), held, held)) == [] and rows() == [0.625, 0.875]
