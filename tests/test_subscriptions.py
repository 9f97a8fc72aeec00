import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.streaming import status
from tessera.streaming import subscriptions as S

BEGIN, END = ("open",), ("done",)


def told(events, lasting):
    """What subscribers are told, by a plain loop, with those that are still subscribed: {key: (id, since)}."""
    held, out = {}, []
    for at, i, key, what in sorted(events):
        if key in held and at >= held[key][1] + lasting:
            out.append((key, held[key][0], "expired", held.pop(key)[1] + lasting))
        if what in BEGIN:
            if key in held:
                out.append((key, held[key][0], "replaced", at))
            held[key] = (i, at)
        elif key in held:
            out.append((key, held[key][0], what, at))
            if what in END:
                del held[key]
    return out, held


class Events:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)
        schema = StructType().add("ts", "timestamp").add("event_id", "long").add("user_id", "long").add("event_type", "string")
        self.stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")

    def add(self, events):
        rows = self.spark.createDataFrame(events, "s long, event_id long, user_id long, event_type string")
        rows.select(F.timestamp_seconds("s").alias("ts"), "event_id", "user_id", "event_type").coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self, lasting=1800):
        with S.state_on_disk(self.spark):
            rows = status.drained(S.followed(self.stream, "user_id", BEGIN, END, lasting, "10 seconds"), "append", f"{self.folder}/state", f"{self.folder}/out")
        return sorted((r.user_id, r.subscriber, r.status, r["at"] // 1_000_000) for r in rows.collect())


def test_a_subscription_outlives_the_query(spark, tmp_path):
    (tmp_path / "in").mkdir()
    e = Events(spark, tmp_path)
    e.add([(100, 1, 1, "open"), (110, 2, 1, "seen"), (90, 3, 1, "seen"), (100, 4, 2, "open"), (120, 5, 3, "seen"), (None, 6, 1, "seen"), (105, 7, None, "open"), (106, 8, 1, None)])
    first = [(1, 1, "seen", 110)]
    assert e.run() == first and spark.conf.get(S.PROVIDER) != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    e.add([(200, 10, 1, "seen"), (210, 11, 1, "open"), (220, 12, 1, "done"), (230, 13, 1, "seen")])  # another query, the same state
    second = [*first, (1, 1, "replaced", 210), (1, 1, "seen", 200), (1, 11, "done", 220)]
    assert e.run() == sorted(second)
    e.add([(5000, 20, 9, "open")])  # another key's event moves the watermark: 2 lapses without an event of its own
    third = [*second, (2, 4, "expired", 1900)]
    assert e.run() == sorted(third)
    assert e.run() == sorted(third)
    e.add([(5100, 21, 2, "seen"), (7000, 22, 9, "seen")])
    assert e.run() == sorted([*third, (9, 20, "expired", 6800)])


def test_random_events_agree_with_a_plain_loop(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rng, e, events = random.Random(11), Events(spark, tmp_path), []
    for batch in range(3):
        some = [(batch * 1000 + rng.randrange(1000), batch * 1000 + i, rng.choice([1, 1, 1, 2, 3, 4]), rng.choice(["open", "seen", "seen", "done"])) for i in range(60)]
        events += some
        rng.shuffle(some)
        e.add(some)
    got = e.run(100)
    plain, held = told(events, 100)
    mark = max(x[0] for x in events) - 10
    plain += [(key, i, "expired", since + 100) for key, (i, since) in held.items() if since + 100 < mark]
    assert got == sorted(plain) and {x[2] for x in got} == {"seen", "done", "expired", "replaced"}
