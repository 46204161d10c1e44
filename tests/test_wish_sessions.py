"""Sessions of wishes: what the stream gives is what the batch form gives, for messages that come late, resets and known sessions."""

import datetime as dt
import random
import uuid

import pytest

from labelmatch.streaming import wishes

SCHEMA = "session_id string, ts timestamp, wish string, value string, first string"
NOON = dt.datetime(2024, 5, 1, 12)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, old)


def row(s, seconds, wish, value):
    return s, NOON + dt.timedelta(seconds=seconds), wish, value, "x"


def kept(rows):
    return sorted((r.session_id, r.first, r.last, r.turns, tuple((w.wish, w.value) for w in r.wishes)) for r in rows)


def by_hand(rows, ttl=600):
    out, by_id = [], {}
    for s, ts, wish, value, _ in rows:
        if s is not None and ts is not None:
            by_id.setdefault(s, []).append((ts, wish, value))
    for s, said in by_id.items():
        said.sort(key=lambda m: m[0])
        groups = [[said[0]]]
        for a, b in zip(said, said[1:]):
            groups.append([b]) if (b[0] - a[0]).total_seconds() > ttl else groups[-1].append(b)
        for g in groups:
            reset = max((t for t, w, _ in g if w == "reset"), default=dt.datetime.min)
            last = {}
            for t, w, v in sorted(g, key=lambda m: (m[0], m[2] is not None, m[2] or "")):
                if w not in (None, "reset") and t > reset:
                    last[w] = v
            out.append((s, g[0][0], g[-1][0], len(g), tuple(sorted(last.items()))))
    return sorted(out, key=repr)


def run(spark, folder, batches, known=None):
    """Each batch is a file, read one at a time."""
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").json(str(folder / "in"))
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").json(str(folder / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    name = f"wishes_{uuid.uuid4().hex}"
    query = wishes.stream_wish_sessions(source, "20 minutes", 600, known).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return kept(spark.table(name).collect())


def made(seed, n):
    r = random.Random(seed)
    return [row(r.choice("ab"), r.randrange(0, 9000), r.choice(["color", "body", "reset", "food", None]), r.choice(["1", "2", None])) for _ in range(n)]


END = row("end", 10**6, "color", "z")


def test_batch_form_equals_a_plain_fold(spark):
    rows = [*made(1, 60), row("c", 0, "color", "red"), row("c", 600, "color", None), row("c", 1201, "body", "x"), row("d", 5, "color", "a"), row("d", 5, "color", "b"), row("d", 5, "color", "b"), row("e", 5, "color", "b"), row("e", 5, "reset", None), row(None, 1, "color", "x"), ("f", None, "color", "x", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(kept(wishes.wish_sessions(df, 600).collect()), key=repr) == by_hand(rows)
    assert wishes.wish_sessions(df.limit(0), 600).collect() == []


def test_stream_equals_batch_for_late_messages_and_resets(spark, tmp_path, rocks):
    rows = sorted(made(2, 60), key=lambda m: m[1])
    late = [m for i, m in enumerate(rows) if i % 3 == 1]  # a third comes up to 20 minutes late: it joins sessions and is overtaken by resets
    order = sorted([(m[1], m) for m in rows if m not in late] + [(m[1] + dt.timedelta(seconds=1100), m) for m in late], key=lambda x: (x[0], repr(x[1])))
    batches = [[m for _, m in order[i : i + 15]] for i in range(0, len(order), 15)]
    got = run(spark, tmp_path, [*batches, [END], [row("end", 10**6 + 1, None, None)]])
    assert sorted([s for s in got if s[0] != "end"], key=repr) == by_hand([m for _, m in order])


def test_stream_begins_with_the_sessions_of_the_batch_form(spark, tmp_path, rocks):
    before = [row("a", 0, "color", "red"), row("a", 10, "body", "light"), row("b", 0, "color", "white")]
    after = [row("a", 300, "color", "white"), row("b", 400, "reset", None), row("c", 500, "food", None)]
    known = wishes.wish_entries(spark.createDataFrame(before, SCHEMA), 600)
    got = run(spark, tmp_path, [after, [END], [row("end", 10**6 + 1, None, None)]], known)
    assert sorted([s for s in got if s[0] != "end"], key=repr) == by_hand([*before, *after])


def test_a_long_session_is_held_as_its_ends_and_wishes(spark, tmp_path, rocks):
    from pyspark.sql import functions as F

    n = 300_000
    for i in range(2):
        turns = spark.range(i * n, (i + 1) * n, 1, 1).select(F.lit("s").alias("session_id"), F.timestamp_micros(F.col("id") * 1000).alias("ts"), F.concat(F.lit("w"), F.col("id") % 5).alias("wish"), F.col("id").cast("string").alias("value"), F.lit("x").alias("first"))
        turns.write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = wishes.stream_wish_sessions(source, "20 minutes", 600).writeStream.format("memory").queryName("long_wishes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    held = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
    assert 6 <= held <= 12  # one session, five wishes, and a timer with its index
