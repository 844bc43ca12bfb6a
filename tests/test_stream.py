import datetime as dt

from pyspark.sql import functions as F

from marginalia.streaming import changes

T0 = dt.datetime(2024, 1, 1)
FILES = "path string, size long, mtime timestamp, hash string"


def test_filter_and_windows(spark):
    rows = [(T0, "a.md", "write"), (T0 + dt.timedelta(milliseconds=100), "a.md", "create|write"), (T0 + dt.timedelta(milliseconds=260), "a.md", "remove"), (T0, ".git/x", "write"), (T0, "b.md", "chmod"), (T0, "../c", "write"), (T0, "d.tmp", "write"), (T0, "e.md", "odd")]
    ev = spark.createDataFrame(rows, "ts timestamp, path string, op string")
    assert {r.dropped: r["count"] for r in changes.drop_counts(ev).collect()} == {"active": 3, "excluded": 2, "chmod": 1, "outside_vault": 1, "unknown_op": 1}
    assert sorted((r.path, r.events, r.coalesced) for r in changes.debounced(ev).collect()) == [("a.md", 1, 0), ("a.md", 2, 1)]
    assert changes.judged(ev).where("path = 'a.md'").select("op").distinct().count() == 3


def test_renames_need_one_on_each_side(spark):
    before = spark.createDataFrame([("a", 1, T0, "h1"), ("b", 1, T0, "h2"), ("c", 1, T0, "h2"), ("e", 0, T0, "h0")], FILES)
    after = spark.createDataFrame([("x", 1, T0, "h1"), ("y", 1, T0, "h2"), ("z", 0, T0, "h0")], FILES)
    assert [tuple(r) for r in changes.renames(before, after).collect()] == [("a", "x")]
    got = {(r.path, r.action, r.to) for r in changes.applied(before, before.select("path").union(after.select("path")), after).collect()}
    assert got == {("a", "rename", "x"), ("b", "remove", None), ("c", "remove", None), ("e", "remove", None), ("y", "replace", None), ("z", "replace", None)}


def test_reconcile(spark):
    index = spark.createDataFrame([("same", 1, T0, ""), ("size", 1, T0, ""), ("gone", 1, T0, ""), ("text", 1, T0, "")], FILES)
    disk = spark.createDataFrame([("same", 1, T0, ""), ("size", 2, T0, ""), ("new", 1, T0, ""), ("text", 1, T0, "")], FILES)
    seen = spark.createDataFrame([("same",), ("size",)], "path string")
    assert {r.path: r.action for r in changes.reconcile(index, disk, seen).collect()} == {"size": "upsert", "new": "upsert", "gone": "delete", "text": "upsert"}


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(T0 + dt.timedelta(milliseconds=90 * i), f"n{i % 3}.md", "write") for i in range(30)]
    ev = spark.createDataFrame(rows + [(T0 + dt.timedelta(hours=1), "last.md", "write")], "ts timestamp, path string, op string")
    ev.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(ev.schema).parquet(str(source))
    q = changes.changed_paths(stream).writeStream.format("memory").queryName("changed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("changed").collect()}
    assert got == {tuple(r) for r in changes.debounced(ev).where("path <> 'last.md'").collect()} and len(got) > 20


def test_watch_gives_batches(spark, tmp_path):
    disk = spark.createDataFrame([("n.md", 2, T0, "h")], FILES)
    index = spark.createDataFrame([("n.md", 1, T0, "g")], FILES)
    ev = spark.createDataFrame([(T0, "n.md", "write"), (T0 + dt.timedelta(hours=1), "z.md", "write")], "ts timestamp, path string, op string")
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = changes.watch(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")), lambda: disk, lambda: index, lambda df, _: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == [("n.md", "replace", None)]


def test_moved_links(spark):
    links = spark.createDataFrame([("a", 0), ("b", 0)], "from_path string, ord int")
    pairs = spark.createDataFrame([("a", "z")], "`from` string, to string")
    assert {r.from_path for r in changes.moved_links(links, pairs).collect()} == {"z", "b"}
    assert changes.last_state(spark.createDataFrame([(T0, "a", "write"), (T0 + dt.timedelta(1), "a", "remove")], "ts timestamp, path string, op string")).select(F.col("op")).first()[0] == "remove"


def test_lost_events_bring_one_reconciliation(spark, tmp_path):
    index = spark.createDataFrame([("same.md", 1, T0, "h"), ("gone.md", 1, T0, "g")], FILES)
    disk = spark.createDataFrame([("same.md", 1, T0, "h"), ("new.md", 1, T0, "n")], FILES)
    ev = spark.createDataFrame([(T0, "", "overflow")] * 3 + [(T0, "same.md", "write")], "ts timestamp, path string, op string")
    assert {tuple(r) for r in changes.actions(ev, index, disk).collect()} == {("gone.md", "delete", None), ("new.md", "upsert", None)}
    assert [(r.overflows, r.reconciles) for r in changes.overflows(ev).collect()] == [(3, 1)]
    # A stream that ends: what came last is not left behind a watermark.
    ev.where("op = 'write'").unionByName(spark.createDataFrame([(T0, "new.md", "create")], ev.schema)).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = changes.watch(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")), lambda: disk, lambda: index, lambda df, _: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp"))
    changes.close(q)
    assert set(seen) == {("same.md", "skip", None), ("new.md", "replace", None)} and not q.isActive


def test_files_of_new_folders(spark):
    ev = spark.createDataFrame([(T0, "a/b", "create"), (T0, "c", "write"), (T0, ".git", "create")], "ts timestamp, path string, op string")
    disk = spark.createDataFrame([(p,) for p in ("a/b/x.md", "a/b/d/y.md", "a/z.md", "c/w.md", "a/bc/v.md", "top.md", ".git/q.md")], "path string")
    assert {tuple(r) for r in changes.scanned(ev, disk).collect()} == {("a/b/x.md", "create"), ("a/b/d/y.md", "create")}
