"""The table end to end: log, map, restart, levels, recovery, care."""

import json
import os
import random
import shutil
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from sparkledger.functions import codec
from sparkledger.operators import filters, log, runs, workload
from sparkledger.sources import errors
from sparkledger.sources.cache import ByteCache
from sparkledger.sources.options import Options
from sparkledger.sources.table import KVTable
from sparkledger.streaming import ingest, server

LOG = "seq long, op string, key string, value string"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "t")


def test_reads_see_the_map_and_a_flush(spark, path):
    table = KVTable(spark, path)
    assert table.get("0") is None
    for i in range(4):
        table.put(str(i), str(i) * 333_333)
        if i == 1:
            table.delete("1")
            assert table.memtable_size == 333_335
    assert table.flushes == 1 and len(table.runs()) == 1 and not table.memtable and not table.files.list("wal")
    table.delete("1")  # blind: there is no such key any more
    assert table.memtable_size == 1 and table.get("1") is None and table.get("3") == "3" * 333_333 and table.get("x") is None
    assert {r.key for r in table.scan().collect()} == {"0", "2", "3"}


def test_restart_restores_the_log(spark, path):
    table = KVTable(spark, path)
    for i in range(10):
        table.put(str(i), f"value {i}")
    table.delete("3")
    table.close()
    torn = sorted(table.files.list("wal"))[-1]
    with open(f"{path}/wal/{torn}", "ab") as f:
        f.write(b"\x01\x03\x00")
    os.remove(f"{path}/wal/.{torn}.crc")
    again = KVTable(spark, path)
    assert len(again.runs()) == 1 and not again.files.list("wal") and again.last_seq() == 11
    assert {r.key: r.value for r in again.scan().collect()} == {str(i): f"value {i}" for i in range(10) if i != 3}
    again.put("3", "back")
    again.close()
    last = KVTable(spark, path)
    assert last.get("3") == "back" and last.last_seq() == 12
    with open(f"{path}/wal/{20:020d}", "wb") as f:
        f.write(b"\x03" + bytes(16))
    with pytest.raises(Exception, match="unknown operation"):
        KVTable(spark, path)


def test_group_commit_acknowledges_all(spark, path):
    table = KVTable(spark, path, Options(group_bytes=500, group_seconds=0.05))
    for done in [table.start_write("PUT", f"k{i}", "v" * 20) for i in range(200)]:
        done.result(10)
    assert 1 < table.wal.by_size + table.wal.by_time < 60 and table.wal.bytes == sum(17 + len(f"k{i}") + 20 for i in range(200))
    table.close()
    assert KVTable(spark, path).scan().count() == 200


def test_levels_cascade_and_reads_stay_right(spark, path):
    table, held, rng = KVTable(spark, path, Options(memtable_bytes=50)), {}, random.Random(3)
    for i in range(130):
        key = str(rng.randrange(20))
        if rng.random() < 0.3:
            table.delete(key)
            held.pop(key, None)
        else:
            table.put(key, f"value {i}")
            held[key] = f"value {i}"
    n = table.flushes
    digits = []
    while n:
        digits.append(n % 3)
        n //= 3
    assert [len(level) for level in table.levels] == digits and table.compactions > 1
    assert {r.key: r.value for r in table.scan().collect()} == held
    assert all(table.get(k) == held.get(k) for k in map(str, range(20)))
    table.close()
    again = KVTable(spark, path)
    assert {r.key: r.value for r in again.scan().collect()} == held
    with pytest.raises(errors.SettingsMismatch):
        KVTable(spark, path, Options(fan=4))


def test_open_is_strict(spark, path):
    table = KVTable(spark, path)
    run = table.write(spark.createDataFrame([(1, "PUT", "a", "1")], LOG))
    os.makedirs(f"{path}/runs/run-left-over")
    assert table.orphans() == ["run-left-over"] and table.remove_orphans() == ["run-left-over"]
    shutil.move(f"{path}/runs/{run}", f"{path}-moved")
    with pytest.raises(errors.MissingRuns) as e:
        KVTable(spark, path)
    assert e.value.expected - e.value.actual == {run}
    shutil.move(f"{path}-moved", f"{path}/runs/{run}")
    shutil.move(f"{path}/wal", f"{path}-wal")
    with pytest.raises(errors.MissingLog):
        KVTable(spark, path)
    shutil.move(f"{path}-wal", f"{path}/wal")
    for name, kind in (("odd", errors.UnexpectedFolder), ("odd.txt", errors.UnexpectedFile)):
        os.makedirs(f"{path}/{name}") if kind is errors.UnexpectedFolder else open(f"{path}/{name}", "w").close()
        with pytest.raises(kind):
            KVTable(spark, path)
        os.rmdir(f"{path}/{name}") if kind is errors.UnexpectedFolder else os.remove(f"{path}/{name}")
    last = sorted(x for x in os.listdir(f"{path}/manifest") if not x.startswith("."))[-1]
    with open(f"{path}/manifest/{last}", "w") as f:
        f.write("Random words")
    if os.path.exists(crc := f"{path}/manifest/.{last}.crc"):
        os.remove(crc)
    with pytest.raises(errors.CorruptManifest):
        KVTable(spark, path)
    shutil.rmtree(f"{path}/manifest")
    with pytest.raises(errors.MissingManifest):
        KVTable(spark, path)


def test_manifest_text(spark):
    text = "a#b#c\n\nd#e\n!last_seq 7\n!stream x y 3"
    assert codec.read_manifest(text) == ([["a", "b", "c"], [], ["d", "e"]], {"last_seq": 7, "stream x y": 3})
    assert codec.write_manifest(*codec.read_manifest(text)) == text and codec.read_manifest("") == ([], {})
    with pytest.raises(errors.CorruptManifest):
        codec.read_manifest("a\n\nb", most=2)
    rows = codec.parse_manifest(spark.createDataFrame([(text,)], "text string"))
    assert {tuple(r) for r in rows.collect()} == {(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (2, 0, "d"), (2, 1, "e")}
    assert codec.manifest_text(rows).first().text == "a#b#c\n\nd#e"
    with pytest.raises(Exception, match="corrupted manifest"):
        codec.parse_manifest(spark.createDataFrame([("a#-b",)], "text string")).collect()


def test_frames_are_strict(spark):
    rows = spark.createDataFrame([("MERGE", "a", "b")], "op string, key string, value string")
    with pytest.raises(Exception, match="unknown operation"):
        rows.select(codec.frame(F.col("op"), F.col("key"), F.col("value"))).collect()
    assert rows.select(codec.frame(F.col("op"), F.col("key"), F.col("value"), strict=False)).first()[0] is None


def test_late_mutations_never_revive_a_key(spark, path):
    table = KVTable(spark, path)
    table.write(spark.createDataFrame([(10, "DELETE", "k", None), (11, "PUT", "m", "1")], LOG))
    table.compact()
    table.write(spark.createDataFrame([(5, "PUT", "k", "old")], LOG))
    assert table.get("k") is None and table.last_seq() == 11
    table.compact(drop_tombstones=True)
    assert table.last_seq() == 11 and table.get("m") == "1"
    with pytest.raises(errors.LateMutation):
        table.write(spark.createDataFrame([(6, "PUT", "k", "old")], LOG))
    table.write(spark.createDataFrame([(12, "PUT", "k", "new")], LOG))
    assert table.get("k") == "new"


def test_bytes_that_are_no_text(spark, path):
    table = KVTable(spark, path, Options(text=False))
    keys = [b"10", b"9", b"Z", b"a", b"\x80"]
    for k in keys:
        table.put(k, b"\xff" + k)
    table.flush()
    assert table.get(b"\x80") == b"\xff\x80"
    assert [bytes(r.key) for r in table.scan().orderBy("key").collect()] == keys


def test_snapshots_pins_and_versions(spark, path):
    table = KVTable(spark, path)
    table.write(spark.createDataFrame([(1, "PUT", "a", "1")], LOG))
    reader = table.reader()
    assert reader().count() == 1
    with table.snapshot() as scan:
        table.write(spark.createDataFrame([(2, "PUT", "a", "2"), (3, "PUT", "b", "2")], LOG))
        table.compact()
        assert len(table.vacuum()) == 1  # the pinned version's run stays
        assert [tuple(r) for r in scan().collect()] == [("a", "1")]
    assert len(table.vacuum(retain_seconds=3600)) == 0
    assert len(table.vacuum()) == 1 and table.versions() == [table.version]
    assert {tuple(r) for r in reader().collect()} == {("a", "2"), ("b", "2")}
    other = KVTable(spark, path)
    table.write(spark.createDataFrame([(4, "PUT", "c", "3")], LOG))
    with pytest.raises(errors.Conflict):
        other.write(spark.createDataFrame([(4, "PUT", "c", "4")], LOG))


def test_lease_and_transactions(spark, path):
    table = KVTable(spark, path)
    with table.lease():
        with pytest.raises(errors.LeaseHeld), KVTable(spark, path).lease():
            pass
    with table.lease(-1), table.lease():
        pass
    table.put("a", "1")
    with table.transaction() as t:
        assert t.get("a") == "1"
        t.put("b", "2")
        assert t.get("b") == "2" and table.get("b") is None
    assert table.get("b") == "2"
    with pytest.raises(errors.Conflict), table.transaction() as t:
        t.get("a")
        t.put("c", "3")
        table.put("a", "9")
    assert table.get("c") is None


def test_scrub_finds_damage(spark, path):
    table = KVTable(spark, path)
    run = table.write(spark.createDataFrame([(1, "PUT", "a", "1"), (2, "DELETE", "b", None)], LOG))
    assert table.scrub() == {run: True}
    stats = table.stats_of(run)
    assert (stats["n_entries"], stats["n_tombstones"], stats["last_seq"]) == (2, 1, 2)
    spark.createDataFrame([(1, "PUT", b"a", b"2"), (2, "DELETE", b"b", None)], "seq long, op string, key binary, value binary").write.mode("append").parquet(f"{path}/runs/{run}")
    assert table.scrub() == {run: False} and table.metrics()["corrupted_runs"] == 1


def test_rate_limited_compaction(spark, path):
    table = KVTable(spark, path)
    for i in range(6):
        table.write(spark.createDataFrame([(i + 1, "PUT", f"k{i}", "v")], LOG))
    assert table.compact_levels(most_bytes=1) == 1 and [len(x) for x in table.levels] == [3, 1]
    assert table.compact_levels() == 1 and [len(x) for x in table.levels] == [0, 2] and table.scan().count() == 6
    limited = KVTable(spark, path + "2", Options(max_levels=1))
    for i in range(3):
        limited.write(spark.createDataFrame([(i + 1, "PUT", "k", "v")], LOG))
    with pytest.raises(errors.LevelTooLarge):
        limited.compact_levels()


def test_cache_bounds_and_single_loads():
    cache, loads, go = ByteCache(10, len), [], threading.Event()

    def load():
        loads.append(1)
        go.wait(5)
        return b"123"

    found = []
    threads = [threading.Thread(target=lambda: found.append(cache.get("a", load))) for _ in range(5)]
    for t in threads:
        t.start()
    time.sleep(0.1)
    go.set()
    for t in threads:
        t.join()
    assert found == [b"123"] * 5 and len(loads) == 1
    with pytest.raises(KeyError):
        cache.get("bad", lambda: {}["x"])
    assert cache.get("bad", lambda: b"1234") == b"1234" and cache.get("c", lambda: b"12345") == b"12345"
    assert cache.used <= 10 and cache.get("a", lambda: b"9") == b"9"  # the oldest entry was dropped
    cache.reset(["a"])
    assert cache.get("a", lambda: b"8") == b"8" and cache.get("big", lambda: b"x" * 99) and cache.used <= 10


def test_streams_are_taken_in_once_and_checked(spark, path, tmp_path):
    source, table = str(tmp_path / "source"), KVTable(spark, path)
    spark.createDataFrame([(1, "PUT", "a", "1"), (2, "GET", "a", None), (3, "PUT", "", "x"), (4, "PUT", "b", "")], LOG).write.parquet(source)
    ingest.ingest(spark, source, LOG, table, str(tmp_path / "c1"))
    assert {tuple(r) for r in table.scan().collect()} == {("a", "1")}
    assert spark.read.parquet(f"{path}/rejected/*").count() == 3
    spark.createDataFrame([(5, "PUT", "a", "5")], LOG).write.mode("append").parquet(source)
    ingest.ingest(spark, source, LOG, table, str(tmp_path / "c1"))
    assert table.get("a") == "5" and len(table.runs()) == 2
    ingest.ingest(spark, source, LOG, table, str(tmp_path / "c2"))  # another stream replaces nothing
    assert len(table.runs()) == 3 and table.get("a") == "5"
    own = next(f.removeprefix("stream ") for f in table.facts if f.startswith("stream "))
    before = table.version
    table.ingest(spark.createDataFrame([(99, "PUT", "z", "z")], LOG), own, 0)
    assert table.version == before and table.get("z") is None


def test_command_stream_and_server(spark, path, tmp_path):
    table = KVTable(spark, path)
    table.put("old", "1")
    source = tmp_path / "commands"
    source.mkdir()
    lines = ["get old", "put k v", "get k", "delete old", "get old", "PUT k x", "get k"]
    (source / "one.json").write_text("\n".join(json.dumps({"seq": i, "line": x}) for i, x in enumerate(lines)))
    server.serve(spark, str(source), table, str(tmp_path / "out"), str(tmp_path / "c"))
    found = [r.response for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert found == ["1", "Success", "v", "Success", "Key not found", "Invalid command", "v"]
    assert table.get("k") == "v" and table.get("old") is None
    bad = codec.replies(spark.createDataFrame([(1, "get b")], "seq long, line string"), spark.createDataFrame([(b"b", b"\xff")], "key binary, value binary"))
    assert bad.first().response == "Get failed."

    s = server.server(table, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    with socket.create_connection(s.server_address) as c:
        for ask, want in ((b"get k", b"v\n"), (b"put \xff 1", b"Success\n"), (b"get nothing", b"Key not found\n"), (b"put k", b"Invalid command\n"), (b"delete k", b"Success\n"), (b"get k\n", b"Key not found\n")):
            c.sendall(ask)
            assert c.recv(100) == want
    s.shutdown()
    assert table.get("�") == "1"
    out = type("Out", (list,), {"write": list.append, "flush": lambda self: None})()
    server.repl(table, ["put a b\n", "get a\n", "\n"], out)
    assert out == ["Success\n", "b\n", "Invalid command\n"]


def test_filters_lose_no_key(spark):
    own = spark.range(5000).select((F.col("id") % 3).alias("run"), F.col("id").cast("string").alias("key"))
    made = filters.build(own, 0.03)
    assert filters.probe(made, own).count() == 5000
    absent = spark.range(5000, 35_000).select((F.col("id") % 3).alias("run"), F.col("id").cast("string").alias("key"))
    assert filters.probe(made, absent).count() < 0.04 * 30_000


def test_blocks_and_index_do_not_depend_on_partitions(spark):
    rng = random.Random(7)
    rows = [(r, f"{k:05d}", rng.choice((1, 30, 984, 2000))) for r in (0, 1) for k in rng.sample(range(9000), 900)] + [(2, "only", 5)]
    want = {}
    for r in (0, 1, 2):
        block = offset = used = 0
        for _, key, n in sorted(x for x in rows if x[0] == r):
            want[r, key] = block, offset
            used += 16 + n
            if used >= 1000:
                block, offset, used = block + 1, offset + used + 8, 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = runs.pack_blocks(spark.createDataFrame(rows, "run long, key string, n long"), 1000)
            assert {(r.run, r.key): (r.block, r.offset) for r in got.collect()} == want
            index = spark.createDataFrame([(0, "b", 1), (0, "d", 2), (1, "x", 3)], "run long, first_key string, offset long")
            keys = spark.createDataFrame([(0, k) for k in ("a", "b", "c", "d", "z")] + [(1, "x"), (1, "w"), (5, "a")], "run long, key string")
            assert {(r.run, r.key): r.block_offset for r in runs.search_index(index, keys).collect()} == {(0, "a"): None, (0, "b"): 1, (0, "c"): 1, (0, "d"): 2, (0, "z"): 2, (1, "x"): 3, (1, "w"): None, (5, "a"): None}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs.pack_blocks(spark.createDataFrame([], "run long, key string, n long")).count() == 0


def test_workload_against_a_table(spark, path):
    table, held = KVTable(spark, path), {}
    own = workload.generated(spark, 300, 0, 40, 10, (40, 40, 20), True)
    rows = own.orderBy("seq").collect()
    answers = {r.seq: r.answer for r in workload.answered(own).collect()}
    for r in rows:
        if r.op == "PUT":
            table.put(r.key, r.value)
            held[r.key] = r.value
        elif r.op == "DELETE":
            table.delete(r.key)
            held.pop(r.key, None)
        else:
            assert table.get(r.key) == held.get(r.key) == answers[r.seq]
    table.close()


def test_differences_and_operands(spark):
    one = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, value string")
    two = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "key string, value string")
    assert {tuple(r) for r in log.differences(one, two, 4).collect()} == {("b", "2", "9"), ("c", "3", None), ("d", None, "4")}
    rows = spark.createDataFrame([(1, "PUT", "a", "1"), (2, "DELETE", "a", None), (3, "PUT", "a", "5"), (4, "PUT", "a", "6")], LOG)
    assert [tuple(r) for r in log.merge_operands(rows, total=F.sum(F.col("value").cast("int"))).collect()] == [("a", 11)]
    assert [r.key for r in log.scan_by(one, F.reverse(F.concat("key", "value")).desc()).collect()] == ["c", "b", "a"]
