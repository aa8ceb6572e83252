"""The registered log queries against DuckDB, and the table against a dict."""

import glob
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkledger.functions import codec
from sparkledger.plans import registry
from sparkledger.sources.table import InvalidMutation, KVTable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    assert rows == sorted(map(repr, want.fetchall()))


def test_table_equals_dict(spark, tmp_path):
    random.seed(1)
    table, held, seq = KVTable(spark, str(tmp_path / "t")), {}, 0
    for _ in range(3):
        rows = []
        for _ in range(40):
            seq += 1
            key = str(random.randrange(15))
            if random.random() < 0.3:
                held.pop(key, None)
                rows.append((seq, "DELETE", key, None))
            else:
                held[key] = f"v{seq}"
                rows.append((seq, "PUT", key, held[key]))
        table.write(spark.createDataFrame(rows, "seq long, op string, key string, value string"))
    assert dict(map(tuple, table.scan().collect())) == held
    table.compact()
    assert len(table.runs()) == 1 and len(table.vacuum()) == 3
    assert dict(map(tuple, table.scan().collect())) == held
    table.put("a", "1")
    table.delete("a")
    assert table.get("a") is None
    with pytest.raises(InvalidMutation):
        table.put("a", "")


def test_frames_come_back(spark):
    hexed = [r[0] for r in spark.sql("SELECT 'PUT' op, 'a' key, 'b' value UNION ALL SELECT 'DELETE', 'a', NULL").select(codec.frame(F.col("op"), F.col("key"), F.col("value"))).collect()]
    assert hexed == ["01010000000000000061010000000000000062", "020100000000000000610000000000000000"]
    data = bytes.fromhex("".join(hexed) + "010100")
    rows = codec.decode_frames(spark.createDataFrame([("f", bytearray(data))], "path string, content binary")).collect()
    assert [(r.seq, r.op, bytes(r.key), r.value) for r in rows] == [(0, "PUT", b"a", bytearray(b"b")), (1, "DELETE", b"a", None)]


def test_replies(spark):
    lines = ["get k", "put k v", "get k", "PUT k v", "put k", "delete  k", "get\tk", ""]
    rows = codec.replies(spark.createDataFrame(list(enumerate(lines)), "seq long, line string")).orderBy("seq").collect()
    assert [r.response for r in rows] == ["Key not found", "Success", "v", "Invalid command", "Invalid command", "Success", "Key not found", "Invalid command"]
