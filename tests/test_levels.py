"""Levels beyond the twelfth."""

from pyspark.sql import functions as F

from sparkledger.operators import runs


def level(run, n):
    i = 0
    while run < n - n % 3 ** (i + 1):
        i += 1
    return i


def test_levels_have_no_depth_limit(spark):
    cases = [(r, n) for n in (1, 9, 13, 3**12 - 1, 3**12, 3**12 + 5, 2 * 3**14 + 7, 3**39 + 3**12, 2**63 - 1) for r in sorted({0, 1, n // 3, n // 2, n - 2, n - 1}) if 0 <= r < n]
    got = spark.createDataFrame(cases, "run long, n long").select("run", "n", runs.level_of(F.col("run"), F.col("n")).alias("level")).collect()
    assert [(r.run, r.n, r.level) for r in got] == [(r, n, level(r, n)) for r, n in cases]


def test_newest_run_wins_above_the_twelfth_level(spark):
    rows = [(0, 1, "PUT", "a", "old"), (0, 2, "PUT", "b", "old"), (3**12 - 1, 3, "PUT", "a", "newer"), (3**12 + 1, 4, "PUT", "a", "new"), (3**12 + 1, 5, "DELETE", "b", None)]
    log = spark.createDataFrame(rows, "run long, seq long, op string, key string, value string")
    assert [tuple(r) for r in runs.leveled_read(runs.assigned(log)).collect()] == [("a", "new")]
