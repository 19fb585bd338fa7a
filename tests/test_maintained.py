"""Kept counts follow a merge, rollups merge, and two digest trees differ where their series do."""

from conftest import d, dec, rows
from pyspark.sql import functions as F
from test_dataset import full_bars

from tradeaxis.config import GROUPS
from tradeaxis.operators import completeness as comp
from tradeaxis.operators import dataset as ds
from tradeaxis.operators import maintained as mt
from tradeaxis.operators import store
from tradeaxis.operators.calendar import SessionWindow

QUOTES = next(g for g in GROUPS if g.group_id == "quotes")


def test_counts_follow_merges_and_take_rows_back(spark, tmp_path):
    root = str(tmp_path)
    days = [d(f"2026-08-{k:02d}") for k in (3, 4, 5, 6)]
    window = SessionWindow(tuple(days))

    def merge(*data):
        mt.merge_counted(spark, root, QUOTES, full_bars(spark, data).withColumn("n", F.lit(1)), ["n"])

    def check():
        for path in ("bar", "coverage"):
            spark.catalog.refreshByPath(f"{root}/{path}")
        full = comp.group_coverage(store.read_table(spark, f"{root}/bar"), ("close",), "session_date", window).first()
        kept = mt.coverage_from_counts(mt.kept_counts(spark, root), QUOTES, window).first()
        assert [kept[c] for c in full.__fields__] == list(full)
        return kept

    merge(("A", "2026-08-03", 1), ("B", "2026-08-03", 2), ("A", "2026-08-04", 3), ("A", "2026-08-07", 9))
    assert (check().sessions_covered, check().gaps, check().rows_with_values) == (2, 2, 3)
    before = {p.name: p.stat().st_mtime for p in (tmp_path / "coverage" / "group_id=quotes").iterdir()}
    merge(("A", "2026-08-03", None), ("C", "2026-08-05", None))  # a value is taken back, a session has a row without one
    assert (check().sessions_covered, check().rows_total, check().rows_with_values) == (3, 4, 2)
    after = {p.name: p.stat().st_mtime for p in (tmp_path / "coverage" / "group_id=quotes").iterdir()}
    assert {n for n in after if after[n] == before.get(n)} == {"part=2026-08-04", "part=2026-08-07"}


def test_rollups_of_parts_unite_and_estimate_within_the_error(spark):
    frame = spark.range(60_000).select(
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("sector"), F.concat(F.lit("m"), (F.col("id") % 7).cast("string")).alias("month"),
        F.pmod(F.xxhash64("id"), F.lit(20_000)).cast("string").alias("asset_id"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("close"),
    )
    by = ["sector", "month"]
    parts = [mt.rollup_base(frame.filter(F.col("close").isNull() == x), by, ["close"]) for x in (True, False)]
    got = {(r.level, r.sector, r.month): r for r in mt.rolled_up(parts[0].unionByName(parts[1]), by).collect()}
    exact = {(r.level, r.sector, r.month): r.assets for r in mt.exact_assets(frame, by).collect()}
    assert len(got) == len(exact) == 21 + 3 + 7 + 1
    assert got["", None, None].rows_total == 60_000 and got["sector", "s1", None].rows_total == 20_000
    assert sum(r.rows_with_values for (level, *_), r in got.items() if level == "month") == 48_000
    assert all(abs(r.assets_about - exact[k]) <= mt.SKETCH_ERROR * exact[k] + 1 for k, r in got.items())


def test_changed_series_equal_a_full_comparison(spark, tmp_path):
    old = [("prices", f"k{i}", f"h{i}") for i in range(400)]
    new = [(p, k, "other" if k == "k7" else h) for p, k, h in old if k != "k9"] + [("prices", "new", "x"), ("sectors", "k1", "x")]
    paths = []
    for name, data in (("old", old), ("new", new), ("same", old[::-1])):
        ds.store_tree(spark.createDataFrame(data, "part STRING, key STRING, hash STRING"), f"{tmp_path}/{name}")
        paths.append(f"{tmp_path}/{name}")
    found = ds.changed_series(spark, paths[0], paths[1])
    assert rows(found) == [("prices", "k7", "changed"), ("prices", "k9", "removed"), ("prices", "new", "added"), ("sectors", "k1", "added")]
    assert ds.changed_series(spark, paths[0], paths[2]).count() == 0
    assert "PartitionFilters: [branch" in found._jdf.queryExecution().executedPlan().toString()
    assert dec(1) == dec("1.0")


def test_a_merge_makes_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    window = SessionWindow((d("2026-08-03"), d("2026-08-04"), d("2026-08-05")))
    first = full_bars(spark, [("A", "2026-08-03", 1), ("B", "2026-08-03", 2), ("A", "2026-08-04", 3)]).withColumn("n", F.lit(1))
    again = full_bars(spark, [("A", "2026-08-03", None), ("B", "2026-08-05", 4)]).withColumn("n", F.lit(1))
    found = {}
    for folded in (False, True):
        root, seen.value = str(tmp_path / str(folded)), 0
        for part in (first, again):
            mt.merge_counted(spark, root, QUOTES, part.mapInPandas(passed, part.schema), ["n"], folded=folded)
        assert seen.value == 5
        found[folded] = rows(mt.coverage_from_counts(mt.kept_counts(spark, root), QUOTES, window), "sessions_covered", "rows_total", "rows_with_values")
    assert found[False] == found[True] == [(3, 4, 3)]
