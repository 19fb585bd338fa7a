import json

from conftest import d, dec, rows, ts
from pyspark.sql import functions as F

from tradeaxis.operators import ranking as rk


def answers(spark, **bodies):
    data = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in bodies.items()]
    return rk.parse_answers(spark.createDataFrame(data, "request_id STRING, body STRING"))


def item(rank, asset, score="1.5"):
    return {"rank": rank, "asset_id": asset, "price_series_id": asset, "score": score}


def test_answer_about_other_data_is_rejected(spark):
    parsed = answers(spark, a={"input_digest": "sha256:abc123", "items": []}, b={"input_digest": "other"}, c={}, e="no json")
    sent = spark.createDataFrame([(x, "sha256:abc123") for x in "abce"], "request_id STRING, digest STRING")
    assert rows(rk.digest_mismatches(parsed, sent), "request_id") == [("b",), ("c",), ("e",)]


def test_items_keep_exact_scores_and_exclusions_default_to_none(spark):
    parsed = answers(
        spark,
        a={"items": [item(1, "A", "0.123456789"), item("2", "B", 7)], "excluded": [{"asset_id": "C", "reason": "short"}, {"asset_id": "D"}]},
        b={"items": [item(1, "Z")]},
    )
    assert rows(rk.items(parsed), "request_id", "rank", "asset_id", "score") == [
        ("a", 1, "A", dec("0.123456789")),
        ("a", 2, "B", dec(7)),
        ("b", 1, "Z", dec("1.5")),
    ]
    assert rows(rk.exclusions(parsed)) == [("a", "C", "short"), ("a", "D", "")]
    asked = spark.createDataFrame([("a", "A"), ("a", "B"), ("b", "Y")], "request_id STRING, asset_id STRING")
    assert rows(rk.unknown_assets(rk.items(parsed), asked), "request_id", "asset_id") == [("b", "Z")]


def test_request_violations(spark):
    assets = spark.createDataFrame(
        [("dup", "A", "1"), ("dup", "A", "2"), ("blank", " ", "1"), ("blank", "B", None), ("ok", "A", "1"), ("twin", "A", "1"), ("twin", "B", "1")]
        + [("big", f"A{i}", f"S{i}") for i in range(1001)],
        "request_id STRING, asset_id STRING, price_series_id STRING",
    )
    asked = spark.createDataFrame([(x,) for x in ("dup", "blank", "ok", "empty", "big", "twin")], "request_id STRING")
    assert rows(rk.request_violations(asked, assets)) == [
        ("big", "too_many", ""),
        ("blank", "blank_asset_id", ""),
        ("blank", "blank_price_series_id", ""),
        ("dup", "duplicate_asset_id", "A"),
        ("empty", "empty", ""),
        ("twin", "duplicate_price_series_id", "1"),
    ]


def runs(spark, data):
    return spark.createDataFrame(
        [(i, d(x), status, None if at is None else ts(at)) for i, x, status, at in data],
        "id BIGINT, asof_date DATE, status STRING, finished_at TIMESTAMP",
    )


def test_latest_success_and_failure(spark):
    r = runs(
        spark,
        [
            (1, "2026-08-27", "success", "2026-08-30 10:00:00"),
            (2, "2026-08-28", "success", "2026-08-29 10:00:00"),
            (3, "2026-08-28", "success", "2026-08-29 11:00:00"),
            (4, "2026-08-29", "failed", "2026-08-29 12:00:00"),
            (5, "2026-08-20", "failed", "2026-08-29 13:00:00"),
        ],
    )
    assert rk.latest_success(r).first().id == 3
    assert rows(rk.latest_success_per_date(r), "asof_date", "id") == [(d("2026-08-27"), 1), (d("2026-08-28"), 3)]
    assert rk.last_failure(r).first().id == 5
    assert rk.latest_success(r.limit(0)).count() == 0
    assert [x.id for x in rk.history_page(r, None, 1, 2).collect()] == [3, 2]
    assert rk.history_total(r, "failed").first().total == 2


def test_queue_progress(spark):
    r = runs(
        spark,
        [(1, "2026-08-26", "success", None), (2, "2026-08-27", "queued", None), (3, "2026-08-27", "success", None), (4, "2026-08-28", "success", None), (5, "2026-08-29", "running", None)],
    )
    assert rows(rk.queue_progress(r)) == [(2, 4)]
    assert rows(rk.queue_progress(r.filter("status = 'success'"))) == [(0, 0)]
    assert [x.id for x in rk.pending_runs(r).collect()] == [2, 5]


def test_run_states_fold(spark):
    log = [
        (1, 1, "queued", None, None), (1, 2, "running", None, None), (1, 3, "failed", "E1", "broke"),
        (2, 1, "queued", None, None), (2, 2, "running", None, None), (2, 3, "failed", "E1", "broke"), (2, 4, "requeued", None, None),
        (3, 1, "running", None, None), (3, 2, "failed", "E", "x"), (3, 3, "requeued", None, None), (3, 4, "running", None, None), (3, 5, "success", None, None),
    ]
    df = spark.createDataFrame(
        [(r, s, k, ts(f"2026-08-28 10:0{s}:00"), c, m, 20 if k == "success" else None) for r, s, k, c, m in log],
        "run_id INT, seq INT, kind STRING, at TIMESTAMP, code STRING, message STRING, items INT",
    )
    got = {r.run_id: r for r in rk.run_states(df).collect()}
    assert (got[1].status, got[1].attempt, got[1].error_code, got[1].finished_at) == ("failed", 1, "E1", ts("2026-08-28 10:03:00"))
    assert (got[2].status, got[2].attempt, got[2].started_at, got[2].error_code) == ("queued", 2, None, None)
    assert (got[3].status, got[3].attempt, got[3].included_asset_count, got[3].error_code) == ("success", 2, 20, None)
    assert got[3].started_at == ts("2026-08-28 10:04:00")


def test_half_a_result_is_not_readable(spark):
    ranked = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "run_id INT, rank INT")
    results = spark.createDataFrame([(1, 2), (2, 2)], "run_id INT, included_asset_count INT")
    assert rows(rk.readable_items(ranked, results)) == [(1, 1), (1, 2)]


def test_results_are_stored_items_first_and_read_whole(spark, tmp_path):
    root = str(tmp_path)
    ranked = spark.createDataFrame(
        [(1, "A", 1), (1, "B", 2), (2, "A", 1), (2, "B", 2), (3, "C", 1)], "run_id INT, asset_id STRING, rank INT"
    )
    at = lambda n: F.lit(f"2026-08-0{n} 10:00:00").cast("timestamp")
    rk.store_items(ranked, root, "a")  # ended before the run rows
    rk.store_items(ranked.filter("NOT (run_id = 2 AND rank = 2)"), root, "b")
    rk.store_results(rk.result_rows(ranked).filter("run_id < 3"), root, "b", at(1))
    read = lambda: rows(rk.stored_items(spark, root), "run_id", "asset_id", "rank")
    assert read() == [(1, "A", 1), (1, "B", 2)]
    again = ranked.filter("run_id = 2")
    rk.store_items(again, root, "c")
    rk.store_results(rk.result_rows(again), root, "c", at(2))
    assert read() == [(1, "A", 1), (1, "B", 2), (2, "A", 1), (2, "B", 2)]
