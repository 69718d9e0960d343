"""Token accounting (A1-A11) with the reference's tracker facts."""

import datetime as dt

from pyspark.sql import functions as F

from quillframe.operators import metrics as M

CALLS = "run_id string, stage string, event_time timestamp, call_id bigint, model string, prompt_tokens bigint, completion_tokens bigint, cached_tokens bigint, latency_ms decimal(18,2), errors int, retries int"
T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def calls(spark, rows):
    from decimal import Decimal

    full = [
        (r[0], r[1], T0 + dt.timedelta(seconds=i), i, "model-a", r[2], r[3], r[4], Decimal(str(r[5])), r[6], r[7])
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, CALLS)


def test_sums_and_ratios(spark):
    df = calls(spark, [
        ("r1", "research", 500, 300, 100, 100.00, 0, 0),
        ("r1", "writer", 1000, 800, 0, 200.00, 0, 0),
        ("r1", "research", 600, 400, 150, 120.00, 1, 2),
    ])
    m = {r.stage: r for r in M.stage_metrics(df).collect()}
    assert m["research"].total_tokens == 1800 and m["research"].calls == 2
    assert m["writer"].total_tokens == 1800
    assert m["research"].errors == 1 and m["research"].retries == 2
    assert m["research"].avg_latency_ms == 110.0 and m["research"].tokens_per_call == 900.0
    assert m["research"].cache_hit_rate == 250 / 1100
    t = M.run_totals(df).first()
    assert t.total_tokens == 3600 and t.total_calls == 3


def test_reference_ratio_facts(spark):
    # 3 calls, 2400 tokens, 450 ms -> 150 ms and 800 per call; 250 cached of 1000 -> 0.25; zero prompt -> 0.0
    df = calls(spark, [
        ("r", "a", 500, 300, 250, 150.00, 0, 0),
        ("r", "a", 500, 300, 0, 150.00, 0, 0),
        ("r", "a", 0, 800, 0, 150.00, 0, 0),
        ("r", "z", 0, 10, 0, 1.00, 0, 0),
    ])
    m = {r.stage: r for r in M.stage_metrics(df).collect()}
    assert m["a"].avg_latency_ms == 150.0 and m["a"].tokens_per_call == 800.0
    assert m["a"].cache_hit_rate == 0.25 and m["z"].cache_hit_rate == 0.0


def test_export_rounding(spark):
    df = calls(spark, [
        ("r", "a", 1, 1, 1, 0.25, 0, 0), ("r", "a", 15, 0, 0, 0.00, 0, 0),  # tokens 17/2 = 8.5 -> 8 (half even)
        ("r", "b", 16, 0, 3, 0.10, 0, 0),  # 3/16 = 18.75% -> "18.8%" (half even)
    ])
    e = {r.stage: r for r in M.export_row(M.stage_metrics(df)).collect()}
    assert e["a"].tokens_per_call_0dp == 8 and e["a"].avg_latency_ms_1dp == 0.1
    assert e["a"].cache_hit_rate_pct == "6.2%" and e["b"].cache_hit_rate_pct == "18.8%"  # 1/16 = 6.25% -> 6.2%


def test_report_order_and_total(spark):
    df = calls(spark, [
        ("r", "writer", 10, 10, 0, 1.00, 0, 0),
        ("r", "research", 30, 10, 5, 1.00, 0, 0),
        ("r", "seo", 10, 10, 0, 1.00, 0, 0),
    ])
    rows = M.consumption_report(df).collect()
    stages = sorted((r for r in rows if not r.is_total), key=lambda r: r.report_rank)
    assert [r.stage for r in stages] == ["research", "writer", "seo"]  # tie writer/seo broken by first use
    total = [r for r in rows if r.is_total][0]
    assert total.total_tokens == 80 and total.calls == 3 and total.cache_hit_rate == 5 / 50


def test_duration_and_document(spark):
    df = calls(spark, [("r", "a", 1, 1, 0, 1.00, 0, 0), ("r", "b", 1, 1, 0, 1.00, 0, 0)])
    assert M.run_duration(df).first().duration_s == 1.0
    doc = M.summary_document(df).first()
    assert doc.agents == 2 and '"agents":{"a":' in doc.document and '"cache_hit_rate":"0.0%"' in doc.document


def test_cost_by_stage(spark):
    df = calls(spark, [("r", "a", 1_000_000, 1_000_000, 500_000, 1.00, 0, 0)])
    prices = spark.createDataFrame([("model-a", "1", "2", "0.5")], "model string, input_per_m string, output_per_m string, cached_per_m string")
    prices = prices.select("model", *[F.col(c).cast("decimal(18,6)").alias(c) for c in prices.columns[1:]])
    c = M.cost_by_stage(df, prices).first()
    assert c.cost_usd == 0.5 * 1 + 0.5 * 0.5 + 2.0 and c.unpriced_calls == 0


def test_benchmark_summary_cap(spark):
    runs = spark.createDataFrame([("a", True, 100, 1.0), ("b", False, 50, 2.0), ("c", True, 300, 3.0)],
                                 "run_id string, ok boolean, total_tokens bigint, duration_s double")
    s = M.benchmark_summary(runs).first()
    assert s.runs == 2 and s.total_tokens == 400 and s.avg_tokens == 200.0 and s.est_daily_tokens == 10000.0
    assert M.benchmark_summary(runs, max_runs=2).first().runs == 1
