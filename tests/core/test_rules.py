"""Rules against literal values: hand-made bars and rows."""

from __future__ import annotations

import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tapewright.functions.recurrences import Indicator, with_indicators
from tapewright.operators import evidence, patterns, research, similarity, tables, votes
from tapewright.plans import ORACLE, QUERIES, evidence as plans_evidence, matrix as plans_matrix
from tapewright.sources import tables as sources

DAY = dt.date(2024, 1, 1)
BARS = "symbol string, ts date, open double, high double, low double, close double, volume double, adjusted_close double"


def bars_of(spark, rows, symbol="A"):
    """Rows are (open, high, low, close); the adjusted close is the close."""
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(i), *map(float, r), 1000.0, float(r[3])) for i, r in enumerate(rows)], BARS)


#: Fourteen bars of range 10 and body 1, so that the mean range is near 10.
CALM = [(100, 105, 95, 101)] * 14
CASES = {
    "doji": [(100, 105, 95, 100.5)],
    "hammer": [(108, 110, 100, 109.5)],
    "inverted_hammer": [(100.5, 110, 100, 102)],
    "shooting_star": [(102, 110, 100, 100.5)],
    "hanging_man": [(109.5, 110, 100, 108)],
    "marubozu_bull": [(100, 110, 100, 110)],
    "marubozu_bear": [(110, 110, 100, 100)],
    "spinning_top": [(104, 110, 100, 106)],
    "long_bull": [(100, 121, 99, 120)],
    "long_bear": [(120, 121, 99, 100)],
    "engulfing_bull": [(105, 106, 99, 100), (99.5, 107, 99, 106)],
    "engulfing_bear": [(100, 106, 99, 105), (105.5, 106, 98, 99)],
    "harami_bull": [(110, 111, 99, 100), (102, 106, 101, 105)],
    "harami_bear": [(100, 111, 99, 110), (108, 109, 103, 104)],
    "piercing_line": [(110, 111, 99, 100), (98, 109, 97, 107)],
    "dark_cloud_cover": [(100, 111, 99, 110), (112, 113, 102, 103)],
    "tweezer_bottom": [(100, 105, 95, 101), (100, 104, 95.05, 101)],
    "tweezer_top": [(100, 105, 95, 101), (100, 105.05, 96, 101)],
    "morning_star": [(110, 111, 100, 101), (100, 101, 98, 99), (100, 110, 99, 109)],
    "evening_star": [(100, 111, 99, 110), (111, 113, 110, 112), (110, 111, 100, 101)],
    "three_white_soldiers": [(100, 108, 99, 107), (104, 113, 103, 112), (109, 118, 108, 117)],
    "three_black_crows": [(117, 118, 109, 110), (113, 114, 104, 105), (108, 109, 99, 100)],
    "three_inside_up": [(110, 111, 99, 100), (102, 106, 101, 105), (105, 108, 104, 107)],
    "three_inside_down": [(100, 111, 99, 110), (108, 109, 103, 104), (104, 105, 100, 101)],
}


def test_every_pattern_fires_on_its_bars(spark):
    assert CASES.keys() == patterns.BIAS.keys()
    frames = [bars_of(spark, CALM + rows, name) for name, rows in CASES.items()]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    last = {r["symbol"]: r for r in patterns.candlestick_patterns(whole).where(F.col("ts") >= F.lit("2024-01-15")).orderBy("ts").collect()}
    for name in CASES:
        assert last[name][name], name
    assert not last["marubozu_bull"]["marubozu_bear"] and not last["hammer"]["hanging_man"] and not last["doji"]["long_bull"]
    calm = patterns.candlestick_patterns(bars_of(spark, [(100, 100, 100, 100)] * 16)).collect()
    assert not any(r[n] for r in calm for n in patterns.BIAS if not n.startswith("tweezer"))


def validated(spark, change=None, n=100, as_of="2024-05-10"):
    rows = [["A", DAY + dt.timedelta(i), 99.0, 102.0, 98.0, 100.0 + i % 7, 5e6, 100.0 + i % 7] for i in range(n)]
    if change:
        rows = change(rows) or rows
    r = tables.validate_bars(spark.createDataFrame([tuple(r) for r in rows], BARS), as_of).collect()[0]
    return r["ok"], r["fatal"], r["flags"], round(r["score"], 6)


def put(i, column, value):
    def change(rows):
        rows[i][column] = value

    return change


@pytest.mark.parametrize(
    "change,n,want",
    [
        (None, 100, (True, "", "", 1.0)),
        (None, 10, (False, "insufficient_bars", "", 0.0)),
        (put(5, 7, None), 100, (True, "", "nan_prices_low", 0.95)),
        (lambda rows: [r[:7] + [None if i < 3 else r[7]] for i, r in enumerate(rows)], 100, (False, "nan_prices_high", "", 0.0)),
        (put(5, 7, 0.0), 100, (False, "nonpositive_price", "", 0.0)),
        (put(5, 1, DAY), 100, (False, "duplicate_dates", "", 0.0)),
        (lambda rows: [r[:7] + [50.0 if i >= 90 else r[7]] for i, r in enumerate(rows)], 100, (False, "flat_prices", "", 0.0)),
        (put(99, 1, DAY + dt.timedelta(110)), 100, (True, "", "date_gap", 0.9)),
        (put(99, 6, 5e6 * 25), 100, (True, "", "volume_outlier", 0.85)),
        (put(50, 7, 500.0), 100, (True, "", "adjustment_anomaly", 0.8)),
        (put(99, 1, DAY + dt.timedelta(200)), 100, (True, "", "date_gap|future_date", 0.85)),
    ],
)
def test_validation(spark, change, n, want):
    assert validated(spark, change, n) == want


def test_tiers(spark):
    rows = [("big", 60.0, 1e6), ("mid", 30.0, 2e5), ("small", 10.0, 2e5), ("thin", 60.0, 1e3), ("penny", 2.0, 1e9)]
    bars = spark.createDataFrame([(s, DAY + dt.timedelta(i), p, v) for s, p, v in rows for i in range(5)], "symbol string, ts date, close double, volume double")
    assert {r["symbol"]: r["tier"] for r in tables.quality_tier(bars).collect()} == {"big": 1, "mid": 2, "small": 3, "thin": 4, "penny": 4}


def test_risk_regime_and_score(spark):
    one = spark.createDataFrame([(0.65, 5e5, -0.06, 0.07), (0.75, 2e6, -0.03, 0.05), (0.9, 1e7, 0.01, 0.01), (None, None, None, None)], "q double, t double, d double, a double")
    assert [r[0] for r in one.select(votes.component_risk(F.col("q"), F.col("t"), F.col("d"), F.col("a"))).collect()] == [25.0, 10.0, 0.0, 0.0]
    rows = spark.createDataFrame([(1.0, 1.0), (-1.0, 0.0), (1.0, 0.0), (0.0, 1.0), (None, 1.0), (None, None)], "trend double, above double")
    found = [tuple(r) for r in rows.select(*votes.component_regime(F.col("trend"), F.col("above"))).collect()]
    assert found == [("bull", 1, 0.7), ("bear", -1, 0.7), ("bull", 0, 0.3), ("range", 0, 0.3), ("bull", 1, 0.7), (None, None, None)]
    parts = ["ml", "pattern", "regime"]
    row = spark.createDataFrame([(1, 0.8, 1, 0.5, 1, 0.7, "bull", 4.0)], "ml_dir int, ml_str double, pattern_dir int, pattern_str double, regime_dir int, regime_str double, regime string, risk double")
    score = votes.confluence_score(votes.alignment(row, parts), parts).collect()[0]
    assert (score["direction"], score["aligned"], score["conflicting"]) == (1, 3, 0)
    assert abs(score["score"] - ((0.65 * (0.3 * 0.8 + 0.2 * 0.5) / 0.5 + 0.35) * 100 - 4)) < 1e-9


def test_exits(spark):
    columns = "symbol string, ts int, ret_5 double, ret_10 double, ret_20 double, mfe double, mae double, atr_pct double, stopped boolean, t1 boolean, t2 boolean, t3 boolean"
    trades = spark.createDataFrame([("A", 0, 1.0, 2.0, 5.0, 4.5, 0.5, 2.0, False, True, True, False), ("B", 1, -4.0, -5.0, -6.0, 0.2, 4.0, 2.0, True, False, False, False)], columns)
    got = {(r["symbol"], r["rule"]): r["ret"] for r in research.exit_rules(trades, F.col("symbol") == "A").collect()}
    assert got["A", "t1_only"] == 2.0 and got["A", "t1_and_runner"] == 3.0 and abs(got["A", "ladder"] - 7 / 3) < 1e-12 and got["A", "break_even"] == 1.0
    assert got["A", "trail"] == 2.0 and got["A", "hold_20_if_high"] == 5.0 and got["B", "hold_20_if_high"] == -4.0
    assert got["B", "t1_only"] == -3.0 and got["B", "tight_stop"] == -1.5 and got["B", "trail"] == -4.0


def test_binomial_and_draws(spark):
    rows = spark.createDataFrame([(10, 7), (1, 0), (5, 5), (400, 230)], "n int, k int")
    got = [r[0] for r in rows.select(evidence.exact_binomial_p(F.col("n"), F.col("k"))).collect()]
    want = [sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n for n, k in ((10, 7), (1, 0), (5, 5), (400, 230))]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))
    table = spark.range(1000).select(F.lit("A").alias("symbol"), F.col("id").alias("ts"))
    drawn = evidence.drawn_rows(table, spark.createDataFrame([(137,)], "k long"), 3).groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ts").alias("d")).collect()
    assert {(r["draw"], r["n"], r["d"]) for r in drawn} == {(i, 137, 137) for i in range(3)}


def test_worst_fall_over_blocks(spark):
    returns = [1.0, -2.0, 3.0, -1.0, -4.0, 2.0, -3.0, 6.0, -1.0]
    rows = spark.createDataFrame([("g", i, r) for i, r in enumerate(returns)], "g string, i int, r double")
    total, top, worst = 0.0, -math.inf, 0.0
    for r in returns:
        total += r
        top = max(top, total)
        worst = max(worst, top - total)
    for size in (1, 2, 4, 20):
        got = evidence.worst_fall(rows, ["g"], "r", F.floor(F.col("i") / size), ["i"]).collect()[0]["max_drawdown"]
        assert abs(got - worst) < 1e-12, size


def test_neighbours_equal_a_full_search(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.collect()
    got: dict[int, list[int]] = {}
    for r in similarity.knn_join(vectors.where("vec_id % 20 = 0"), vectors, 7, ["label"], cells=8).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["neighbor"])
    for q in rows:
        if q["vec_id"] % 20 == 0:
            near = sorted((math.dist(q["embedding"], m["embedding"]), m["vec_id"]) for m in rows if m["label"] == q["label"] and m["vec_id"] != q["vec_id"])
            assert got.get(q["vec_id"], []) == [i for _, i in near[:7]]


def test_neighbours_of_copies_and_odd_vectors(spark):
    """Copies are ranked by id, large components compared exactly, vectors without a distance come last."""
    rows = [(i, [1.0, 2.0], 1) for i in range(40)] + [(50, None, 1), (51, [1.0, None], 1), (52, [1e200, 0.0], 1), (53, [1.0], 1), (60, [3.0, 2.0], 2), (61, None, 2), (62, [3.0, 5.0], 2), (63, [0.0, 2.0], 2), (None, [3.0, 2.0], 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = similarity.knn_join(vectors.where("vec_id in (5, 60)"), vectors, 4, ["label"], cells=3)
    got = [(r["query"], r["rank"], r["neighbor"], r["distance"]) for r in out.orderBy("query", "rank").collect()]
    assert got == [(5, 1, 0, 0.0), (5, 2, 1, 0.0), (5, 3, 2, 0.0), (5, 4, 3, 0.0), (60, 1, 62, 3.0), (60, 2, 63, 3.0), (60, 3, 61, None)]


def test_the_backtest_asks_for_every_row(spark, tmp_path):
    """Rows of any id are queries, those without a vector too, as in SQL."""
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)]
    rows += [(100, None, 0), (101, [1.0, 2.0, 3.0, 4.0], None), (None, [1.0, 2.0, 3.0, 4.0], 0), (104, [0.5] * 4, 7), (105, [0.5] * 4, 8), (106, None, 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(ORACLE["similarity_backtest"]).fetchall())
    assert [n for _, n, *_ in want] == [63] * 3
    for got, row in zip(sorted(map(tuple, QUERIES["similarity_backtest"](spark, str(tmp_path)).collect())), want, strict=True):
        assert got == pytest.approx(row)


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["behavior_stats", "behavior_interactions", "listing_performance", "listing_breakdowns"])
def test_prints_are_not_read_again_for_each_use_of_bars(spark, name):
    assert not [f for f in QUERIES[name](spark, SMALL).inputFiles() if "lineitem" in f or "orders" in f]


def test_the_vote_makes_bars_once(spark, monkeypatch):
    calls, daily = [], sources.daily_bars
    monkeypatch.setattr(sources, "daily_bars", lambda *a: calls.append(a) or daily(*a))
    QUERIES["run_confluence"](spark, SMALL)
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["alignment_variants", "evidence_breakdown", "listing_breakdowns"])
def test_prints_are_read_for_bars_only(spark, monkeypatch, name):
    """Whatever a query builds on bars, prints are read for their sums and for their ends, once each and unsorted."""
    seen, keep = [], sources.written

    def noted(df, label):
        if [f for f in df.inputFiles() if "lineitem" in f]:
            seen.append((label, "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, label)

    for module in (sources, plans_matrix, plans_evidence):
        monkeypatch.setattr(module, "written", noted)
    out = QUERIES[name](spark, SMALL)
    assert [label for label, _ in seen] == ["bar-ends", "bars"] and not seen[0][1]
    assert not [f for f in out.inputFiles() if "lineitem" in f or "orders" in f]


@pytest.mark.parametrize("name", ["daily_bars", "weekly_bars", "hourly_bars"])
def test_prints_are_not_sorted_for_bars(spark, monkeypatch, name):
    plans, keep = [], sources.written
    monkeypatch.setattr(sources, "written", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, label))
    getattr(sources, name)(spark, SMALL)
    assert "HashAggregate" in plans[0] and not [x for x in ("SortAggregate", "SortMergeJoin", "BroadcastHashJoin") if x in plans[0]]


def test_bars_of_prints_that_tie(spark):
    rows = [("a", 1, 5, 2, 10.0, 1.0), ("a", 1, 5, 1, 11.0, 2.0), ("a", 1, 4, 9, None, 3.0), ("a", 1, 7, 1, 12.0, 1.0), ("a", 1, 7, 2, 9.0, 1.0), ("b", 1, 5, 0, 99.0, 1.0)]
    rows += [(None, 1, 6, 1, 3.0, 1.0), (None, None, 8, 2, 4.0, 1.0), (None, None, 8, 1, 5.0, 1.0), ("a", 2, -3, 1, 6.0, 1.0), ("a", 2, None, 1, 7.0, 1.0)]
    prints = spark.createDataFrame(rows, "symbol string, ts int, k long, n int, price double, size double")
    got = {(r["symbol"], r["ts"]): tuple(r)[2:] for r in sources.bars_from_prints(prints, F.col("k"), ["k", "n"]).collect()}
    assert got == {
        ("a", 1): (None, 12.0, 9.0, 9.0, 8.0), ("b", 1): (99.0, 99.0, 99.0, 99.0, 1.0), (None, 1): (3.0, 3.0, 3.0, 3.0, 1.0), (None, None): (5.0, 5.0, 4.0, 4.0, 2.0), ("a", 2): (6.0, 7.0, 6.0, 6.0, 2.0),
    }


def test_the_matrix_is_written_from_written_bars(spark, monkeypatch):
    seen = []

    def stop(rows, path):
        seen.extend(rows.inputFiles())
        raise InterruptedError

    monkeypatch.setattr(plans_matrix.files, "write_feature_matrix", stop)
    with pytest.raises(InterruptedError):
        QUERIES["feature_matrix_files"](spark, SMALL)
    assert seen and not [f for f in seen if "lineitem" in f or "orders" in f]


def test_indicators_keep_the_bars(spark):
    out = with_indicators(bars_of(spark, [(1, 2, 0, i) for i in range(1, 6)]), [Indicator("e", "ema", 3)]).orderBy("ts").collect()
    assert [r["e"] for r in out] == [None, None, 2.0, 3.0, 4.0]
    assert [r["close"] for r in out] == [1.0, 2.0, 3.0, 4.0, 5.0]
