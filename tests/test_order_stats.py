import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftgauge.operators import order_stats
from driftgauge.operators.cumulative import bucketed_long, pair_sums, running_totals


def hot_frame(n=6000, seed=3):
    """A third of the rows share one value; group sizes are uneven."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    a[: n // 3] = 0.25
    a[5::97] = np.nan
    g = np.where(rng.random(n) < 0.8, "big", "small")
    return pd.DataFrame({"g": g, "a": a, "b": rng.integers(0, 5, n).astype(float), "id": np.arange(n)})


@pytest.mark.parametrize("limit", [10**6, 50])
def test_quantiles_match_pandas(spark, limit):
    pdf = hot_frame()
    df = spark.createDataFrame(pdf)
    wanted = {"q1": 0.1, "median": 0.5, "q9": 0.9, "top": 1.0, "low": 0.0}
    got = order_stats.exact_quantiles(df, ["a", "b"], wanted, ["g"], limit=limit).toPandas()
    assert len(got) == 4
    for row in got.itertuples():
        values = pdf.loc[pdf.g == row.g, row.feature].dropna()
        for name, q in wanted.items():
            assert getattr(row, name) == pytest.approx(values.quantile(q), abs=1e-12)


def test_bracket_path_equals_direct_path_on_constant_and_tiny_groups(spark):
    df = spark.createDataFrame([("x", 7.0)] * 500 + [("y", float(i)) for i in range(3)], "g string, a double")
    for limit in (10**6, 2):
        rows = order_stats.exact_quantiles(df, ["a"], {"m": 0.5}, ["g"], limit=limit).collect()
        assert {(r["g"], r["m"]) for r in rows} == {("x", 7.0), ("y", 1.0)}


def hard_values():
    """Values of all sizes and signs, neighbours that differ in the last bit, and a value that a third of the rows have."""
    rng = np.random.default_rng(9)
    wide = np.concatenate([rng.normal(size=150) * 10.0 ** rng.integers(-300, 300, 150), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]])
    close = [1.0]
    for _ in range(300):
        close.append(float(np.nextafter(close[-1], 2)))
    return {"wide": wide.tolist(), "close": close, "hot": [3.5] * 200 + list(range(400)), "one": [2.0] * 50, "two": [1.0] * 90 + [np.nextafter(1.0, 2)] * 90}


@pytest.mark.parametrize("even", [False, True])
def test_ranks_of_hard_values_in_a_few_passes(spark, monkeypatch, even):
    groups = hard_values()
    if even:
        del groups["wide"]  # even cells are for values of one size
    long = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None)], "g string, value double")
    passes, whole = [], order_stats._narrowed
    monkeypatch.setattr(order_stats, "_narrowed", lambda *a: passes.append(a) or whole(*a))
    at = [0, 1, 0.25, 0.5, 0.515, 0.75]
    found = order_stats.locate(long, ["g"], lambda _, n: [(str(q), q * (n - 1)) for q in at], 3, even).collect()
    assert len(found) == len(groups) * len(at) and 0 < len(passes) <= 8
    for row in found:
        values = np.sort(groups[row["g"]])
        position = float(row["name"]) * (len(values) - 1)
        low, high = values[int(np.floor(position))], values[int(np.ceil(position))]
        assert row["value"] == (low if low == high else low + (high - low) * (position - np.floor(position)))
        assert (row["n_before"], row["n_equal"]) == ((values < low).sum(), (values == low).sum())


def test_rows_meet_a_bracket_once_for_all_quantiles(spark, monkeypatch):
    """Wanted ranks in one bracket share it: the first pass joins each group's rows to one bracket."""
    seen, whole = [], order_stats._narrowed
    monkeypatch.setattr(order_stats, "_narrowed", lambda long, keys, brackets, *a: seen.append(len(brackets)) or whole(long, keys, brackets, *a))
    df = spark.range(3000).select((F.col("id") % 997).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    order_stats.exact_quantiles(df, ["a", "b"], {str(i): i / 20 for i in range(21)}, limit=40).collect()
    assert seen[0] == 2


@pytest.mark.parametrize("limit", [10**6, 20])
@pytest.mark.parametrize("size", [1, 37, 2000, 2001, 5999])
def test_order_cut_takes_exactly_the_first_rows(spark, size, limit):
    pdf = hot_frame().fillna({"a": 9.0})
    df = spark.createDataFrame(pdf).withColumn("all", F.lit(0))
    cut = order_stats.order_cuts(df, "all", {0: size}, ["a", "id"], limit)[0]
    got = {r["id"] for r in df.where(cut.taken()).select("id").collect()}
    assert got == set(pdf.sort_values(["a", "id"]).head(size)["id"])


def test_copies(spark):
    df = spark.createDataFrame([("a", 5), ("b", 0), ("c", 1)], "k string, n long")
    rows = order_stats.copies(df, "n", chunk=2).groupBy("k").count().collect()
    assert {(r["k"], r["count"]) for r in rows} == {("a", 5), ("c", 1)}


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_running_totals_do_not_depend_on_the_buckets(spark, parts):
    pdf = hot_frame()
    df = spark.createDataFrame(pdf)
    cells = bucketed_long(df, ["a", "b"], ["g"], parts=parts).groupBy("feature", "bucket", "value").agg(
        F.count_if(F.col("g") == "big").alias("x"), F.count_if(F.col("g") == "small").alias("y")
    )
    got = running_totals(cells, ["feature"], ["x", "y"], descending=True).toPandas()
    for feature in ("a", "b"):
        mine = got[got.feature == feature].sort_values("value", ascending=False)
        assert (mine["cum_x"] == mine["x"].cumsum()).all() and (mine["cum_y"] == mine["y"].cumsum()).all()
        assert mine["x"].sum() + mine["y"].sum() == pdf[feature].notna().sum()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.integers(-3, 3), min_size=1, max_size=25), st.lists(st.integers(-3, 3), min_size=1, max_size=25)
)
def test_pair_sums_count_every_pair(spark, left, right):
    rows = [("l", float(v)) for v in left] + [("r", float(v)) for v in right]
    df = spark.createDataFrame(rows, "side string, v double")
    cells = bucketed_long(df, ["v"], ["side"], parts=3).groupBy("feature", "bucket", "value").agg(
        F.count_if(F.col("side") == "l").alias("l"), F.count_if(F.col("side") == "r").alias("r")
    )
    row = pair_sums(cells, ["feature"], "l", ["r"]).first()
    assert row["r_pairs"] == sum((a > b) + 0.5 * (a == b) for a in left for b in right)


@pytest.mark.parametrize("limit", [10**6, 25])
def test_hash_cuts_hold_with_many_copies_of_one_row(spark, limit):
    df = spark.createDataFrame([(i if i % 3 else 0,) for i in range(6000)], "v long").withColumn("all", F.lit(0))
    ordered = order_stats.content_order(df, ["v"])
    for size in (1, 500, 2500, 5999):
        cut = order_stats.order_cuts(ordered, "all", {0: size}, ["_order_1", "_order_2"], limit)[0]
        before = ordered.where(cut.before()).count()
        equal = ordered.where(cut.at()).count()
        taken = equal if cut.ties == cut.n_equal else cut.ties
        assert before + taken == size and cut.n_equal == equal
