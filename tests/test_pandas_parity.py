"""Column helpers against the pandas / numpy behaviour they reproduce, on generated inputs."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from txnlens.functions.dates import whole_days
from txnlens.functions.numeric import round_half_even, safe_ratio, to_number
from txnlens.operators.binning import band_label
from txnlens.operators.correlation import correlation_matrix
from txnlens.operators.quantiles import quantile_table
from txnlens.schemas import CREDIT_EDGES, CREDIT_LABELS

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

digits = st.text("0123456789", min_size=1, max_size=6)
number_text = st.builds(
    lambda sign, a, point, b, exp, pad: f"{pad}{sign}{a}{point}{b}{exp}{pad}",
    st.sampled_from(["", "-", "+"]), digits, st.sampled_from(["", "."]), st.sampled_from(["", "5", "25"]),
    st.sampled_from(["", "e3", "E-2", "e+1"]), st.sampled_from(["", " "]),
)
junk_text = st.sampled_from(["", "abc", "1.0d", "1_000", "0x10", "1e", ".", "-", "1.2.3", "$5", "NaN",
                             "Infinity", "1,5", "inf", "1e400", "--1", "1 2"])


def _pandas_number(s):
    v = pd.to_numeric(pd.Series([s], dtype=object), errors="coerce").iloc[0]
    return None if v is None or (isinstance(v, float) and (math.isnan(v) or math.isinf(v))) else float(v)


@SETTINGS
@given(st.lists(st.one_of(number_text, junk_text), min_size=1, max_size=60))
def test_to_number_matches_pandas(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r.v for r in df.select("i", to_number("s").alias("v")).orderBy("i").collect()]
    # documented deviation: non-finite values are null here (pandas keeps inf)
    want = [_pandas_number(t) for t in texts]
    assert got == want


@SETTINGS
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=80))
def test_round_matches_numpy(spark, xs):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    got = [r.v for r in df.select("i", round_half_even("x", 2).alias("v")).orderBy("i").collect()]
    assert got == [float(np.round(x, 2)) for x in xs]


@SETTINGS
@given(st.lists(st.tuples(st.integers(-100, 100), st.integers(-100, 100)), min_size=1, max_size=60))
def test_ratio_matches_pandas(spark, pairs):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pairs)], "i int, a double, b double")
    got = [r.v for r in df.select("i", safe_ratio("a", "b").alias("v")).orderBy("i").collect()]
    want = (pd.Series([float(a) for a, _ in pairs]) / pd.Series([float(b) for _, b in pairs])).tolist()
    for g, w in zip(got, want):
        assert (math.isnan(g) and math.isnan(w)) or g == w


stamp = st.datetimes(min_value=dt.datetime(2000, 1, 1), max_value=dt.datetime(2030, 12, 31))


@SETTINGS
@given(st.lists(st.tuples(stamp, stamp), min_size=1, max_size=60))
def test_whole_days_matches_timedelta_days(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a timestamp_ntz, b timestamp_ntz")
    got = [r.d for r in df.select("i", whole_days("a", "b").alias("d")).orderBy("i").collect()]
    want = (pd.Series([b for _, b in pairs]) - pd.Series([a for a, _ in pairs])).dt.days.tolist()
    assert got == want


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(0, 40).map(lambda v: v / 4)), min_size=1, max_size=120))
def test_quantiles_match_pandas(spark, xs):
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = quantile_table(df, ["x"], probs).collect()
    s = pd.Series([x for x in xs], dtype="float64")
    if s.count() == 0:
        assert rows == []
        return
    got = [rows[0][f"_q{i}"] for i in range(len(probs))]
    want = [float(s.quantile(p)) for p in probs]
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-50, 50)), st.integers(-50, 50),
                          st.one_of(st.none(), st.integers(0, 9))), min_size=3, max_size=60))
def test_correlation_matches_pandas(spark, rows):
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"], dtype="float64")
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows],
                               "a double, b double, c double")
    got = {(r.column_a, r.column_b): r.r for r in correlation_matrix(df, ["a", "b", "c"]).collect()}
    want = pdf.corr()
    for (x, y), r in got.items():
        w = want.loc[x, y]
        if r is None:
            assert math.isnan(w) or x != y and (pdf[[x, y]].dropna().shape[0] < 2)
        else:
            assert r == round(float(w), 9) or abs(r - float(w)) < 1e-9


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(250, 900)), min_size=1, max_size=80))
def test_bins_match_pandas_cut(spark, scores):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s int")
    got = [r.b for r in df.select("i", band_label("s").alias("b")).orderBy("i").collect()]
    cut = pd.cut(pd.Series(scores, dtype="float64"), bins=list(CREDIT_EDGES), labels=list(CREDIT_LABELS))
    want = [None if pd.isna(v) else str(v) for v in cut]
    assert got == want


def test_strip_currency_matches_astype_float(spark):
    from txnlens.functions.numeric import strip_currency
    ok = ["$12.50", "$-3", "$1e3", " $7 ", "$inf", "-$INF", "$-Infinity", "$nan", "$NaN", "$+4.", "$.5",
          "$1_000", "$1_0.2_5", "$2e1_0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ok)], "i int, s string")
    got = [r.v for r in df.select("i", strip_currency("s").alias("v")).orderBy("i").collect()]
    want = pd.Series(ok).str.replace("$", "", regex=False).astype(float).tolist()
    for g, w in zip(got, want):
        assert (g is None and math.isnan(w)) or g == w
    for bad in ["$1,000", "$1__000", "$_1", "$1_", "$1_.5", "$abc", "$1.0d", "$", "$0x10"]:
        with pytest.raises(ValueError):
            pd.Series([bad]).str.replace("$", "", regex=False).astype(float)
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "s string").select(strip_currency("s")).collect()


special = st.sampled_from([math.inf, -math.inf, math.nan])


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), special, st.integers(-1000, 1000).map(lambda v: v / 8))),
                min_size=1, max_size=60))
def test_float_mean_matches_pandas(spark, rows):
    from txnlens.operators.aggregates import group_means
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g int, x double")
    got = {r.g: r.x for r in group_means(df, "g", ["x"]).collect()}
    want = pd.DataFrame(rows, columns=["g", "x"]).astype({"x": "float64"}).groupby("g")["x"].mean()
    assert set(got) == set(want.index)
    for g, w in want.items():
        v = got[g]
        if math.isnan(w):
            assert v is None or math.isnan(v)
        elif math.isinf(w):
            assert v == w
        else:
            assert math.isclose(v, w, rel_tol=1e-12, abs_tol=1e-12)


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.sampled_from(["Yes", "No", "Maybe"])), min_size=1, max_size=80))
def test_value_shares_match_pandas(spark, labels):
    from txnlens.operators.aggregates import value_counts, value_shares
    df = spark.createDataFrame([(v,) for v in labels], "Target string")
    s = pd.Series(labels, dtype=object)
    assert {r.Target: r["count"] for r in value_counts(df, "Target").collect()} == s.value_counts().to_dict()
    assert {r.Target: r.proportion for r in value_shares(df, "Target").collect()} == \
        s.value_counts(normalize=True).to_dict()


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.sampled_from(["a", "b", None])),
                min_size=1, max_size=60))
def test_duplicates_match_pandas(spark, rows):
    from txnlens.operators.profile import duplicate_rows
    df = spark.createDataFrame(rows, "a int, b string")
    want = int(pd.DataFrame(rows, columns=["a", "b"]).duplicated().sum())
    assert duplicate_rows(df, "t").first().duplicates == want


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-50, 50)),
                          st.one_of(st.none(), st.sampled_from([math.inf]), st.integers(0, 400).map(lambda v: v / 4))),
                min_size=1, max_size=80))
def test_describe_matches_pandas(spark, rows):
    from txnlens.operators.profile import describe
    pdf = pd.DataFrame(rows, columns=["a", "b"], dtype="float64")
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], "a double, b double")
    got = {r.column: r for r in describe(df).collect()}
    want = pdf.describe()
    for c in ("a", "b"):
        g, w = got[c], want[c]
        assert g["count"] == int(w["count"])
        for ours, theirs in (("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            v, t = g[ours], w[theirs]
            assert (v is None and math.isnan(t)) or (v is not None and math.isnan(v) and math.isnan(t)) or v == t
        for ours, theirs in (("mean", "mean"), ("std", "std")):
            v, t = g[ours], w[theirs]
            if math.isnan(t):
                assert v is None or math.isnan(v)
            elif math.isinf(t):
                assert v == t
            else:
                assert math.isclose(v, t, rel_tol=1e-9, abs_tol=1e-8)


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["x", "y", "z"])),
                          st.one_of(st.none(), st.integers(-100000, 100000).map(lambda v: v / 100))),
                min_size=1, max_size=80))
def test_grouped_count_sum_mean_match_pandas(spark, rows):
    from txnlens.operators.aggregates import amount_by
    df = spark.createDataFrame(rows, "k string, amount double")
    got = {r.k: r for r in amount_by(df, "k", "n", "total", "mean").collect()}
    want = pd.DataFrame(rows, columns=["k", "amount"]).astype({"amount": "float64"}).groupby("k")["amount"].agg(
        ["count", "sum", "mean"])
    assert set(got) == set(want.index)
    for k, w in want.iterrows():
        g = got[k]
        assert g.n == w["count"]
        assert math.isclose(g.total, w["sum"], rel_tol=1e-12, abs_tol=1e-9)
        assert (g.mean is None and math.isnan(w["mean"])) or math.isclose(g.mean, w["mean"], rel_tol=1e-12, abs_tol=1e-9)
