"""Properties of the scoring run on hand-made universes."""

import duckdb
import pytest

from rankloom.operators.scoring import RATING, Config, Factor, score, scorer
from rankloom.plans.rel import Rel

AB = (Factor("a", "momentum", 60), Factor("b", "quality", 30), Factor("c", "sentiment", 10))


def run(spark, values, cfg=None, flags=(), want="ranking", **more):
    cfg = cfg or Config(AB, {"bad": (None, -10.0)}, neutralize=False, min_include=0.0, **more)
    rows = [(t, "Tech", f, v) for t, own in values.items() for f, v in own.items()]
    fv = spark.createDataFrame(rows, "ticker string, sector string, factor_id string, raw double")
    pf = spark.createDataFrame(list(flags), "ticker string, penalty_id string")
    return {r.ticker: r for r in score(fv, pf, cfg, want).collect()}


def ladder(n, **fixed):
    return {f"T{i}": {"a": float(i), "b": float(i), "c": float(i)} | fixed for i in range(n)}


def test_descending_ranks_and_bounds(spark):
    got = run(spark, ladder(10))
    assert sorted((r.rank, t) for t, r in got.items())[0] == (1, "T9")
    assert sorted(r.rank for r in got.values()) == list(range(1, 11))
    assert all(0 <= r.total_score <= 100 for r in got.values())


def test_missing_factor_is_redistributed(spark):
    values = ladder(10)
    values["T9"]["c"] = None
    got = run(spark, values)
    assert got["T9"].rank == 1 and got["T9"].coverage < 1 and got["T9"].base_raw > 90


def test_sparse_factor_is_disabled_and_weights_sum(spark):
    values = ladder(20, c=None)
    values["T3"]["c"] = 5.0
    rows = [(t, "Tech", f, v) for t, own in values.items() for f, v in own.items()]
    fv = spark.createDataFrame(rows, "ticker string, sector string, factor_id string, raw double")
    pf = spark.createDataFrame([], "ticker string, penalty_id string")
    w = {r.factor_id: r.w for r in score(fv, pf, Config(AB, neutralize=False), "weighted").collect()}
    assert set(w) == {"a", "b"} and sum(w.values()) == pytest.approx(100) and w["a"] / w["b"] == pytest.approx(2)


def test_override_reverses(spark):
    values = {f"T{i}": {"a": float(i), "b": float(-i), "c": 0.0} for i in range(10)}
    assert run(spark, values, overrides={"b": 900.0})["T0"].rank == 1


def test_points_and_sigma_penalties_and_cap(spark):
    clean, hit = run(spark, ladder(20)), run(spark, ladder(20), flags=[("T9", "bad")])
    assert hit["T9"].penalty == pytest.approx(-10) and hit["T9"].total_score == pytest.approx(clean["T9"].total_score - 10)
    sigma = Config(AB, {"bad": (-0.5, 0.0)}, neutralize=False, min_include=0.0)
    got = run(spark, ladder(20), sigma, [("T9", "bad")])
    assert got["T9"].penalty == pytest.approx(-0.5 * got["T9"].sigma)
    capped = run(spark, ladder(20), Config(AB, {"bad": (-2.0, 0.0)}, neutralize=False, min_include=0.0, penalty_cap=0.8), [("T9", "bad")])
    assert capped["T9"].penalty == pytest.approx(-0.8 * capped["T9"].sigma)


def test_shrink_pulls_towards_fifty_from_both_sides(spark):
    values = ladder(10)
    values["T9"] |= {"b": None, "c": None}
    got = run(spark, values)
    assert 50 < got["T9"].total_score < got["T8"].total_score
    values = ladder(10)
    values["T0"] |= {"b": None, "c": None}
    got = run(spark, values)
    assert got["T1"].total_score < got["T0"].total_score < 50


def test_low_coverage_is_excluded_unless_pinned(spark):
    values = ladder(10)
    values["T4"] |= {"a": None, "b": None}
    cfg = dict(penalties={}, neutralize=False)
    got = run(spark, values, Config(AB, **cfg))
    assert "T4" not in got and sorted(r.rank for r in got.values()) == list(range(1, 10))
    assert run(spark, values, Config(AB, pinned=("T4",), **cfg))["T4"].low_confidence


def test_cluster_budget(spark):
    rows = [(f"T{i}", "Tech", f, float(i)) for i in range(20) for f in "abc"]
    fv = spark.createDataFrame(rows, "ticker string, sector string, factor_id string, raw double")
    pf = spark.createDataFrame([], "ticker string, penalty_id string")
    w = {r.factor_id: r.w for r in score(fv, pf, Config(AB, clusters=(("trend", 20.0, ("a", "b")),), neutralize=False), "weighted").collect()}
    assert 60 <= w["a"] + w["b"] <= 70 and w["a"] / w["b"] == pytest.approx(2)


def test_percentiles_with_ties_and_single_values(spark):
    values = {f"T{i}": {"a": 1.0, "b": None, "c": None} for i in range(4)}
    values["T0"]["b"] = 7.0
    rows = [(t, "Tech", f, v) for t, own in values.items() for f, v in own.items()]
    fv = spark.createDataFrame(rows, "ticker string, sector string, factor_id string, raw double")
    pf = spark.createDataFrame([], "ticker string, penalty_id string")
    got = {(r.ticker, r.factor_id): r.percentile for r in score(fv, pf, Config(AB), "ranked").collect()}
    assert got["T0", "a"] == pytest.approx(62.5) and got["T0", "b"] == 50 and got["T1", "b"] is None


def test_bands_label_whatever_the_norm(spark):
    rating = Config((Factor("r", "analyst", 1, "rank", True, RATING),), neutralize=False)
    values = {f"T{i}": {"r": v} for i, v in enumerate((1.2, 2.0, 3.0, 1.4, 4.5, 2.2))}
    rows = [(t, "Tech", f, v) for t, own in values.items() for f, v in own.items()]
    fv = spark.createDataFrame(rows, "ticker string, sector string, factor_id string, raw double")
    pf = spark.createDataFrame([], "ticker string, penalty_id string")
    got = {r.ticker: r for r in score(fv, pf, rating, "weighted").collect()}
    assert got["T0"].band_label == "Strong Buy" and got["T4"].band_label == "Sell" and got["T0"].score > got["T4"].score


def test_sector_neutralisation_needs_five_and_spread(spark):
    rows = [(f"T{i}", "X" if i < 5 else "Y" if i < 9 else "Z", "a", float(i if i < 9 else 100)) for i in range(15)]
    fv = spark.createDataFrame(rows, "ticker string, sector string, factor_id string, raw double")
    pf = spark.createDataFrame([], "ticker string, penalty_id string")
    got = score(fv, pf, Config((Factor("a", "momentum", 1),)), "normalised").collect()
    x = [r for r in got if r.sector == "X"]
    assert sum(r.score for r in x) / 5 == pytest.approx(50) and all(r.score == r.directed for r in got if r.sector in "YZ")


def test_empty_universe(spark):
    fv = spark.createDataFrame([], "ticker string, sector string, factor_id string, raw double")
    pf = spark.createDataFrame([], "ticker string, penalty_id string")
    assert score(fv, pf).count() == 0


def universe(n=24):
    values = {f"T{i}": {"a": float(i * 7 % 11), "b": float(i * i % 13), "c": float(i)} for i in range(n)}
    for i in range(0, n, 5):
        values[f"T{i}"]["a"] = None
    for i in range(1, n, 4):
        values[f"T{i}"]["c"] = None
    return values


@pytest.mark.parametrize("clusters", [(), (("k", 20.0, ("a", "b")),)])
def test_absent_rows_equal_null_rows(spark, clusters):
    cfg = Config(AB, {"bad": (-0.5, 0.0)}, clusters, neutralize=False, min_include=0.0)
    sparse = {t: {f: v for f, v in own.items() if v is not None} for t, own in universe().items()}
    for want in ("scores", "ranking"):
        whole, left_out = run(spark, universe(), cfg, [("T3", "bad")], want), run(spark, sparse, cfg, [("T3", "bad")], want)
        assert whole.keys() == left_out.keys()
        for t, r in whole.items():
            assert left_out[t].coverage == pytest.approx(r.coverage) and left_out[t].total_score == pytest.approx(r.total_score)
    assert min(r.coverage for r in left_out.values()) < 1


def test_weights_of_zero(spark):
    none = Config(tuple(Factor(f.id, f.category, 0.0) for f in AB), neutralize=False, min_include=0.0)
    assert run(spark, universe(), none) == {} and run(spark, universe(), none, want="scores") == {}
    part = Config((Factor("a", "momentum", 10), Factor("b", "idle", 0)), neutralize=False, min_include=0.0)
    assert len(run(spark, universe(), part)) == 24
    rows = [(t, "Tech", f, v) for t, own in universe().items() for f, v in own.items()]
    fv = spark.createDataFrame(rows, "ticker string, sector string, factor_id string, raw double")
    got = score(fv, spark.createDataFrame([], "ticker string, penalty_id string"), part, "category_scores").collect()
    assert all((r.category_score is None) == (r.category == "idle") for r in got)
    assert run(spark, {}, part) == {}


def test_configuration_files(spark, tmp_path):
    from rankloom.sources.config import read_config, with_weights

    (tmp_path / "w.yaml").write_text("""
meta: {auto_disable_coverage_below: 0.2, sector_neutralize: false, penalty_total_cap_sigma: 1.5}
factors:
  - {id: a, category: momentum, weight: 60}
  - {id: r, category: analyst, norm: band, direction: lower_better, bands: [{max: 2, score: 90, label: Buy}, {max: 5.1, score: 10, label: Sell}]}
penalties: [{id: bad, sigma: -0.3}, {id: worse, points: -4}]
clusters: [{id: k, budget: 5, members: [a, r]}]
""")
    cfg = read_config(spark, str(tmp_path / "w.yaml"))
    assert cfg.factors == (Factor("a", "momentum", 60.0), Factor("r", "analyst", 1.0, "band", True, ((2.0, 90.0, "Buy"), (5.1, 10.0, "Sell"))))
    assert (cfg.min_coverage, cfg.neutralize, cfg.penalty_cap, cfg.penalties, cfg.clusters) == (0.2, False, 1.5, {"bad": (-0.3, 0.0), "worse": (None, -4.0)}, (("k", 5.0, ("a", "r")),))
    joined = with_weights(Config(AB, overrides={"a": 1.0}), {"a": 9.0, "b": 70.0, "zz": 1.0}, disabled=("c",))
    assert joined.overrides == {"a": 1.0, "b": 70.0} and [f.id for f in joined.factors] == ["a", "b"]


def test_ranks_follow_learned_weights(spark):
    from rankloom.sources.config import with_weights

    values = {f"T{i}": {"a": float(i), "b": float(-i), "c": 0.0} for i in range(10)}
    assert run(spark, values, with_weights(Config(AB, neutralize=False, min_include=0.0), {"b": 900.0}))["T0"].rank == 1


def test_defaults_and_filters_of_a_document():
    from rankloom.operators.universe import Screen
    from rankloom.sources.config import parse_config, parse_screen

    bare = parse_config({})
    assert (bare.penalty_cap, bare.min_include, bare.min_confidence) == (3.0, 0.0, 0.6)
    assert parse_config({"meta": {"penalty_total_cap_sigma": 2.2, "min_coverage_to_include": 0.55}}).penalty_cap == 2.2
    filters = {"min_price": 1.0, "min_market_cap": 150000000, "max_market_cap": 20000000000, "min_avg_dollar_volume": 1000000, "max_price": None, "require_wsb": False, "require_analyst_buy": False}
    assert parse_screen({"filters": filters}) == Screen(1.0, None, 1.5e8, 2e10, 1e6)
    assert parse_screen({"filters": {"require_wsb": True, "require_analyst_buy": True, "min_price": 0}}) == Screen(require_mentions=True, analyst_buy=2.5)
    assert parse_screen({}) == parse_screen({"filters": None}) == Screen()


def test_any_two_securities_are_compared(spark):
    from rankloom.operators.reports import compare

    scores = spark.createDataFrame([("A", "risk", 1.0), ("O'B", "risk", 2.0), ("A", "size", 3.0), ("C", "size", 9.0)], "ticker string, category string, category_score double")
    rows = compare("A", "O'B").on(spark, category_scores=scores).collect()
    assert sorted(map(tuple, rows)) == [("risk", 1.0, 2.0), ("size", 3.0, None)]


def test_missing_values_stay_missing_in_a_neutralised_sector(spark):
    rows = [(f"T{i}", "s", "a", float(i)) for i in range(6)] + [("N", "s", "a", None)] + [(t, "s", "b", 1.0 + k) for k, t in enumerate(("T0", "T1", "T2", "T3", "T4", "N"))] + [("E", "s", "a", None)]
    values = spark.createDataFrame(rows, "ticker string, sector string, factor_id string, raw double")
    flags = spark.createDataFrame([("E", "bad")], "ticker string, penalty_id string")
    cfg = Config((Factor("a", "value", 50), Factor("b", "quality", 50)), {"bad": (-0.25, 0.0)}, min_include=0.0)
    scored = {(r.ticker, r.factor_id): r.score for r in score(values, flags, cfg, "normalised").collect()}
    assert scored["N", "a"] is None and scored["E", "a"] is None and all(scored[f"T{i}", "a"] is not None for i in range(6))
    ranking = sorted(score(values, flags, cfg).collect(), key=lambda r: r.rank)
    assert ranking[-1].ticker == "E" and ranking[-1].total_score is None and ranking[-1].coverage == 0
    assert {r.ticker: r.coverage for r in ranking}["N"] == 0.5


def test_values_and_scores_that_differ_in_noise_only_tie(spark):
    cfg = Config((Factor("a", "x"), Factor("b", "y")), neutralize=False)
    raw = {"T3": (0.3, 2.0), "T1": (0.1 + 0.2, 2.0), "T2": (0.3 - 5e-17, 2.0), "T9": (0.5, 1.0), "T5": (0.1, 3.0)}
    rows = [(t, "s", f, x) for t, pair in raw.items() for f, x in zip("ab", pair)]
    values = spark.createDataFrame(rows, "ticker string, sector string, factor_id string, raw double")
    flags = spark.createDataFrame([], "ticker string, penalty_id string")
    got = {r.ticker: r.percentile for r in score(values, flags, cfg, "ranked").where("factor_id = 'a'").collect()}
    assert got == {"T5": 20.0, "T1": 60.0, "T2": 60.0, "T3": 60.0, "T9": 100.0}
    con = duckdb.connect()
    con.execute("CREATE TABLE factor_values (ticker varchar, sector varchar, factor_id varchar, raw double)")
    con.executemany("INSERT INTO factor_values VALUES (?, ?, ?, ?)", rows)
    ranked = scorer(cfg, Rel("factor_values"))["ranked"]
    assert dict(con.sql(f"SELECT ticker, percentile FROM ({ranked.sql()}) WHERE factor_id = 'a'").fetchall()) == got
    scores = spark.createDataFrame([("T2", 50 + 1e-12), ("T1", 50.0), ("T3", 50.1)], "ticker string, total_score double").selectExpr("*", "1e0 AS coverage", "false AS pinned")
    assert [r.ticker for r in scorer(cfg)["ranking"].on(spark, scores=scores).orderBy("rank").collect()] == ["T3", "T1", "T2"]
