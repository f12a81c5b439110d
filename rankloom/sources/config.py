"""Scoring and screening configuration from a YAML or JSON file."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import SparkSession

from rankloom.operators.scoring import Config, Factor
from rankloom.operators.universe import Screen

#: What a document that doesn't say it means: names of ours, of the document, and the value.
META = {
    "min_coverage": ("auto_disable_coverage_below", 0.15), "min_confidence": ("min_coverage_for_confidence", 0.60), "min_include": ("min_coverage_to_include", 0.0),
    "shrink_power": ("coverage_shrink_power", 1.0), "penalty_cap": ("penalty_total_cap_sigma", 3.0),
}
#: Fixed value: the mean rating up to which analysts say buy.
ANALYST_BUY = 2.5


def parse_config(document: dict) -> Config:
    """A document of meta, factors, penalties and clusters as a ``Config``; what it doesn't say keeps the default.

    Weights must not be negative and ids not repeat. Bands are lists of {max, score, label}; the score of a band
    is 0 where none is given.
    """
    meta, factors = document.get("meta") or {}, []
    for f in document.get("factors") or []:
        bands = tuple((float(b["max"]), float(b.get("score", 0.0)), str(b.get("label", b.get("label_tr", "")))) for b in f.get("bands") or [])
        factors.append(Factor(f["id"], f.get("category", "other"), float(f.get("weight", 1.0)), f.get("norm", "rank"), f.get("direction") == "lower_better", bands))
    if len({f.id for f in factors}) < len(factors) or any(f.weight < 0 for f in factors):
        raise ValueError("factor ids repeat, or a weight is negative")
    penalties = {p["id"]: (None if p.get("sigma") is None else float(p["sigma"]), float(p.get("points", 0.0))) for p in document.get("penalties") or []}
    clusters = tuple((c["id"], float(c.get("budget", 0.0)), tuple(c.get("members") or ())) for c in document.get("clusters") or [])
    given = {own: float(default if meta.get(key) is None else meta[key]) for own, (key, default) in META.items()}
    return Config(tuple(factors), penalties, clusters, neutralize=bool(meta.get("sector_neutralize", True)), **given)


def parse_screen(document: dict) -> Screen:
    """The section ``filters`` of a document as a ``Screen``; a bound that is absent, null or zero isn't tested."""
    f = document.get("filters") or {}
    number = lambda key: float(f[key]) if f.get(key) else None
    return Screen(number("min_price"), number("max_price"), number("min_market_cap"), number("max_market_cap"), number("min_avg_dollar_volume"), bool(f.get("require_wsb")), ANALYST_BUY if f.get("require_analyst_buy") else None)


def read_screen(spark: SparkSession, path: str) -> Screen:
    """The screen of a configuration file."""
    return parse_screen(_document(spark, path))


def read_config(spark: SparkSession, path: str) -> Config:
    """A configuration file from any store that Spark reads. YAML needs the yaml module; JSON is read without it."""
    return parse_config(_document(spark, path))


def _document(spark: SparkSession, path: str) -> dict:
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def with_weights(cfg: Config, learned: dict[str, float], disabled: tuple[str, ...] = ()) -> Config:
    """Learned weights join the configuration: explicit overrides win over them, ids in ``disabled`` go, unknown ids are ignored."""
    ids = {f.id for f in cfg.factors}
    return replace(cfg, factors=tuple(f for f in cfg.factors if f.id not in disabled), overrides={k: w for k, w in learned.items() if k in ids} | cfg.overrides)
