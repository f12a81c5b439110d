"""All registered queries of the ranking engine: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from rankloom.operators import daily, factor_oracles, factors, indicators, models, profile, reports, research, scoring, scoring_oracles, signals, targets, universe

_MODULES = (indicators, daily, profile, signals, factors, scoring, targets, universe, research, models, reports)

QUERIES, ORACLES = {}, {}
for _m in _MODULES:
    QUERIES |= _m.REG.queries()
    ORACLES |= {n: r.sql() for n, r in _m.REG.rels.items()}
ORACLES |= {f"fa_{n}": s for n, s in factor_oracles.SQL.items()}
ORACLES["src_previous_snapshot"] = research.PREVIOUS_ORACLE.sql()
ORACLES["in_daily"] = daily.ORACLE.sql()
ORACLES |= scoring_oracles.SQL
