"""The engine's tables, derived from a star schema: bars, benchmark, securities, fundamentals, ratings, mentions.

The operators take any frames of these shapes; this module makes them from ``lineitem`` and its dimensions
so that every operator can run, and be checked, on real volumes. A supplier is a security, the price of a
day is that of its line items, its sector the region of its nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from rankloom.functions.expr import d
from rankloom.plans.rel import Rel, Spark, deal

LINEITEM, SUPPLIER, NATION, REGION, ORDERS, EVENTS = (Rel(n) for n in ("lineitem", "supplier", "nation", "region", "orders", "events"))



def ticker(x: str) -> str:
    return f"concat('T', lpad(cast({x} AS varchar(12)), 6, '0'))"


def _ticks(lineitem: DataFrame) -> DataFrame:
    """Line items dealt by ticker once, to tasks whose number grows with the items, so that what a task sorts and sums up doesn't."""
    rows = lineitem.sparkSession.sql(TICKS.text(Spark).replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
    return deal(rows, "ticker", lineitem.count())  # of files, the count is that of their footers


TICKS = Rel(
    "ticks",
    lambda q: f"""
    SELECT {ticker("l_suppkey")} AS ticker, cast(l_shipdate AS date) AS date, l_extendedprice / l_quantity AS price,
           l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax
    FROM lineitem WHERE l_quantity > 0{q.distribute("ticker")}""",
    (LINEITEM,),
    run=_ticks,
)

_FULL = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")

#: ticker, date, open, high, low, close, volume; ties of a day's first and last item are broken by all columns.
BARS = Rel(
    "bars",
    lambda q: f"""
    SELECT ticker, date, min_by(price, {q.row(*_FULL)}) AS open, max(price) AS high, min(price) AS low,
           max_by(price, {q.row(*_FULL)}) AS close, sum(l_quantity) AS volume
    FROM ticks GROUP BY ticker, date""",
    (TICKS,),
    dealt="ticker",
)

#: Benchmark: mean close of a day.
BENCH = Rel("bench", "SELECT date, avg(close) AS bench_close FROM bars GROUP BY date", (BARS,))

#: Sums of each security and calendar quarter: revenue, items, discounts, taxes and volume.
QUARTERLY = Rel(
    "quarterly",
    """
    SELECT ticker, year(date) AS y, quarter(date) AS q, sum(l_extendedprice * (1 - l_discount)) AS value, count(*) AS items, sum(l_discount) AS discounts, sum(l_tax) AS taxes, sum(l_quantity) AS volume
    FROM ticks GROUP BY 1, 2, 3""",
    (TICKS,),
)

#: Revenue of each security and calendar quarter, latest first.
INCOME = Rel("income", "SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY y DESC, q DESC) AS quarter_rank, 4 * y + q AS quarter, value FROM quarterly", (QUARTERLY,))

SECURITIES = Rel(
    "securities",
    f"""
    SELECT {ticker("s_suppkey")} AS ticker, s_name AS name, r_name AS sector, n_name AS industry, s_suppkey AS k, s_acctbal AS cash,
           m.market_cap, m.margin, m.total_volume, m.total_revenue
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT ticker, sum(value) AS market_cap, 1 - sum(discounts) / sum(items) - sum(taxes) / sum(items) AS margin, sum(volume) AS total_volume,
                      sum(CASE WHEN latest <= 4 THEN value END) AS total_revenue
               FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY y DESC, q DESC) AS latest FROM quarterly) x GROUP BY ticker) m ON m.ticker = {ticker("s_suppkey")}""",
    (SUPPLIER, NATION, REGION, QUARTERLY),
)


def _made(i: int, low: float, high: float, gap: int = 11) -> str:
    """A deterministic figure between two bounds, null for every ``gap``-th security."""
    return f"CASE WHEN (k + {i}) % {gap} <> 0 THEN {d(low)} + {d(high - low)} * ((k * 7919 + {i} * 104729) % 1000) / 1000e0 END"


#: Name, lowest and highest figure of each derived fundamental.
FIGURES = {
    "revenue_growth": (-0.3, 0.6), "earnings_growth": (-0.4, 0.7), "earnings_q_growth": (-0.5, 0.9), "gross_margin": (0.05, 0.7), "operating_margin": (-0.2, 0.35),
    "profit_margin": (-0.25, 0.3), "ebitda_margin": (-0.15, 0.4), "roe": (-0.2, 0.45), "roa": (-0.1, 0.2), "debt_to_equity": (0, 260), "current_ratio": (0.4, 3.5),
    "quick_ratio": (0.3, 3), "trailing_pe": (-10, 45), "forward_pe": (4, 40), "peg": (-1, 4), "price_to_sales": (0.2, 9), "price_to_book": (0.3, 8), "ev_ebitda": (-5, 30),
    "trailing_eps": (-3, 12), "forward_eps": (-2, 14), "beta": (0.2, 2.2), "short_percent": (0, 0.3), "short_ratio": (0.5, 12), "held_institutions": (0, 1.1),
    "held_insiders": (0, 0.4), "analysts": (0, 30), "rating_mean": (1, 5), "est_growth_next": (-0.3, 0.5), "est_growth_now": (-0.3, 0.5), "est_revenue_next": (-0.2, 0.4),
    "fcf_share": (-0.3, 0.3), "ocf_share": (-0.2, 0.4), "debt_share": (0, 1.5), "target_mean_ratio": (0.6, 1.8), "target_high_ratio": (1.1, 2.5), "target_low_ratio": (0.4, 1),
}

FUNDAMENTALS = Rel(
    "fundamentals",
    "SELECT *, (k * 37) % 90 AS days_to_earnings, market_cap * fcf_share AS free_cashflow, market_cap * ocf_share AS operating_cashflow, market_cap * debt_share AS total_debt, "
    "total_revenue * profit_margin AS net_income, CASE WHEN k % 13 <> 0 THEN greatest(cash, 0e0) * 1000 END AS total_cash FROM (SELECT ticker, market_cap, total_revenue, cash, k, "
    + ", ".join(f"{_made(i, lo, hi)} AS {n}" for i, (n, (lo, hi)) in enumerate(FIGURES.items()))
    + " FROM securities) x",
    (SECURITIES,),
)

#: Rating counts of each security and period (0m: last year, -3m: all before), from order priorities.
RATINGS = Rel(
    "ratings",
    "SELECT ticker, period, "
    + ", ".join(f"sum(CASE WHEN o_orderpriority LIKE '{i + 1}-%' THEN 1 ELSE 0 END) AS {n}" for i, n in enumerate(("strong_buy", "buy", "hold", "sell", "strong_sell")))
    + """ FROM (SELECT ticker, CASE WHEN o_orderdate >= timestamp '2000-07-01 00:00:00' THEN '0m' ELSE '-3m' END AS period, o_orderpriority
          FROM ticks JOIN orders ON l_orderkey = o_orderkey) x GROUP BY ticker, period""",
    (TICKS, ORDERS),
)

#: Estimate revisions of each security and period (0q, +1q, 0y, +1y), deterministic.
ESTIMATES = Rel(
    "estimates",
    "SELECT ticker, period, "
    + ", ".join(f"CASE WHEN (k + j + {i}) % 9 <> 0 THEN {d(lo)} + {d(hi - lo)} * ((k * 7919 + j * 31 + {i} * 104729) % 1000) / 1000e0 END AS {n}" for i, (n, lo, hi) in enumerate((("eps_now", 0.5, 5), ("eps_30d", 0.5, 5), ("eps_90d", 0.5, 5), ("up_30d", 0, 8), ("down_30d", 0, 8))))
    + " FROM securities CROSS JOIN (SELECT '0q' AS period, 0 AS j UNION ALL SELECT '+1q', 1 UNION ALL SELECT '0y', 2 UNION ALL SELECT '+1y', 3) p",
    (SECURITIES,),
)

#: Earnings surprise of each security and quarter (a number that grows with time), deterministic, null for every ninth.
EARNINGS = Rel(
    "earnings_history",
    "SELECT i.ticker, i.quarter, CASE WHEN (s.k + i.quarter) % 9 <> 0 THEN -0.4e0 + 0.8e0 * ((s.k * 7919 + i.quarter * 31) % 1000) / 1000e0 END AS surprise FROM income i JOIN securities s ON s.ticker = i.ticker",
    (INCOME, SECURITIES),
)

#: Mentions of each security and day of the event stream, the day before's, rank of the day and mean sentiment.
MENTIONS = Rel(
    "mentions",
    f"""
    SELECT ticker, day, mentions, lag(mentions) OVER (PARTITION BY ticker ORDER BY day) AS mentions_prev,
           rank() OVER (PARTITION BY day ORDER BY mentions DESC) AS rank, sentiment_score
    FROM (SELECT {ticker("1 + user_id % 100")} AS ticker, cast(ts AS date) AS day, count(*) AS mentions, avg(value) / 250e0 - 1e0 AS sentiment_score
          FROM events GROUP BY 1, 2) x""",
    (EVENTS,),
)

#: Positions: every seventh security, entered at the close 60 bars ago.
POSITIONS = Rel(
    "positions",
    """
    SELECT b.ticker, b.date AS added_date, b.close AS entry_price, 10e0 + s.k % 5 AS quantity, 40e0 + s.k % 41 AS score_at_entry
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rd FROM bars) b JOIN securities s ON s.ticker = b.ticker
    WHERE b.rd = 61 AND s.k % 7 = 0""",
    (BARS, SECURITIES),
)
