"""Universe building, filters, scan rotation and set differences."""

from __future__ import annotations

from dataclasses import dataclass

from rankloom.operators.factors import CUTS, FACTORS
from rankloom.plans.numbering import numbering
from rankloom.plans.rel import Rel, Registry
from rankloom.sources.adapters import BARS, MENTIONS, SECURITIES

REG = Registry(CUTS)

#: Lowest and highest market capitalisation of each preset.
PRESETS = {"micro": (5e7, 3e8), "smallcap": (3e8, 2e9), "midcap": (2e9, 1e10), "emerging": (2e8, 1e10), "largecap": (1e10, 2e11), "us": (5e7, 1e15)}
#: Symbols that are no stocks (of the derived tables, by way of example).
NON_STOCK = ("T000003", "T000050")
SYMBOL = "^[A-Z][A-Z.-]{0,6}$"

REG.rel("un_presets", lambda q: f"SELECT s.ticker, p.preset, round(s.market_cap, 3) AS market_cap FROM securities s JOIN {q.values(('preset', 'low', 'high'), [(f"'{n}'", repr(a), repr(b)) for n, (a, b) in PRESETS.items()])} p ON 20 * s.market_cap BETWEEN p.low AND p.high", SECURITIES)
def cap_band(low: float, high: float, listings: Rel = SECURITIES, unit: float = 1.0) -> Rel:
    """Symbols of listings (ticker, market_cap in ``unit``) with a capitalisation in the band, dots as dashes, the largest first; what looks like no symbol goes, and a symbol's largest listing stands."""
    banded = Rel(
        "banded_listings",
        lambda q: f"""SELECT symbol, max(cap) AS cap FROM (SELECT replace(upper(trim(ticker)), '.', '-') AS symbol, {unit!r} * market_cap AS cap FROM {listings.name}) x
            WHERE cap > 0 AND cap BETWEEN {low!r} AND {high!r} AND {q.matches("symbol", SYMBOL)} GROUP BY symbol""",
        (listings,),
    )
    return numbering("cap_band", banded, "place", ("cap", "DESC"), ("symbol", "ASC"))


#: The derived tickers end in digits; as symbols their digits are written as letters.
_LISTED = Rel("listed", "SELECT translate(ticker, '0123456789', 'ABCDEFGHIJ') AS ticker, market_cap FROM securities", (SECURITIES,))
REG.rel("flt_cap_band", "SELECT symbol, round(cap, 3) AS cap, place FROM cap_band", cap_band(*PRESETS["smallcap"], _LISTED, 20.0))
def symbol_lines(lines: Rel) -> Rel:
    """Symbols of a list of lines (column ``line``): comments and all after a comma go, upper case, dots as dashes, valid ones only."""
    return Rel("symbol_lines", lambda q: f"SELECT DISTINCT replace(symbol, '.', '-') AS symbol FROM (SELECT upper(trim(split_part(split_part(line, '#', 1), ',', 1))) AS symbol FROM {lines.name}) x WHERE {q.matches('symbol', SYMBOL)}", (lines,))


def screener_caps(rows: Rel) -> Rel:
    """Capitalisation of each symbol of a screener's rows (``symbol``, ``cap_text`` with separators): the largest; what is no number doesn't count."""
    return Rel("screener_caps", f"SELECT symbol, max(cap) AS cap FROM (SELECT symbol, try_cast(replace(cap_text, ',', '') AS double) AS cap FROM {rows.name}) x WHERE cap > 0 GROUP BY symbol", (rows,))


#: A list of symbols and a screener's rows as files have them, made of parts and customers.
_LINES = Rel("part_lines", "SELECT concat(' ', lower(translate(p_brand, '#0123456789', '.abcdefghij')), ', ', p_name, ' # ', p_type) AS line FROM part UNION ALL SELECT concat('# ', p_name) FROM part UNION ALL SELECT lower(p_type) FROM part", (Rel("part"),))
_WHOLE = "cast(floor(c_acctbal) AS int)"
_ROWS = Rel(
    "screener_rows",
    f"""SELECT concat('N', translate(cast(c_nationkey AS varchar(9)), '0123456789', 'ABCDEFGHIJ')) AS symbol, CASE WHEN c_acctbal < 0 THEN 'n/a' WHEN c_acctbal >= 1000
           THEN concat(cast(cast(floor(c_acctbal / 1000) AS int) AS varchar(9)), ',', lpad(cast({_WHOLE} % 1000 AS varchar(9)), 3, '0')) ELSE cast({_WHOLE} AS varchar(9)) END AS cap_text FROM customer""",
    (Rel("customer"),),
)
REG.rel("un_symbols", "SELECT symbol FROM symbol_lines", symbol_lines(_LINES))
REG.rel("un_listings", "SELECT symbol, cap FROM screener_caps", screener_caps(_ROWS))
#: Symbols of several sources in order; the first source that has a symbol keeps it.
_SOURCES = Rel(
    "union_rows",
    f"""
    SELECT ticker, source, src, size FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY src) AS seen FROM (
        SELECT ticker, 'mentions' AS source, 1 AS src, cast(mentions AS double) AS size FROM (SELECT ticker, sum(mentions) AS mentions FROM mentions GROUP BY ticker) m WHERE mentions > 0
        UNION ALL SELECT ticker, 'listings', 2, cast(market_cap AS double) FROM securities) a) b
    WHERE seen = 1 AND ticker NOT IN ({", ".join(repr(t) for t in NON_STOCK)})""",
    (MENTIONS, SECURITIES),
)
UNION = numbering("universe_union", _SOURCES, "place", ("src", "ASC"), ("size", "DESC"), ("ticker", "ASC"))
REG.rel("un_union", "SELECT ticker, source, place FROM universe_union", UNION)
REG.rel("un_stride_sample", lambda q: f"SELECT u.ticker, u.place, i.i FROM (SELECT *, (SELECT count(*) FROM universe_union) AS n FROM universe_union) u JOIN (SELECT {q.explode(q.numbers('0', '24'))} AS i) i ON u.place = floor(i.i * u.n / 25e0) + 1", UNION)
REG.rel("un_wsb_top", "SELECT ticker, mentions, place FROM (SELECT ticker, mentions, row_number() OVER (ORDER BY mentions DESC, ticker) AS place FROM (SELECT ticker, sum(mentions) AS mentions FROM mentions GROUP BY ticker) m) x WHERE place <= 20", MENTIONS)
#: Last scan of each security: none for every fourth.
SCANS = Rel("scan_log", "SELECT ticker, k % 13 = 0 AS pinned, CASE WHEN k % 4 <> 0 THEN 20240100 + k % 9 END AS last_scan FROM securities", (SECURITIES,))
ROTATION = numbering("rotation", SCANS, "place", ("CASE WHEN pinned THEN 0 WHEN last_scan IS NULL THEN 1 ELSE 2 END", "ASC"), ("CASE WHEN pinned THEN 0 ELSE coalesce(last_scan, 0) END", "ASC"), ("ticker", "ASC"))
REG.rel("un_rotation", "SELECT ticker, pinned, last_scan, place FROM rotation WHERE place <= greatest((SELECT count(*) FROM scan_log WHERE pinned), 30)", ROTATION, SCANS)
REG.rel("un_coverage", "SELECT count(*) AS universe, sum(CASE WHEN last_scan IS NULL THEN 1 ELSE 0 END) AS never_scanned, count(last_scan) AS ever_scanned, round(100e0 * count(last_scan) / greatest(1, count(*)), 4) AS coverage_pct FROM scan_log", SCANS)
REG.rel("un_scan_days", "SELECT last_scan, n FROM (SELECT last_scan, count(*) AS n, row_number() OVER (ORDER BY last_scan DESC) AS r FROM scan_log WHERE last_scan IS NOT NULL GROUP BY last_scan) x WHERE r <= 7", SCANS)
#: The last two trading days, and which tickers had a bar on them.
_DAYS = Rel("days", "SELECT b.ticker, b.date, x.day_back FROM bars b JOIN (SELECT date, row_number() OVER (ORDER BY date DESC) AS day_back FROM (SELECT DISTINCT date FROM bars) u) x ON x.date = b.date WHERE x.day_back <= 2", (BARS,))
REG.rel("un_disappeared", "SELECT ticker FROM days WHERE day_back = 2 EXCEPT SELECT ticker FROM days WHERE day_back = 1", _DAYS)
REG.rel("src_cache_valid", "SELECT ticker, count(*) AS n_bars FROM bars GROUP BY ticker HAVING count(*) >= 30", BARS)
REG.rel("src_backfill", "SELECT b.ticker, max(b.date) AS last_bar FROM bars b WHERE NOT EXISTS (SELECT 1 FROM scan_log s WHERE s.ticker = b.ticker AND s.last_scan >= 20240105) GROUP BY b.ticker", BARS, SCANS)



@dataclass(frozen=True)
class Screen:
    """What a record must satisfy; None or 0 switches a test off."""

    min_price: float | None = None
    max_price: float | None = None
    min_cap: float | None = None
    max_cap: float | None = None
    min_dollar_volume: float | None = None
    require_mentions: bool = False
    #: Highest mean rating of analysts that is a buy (1 best); no rating fails.
    analyst_buy: float | None = None


def first_reasons(screen: Screen, records: Rel = FACTORS) -> Rel:
    """The first test, in the order of ``Screen``, that a record fails (null: none). A record without bars isn't usable; pinned ones pass all others. A missing price counts as 0; a missing capitalisation or volume passes."""
    tests = (
        (screen.min_price, "coalesce(f.price, 0e0) < {}", "price low"), (screen.max_price, "f.price > {}", "price high"), (screen.min_cap, "f.market_cap < {}", "market cap low"), (screen.max_cap, "f.market_cap > {}", "market cap high"),
        (screen.min_dollar_volume, "f.dollar_volume < {}", "dollar volume low"), (screen.require_mentions, "f.mention_rank IS NULL", "not mentioned"), (screen.analyst_buy, "f.analyst_consensus IS NULL OR f.analyst_consensus > {}", "no analyst buy"),
    )
    cases = " ".join(f"WHEN {test.format(repr(float(bound)))} THEN '{reason}'" for bound, test, reason in tests if bound)
    return Rel("reasons", f"SELECT f.ticker, CASE WHEN f.n IS NULL OR f.n = 0 THEN 'not usable' WHEN coalesce(s.pinned, FALSE) THEN NULL {cases} END AS reason FROM {records.name} f LEFT JOIN scan_log s ON s.ticker = f.ticker", (records, SCANS))


REASONS = first_reasons(Screen(1.0, 2500.0, 2.8e7, 3.2e7, 20000.0, True, 4.2))
REG.rel("flt_reasons", "SELECT ticker, reason FROM reasons", REASONS)
REG.rel("flt_histogram", "SELECT reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY reason", REASONS)


def usable_bars(as_of: str | None = None, least: int = 30) -> Rel:
    """Tickers and their usable bars, ``least`` or more. A last bar of the day ``as_of`` (by default the last day of all) isn't over yet and goes, if more than ``least`` bars are there."""
    day = "(SELECT max(date) FROM bars)" if as_of is None else f"cast('{as_of}' AS timestamp)"
    return Rel("usable_bars", f"SELECT ticker, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n_all, max(date) OVER (PARTITION BY ticker) AS last FROM bars WHERE close IS NOT NULL) x WHERE NOT (date = last AND date >= {day} AND n_all > {least}) GROUP BY ticker HAVING count(*) >= {least}", (BARS,))


REG.rel("flt_usable_bars", "SELECT ticker, n FROM usable_bars", usable_bars())
#: Texts in lower case, Turkish and accented letters as plain ones, runs of spaces as one.
FOLDED = Rel("folded_texts", lambda q: "SELECT doc_id, trim(" + q.replace_all("translate(lower(text), 'ıçğöşüâå', 'icgosuaa')", " +", " ") + ") AS folded FROM documents", (Rel("documents"),))
REG.rel("prj_fold_text", "SELECT doc_id, md5(folded) AS folded, length(folded) AS n_chars FROM folded_texts", FOLDED)
REG.rel("jn_mentions_sentiment", "SELECT coalesce(m.ticker, s.ticker) AS ticker, m.mentions, round(s.score, 6) AS score FROM (SELECT ticker, sum(mentions) AS mentions FROM mentions WHERE rank <= 40 GROUP BY ticker) m FULL OUTER JOIN (SELECT ticker, avg(sentiment_score) AS score FROM mentions WHERE rank > 30 GROUP BY ticker) s ON s.ticker = m.ticker", MENTIONS)
REG.rel("jn_pinned", "SELECT f.ticker, s.ticker IS NOT NULL AS pinned FROM (SELECT ticker FROM factors) f LEFT JOIN (SELECT ticker FROM scan_log WHERE pinned) s ON s.ticker = f.ticker", FACTORS, SCANS)
