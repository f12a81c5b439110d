"""SQL expressions over one key's rows in date order: rolling windows, clamps, weighted means, recurrences."""

from __future__ import annotations

import math

KEY, ORDER = "ticker", "date"


def d(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def over(n: int | None = None, key: str = KEY, order: str = ORDER, after: int = 0) -> str:
    """The last ``n`` rows up to this one (all without n), and ``after`` rows after it."""
    begin = "UNBOUNDED PRECEDING" if n is None else f"{n - 1} PRECEDING"
    end = "CURRENT ROW" if not after else f"{after} FOLLOWING"
    return f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {begin} AND {end})"


def whole(key: str = KEY) -> str:
    return f"OVER (PARTITION BY {key})"


def roll(agg: str, x: str, n: int, least: int) -> str:
    """An aggregate of the last n rows, if ``least`` of them have a value."""
    return f"CASE WHEN count({x}) {over(n)} >= {least} THEN {agg}({x}) {over(n)} END"


def mean(total: str, n: int) -> str:
    """Simple moving average of a series without gaps, from its running total; half the window is enough."""
    return f"CASE WHEN rn + 1 >= {max(2, n // 2)} THEN ({total} - coalesce(lag({total}, {n}) OVER (PARTITION BY {KEY} ORDER BY {ORDER}), 0e0)) / least(rn + 1, {n}) END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {KEY} ORDER BY {ORDER})"


def clamp(low: float, high: float, x: str) -> str:
    """A missing value stays missing (greatest and least skip nulls)."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({d(low)}, least({d(high)}, {x})) END"


def cap(high: float, x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least({d(high)}, {x}) END"


def floor_at(low: float, x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({d(low)}, {x}) END"


def wavg(*parts: tuple[float, str]) -> str:
    """Weighted mean of the parts that aren't null; null if none is."""
    top = " + ".join(f"coalesce({d(w)} * ({x}), 0e0)" for w, x in parts)
    low = " + ".join(f"CASE WHEN ({x}) IS NOT NULL THEN {d(w)} ELSE 0e0 END" for w, x in parts)
    return f"({top}) / nullif({low}, 0e0)"


def ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def position(x: str) -> str:
    """Number (from 0) of a value among its key's values; for recurrences."""
    return f"CASE WHEN {x} IS NOT NULL THEN count({x}) {over()} - 1 END"


#: Rows of a block of the weighted means below: powers of up to 1 - 1/3 stay finite within one.
BLOCK = 1024


def _blocks_back(alpha: float) -> int:
    """Earlier blocks that still count in double precision."""
    return max(1, math.ceil(41.5 / (BLOCK * -math.log(1 - alpha))))


def ewm_inner(x: str, first: str, alpha: float) -> str:
    """The share of a row's own block in its exponentially weighted mean e_0 = x_0, e_i = (1 - alpha) e_(i-1) + alpha x_i.

    ``first`` tells the first value; nulls stand before it only. Rows have ``blk`` and ``pos``, the number of
    their block of BLOCK rows and their place in it.
    """
    r = math.log(1 - alpha)
    return f"exp(pos * {d(r)}) * sum(CASE WHEN {first} THEN 1e0 ELSE {d(alpha)} END * {x} * exp(pos * {d(-r)})) OVER (PARTITION BY {KEY}, blk ORDER BY {ORDER})"


def carried(inner: str, alpha: float) -> str:
    """What the blocks before a row's have left at the end of the last of them, from the column of their inner shares."""
    m, left = _blocks_back(alpha), BLOCK * math.log(1 - alpha)
    ends = [f"coalesce(max_by(coalesce({inner}, 0e0), CASE WHEN pos = {BLOCK - 1} AND blk % {m} = {k} THEN blk END) OVER (PARTITION BY {KEY} ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)" for k in range(m)]
    if m == 1:
        return ends[0]
    terms = lambda c: " + ".join(f"{d(math.exp(left * (k - 1)))} * {ends[(c - k) % m]}" for k in range(1, m + 1))
    return f"CASE blk % {m} " + " ".join(f"WHEN {c} THEN {terms(c)}" for c in range(m)) + " END"


def ewm_whole(x: str, inner: str, alpha: float, least: int) -> str:
    """The weighted mean from the inner share and what was carried; null before ``least`` values. Any length of history is exact to double precision."""
    return f"CASE WHEN count({x}) {over()} >= {least} THEN coalesce({inner}, 0e0) + exp((pos + 1) * {d(math.log(1 - alpha))}) * {carried(inner, alpha)} END"


def gap_since(x: str) -> str:
    """Rows since the value before this row's; null before the first."""
    return f"rn - max(CASE WHEN {x} IS NOT NULL THEN rn END) OVER (PARTITION BY {KEY} ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def gap_steps(x: str, gap: str, alpha: float) -> tuple[str, str]:
    """(logarithm of what is kept of the mean before, weight of this value) where gaps let the mean's weight decay: it is kept in a row without a value."""
    r = math.log(1 - alpha)
    whole_ = f"(exp({gap} * {d(r)}) + {d(alpha)})"
    return f"CASE WHEN {x} IS NULL OR {gap} IS NULL THEN 0e0 ELSE {gap} * {d(r)} - ln({whole_}) END", f"CASE WHEN {gap} IS NULL THEN 1e0 ELSE {d(alpha)} / {whole_} END"


def span(n: int) -> float:
    return 2 / (n + 1)


def bands(x: str, steps: list[tuple[float, str]], last: str) -> str:
    """First label whose bound isn't below x."""
    whens = " ".join(f"WHEN {x} <= {d(b)} THEN {v}" for b, v in steps)
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE {last} END"


def level(x: str) -> str:
    """A value to the seven or so digits of single precision, by which values tie: later digits are the order of their sums, which differs from run to run and between copies of a row."""
    return f"cast(cast({x} AS float) AS double)"


def r6(x: str) -> str:
    return f"round({x}, 6)"
