"""Perceptron and recurrent rankers, trained by rounds of gradients that Spark sums over days.

Rows are packed once into blocks of a day (a large day into several). In a round every task runs the net over its
blocks, forward and backward, and hands on one summed gradient; the driver takes an AdamW step and sends the new
weights with the next round. The loss is minus the correlation of predictions and labels within a day. A block that
holds its whole day needs one pass; days in several blocks first exchange their moments (six sums a day), then their
gradients. All folds of a walk-forward evaluation train in the same rounds. Nothing but sums, weights and a few figures
a day reaches the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.plans.rel import PLAIN, written

#: Rows of a block, and fewest rows of a day that teaches.
BLOCK, LEAST_DAY = 16_384, 8
#: Tasks of a round for each core.
WAVES = 3
#: Partial gradients that the driver adds up itself; beyond that tasks add them up first.
PARTIALS = 64
_EPS = 1e-5


def _norm(x: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Layer normalisation of columns: units lie in rows, so that all rows of a block are next to each other."""
    z = x - x.mean(axis=0)
    spread = np.sqrt(np.square(z).mean(axis=0) + _EPS)
    z /= spread
    return z * g[:, None] + b[:, None], (z, spread, g)


def _norm_back(d: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z, spread, g = kept
    dz, by_unit = d * g[:, None], d * z
    out = dz - dz.mean(axis=0)
    out -= z * np.multiply(dz, z, out=dz).mean(axis=0)
    out /= spread
    return out, by_unit.sum(axis=1), d.sum(axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place: exp takes half of tanh's time and less."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


_C, _K = float(2 * np.sqrt(2 / np.pi)), 0.044715


def _gelu(x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """x times the logistic function of _C * (x + _K * x**3): the usual form by tanh."""
    square = x * x
    s = square * (-_C * _K)
    s -= _C
    s *= x
    y = x * _logistic(s)
    return y, (square, s, y)


def _gelu_back(d: np.ndarray, kept: tuple) -> np.ndarray:
    square, s, y = kept
    out = square * (3 * _C * _K)
    out += _C
    out *= y
    out *= 1 - s
    out += s
    out *= d
    return out


def _dropped(x: np.ndarray, share: float, rng: np.random.Generator | None) -> tuple[np.ndarray, np.ndarray | float]:
    if rng is None or not share:
        return x, 1.0
    keep = (rng.random(x.shape, dtype=np.float32) >= share).astype(x.dtype)
    keep *= 1 / (1 - share)
    return x * keep, keep


class Net:
    """Weights in one vector; subclasses name their parts. The weights' type is that of all figures.

    ``chunk``: rows that a training task computes at a time (all of a block without it); ``kind``: the type it computes in.
    """

    chunk: ClassVar[int | None] = None
    kind: ClassVar[type] = np.float64

    def parts(self) -> dict[str, tuple[int, ...]]:
        raise NotImplementedError

    def named(self, theta: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts().items():
            n = int(np.prod(shape))
            out[name] = theta[at : at + n].reshape(shape)
            at += n
        return out

    def packed(self, gradients: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([gradients[name].ravel() for name in self.parts()])

    def start(self, seed: int) -> np.ndarray:
        """Weights uniform within one over the square root of their inputs; scales one, shifts zero."""
        rng = np.random.default_rng(seed)
        draw = lambda name, shape: np.ones(shape) if name[0] == "g" else np.zeros(shape) if len(shape) == 1 else rng.uniform(-1, 1, shape) / np.sqrt(shape[0])
        return np.concatenate([draw(name, shape).ravel() for name, shape in self.parts().items()])


@dataclass(frozen=True)
class Perceptron(Net):
    """Two hidden layers, each normalised, with Gaussian error units and dropout. Input: (rows, features)."""

    features: int
    hidden: int = 32
    dropout: float = 0.1
    steps: int = 1

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, k = self.hidden, self.hidden // 2
        return {"w1": (self.features, h), "b1": (h,), "g1": (h,), "s1": (h,), "w2": (h, k), "b2": (k,), "g2": (k,), "s2": (k,), "w3": (k, 1), "b3": (1,)}

    chunk: ClassVar[int | None] = 2048
    kind: ClassVar[type] = np.float32

    def forward(self, theta: np.ndarray, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, tuple]:
        m, x = self.named(theta), np.ascontiguousarray(x.T, theta.dtype)
        with np.errstate(over="ignore"):
            a1, n1 = _norm(m["w1"].T @ x + m["b1"][:, None], m["g1"], m["s1"])
            h1, e1 = _gelu(a1)
            h1, d1 = _dropped(h1, self.dropout, rng)
            a2, n2 = _norm(m["w2"].T @ h1 + m["b2"][:, None], m["g2"], m["s2"])
            h2, e2 = _gelu(a2)
        h2, d2 = _dropped(h2, self.dropout, rng)
        return (m["w3"].T @ h2 + m["b3"])[0], (m, x, n1, e1, d1, h1, n2, e2, d2, h2)

    def backward(self, kept: tuple, dp: np.ndarray) -> np.ndarray:
        m, x, n1, e1, d1, h1, n2, e2, d2, h2 = kept
        d = dp.astype(x.dtype, copy=False)[None]
        g = {"w3": h2 @ d.T, "b3": dp.sum(keepdims=True)}  # a day's slopes sum to nothing: rounded ones would leave a trace that the step's scale blows up
        d, g["g2"], g["s2"] = _norm_back(_gelu_back(m["w3"] @ d * d2, e2), n2)
        g["w2"], g["b2"] = h1 @ d.T, d.sum(axis=1)
        d, g["g1"], g["s1"] = _norm_back(_gelu_back(m["w2"] @ d * d1, e1), n1)
        g["w1"], g["b1"] = x @ d.T, d.sum(axis=1)
        return self.packed(g)


@dataclass(frozen=True)
class Recurrent(Net):
    """A gated recurrent cell over a row's last ``steps`` observations, normalised, with a linear head. Input: (rows, steps * features), oldest first."""

    features: int
    hidden: int = 24
    dropout: float = 0.1
    steps: int = 5

    def parts(self) -> dict[str, tuple[int, ...]]:
        f, h = self.features, self.hidden
        return {"wz": (f, h), "uz": (h, h), "bz": (h,), "wr": (f, h), "ur": (h, h), "br": (h,), "wn": (f, h), "un": (h, h), "bn": (h,), "cn": (h,), "g": (h,), "s": (h,), "w": (h, 1), "b": (1,)}

    #: Rows whose trail of a few kB each stays in a core's cache; the stored inputs have no more digits than this type.
    chunk: ClassVar[int | None] = 4096
    kind: ClassVar[type] = np.float32

    def forward(self, theta: np.ndarray, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, tuple]:
        """A step is one product of all weights with what it is given: inputs, a one for the shifts, the state. Its rows are the update and reset gates (negated, as ``_logistic`` takes them), the candidate's part by state and that by inputs (both times -2: tanh is twice the logistic function less one)."""
        m, k, f, n = self.named(theta), self.hidden, self.features, len(x)
        by_input, shift = np.hstack([-m["wz"], -m["wr"], np.zeros((f, k), theta.dtype), -2 * m["wn"]]), np.concatenate([-m["bz"], -m["br"], -2 * m["cn"], -2 * m["bn"]])
        weights = np.vstack([by_input, shift, np.hstack([-m["uz"], -m["ur"], -2 * m["un"], np.zeros((k, k), theta.dtype)])]).T.copy()
        given = np.empty((f + 1 + k, self.steps, n), theta.dtype)
        given[:f], given[f], given[f + 1 :, 0] = x.reshape(n, self.steps, f).transpose(2, 1, 0), 1, 0
        trail = []
        with np.errstate(over="ignore"):
            for t in range(self.steps):
                gates = weights[:, : f + 1] @ given[: f + 1, 0] if t == 0 else weights @ given[:, t]
                _logistic(gates[: 2 * k])
                z, r, u, c = gates[:k], gates[k : 2 * k], gates[2 * k : 3 * k], gates[3 * k :]
                c += r * u
                np.subtract(2 * _logistic(c), 1, out=c)
                away = given[f + 1 :, t] - c
                away *= z
                trail.append((gates, away))
                h = np.add(c, away, out=given[f + 1 :, t + 1] if t + 1 < self.steps else None)
        a, kept = _norm(h, m["g"], m["s"])
        a, d = _dropped(a, self.dropout, rng)
        return (m["w"].T @ a + m["b"])[0], (m, given, trail, kept, a, d)

    def backward(self, kept: tuple, dp: np.ndarray) -> np.ndarray:
        m, given, trail, normed, a, dropped = kept
        k, f, d = self.hidden, self.features, dp.astype(a.dtype, copy=False)[None]
        g = {"w": a @ d.T, "b": dp.sum(keepdims=True)}
        dh, g["g"], g["s"] = _norm_back(m["w"] @ d * dropped, normed)
        slopes = np.empty((4 * k, self.steps, len(dp)), a.dtype)  # by the rows of a step's product; that of the reset gate times -2
        own = np.hstack([m["uz"], -0.5 * m["ur"], m["un"]])
        for t in reversed(range(self.steps)):
            gates, away = trail[t]
            z, r, u, c = gates[:k], gates[k : 2 * k], gates[2 * k : 3 * k], gates[3 * k :]
            dz, dr, du, dc = (slopes[i * k : (i + 1) * k, t] for i in range(4))
            rest = 1 - z
            np.multiply(dh, away, out=dz)
            dz *= rest
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= rest
            dc *= dh
            np.multiply(dc, r, out=du)
            np.subtract(1, r, out=dr)
            dr *= du
            dr *= u
            if t:
                dh *= z
                dh += own @ slopes[: 3 * k, t]
        total = slopes.reshape(4 * k, -1) @ given.reshape(f + 1 + k, -1).T
        total[k : 2 * k] *= -0.5
        z, r, u, c = (total[i * k : (i + 1) * k].T for i in range(4))
        for name, by in (("z", z), ("r", r), ("n", c)):
            g["w" + name], g["b" + name] = by[:f], by[f]
        g |= {"uz": z[f + 1 :], "ur": r[f + 1 :], "un": u[f + 1 :], "cn": u[f]}
        return self.packed(g)


NETS = {"perceptron": Perceptron, "recurrent": Recurrent}


def moments(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """What a correlation needs; sums over parts of a day add up."""
    return np.array([len(p), p.sum(), (p * p).sum(), t.sum(), (t * t).sum(), (p * t).sum()])


def correlation(m: np.ndarray) -> float | None:
    n, p, pp, t, tt, pt = m
    vp, vt = pp / n - (p / n) ** 2, tt / n - (t / n) ** 2
    return None if vp < 1e-12 or vt < 1e-12 else float((pt / n - p * t / n / n) / np.sqrt(vp * vt))


def loss_slope(p: np.ndarray, t: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Derivative of minus the day's correlation (its moments are ``m``) by each prediction."""
    c = correlation(m)
    if c is None:
        return np.zeros(len(p))
    n, sp, spp, st, stt, _ = m
    sd, td = np.sqrt(spp / n - (sp / n) ** 2), np.sqrt(stt / n - (st / n) ** 2)
    return -((t - st / n) / td - c * (p - sp / n) / sd) / (n * sd)


@dataclass
class Blocks:
    """frame: (day, part, whole, x, y), a block a row; days: day -> (rows, sums, sums of squares) of the features."""

    frame: DataFrame
    days: dict[int, tuple[int, np.ndarray, np.ndarray]]
    columns: tuple[str, ...]
    features: int
    split: bool


def pack(panel: DataFrame, columns: tuple[str, ...], steps: int = 1, day: str = "snapshot", label: str = "y", key: str = "ticker", block: int = BLOCK) -> Blocks:
    """Blocks of a panel. ``columns`` are the inputs of a row, for ``steps`` above one the oldest observation's first. Rows with a null input or label, and days of fewer than LEAST_DAY rows, teach nothing."""
    named = {"day": F.col(day).cast("long"), "key": F.col(key).cast("string"), "y": F.col(label).cast("double")} | {f"x{i}": F.col(c).cast("double") for i, c in enumerate(columns)}
    # A condition a column: one over all of them would double Catalyst's constraints with every column.
    known = [c.isNotNull() for c in named.values()] + [~F.isnan(c) for name, c in named.items() if name not in ("day", "key")]
    kept = panel.where(reduce(lambda a, b: a & b, known))
    k = len(columns)
    sizes = kept.groupBy(named["day"].alias("day")).agg(F.count(F.lit(1)).alias("n")).where(f"n >= {LEAST_DAY}").collect()  # a row a day
    cut = panel.sparkSession.createDataFrame([(r["day"], -(r["n"] // -block)) for r in sizes], "day long, parts int")
    x = F.array(*[named[f"x{i}"].cast("float") for i in range(k)]).alias("x")
    dealt = kept.select(*[named[c].alias(c) for c in ("day", "key", "y")], x).join(F.broadcast(cut), "day")
    n_blocks, cores = sum(-(r["n"] // -block) for r in sizes), panel.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(WAVES * cores, max(cores, n_blocks // 4)))
    dealt = dealt.select("day", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), (F.col("parts") == 1).alias("whole"), "x", "y").repartition(tasks, "day", "part")
    reader = panel.sparkSession.newSession()  # its readers make a task of each file: packed by size, a round's last few tasks would keep the other cores waiting
    reader.conf.set("spark.sql.files.openCostInBytes", str(1 << 40))

    def put(table: pa.Table) -> pa.Table:
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, k).astype("<f4", copy=False)
        y, wide = table["y"].to_numpy().astype("<f8", copy=False), x.astype(np.float64)
        one = {c: table[c][0].as_py() for c in ("day", "part", "whole")} | {"x": x.tobytes(), "y": y.tobytes(), "n": len(y), "s": wide.sum(axis=0).tolist(), "q": np.square(wide).sum(axis=0).tolist()}
        return pa.Table.from_pylist([one], schema=pa.schema([("day", pa.int64()), ("part", pa.int32()), ("whole", pa.bool_()), ("x", pa.binary()), ("y", pa.binary()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("q", pa.list_(pa.float64()))]))

    frame = written(dealt.groupBy("day", "part").applyInArrow(put, "day long, part int, whole boolean, x binary, y binary, n long, s array<double>, q array<double>"), "blocks", reader, **PLAIN)
    days: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for r in frame.select("day", "n", "s", "q").orderBy("day", "part").collect():  # a row a block
        n, s, q = days.get(r["day"], (0, 0.0, 0.0))
        days[r["day"]] = n + r["n"], s + np.array(r["s"]), q + np.array(r["q"])
    return Blocks(frame.select("day", "part", "whole", "x", "y"), days, tuple(columns), k // steps, any(n > block for n, _, _ in days.values()))


@dataclass
class Trained:
    """A net with its weights and the scale of its inputs."""

    kind: str
    net: Net
    columns: tuple[str, ...]
    mean: np.ndarray
    sd: np.ndarray
    theta: np.ndarray
    history: list[dict] = field(default_factory=list)

    def predict(self) -> Column:
        """The prediction of a row; null where an input is."""
        net, theta, mean, sd = self.net, self.theta, self.mean, self.sd

        @F.pandas_udf("double")
        def run(rows: pd.DataFrame) -> pd.Series:
            x = rows.to_numpy(np.float64)
            known = np.isfinite(x).all(axis=1)
            out = np.full(len(x), np.nan)
            out[known] = net.forward(theta, (x[known] - mean) / sd)[0]
            return pd.Series(out).astype("Float64").mask(~known)

        return run(F.struct(*[F.col(c).cast("double") for c in self.columns]))

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "net": asdict(self.net), "columns": self.columns, "mean": self.mean.tolist(), "sd": self.sd.tolist(), "theta": self.theta.tolist(), "history": self.history})

    @staticmethod
    def from_json(text: str) -> Trained:
        d = json.loads(text)
        return Trained(d["kind"], NETS[d["kind"]](**d["net"]), tuple(d["columns"]), *[np.array(d[k]) for k in ("mean", "sd", "theta")], d["history"])


@dataclass
class _Run:
    """One fold's training: fits on days below ``fit_to``, stops early by days from there up to ``valid_to``."""

    number: int
    fit_to: int
    valid_to: int
    mean: np.ndarray
    sd: np.ndarray
    theta: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best: np.ndarray
    best_ic: float = -np.inf
    since: int = 0
    done: bool = False
    history: list[dict] = field(default_factory=list)


def _scaled(days: dict, below: int) -> tuple[np.ndarray, np.ndarray]:
    n, s, q = (reduce(lambda a, b: a + b, parts) for parts in zip(*[v for d, v in days.items() if d < below]))
    mean = s / n
    sd = np.sqrt(np.maximum(q / n - mean * mean, 0))
    return mean, np.where(sd > 1e-9, sd, 1.0)


_SUMS = "fold int, day long, loss double, ic double, n long, sums array<double>"


def _pass(net: Net, runs: list[_Run], seed: int, turn: int, of_days: dict[tuple[int, int], np.ndarray] | None):
    """A task's part of a round. Blocks of split days give their moments first (``of_days`` None) and their gradient once the day's are known."""
    open_ = [(r.number, r.fit_to, r.valid_to, r.mean.astype(net.kind), r.sd.astype(net.kind), r.theta.astype(net.kind)) for r in runs if not r.done]

    def forward(x: np.ndarray, mean: np.ndarray, sd: np.ndarray, theta: np.ndarray, rng: np.random.Generator | None) -> Iterator[tuple[slice, np.ndarray, tuple]]:
        """Predictions of a block, chunk by chunk, with what the way back needs."""
        step = net.chunk or max(1, len(x))
        for at in range(0, len(x), step):
            p, trail = net.forward(theta, (x[at : at + step] - mean) / sd, rng)
            yield slice(at, at + len(p)), p.astype(np.float64), trail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        parts = []
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("day", "part", "whole")]
            for i, (day, part, whole) in enumerate(zip(*keys)):
                if of_days is not None and whole:
                    continue
                y = np.frombuffer(batch.column("y")[i].as_buffer(), "<f8")
                raw = np.frombuffer(batch.column("x")[i].as_buffer(), "<f4").reshape(len(y), -1).astype(net.kind, copy=False)
                for fold, fit_to, valid_to, mean, sd, theta in open_:
                    if day >= valid_to:
                        continue
                    fits = day < fit_to
                    if of_days is not None and not fits:
                        continue  # judged by its moments
                    chunks = forward(raw, mean, sd, theta, np.random.default_rng((seed, turn, day, part)) if fits else None)
                    if whole and fits:
                        chunks = list(chunks)  # their slopes are known once all predictions are
                        m = moments(np.concatenate([p for _, p, _ in chunks]), y)
                    elif of_days is not None:
                        m = of_days[fold, day]
                    else:
                        m = sum(moments(p, y[at]) for at, p, _ in chunks)
                        if not whole:
                            parts.append((fold, day, m))
                            continue
                    own = total.setdefault(fold, [0.0, 0.0, 0, 0, np.zeros(len(theta))])
                    c = correlation(m)
                    if c is None:
                        continue
                    if not fits:
                        own[1] += c
                        own[3] += 1
                        continue
                    own[0] -= c * len(y) / m[0]
                    own[2] += len(y) / m[0]
                    for at, p, trail in chunks:
                        own[4] += net.backward(trail, loss_slope(p, y[at], m))
        out = [(fold, None, loss, ic, valid, np.append(g, n).tolist()) for fold, (loss, ic, n, valid, g) in total.items()]
        out += [(fold, day, 0.0, 0.0, 0, m.tolist()) for fold, day, m in parts]
        if out:
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["fold", "day", "loss", "ic", "n", "sums"])

    return run


def _added(frame: DataFrame, partitions: int) -> list:
    """Rows of (fold, day) with their sums; many tasks' are added up on the executors first."""
    if partitions > PARTIALS:
        one = frame.select("fold", "day", "loss", "ic", "n", F.posexplode("sums").alias("at", "v")).groupBy("fold", "day", "at").agg(F.sum("v").alias("v"), F.sum("loss").alias("loss"), F.sum("ic").alias("ic"), F.sum("n").alias("n"))
        frame = one.groupBy("fold", "day").agg(F.max("loss").alias("loss"), F.max("ic").alias("ic"), F.max("n").alias("n"), F.expr("transform(array_sort(collect_list(struct(at, v))), s -> s.v)").alias("sums"))
    out: dict[tuple, list] = {}
    for r in frame.collect():
        own = out.setdefault((r["fold"], r["day"]), [0.0, 0.0, 0, 0.0])
        own[0] += r["loss"]
        own[1] += r["ic"]
        own[2] += r["n"]
        own[3] = own[3] + np.array(r["sums"])
    return [(fold, day, *v) for (fold, day), v in out.items()]


def train(blocks: Blocks, kind: str, folds: list[int], rounds: int = 60, rate: float = 0.03, decay: float = 1e-3, patience: int = 12, valid: float = 0.2, seed: int = 7, refit: bool = False, **options) -> list[Trained | None]:
    """A model for each fold, learnt on the days below its number; None where no day is.

    The last ``valid`` of a fold's days stop the training early, by mean correlation with the label: the weights
    of the best round are kept. With ``refit`` the best number of rounds is run anew on all of the fold's days.
    """
    net = NETS[kind](blocks.features, **options, **({"steps": len(blocks.columns) // blocks.features} if kind == "recurrent" else {}))
    runs: list[_Run] = []
    for number, end in enumerate(folds):
        own = sorted(d for d in blocks.days if d < end)
        if not own:
            continue
        cut = own[min(len(own) - 1, int(len(own) * (1 - valid)))] if len(own) > 4 else end
        theta = net.start(seed)
        runs.append(_Run(number, cut, end, *_scaled(blocks.days, cut), theta, np.zeros_like(theta), np.zeros_like(theta), theta))
    _loop(blocks, net, runs, rounds, rate, decay, patience, seed)
    if refit:
        again = []
        for r in runs:
            theta, best = net.start(seed), max((h["round"] for h in r.history if h["ic"] == r.best_ic), default=rounds)
            again.append((_Run(r.number, r.valid_to, r.valid_to, *_scaled(blocks.days, r.valid_to), theta, np.zeros_like(theta), np.zeros_like(theta), theta), best))
        for n in {b for _, b in again}:
            _loop(blocks, net, [r for r, b in again if b == n], n, rate, decay, patience, seed)
        runs = [r for r, _ in again]
    done = {r.number: Trained(kind, net, blocks.columns, r.mean, r.sd, r.best, r.history[-12:]) for r in runs}
    return [done.get(i) for i in range(len(folds))]


def _loop(blocks: Blocks, net: Net, runs: list[_Run], rounds: int, rate: float, decay: float, patience: int, seed: int) -> None:
    partitions = blocks.frame.rdd.getNumPartitions()
    for turn in range(1, rounds + 1):
        if all(r.done for r in runs):
            return
        found = _added(blocks.frame.mapInArrow(_pass(net, runs, seed, turn, None), _SUMS), partitions)
        sums = [x for x in found if x[1] is None]
        split = {(fold, day): m for fold, day, *_, m in found if day is not None}
        if split:
            sums += _added(blocks.frame.where("not whole").mapInArrow(_pass(net, runs, seed, turn, split), _SUMS), partitions)
        for r in runs:
            if r.done:
                continue
            own = [x for x in sums if x[0] == r.number]
            gradient = sum((x[5] for x in own), np.zeros(len(r.theta) + 1))
            over = [c for (fold, day), m in split.items() if fold == r.number and day >= r.fit_to and (c := correlation(m)) is not None]
            n_valid = sum(x[4] for x in own) + len(over)
            ic = (sum(x[3] for x in own) + sum(over)) / n_valid if n_valid else None
            _step(r, gradient[:-1] / max(gradient[-1], 1e-9), ic, sum(x[2] for x in own) / max(gradient[-1], 1e-9), turn, rate, decay, patience)
    for r in runs:
        if r.best_ic == -np.inf:
            r.best = r.theta


def _step(r: _Run, gradient: np.ndarray, ic: float | None, loss: float, turn: int, rate: float, decay: float, patience: int) -> None:
    """Judge the weights that the round has seen, then an AdamW step with the gradient's norm clipped to one."""
    r.history.append({"round": turn - 1, "loss": round(loss, 6), "ic": ic})
    if ic is not None:
        if ic > r.best_ic + 1e-5:
            r.best_ic, r.best, r.since = ic, r.theta, 0
        else:
            r.since += 1
            r.done = r.since >= patience
    gradient = gradient / max(1.0, float(np.linalg.norm(gradient)))
    r.first = 0.9 * r.first + 0.1 * gradient
    r.second = 0.999 * r.second + 0.001 * gradient**2
    r.theta = r.theta * (1 - rate * decay) - rate * (r.first / (1 - 0.9**turn)) / (np.sqrt(r.second / (1 - 0.999**turn)) + 1e-8)


def save(spark: SparkSession, path: str, name: str, model: Trained, version: int) -> None:
    """Append a model to a store of models (one row a version)."""
    spark.createDataFrame([(name, version, model.to_json())], "name string, version int, model string").coalesce(1).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, name: str, version: int | None = None) -> Trained:
    """A stored model; the newest version without one."""
    rows = spark.read.schema("name string, version int, model string").parquet(path).where(F.col("name") == name)
    found = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    if found is None:
        raise KeyError(f"no model {name} in {path}")
    return Trained.from_json(found["model"])
