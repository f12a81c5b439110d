"""Relations as named SQL steps over other relations.

A step is written once in SQL. On Spark it becomes part of one Catalyst plan over DataFrames (no views are
registered); the same steps also render as a chain of common table expressions for a second engine, against
which results are held. ``Dialect`` has the few spellings in which the two differ.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Spark:
    name = "spark"

    @staticmethod
    def row(*x: str) -> str:
        return f"struct({', '.join(x)})"

    @staticmethod
    def distribute(by: str) -> str:
        """Deal a relation by a key before it is grouped by more keys: the windows over it then need no second shuffle."""
        return f" DISTRIBUTE BY {by}"

    @staticmethod
    def small(name: str) -> str:
        """A joined relation that has a row a day at most: it is sent to all tasks, and the other side stays dealt and in order."""
        return f"/*+ BROADCAST({name}) */ "

    @staticmethod
    def quantile(x: str, p: str) -> str:
        return f"percentile({x}, {p})"

    @staticmethod
    def half_even(x: str) -> str:
        return f"cast(bround({x}, 0) AS bigint)"

    @staticmethod
    def binary_round(x: str, digits: int) -> str:
        """DuckDB's rounding of doubles: of the product with a power of ten, not of the shortest decimal. Ties as 0.071875 may differ."""
        return f"round({x} * 1e{digits}, 0) / 1e{digits}"

    @staticmethod
    def collect(x: str, order: str, where: str = "TRUE") -> str:
        return f"transform(array_sort(collect_list(struct({order} AS o, {x} AS v)) FILTER (WHERE {where})), s -> s.v)"

    @staticmethod
    def days(a: str, b: str) -> str:
        return f"datediff({a}, {b})"

    @staticmethod
    def explode(x: str) -> str:
        return f"explode({x})"

    @staticmethod
    def numbers(a: str, b: str) -> str:
        """The whole numbers from a to b (at most)."""
        return f"sequence({a}, {b})"

    @staticmethod
    def matches(x: str, pattern: str) -> str:
        return f"{x} RLIKE '{pattern}'"

    @staticmethod
    def replace_all(x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}')"

    @staticmethod
    def merge_levels(x: str, tolerance: float) -> str:
        """Sorted levels, each merged into the one before it (as their mean) if it lies within the tolerance."""
        last = "element_at(s, -1)"
        return f"aggregate(array_sort(collect_list({x})), cast(array() AS array<double>), (s, b) -> CASE WHEN size(s) > 0 AND abs(b - {last}) / greatest({last}, 1e-9) <= {tolerance} THEN concat(slice(s, 1, size(s) - 1), array(({last} + b) / 2)) ELSE concat(s, array(b)) END)"

    @staticmethod
    def stack(names: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
        """One row per tuple: a wide row becomes long ones."""
        return f"stack({len(rows)}, {', '.join(', '.join(r) for r in rows)}) AS ({', '.join(names)})"

    @staticmethod
    def values(names: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
        return f"(SELECT * FROM VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)} AS t({', '.join(names)}))"

    @staticmethod
    def record(**fields: str) -> str:
        return f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())})"

    @staticmethod
    def doubles(*x: str) -> str:
        return f"array({', '.join(x)})"

    @staticmethod
    def no_doubles() -> str:
        return "cast(array() AS array<double>)"

    @staticmethod
    def each(items: str, x: str) -> str:
        """``x``, an expression over the item b, of each item."""
        return f"transform({items}, b -> {x})"

    @staticmethod
    def side_by_side(a: str, b: str, as_a: str, as_b: str) -> str:
        """One row per place of two arrays of one length."""
        return f"inline(arrays_zip({a}, {b})) AS ({as_a}, {as_b})"

    @staticmethod
    def fold(items: str, start: str, step: str) -> str:
        """Left fold; ``step`` is an expression over the state s and the item b, which are records of one type."""
        return f"aggregate({items}, {start}, (s, b) -> {step})"


class Duck(Spark):
    name = "duckdb"

    @staticmethod
    def row(*x: str) -> str:
        return f"row({', '.join(x)})"

    @staticmethod
    def distribute(by: str) -> str:
        return ""

    @staticmethod
    def small(name: str) -> str:
        return ""

    @staticmethod
    def quantile(x: str, p: str) -> str:
        return f"quantile_cont({x}, {p})"

    @staticmethod
    def half_even(x: str) -> str:
        return f"cast(round_even({x}, 0) AS bigint)"

    @staticmethod
    def binary_round(x: str, digits: int) -> str:
        return f"round({x}, {digits})"

    @staticmethod
    def collect(x: str, order: str, where: str = "TRUE") -> str:
        return f"list({x} ORDER BY {order}) FILTER (WHERE {where})"

    @staticmethod
    def days(a: str, b: str) -> str:
        return f"datediff('day', {b}, {a})"

    @staticmethod
    def explode(x: str) -> str:
        return f"unnest({x})"

    @staticmethod
    def numbers(a: str, b: str) -> str:
        return f"range({a}, {b} + 1)"

    @staticmethod
    def matches(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    @staticmethod
    def replace_all(x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    @staticmethod
    def merge_levels(x: str, tolerance: float) -> str:
        return f"list_reduce(list_transform(list_sort(list({x})), lambda x: [x]), lambda s, b: CASE WHEN len(s) > 0 AND abs(b[1] - s[-1]) / greatest(s[-1], 1e-9) <= {tolerance} THEN list_append(s[1:len(s) - 1], (s[-1] + b[1]) / 2) ELSE list_concat(s, b) END, CAST([] AS DOUBLE[]))"

    @staticmethod
    def stack(names: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
        return "unnest([" + ", ".join("{" + ", ".join(f"'{n}': {v}" for n, v in zip(names, r)) + "}" for r in rows) + "], recursive := true)"

    @staticmethod
    def values(names: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
        return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)}) AS t({', '.join(names)}))"

    @staticmethod
    def record(**fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    @staticmethod
    def doubles(*x: str) -> str:
        return f"[{', '.join(x)}]"

    @staticmethod
    def no_doubles() -> str:
        return "CAST([] AS DOUBLE[])"

    @staticmethod
    def each(items: str, x: str) -> str:
        return f"list_transform({items}, lambda b: {x})"

    @staticmethod
    def side_by_side(a: str, b: str, as_a: str, as_b: str) -> str:
        return f"unnest({a}) AS {as_a}, unnest({b}) AS {as_b}"

    @staticmethod
    def fold(items: str, start: str, step: str) -> str:
        return f"list_reduce({items}, lambda s, b: {step}, {start})"


@dataclass(frozen=True, eq=False)
class Rel:
    """A relation: ``body`` is a SELECT over ``inputs`` (by name), or None for a table that is given.

    ``run`` says how Spark computes it from its inputs' frames where one statement would pass a table through
    one task or carry wide rows, or from ``reads`` where these are others than the statement's; ``cut`` that Spark writes it before others read it, because they read it more than once;
    ``dealt`` is the key by which a kept relation of many rows is dealt to tasks, whose number grows with its rows.
    """

    name: str
    body: str | Callable[[type[Spark]], str] | None = None
    inputs: tuple[Rel, ...] = ()
    run: Callable[..., DataFrame] | None = None
    cut: bool = False
    dealt: str | None = None
    reads: tuple[Rel, ...] = ()

    def text(self, dialect: type[Spark]) -> str:
        return self.body(dialect) if callable(self.body) else self.body

    def sources(self, stated: bool = False) -> tuple[Rel, ...]:
        """What it is computed from; ``stated``: what its statement names."""
        return self.inputs if stated else self.reads or self.inputs

    def chain(self, given: set[str], stated: bool = False) -> list[Rel]:
        """Relations to define, inputs first."""
        out: dict[str, Rel] = {}

        def visit(r: Rel) -> None:
            if r.body is None or r.name in given or r.name in out:
                return
            for x in r.sources(stated):
                visit(x)
            out[r.name] = r

        visit(self)
        return list(out.values())

    def tables(self, given: set[str] = frozenset()) -> set[str]:
        """Names of the tables that the relation reads."""
        steps = self.chain(set(given))
        return {x.name for r in [*steps, self] for x in r.sources() if x.body is None or x.name in given} | ({self.name} if self.body is None else set())

    def on(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        """The relation over DataFrames. A frame replaces the table, or the derived relation, of its name."""
        if missing := self.tables(set(frames)) - set(frames):
            raise ValueError(f"{self.name} also needs {sorted(missing)}")
        for r in self.chain(set(frames)):  # inputs first
            if r.run is not None:
                frames[r.name] = r.run(*[x.on(spark, **frames) for x in r.sources()])
            elif r.cut and r is not self:
                frames[r.name] = written(r.on(spark, **frames), r.name)
        steps = self.chain(set(frames))
        need = self.tables(set(frames))
        if not steps:
            return frames[self.name]
        inputs = [f"{n} AS (SELECT * FROM {{{n}}})" for n in sorted(need)]
        text = [f"{r.name} AS ({_escaped(r.text(Spark)) if need else r.text(Spark)})" for r in steps]
        return spark.sql(f"WITH {', '.join(inputs + text)} SELECT * FROM {self.name}", **{n: frames[n] for n in need})

    def from_dir(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The relation over the tables of a folder."""
        return self.on(spark, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in self.tables()})

    def over(self, spark: SparkSession, sf_dir: str, cuts: tuple[Rel, ...] = ()) -> DataFrame:
        """The relation over the tables of a folder; of the relations in ``cuts`` the rows that are kept are used. Later cuts may build on earlier ones."""
        own = {id(r) for r in self.chain(set())} - {id(self)}  # by identity: another run's relation may have the same name
        frames: dict[str, DataFrame] = {}
        for i in reversed(range(len(cuts))):
            reached = {r.name for r in self.chain(set(frames))} | self.tables(set(frames))
            if id(cuts[i]) in own and cuts[i].name in reached:
                frames[cuts[i].name] = kept(cuts[i], spark, sf_dir, cuts[:i])
        need = self.tables(set(frames))
        return self.on(spark, **{n: frames[n] if n in frames else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in need})

    def sql(self) -> str:
        """The relation as one DuckDB statement."""
        steps = ",\n".join(f"{r.name} AS ({r.text(Duck)})" for r in self.chain(set(), stated=True))
        return f"WITH {steps}\nSELECT * FROM {self.name}" if steps else f"SELECT * FROM {self.name}"


def _escaped(text: str) -> str:
    """Spark's SQL formatter takes braces for parameters."""
    return text.replace("{", "{{").replace("}", "}}")


@dataclass
class Registry:
    """Registered relations, and functions for what one statement can't hold."""

    #: Relations that are computed once a session and folder and written; later ones may build on earlier ones.
    cuts: tuple[Rel, ...] = ()
    rels: dict[str, Rel] = field(default_factory=dict)
    functions: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)

    def rel(self, name: str, body, *inputs: Rel) -> Rel:
        """A registered query."""
        self.rels[name] = r = Rel(name, body, inputs)
        return r

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return {n: self._query(r) for n, r in self.rels.items()} | self.functions

    def _query(self, rel: Rel) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rel.over(spark, sf_dir, self.cuts)

        return run

    def function(self, f: Callable[[SparkSession, str], DataFrame]):
        self.functions[f.__name__] = f
        return f


_kept: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_rankloom_kept", None) or "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark._rankloom_kept = root
    return root.rstrip("/")


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: a table that was written anew has another stamp."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(target)))


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, reader: SparkSession | None = None, **options) -> DataFrame:
    """A table's rows, written to the shared folder and read back (by another session of the same driver, if one is given); they are removed when the driver ends. ``options``: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    atexit.register(_remove, spark, path)
    return (reader or spark).read.schema(df.schema).parquet(path)


#: Writer's option for columns whose values hardly recur: Parquet doesn't look for dictionaries.
PLAIN = {"parquet.enable.dictionary": "false"}


def kept(rel: Rel, spark: SparkSession, sf_dir: str, cuts: tuple[Rel, ...] = ()) -> DataFrame:
    """A relation over a folder, written to the shared folder for the session's further queries: they plan over its rows, not over its long plan.

    It is computed again when one of the tables it reads has changed; the rows are removed when the driver ends.
    """
    key = (spark.sparkContext.applicationId, sf_dir, rel.name, tuple((t, _stamp(spark, f"{sf_dir}/{t}.parquet")) for t in sorted(rel.tables())))
    if key not in _kept:
        path = f"{shared_dir(spark)}/{rel.name}-{uuid.uuid4().hex[:12]}"
        rows = rel.over(spark, sf_dir, cuts[: cuts.index(rel)] if rel in cuts else cuts)
        rows.write.parquet(path)
        atexit.register(_remove, spark, path)
        found = spark.read.schema(rows.schema).parquet(path)
        _kept[key] = deal(found, rel.dealt, found.count()) if rel.dealt else found  # the count is that of the files' footers
    return _kept[key]


#: Rows of a task on average, where a kept relation is dealt by a key.
TASK_ROWS = 250_000


def deal(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows dealt by a key to one task per TASK_ROWS of them, so that a task's share doesn't grow with the table. Fewer rows are left to the session's number of tasks."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
