"""The warehouse: named lazy tables over eight sources."""

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.config import Thresholds
from panelspark.operators import load_all
from panelspark.plans.registry import BUILDERS, LARGE_SOURCES, LAYERS, SHARED
from panelspark.sources.files import work_folder, write_counted


#: Worth setting when a session is built (bench.py does); a warehouse leaves its session alone. A hot key
#: may sit under a join whose result is then grouped on the same key: splitting it is worth the
#: extra shuffle.
SETTINGS = {"spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
#: Lines a task sorts or groups at most, on average, where a step is spread by size: beyond so many
#: per shuffle partition a step takes more partitions.
LINES_A_TASK = 1_000_000
#: Rows of a kept table that a join may send to every task; Spark would judge by the size of its packed files.
BROADCAST_ROWS = 2_000_000


class Bounds(NamedTuple):
    first_day: int | None
    last_day: int | None
    first_week: int | None
    last_week: int | None
    lines: int = 0


class Warehouse:
    """Builds each table once per instance, as a lazy DataFrame, from the tables below it.

    ``sources`` maps a source name to its raw DataFrame. Tables written by
    :meth:`materialise` are read back from parquet instead of being derived again.
    """

    def __init__(
        self,
        spark: SparkSession,
        sources: Callable[[str], DataFrame],
        rules: Thresholds | None = None,
    ):
        load_all()
        self.spark = spark
        self.rules = rules or Thresholds()
        self._sources = sources
        self._raw: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}
        self._building: list[str] = []
        #: per table, the tables and ("raw", source) pairs it was built from directly
        self.inputs: dict[str, set] = {}
        #: rows of the tables that were written, counted by the write
        self.written: dict[str, int] = {}
        self._bounds: Bounds | None = None
        self._replaced: set[str] = set()
        #: sources and tables that are written when first used, and the folder they go to
        self._keeps: tuple[str, ...] = ()
        self._folder: str | None = None
        self._stored: dict[tuple[str, ...], Warehouse] = {}

    def raw(self, source: str) -> DataFrame:
        self._used(("raw", source))
        if source not in self._raw:
            rows = self._sources(source)
            if source in self._keeps:
                rows = self._written(rows, f"raw-{source}")[0]
            self._raw[source] = rows
        return self._raw[source]

    def _written(self, rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        path = f"{self._folder}/{name}"
        n = write_counted(rows, path)
        return self.spark.read.parquet(path), n

    def __getitem__(self, name: str) -> DataFrame:
        self._used(name)
        if name not in self._tables:
            self._building.append(name)
            self.inputs[name] = set()
            try:
                rows = BUILDERS[name](self)
                if name in self._keeps:
                    rows, self.written[name] = self._written(rows, name)
                self._tables[name] = rows
            finally:
                self._building.pop()
        return self._tables[name]

    def built(self, name: str) -> bool:
        return name in self._tables

    def _used(self, name) -> None:
        if self._building:
            self.inputs[self._building[-1]].add(name)

    def models_read(self, name: str) -> set:
        """The sources and tables a built table reads, internal steps looked through."""
        out, todo, seen = set(), list(self.inputs.get(name, ())), {name}
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            if isinstance(at, str) and at in LAYERS.get("internal", ()):
                todo += self.inputs.get(at, ())
            else:
                out.add(at)
        return out

    @property
    def bounds(self) -> Bounds:
        """First and last observed day and week and the number of lines: one row, read once and used as literals."""
        self._used("stg_transaction")
        if self._bounds is None:
            ends = [f(c) for c in ("day_key", "week_number") for f in (F.min, F.max)]
            self._bounds = Bounds(*self["stg_transaction"].agg(*ends, F.count(F.lit(1))).first())
        return self._bounds

    def spread(self, rows: DataFrame, *keys: str) -> DataFrame:
        """``rows`` of lines or baskets by ``keys`` in partitions whose size does not grow with the lines.

        As long as the session's shuffle partitions are enough, nothing is moved.
        """
        wanted = -(-self.bounds.lines // LINES_A_TASK)
        if wanted <= int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            return rows
        return rows.repartition(wanted, *keys)

    def beside(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` of table ``name`` as the smaller side of a join, which is not broadcast when the table was
        kept with more rows than the driver should collect."""
        return rows.hint("merge") if self.written.get(name, 0) > BROADCAST_ROWS else rows

    def fork(self, keeps: Iterable[str] = ()) -> "Warehouse":
        """A warehouse over the same sources with nothing derived yet.

        Sources and tables named in ``keeps`` are written to a folder of its own when first used and read
        back from there.
        """
        out = Warehouse(self.spark, self.raw, self.rules)
        out._keeps = tuple(keeps)
        if out._keeps:
            out._folder = work_folder(self.spark, "kept")
        return out

    def stored(self, keeps: Iterable[str] = LARGE_SOURCES + SHARED) -> "Warehouse":
        """The same warehouse with its large sources and shared steps kept in files, written on first use.

        Reports that read many tables work on it, so that they derive the lines once. There is one per
        warehouse and list; tables this one reads from files are taken over.
        """
        keeps = tuple(keeps)
        if set(keeps) <= set(self._keeps):
            return self
        if keeps not in self._stored:
            kept = self._stored[keeps] = self.fork(keeps)
            for name in self._replaced:
                kept.replace(name, self._tables[name], self.written.get(name))
                kept.inputs[name] = self.inputs.get(name, set())
        return self._stored[keeps]

    def replace(self, name: str, df: DataFrame, rows: int | None = None) -> None:
        """Use ``df`` as a table from now on; ``rows`` if its write counted them."""
        self._tables[name] = df
        self._replaced.add(name)
        self._stored.clear()
        self.written.pop(name, None)
        if rows is not None:
            self.written[name] = rows

    def materialise(self, folder: str, names: Iterable[str]) -> None:
        """Write tables to ``folder`` and let everything downstream read those files."""
        for name in names:
            path = f"{folder}/{name}"
            rows = write_counted(self[name], path, mode="overwrite")
            self.replace(name, self.spark.read.parquet(path), rows)

    def materialise_facts(self, folder: str) -> None:
        """Write what most tables are built from, so a full build derives each of it once."""
        staged = self["stg_transaction"].columns
        self.materialise(folder, ["lines"])
        self.replace("stg_transaction", self["lines"].select(*staged))
        self.materialise(
            folder,
            [
                "products",
                "fct_basket",
                "household_week_spend",
                "mart_household_weekly",
                "fct_promotion_product_store_week",
                "fct_campaign_exposure",
            ],
        )
