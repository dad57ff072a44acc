"""Named products: operators with declared inputs, options and outputs, resolved lazily and kept under a lineage key."""

from __future__ import annotations

import hashlib
import json
import re
import time
import warnings
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import product as combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import store as stored
from .epoch import Epoch


@dataclass(frozen=True)
class Option:
    """A setting: its default, kind (cast on reading), choices, bounds, unit factor, older names, and whether it is part of the lineage."""

    default: object = None
    kind: type | None = None
    choices: tuple = ()
    least: float | None = None
    most: float | None = None
    track: bool = True
    factor: float | None = None
    aliases: tuple[str, ...] = ()
    deprecated: str = ""
    help: str = ""

    def check(self, name: str, value):
        if self.kind and value is not None:
            value = self.kind(value)
        if self.choices and value not in self.choices:
            raise ValueError(f"{name}: {value!r} is none of {self.choices}")
        if self.least is not None and value < self.least:
            raise ValueError(f"{name}: {value!r} is below {self.least}")
        if self.most is not None and value > self.most:
            raise ValueError(f"{name}: {value!r} is above {self.most}")
        return value * self.factor if self.factor is not None and value is not None else value


@dataclass(frozen=True)
class Operator:
    """build(engine, run, inputs, options) gives a lazy DataFrame.  needs: names, or a function (engine, run) -> names.

    schema (DDL), if given, is what the result must hold: every field of that name and type.
    """

    provides: str
    build: Callable
    needs: tuple[str, ...] | Callable = ()
    version: str = "1"
    options: dict[str, Option] = field(default_factory=dict)
    schema: str = ""
    description: str = ""

    def problems(self) -> list[str]:
        out = [] if re.fullmatch(r"\w+", self.provides or "") else [f"{self.provides!r} is no name"]
        if not callable(self.build):
            out.append(f"{self.provides}: build is not callable")
        if not callable(self.needs) and self.provides in self.needs:
            out.append(f"{self.provides} needs itself")
        for n, o in self.options.items():
            try:
                if o.default is not None:
                    o.check(n, o.default)
            except (TypeError, ValueError) as e:
                out.append(f"{self.provides}: {e}")
        return out


def wave_source(use_filtered: str = "use_filtered", plain: str = "records", filtered: str = "filtered_waveforms") -> Callable:
    """needs of an operator over waves: the filtered ones if its option says so (call with the product's name)."""

    def of(product: str) -> Callable:
        return lambda engine, run: (filtered if engine.options(product, run).get(use_filtered) else plain,)

    return of


class Engine:
    def __init__(self, spark: SparkSession, store: str | None = None, run_configs: Mapping[str, Mapping] | None = None):
        self.spark, self.store = spark, store
        self.operators: dict[str, Operator] = {}
        self.config: dict[str, dict] = {}
        self.inferred: dict[str, object] = {}
        self.run_configs = dict(run_configs or {})
        self.epochs: dict[str, Epoch] = {}

    # ---- operators and options

    def register(self, *operators: Operator) -> None:
        for op in operators:
            if problems := op.problems():
                raise ValueError("; ".join(problems))
            self.operators[op.provides] = op

    def set_config(self, values: dict, product: str = "") -> None:
        self.config.setdefault(product, {}).update(values)

    def get_config(self, product: str, name: str):
        return self.options(product)[name]

    def run_config(self, run: str) -> dict:
        """The run's own settings; a JSON file run_config/<run>.json under the store if none were given."""
        if run not in self.run_configs and self.store:
            text = stored.read_text(self.spark, f"{self.store}/run_config/{run}.json")
            self.run_configs[run] = json.loads(text) if text else {}
        return dict(self.run_configs.get(run, {}))

    def hardware_channels(self, run: str) -> list[tuple[int, int]]:
        from ..operators.detector import channel_ref

        return sorted(channel_ref(c) for c in self.run_config(run).get("channels", {}))

    def options(self, product: str, run: str = "") -> dict:
        """The product's own setting, else the run's, else the general one, else what was inferred from the source, else the default."""
        own, general = self.config.get(product, {}), self.config.get("", {})
        layers = [own, self.run_config(run).get("products", {}).get(product, {}) if run else {}, general, self.inferred]
        out = {}
        for name, o in self.operators[product].options.items():
            names = (name, *o.aliases)
            layer, found = next(((x, n) for x in layers for n in names if n in x), (None, name))
            if found != name or o.deprecated and layer is not None:
                warnings.warn(f"{product}.{found}: {o.deprecated or 'use ' + name}", DeprecationWarning, stacklevel=2)
            out[name] = o.check(name, o.default if layer is None else layer[found])
        return out

    # ---- dependencies and lineage

    def needs(self, product: str, run: str = "") -> tuple[str, ...]:
        if product not in self.operators:
            raise KeyError(f"no operator provides {product}")
        n = self.operators[product].needs
        return tuple(n(self, run)) if callable(n) else tuple(n)

    def order(self, product: str, run: str = "") -> list[str]:
        """What is built for a product, inputs first."""
        out: list[str] = []

        def visit(p: str, above: tuple[str, ...]) -> None:
            if p in above:
                raise ValueError("operators need each other: " + " -> ".join([*above, p]))
            for n in self.needs(p, run):
                visit(n, (*above, p))
            if p not in out:
                out.append(p)

        visit(product, ())
        return out

    def lineage(self, product: str, run: str = "") -> dict:
        self.order(product, run)  # refuses circles
        op, values = self.operators[product], self.options(product, run)
        tracked = {k: v for k, v in values.items() if op.options[k].track}
        return {"product": product, "version": op.version, "options": tracked, "needs": [self.lineage(n, run) for n in self.needs(product, run)]}

    def key(self, run: str, product: str) -> str:
        text = json.dumps(self.lineage(product, run), sort_keys=True, default=str)
        return f"{run}-{product}-" + hashlib.sha1(text.encode()).hexdigest()[:8]

    def mermaid(self, product: str, run: str = "") -> str:
        """The product's graph as Mermaid text."""
        names = self.order(product, run)
        nodes = [f"  {n}[{n} v{self.operators[n].version}]" for n in names]
        return "\n".join(["graph LR", *nodes, *[f"  {m} --> {n}" for n in names for m in self.needs(n, run)]])

    def plan(self, run: str, product: str) -> DataFrame:
        """What table() would do: (step, product, key, stored, action); inputs of a stored product are not read."""
        names = self.order(product, run)
        kept = {n: bool(self.store) and self.exists(self.path(run, n)) for n in names}
        used, todo = set(), [product]
        while todo:
            n = todo.pop()
            if n not in used:
                used.add(n)
                todo += [] if kept[n] else self.needs(n, run)
        rows = [(i, n, self.key(run, n), kept[n], "skip" if n not in used else "read" if kept[n] else "build") for i, n in enumerate(names)]
        return self.spark.createDataFrame(rows, "step int, product string, key string, stored boolean, action string")

    # ---- products

    def path(self, run: str, product: str) -> str:
        return f"{self.store}/{self.key(run, product)}"

    def table(self, run: str, product: str, keep: bool = False) -> DataFrame:
        """The product; with `keep` it is read from, or first written to, the store under its lineage key."""
        path = self.path(run, product) if self.store else None
        if path and self.exists(path):
            return self.spark.read.parquet(path)
        op = self.operators[product]
        inputs = {n: self.table(run, n) for n in self.needs(product, run)}
        df = self.checked(op, op.build(self, run, inputs, self.options(product, run)))
        if keep and path:
            return stored.save(df, path, {"run_id": run, "product": product, "version": op.version, "lineage": self.lineage(product, run)})
        return df

    def checked(self, op: Operator, df: DataFrame) -> DataFrame:
        if op.schema:
            has = {f.name: f.dataType for f in df.schema}
            wrong = [f.name for f in StructType.fromDDL(op.schema) if has.get(f.name) != f.dataType]
            if wrong:
                raise TypeError(f"{op.provides}: missing or of another type: {', '.join(wrong)}")
        return df

    def exists(self, path: str) -> bool:
        fs, p = stored.files(self.spark, f"{path}/{stored.META}")
        return fs.exists(p)

    def clear(self, run: str, product: str, downstream: bool = False) -> list[str]:
        """Drops a stored product, and all that need it if asked; gives the names dropped."""
        names = [n for n in self.operators if n == product or downstream and product in self.order(n, run)]
        dropped = []
        for n in names:
            fs, p = stored.files(self.spark, self.path(run, n))
            if fs.exists(p) and fs.delete(p, True):
                dropped.append(n)
        return dropped

    # ---- runs

    def runs(self, runs: Iterable[str], product: str) -> DataFrame:
        """A product of many runs as one DataFrame with run_id."""
        return reduce(DataFrame.unionByName, [self.table(r, product).withColumn("run_id", F.lit(r)) for r in runs])

    def batch(self, runs: Iterable[str], work: Callable, retries: int = 0, on_error: str = "continue", cancelled: Callable[[], bool] = lambda: False) -> dict[str, dict]:
        """work(engine, run) for each run: {run: {"result" or "error", "tries", "seconds"}}; on_error: continue, stop or raise."""
        if on_error not in ("continue", "stop", "raise"):
            raise ValueError(f"no error rule {on_error}")
        out: dict[str, dict] = {}
        for run in runs:
            if cancelled():
                break
            began = time.time()
            for attempt in range(retries + 1):
                try:
                    out[run] = {"result": work(self, run), "tries": attempt + 1}
                    break
                except Exception as e:  # the caller's own work
                    out[run] = {"error": e, "tries": attempt + 1}
            out[run]["seconds"] = time.time() - began
            if "error" in out[run]:
                if on_error == "raise":
                    raise out[run]["error"]
                if on_error == "stop":
                    break
        return out

    def grid(self, run: str, product: str, choices: Mapping[str, list]) -> DataFrame:
        """The product for every combination of its options' values, with config_id and the values as JSON."""
        before, parts = dict(self.config.get(product, {})), []
        try:
            for i, values in enumerate(combinations(*choices.values())):
                chosen = dict(zip(choices, values))
                self.config[product] = before | chosen
                part = self.table(run, product)
                parts.append(part.withColumns({"config_id": F.lit(i), "config": F.lit(json.dumps(chosen, sort_keys=True))}))
        finally:
            self.config[product] = before
        return reduce(DataFrame.unionByName, parts)

    # ---- time

    def set_epoch(self, run: str, epoch: Epoch) -> None:
        self.epochs[run] = epoch

    def time_range(self, run: str, product: str, start: int | None = None, end: int | None = None, column: str | None = None, domain: str = "raw_ps", channel: tuple[int, int] | None = None) -> DataFrame:
        """Rows of a product with start <= time < end, on its stored time column.

        domain raw_ps: `timestamp` or `time_start`, in ps; system_ns: `time`, in ns.
        """
        df = self.table(run, product)
        if domain not in ("raw_ps", "system_ns"):
            raise ValueError(f"no time domain {domain}")
        names = [column] if column else ["timestamp", "time_start", "t"] if domain == "raw_ps" else ["time"]
        name = next((n for n in names if n in df.columns), None)
        if name is None:
            raise ValueError(f"{product} has no time in {domain}")
        for test in ([] if start is None else [F.col(name) >= start]) + ([] if end is None else [F.col(name) < end]):
            df = df.filter(test)
        return df if channel is None else df.filter((F.col("board") == channel[0]) & (F.col("channel") == channel[1]))

    def time_range_absolute(self, run: str, product: str, start=None, end=None, **how) -> DataFrame:
        """As time_range, with dates, by the run's epoch (see epoch.find)."""
        if run not in self.epochs:
            raise ValueError(f"run {run} has no epoch")
        at = lambda d: None if d is None else self.epochs[run].relative(d)
        return self.time_range(run, product, at(start), at(end), **how)

    # ---- what there is

    def products(self) -> DataFrame:
        rows = [(o.provides, o.version, [] if callable(o.needs) else list(o.needs), o.schema, o.description) for o in self.operators.values()]
        return self.spark.createDataFrame(rows, "product string, version string, needs array<string>, schema string, description string")

    def settings(self) -> DataFrame:
        rows = [(o.provides, n, str(v.default), v.kind.__name__ if v.kind else "", v.track, v.help) for o in self.operators.values() for n, v in o.options.items()]
        return self.spark.createDataFrame(rows, "product string, option string, default string, kind string, tracked boolean, help string")

    def search(self, pattern: str) -> DataFrame:
        """Products and fields whose name matches a regular expression; fields of operators that declare a schema."""
        rows = [(o.provides, f.name) for o in self.operators.values() for f in (StructType.fromDDL(o.schema) if o.schema else [])]
        rows = [r for r in rows if re.search(pattern, r[0]) or re.search(pattern, r[1])]
        rows += [(o.provides, None) for o in self.operators.values() if not o.schema and re.search(pattern, o.provides)]
        return self.spark.createDataFrame(rows, "product string, field string")

    def cache_analysis(self, versions: dict[str, str] | None = None) -> dict[str, DataFrame]:
        """The store's entries, their statistics and problems."""
        e = stored.entries(self.spark, self.store)
        now = versions or {o.provides: o.version for o in self.operators.values()}
        return {"entries": e, "statistics": stored.statistics(e), "by_run": stored.statistics(e, ["run_id"]), "by_product": stored.statistics(e, ["product"]), "problems": stored.diagnose(e, now)}
