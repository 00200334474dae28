"""Output orders: one row for each (group, slice, variable), rewritten as data and then executed."""

from __future__ import annotations

import logging
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendars as C
from ..functions import paths as P
from ..functions import timestamps as T
from ..functions.globs import any_matches, matches
from ..operators import timeline
from ..operators.catalog import HistoryCollection
from ..session import ship
from ..sources import cdf, history
from ..sources.multifile import MultiFile
from ..streaming import incremental
from .chunks import values

LOG = logging.getLogger("strandline")
AUXILIARY = "auxiliary"
VERSION = "1"
#: Of one run of execute(); more batches than that share tasks.
MOST_TASKS = 20_000
STATUS = "out_path string, status string, error string"


def plan(steps: DataFrame, delta: DataFrame, head: str, output: str, formats: dict[str, str] | None = None) -> DataFrame:
    """steps: as HistoryCollection.steps. One order a (group, slice, primary variable); a group without
    primary variables has one auxiliary order. Index ranges are on the group's sorted time axis."""
    key = ["group_id", "slice_start", "slice_end"]
    axis = steps.groupBy(*key, "micros").agg(F.min("instant").alias("instant"))
    counts = axis.groupBy(*key).agg(F.count("*").alias("n"), F.min("micros").alias("_t"), F.min("instant").alias("low"), F.max("instant").alias("high"))
    before = "sum(n) OVER (PARTITION BY group_id ORDER BY _t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ranges = counts.withColumn("ts_start_index", F.expr(f"coalesce({before}, 0L)")).withColumn("ts_end_index", F.col("ts_start_index") + F.col("n"))
    first = steps.groupBy(*key).agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.array_sort(F.collect_set("path")).alias("hf_paths"), F.min_by("variables", "path").alias("variables"), F.first("calendar").alias("calendar"))
    # Bytes of an output: those of the variable in the first file, times the files.
    size = lambda v: v["itemsize"] * values(v["shape"]) * F.size("hf_paths")
    primary = F.transform(F.filter("variables", lambda v: ~v["secondary"]), lambda v: F.struct(v["name"].alias("name"), size(v).cast("long").alias("n_bytes")))
    alone = F.array(F.struct(F.lit(AUXILIARY).alias("name"), F.lit(0).cast("long").alias("n_bytes")))
    secondary = F.transform(F.filter("variables", lambda v: v["secondary"]), lambda v: v["name"])
    rows = _null_safe(first, ranges, key)
    rows = rows.join(delta, "group_id", "left")
    rows = rows.withColumns({"_kind": T.format_kind(F.coalesce(F.col("delta"), F.lit(0))), "_low": C.civil(F.col("calendar"), F.col("low")), "_high": C.civil(F.col("calendar"), F.col("high"))})
    stamp = lambda c: T.stamp(F.col(c), F.col("_kind"), formats)
    rest = F.regexp_replace(F.substring(F.col("group_id"), len(head.rstrip("/")) + 1, 1 << 20), r"\*$", "")
    return rows.select(
        *key, "hf_paths", F.concat(F.lit(output.rstrip("/")), rest).alias("ts_path_template"),
        F.explode(F.when(F.size(primary) > 0, primary).otherwise(alone)).alias("_v"), secondary.alias("secondary_vars"),
        F.concat(stamp("_low"), F.lit("-"), stamp("_high")).alias("ts_string"), "ts_start_index", "ts_end_index", "first_time", "last_time", "delta",
        F.lit(None).cast("int").alias("complevel"), F.lit(None).cast("string").alias("compression"), F.lit(False).alias("overwrite"), F.create_map().cast("map<string,string>").alias("append_attrs"),
    ).withColumns({"primary_var": F.col("_v.name"), "n_bytes": F.col("_v.n_bytes")}).drop("_v")


def _null_safe(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    other = b.withColumnsRenamed({k: f"_r_{k}" for k in key})
    cond = None
    for k in key:
        own = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = own if cond is None else cond & own
    return a.join(other, cond).drop(*[f"_r_{k}" for k in key])


def out_path() -> Column:
    return F.concat_ws(".", "ts_path_template", "primary_var", "ts_string", F.lit("nc"))


@dataclass(frozen=True)
class OrderCollection:
    frame: DataFrame
    source: HistoryCollection | None = None
    output: str = ""

    @classmethod
    def build(cls, collection: HistoryCollection, output: str | None = None, formats: dict[str, str] | None = None) -> OrderCollection:
        out = output or collection.head
        steps = collection.steps().cache()  # a row a file and step: read by the plan's several aggregates
        delta = timeline.timestep_delta(steps, ["group_id"], "micros")
        return cls(plan(steps, delta, collection.head, out, formats).cache(), collection, out)

    def _with(self, frame: DataFrame) -> OrderCollection:
        return OrderCollection(frame, self.source, self.output)

    @staticmethod
    def _hit(path_glob: str | list[str], var_glob: str | list[str]) -> Column:
        return any_matches(F.col("hf_paths"), path_glob) & matches(F.col("primary_var"), var_glob)

    def include(self, path_glob: str | list[str] = "*", var_glob: str | list[str] = "*") -> OrderCollection:
        return self._with(self.frame.where(self._hit(path_glob, var_glob)))

    def exclude(self, path_glob: str | list[str], var_glob: str | list[str] = "", strict_and: bool = False) -> OrderCollection:
        """Drop orders where a path or the variable matches; with strict_and both must."""
        path, var = any_matches(F.col("hf_paths"), path_glob), matches(F.col("primary_var"), var_glob)
        return self._with(self.frame.where(~(path & var) if strict_and else ~(path | var)))

    def add_args(self, path_glob: str = "*", var_glob: str = "*", level: int | None = None, alg: str | None = None, overwrite: bool | None = None) -> OrderCollection:
        """Set the arguments given on the orders that match."""
        hit = self._hit(path_glob, var_glob)
        given = {"complevel": level, "compression": alg, "overwrite": overwrite}
        return self._with(self.frame.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in given.items() if v is not None}))

    def apply_compression(self, level: int, alg: str, path_glob: str = "*", var_glob: str = "*") -> OrderCollection:
        return self.add_args(path_glob, var_glob, level=level, alg=alg)

    def apply_overwrite(self, path_glob: str = "*", var_glob: str = "*") -> OrderCollection:
        return self.add_args(path_glob, var_glob, overwrite=True)

    def remove_overwrite(self, path_glob: str = "*", var_glob: str = "*") -> OrderCollection:
        return self.add_args(path_glob, var_glob, overwrite=False)

    def apply_path_swap(self, string_match: str, string_swap: str, path_glob: str = "*", var_glob: str = "*") -> OrderCollection:
        swapped = F.replace(F.col("ts_path_template"), F.lit(string_match), F.lit(string_swap))
        return self._with(self.frame.withColumn("ts_path_template", F.when(self._hit(path_glob, var_glob), swapped).otherwise(F.col("ts_path_template"))))

    def append_timestep_dirs(self, var_glob: str = "*") -> OrderCollection:
        """Put a directory named after the time step before the file name; other orders pass unchanged."""
        t = F.col("ts_path_template")
        named = F.concat(P.parent(t), F.lit("/"), T.step_label(F.col("delta")), F.lit("/"), P.basename(t))
        return self._with(self.frame.withColumn("ts_path_template", F.when(matches(F.col("primary_var"), var_glob) & F.col("delta").isNotNull(), named).otherwise(t)))

    def add_attrs(self, attrs: dict[str, str]) -> OrderCollection:
        entries = F.create_map(*[F.lit(x) for kv in attrs.items() for x in kv]) if attrs else F.create_map().cast("map<string,string>")
        return self._with(self.frame.withColumn("append_attrs", entries))

    def __len__(self) -> int:
        return self.frame.count()

    def __iter__(self):
        return iter(self.frame.collect())

    def __contains__(self, path: str) -> bool:
        return not self.frame.where(out_path() == path).isEmpty()

    def __getitem__(self, path: str):
        """The order that writes `path`."""
        row = self.frame.where(out_path() == path).first()
        if row is None:
            raise KeyError(path)
        return row

    def copy(self) -> OrderCollection:
        return self._with(self.frame)

    def create_directories(self) -> list[str]:
        """Make the directories of all outputs; a directory that exists is kept."""
        made = [r["d"] for r in self.frame.select(P.parent(out_path()).alias("d")).distinct().collect()]
        for d in made:
            os.makedirs(d, exist_ok=True)
        return made

    def remaining(self, done: DataFrame) -> OrderCollection:
        """Without the orders whose output is listed in `done` (out_path) already; those that overwrite stay."""
        named = self.frame.withColumn("out_path", out_path())
        left = incremental.remaining(named.where(~F.col("overwrite")), done, "out_path").unionByName(named.where("overwrite"))
        return self._with(left.drop("out_path"))

    def batches(self, optimize: bool = True, optimize_batch_n: int = 200) -> DataFrame:
        """A row a task: (group_id, slice_start, slice_end, batch, hf_paths, orders), up to optimize_batch_n orders of a group's slice, or one."""
        orders = self.frame.withColumn("out_path", out_path())
        batch = F.floor((F.row_number().over(_by("group_id", "slice_start", "slice_end")) - 1) / (optimize_batch_n if optimize else 1)).cast("int")
        columns = ["out_path", "primary_var", "secondary_vars", "first_time", "last_time", "overwrite", "append_attrs", "complevel", "compression"]
        # A row a batch, so that a group's paths are sent once and not with each of its variables.
        dealt = orders.withColumn("batch", batch).groupBy("group_id", "slice_start", "slice_end", "batch")
        return dealt.agg(F.first("hf_paths").alias("hf_paths"), F.collect_list(F.struct(*columns)).alias("orders"))

    def execute(self, optimize: bool = True, optimize_batch_n: int = 200, raise_errors: bool = False, tasks: int = MOST_TASKS) -> DataFrame:
        """Write every order that is not complete yet: (out_path, status, error), in `tasks` tasks at most. A task opens a group's files once for
        up to optimize_batch_n variables. Outputs are written beside their place and renamed, so a task that is run
        again leaves whole files. Paths must be on a file system that all executors mount."""
        ship(self.frame.sparkSession)
        batches = self.batches(optimize, optimize_batch_n).cache()
        # A stated number of tasks: rows are few and small, and would be coalesced into one task otherwise.
        spread = batches.select("hf_paths", "orders").repartition(max(1, min(batches.count(), tasks)))
        rows = spread.mapInPandas(_write_batches(list(history.DONE_MARKERS)), STATUS).collect()  # one short row an output; writing happens here, once
        batches.unpersist()
        LOG.info("outputs: %s", dict(Counter(r["status"] for r in rows)))
        if raise_errors and (bad := next((r for r in rows if r["error"]), None)):
            raise RuntimeError(bad["error"])
        return self.frame.sparkSession.createDataFrame(rows, STATUS)


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns).orderBy("primary_var")


def is_complete(path: str, markers: list[str] | None = None) -> bool:
    """Whether an output exists, is whole and carries a completion marker; only its header is read."""
    try:
        return any(m in cdf.load(path).attrs for m in (history.DONE_MARKERS if markers is None else markers))
    except (OSError, ValueError):
        return False


def _write_batches(markers: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for paths, orders in zip(pdf["hf_paths"], pdf["orders"]):
                yield pd.DataFrame(_write_batch(list(paths), orders, markers), columns=["out_path", "status", "error"])

    return run


def _write_batch(paths: list[str], orders: list, markers: list[str]) -> list[tuple]:
    """Files are mapped once for all orders of the batch; each output is written a time step at a time."""
    out, group = [], None
    for r in orders:
        path, temporary = r["out_path"], None
        try:
            if not r["overwrite"] and is_complete(path, markers):
                out.append((path, "skipped", None))
                continue
            packed = r["compression"] not in (None, "none") and (r["complevel"] or 0) > 0
            if group is None:
                group = MultiFile.open(paths)
            primary = None if r["primary_var"] == AUXILIARY else r["primary_var"]
            ds = group.series(primary, list(r["secondary_vars"]), float(r["first_time"]), float(r["last_time"]))
            ds.attrs |= dict(r["append_attrs"] or {})
            ds.attrs[history.MARKER] = VERSION
            os.makedirs(os.path.dirname(path), exist_ok=True)
            temporary = f"{path}.{uuid.uuid4().hex}.tmp"
            with open(temporary, "wb") as f:
                cdf.write_to(f, ds)
            os.replace(temporary, path)
            out.append((path, "written: classic files hold no compressed data; written plain" if packed else "written", None))
        except (OSError, ValueError, KeyError, IndexError) as e:
            if temporary is not None and os.path.exists(temporary):
                os.remove(temporary)
            out.append((path, "failed", f"{type(e).__name__}: {e}"))
    return out


def write_parquet(facts: DataFrame, path: str) -> None:
    """The long form as a table by group, variable and slice, sorted by time within its files."""
    parts = ["group_id", "variable", "slice_start"]
    facts.repartition(*parts).sortWithinPartitions(*parts, "time").write.mode("overwrite").partitionBy(*parts).parquet(path)

