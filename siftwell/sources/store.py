"""A folder of relations: loaded sources, saved slices, and how they relate.

Tables are written to a new version directory each time and never in place, so
a reader of the old version is not disturbed. The registry is a set of small
append-only tables: the newest entry of a name counts, and an entry is added
only after its data is complete. One writer at a time is assumed.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import re
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpecError
from ..operators.lineage import dependents, reasons, staleness
from ..plans.spec import Query, build, inputs_of, rerun, saveable
from .csv import (BLANK_MARKER, REJECT_SCHEMA, Detected, Loaded, Rejects, detect_types, list_rejects,
                  load_csv)

REGISTRY = {
    "sources": ("name string, csv_path string, parquet_path string, rejects_path string, "
                "loaded_at timestamp_ntz, n_rows long, rejected long, text_cols string, loaded_by string"),
    "slices": ("name string, source string, source_csv string, parquet_path string, "
               "created_at timestamp_ntz, n_rows long, spec string, owner string, inputs array<string>"),
    "queries": ("name string, spec string, owner string, created_at timestamp_ntz"),
    # Stores restored from this one, which read its version folders.
    "holders": "name string",
}
SNAPSHOT = ("sources", "slices", "queries")
_ENTRY = ", version long, dropped boolean"


def relation_name(label: str) -> str:
    """A file name or label as a stable name: the same label, the same name."""
    stem = PurePosixPath(str(label).replace("\\", "/").rstrip("/")).stem
    words = re.findall(r"[0-9a-z]+", stem.lower())
    name = "_".join(words)
    if not name:
        raise SpecError(f"{label!r} leaves nothing to name a relation by")
    return name if name[0].isalpha() else f"s_{name}"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Impact:
    """What loading a name again would do."""

    name: str
    already_loaded: bool
    prior_path: str | None
    prior_loaded_at: dt.datetime | None
    turns_stale: DataFrame | None


def _said_by(root: str):
    return lambda held: F.concat(F.lit(f"{root}: "), held)


class _Opened(Mapping):
    """DataFrames by name over known paths, each opened on first use."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        self._spark, self._paths, self._held = spark, paths, {}

    def __getitem__(self, name):
        if name not in self._held:
            self._held[name] = self._spark.read.parquet(self._paths[name])
        return self._held[name]

    def __contains__(self, name):
        return name in self._paths

    def __iter__(self):
        return iter(self._paths)

    def __len__(self):
        return len(self._paths)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------ registry

    def _log(self, table: str) -> str:
        return f"{self.root}/registry/{table}"

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        target, fs = self._fs(path)
        return fs.exists(target)

    def registry(self, table: str) -> DataFrame:
        """The current entries of a registry table."""
        schema = REGISTRY[table] + _ENTRY
        if not self._exists(self._log(table)):
            return self.spark.createDataFrame([], schema).drop("version", "dropped")
        log = self.spark.read.schema(schema).parquet(self._log(table))
        newest = log.groupBy("name").agg(F.max_by(F.struct(*log.columns), "version").alias("e"))
        return newest.select("e.*").filter(~F.col("dropped")).drop("version", "dropped")

    def _record(self, table: str, dropped: bool = False, **entry) -> None:
        schema = REGISTRY[table] + _ENTRY
        names = [part.split()[0] for part in re.split(r",\s*(?![^<]*>)", schema)]
        row = {**dict.fromkeys(names), **entry, "version": time.time_ns(), "dropped": dropped}
        one = self.spark.createDataFrame([tuple(row[n] for n in names)], schema)
        one.coalesce(1).write.mode("append").parquet(self._log(table))

    def _entry(self, table: str, name: str):
        return self.registry(table).filter(F.col("name") == name).first()

    def _new_dir(self, kind: str, name: str) -> str:
        return f"{self.root}/{kind}/{name}/{_now():%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"

    # ------------------------------------------------------------- sources

    def detect(self, path: str, delim: str = ",", marker: str = BLANK_MARKER,
               name: str | None = None) -> tuple[Detected, Impact]:
        return detect_types(self.spark, path, delim, marker), self.reload_impact(relation_name(name or path))

    def load(self, path: str, name: str | None = None, delim: str = ",", marker: str = BLANK_MARKER,
             force_text=(), owner: str | None = None) -> Loaded:
        """Load a CSV as a source; loading a name again replaces it."""
        name = relation_name(name or path)
        if self._entry("slices", name):
            raise SpecError(f"{name} is a saved slice, not a source")
        loaded = load_csv(self.spark, path, self._new_dir("sources", name), self._new_dir("rejects", name),
                          delim, marker, force_text)
        self._record("sources", name=name, csv_path=path, parquet_path=loaded.path,
                     rejects_path=loaded.rejects_path, loaded_at=_now(), n_rows=loaded.rows,
                     rejected=loaded.rejected, text_cols=", ".join(force_text), loaded_by=owner)
        self.table(name)
        return loaded

    def reload_impact(self, name: str) -> Impact:
        """Which slices would turn stale, and what the name holds now."""
        prior = self._entry("sources", name)
        if not prior:
            return Impact(name, False, None, None, None)
        return Impact(name, True, prior["csv_path"], prior["loaded_at"], self.dependents(name))

    def rejects(self, name: str, limit: int = 1_000) -> Rejects:
        return list_rejects(self._rejects(name), limit)

    def count_rejects(self, name: str) -> int:
        entry = self._entry("sources", name)
        return entry["rejected"] if entry else 0

    def _rejects(self, name: str) -> DataFrame:
        entry = self._entry("sources", name)
        if not entry:
            raise SpecError(f"unknown source: {name!r}")
        return self.spark.read.schema(REJECT_SCHEMA).parquet(entry["rejects_path"])

    # ----------------------------------------------------------- relations

    def paths(self) -> dict[str, str]:
        """Where each relation's current version lies."""
        slices = self.registry("slices").select("name", "parquet_path")
        both = slices.unionByName(self.registry("sources").select("name", "parquet_path"))
        return {r["name"]: r["parquet_path"] for r in both.collect()}

    def table(self, name: str) -> DataFrame:
        """A relation's rows, also registered as a view of that name."""
        found = self.paths().get(name)
        if not found:
            raise SpecError(f"unknown relation: {name!r}")
        df = self.spark.read.parquet(found)
        df.createOrReplaceTempView(name)
        return df

    def tables(self, paths: dict[str, str] | None = None) -> Mapping[str, DataFrame]:
        """Every relation by name; one is opened when it is first asked for."""
        return _Opened(self.spark, self.paths() if paths is None else paths)

    def drop(self, name: str) -> list[str]:
        """Forget a relation and name its direct readers. Its files stay."""
        kind = next((t for t in ("sources", "slices") if self._entry(t, name)), None)
        if not kind:
            raise SpecError(f"unknown relation: {name!r}")
        readers = [r["child"] for r in self.edges().filter(F.col("parent") == name).collect()]
        self._record(kind, dropped=True, name=name)
        self.spark.catalog.dropTempView(name)
        return sorted(readers)

    # --------------------------------------------------------------- query

    def query(self, spec: dict, confirm: bool = False) -> Query:
        paths = self.paths()
        return build(self.spark, spec, self.tables(paths), paths, confirm)

    def save(self, query: Query, name: str, owner: str | None = None) -> int:
        """Write a query's rows as a slice, with everything it was cut from."""
        name = relation_name(name)
        if self._entry("sources", name):
            raise SpecError(f"{name} is a loaded source, not a slice")
        target = self._new_dir("slices", name)
        query.rows.write.option("compression", "zstd").parquet(target)
        rows = self.spark.read.parquet(target).count()
        origin = self._entry("sources", query.base) if query.base else None
        self._record("slices", name=name, source=query.base,
                     source_csv=origin["csv_path"] if origin else query.base, parquet_path=target,
                     created_at=_now(), n_rows=rows, spec=json.dumps(query.spec), owner=owner,
                     inputs=list(query.inputs))
        self.table(name)
        return rows

    def save_query(self, name: str, spec: dict, owner: str | None = None) -> None:
        """Keep the spec of a query that today's relations can answer."""
        title = re.sub(r"\s+", " ", name or "").strip()
        if not title:
            raise SpecError("there is no name to keep the query under")
        answered = self.query(saveable(spec), confirm=True)
        self._record("queries", name=title, owner=owner, created_at=_now(),
                     spec=json.dumps(answered.spec, sort_keys=True))

    def run_saved(self, name: str, confirm: bool = False) -> Query:
        entry = self._entry("queries", name)
        if not entry:
            raise SpecError(f"no saved query is called {name!r}")
        paths = self.paths()
        return rerun(self.spark, name, json.loads(entry["spec"]), self.tables(paths), paths, confirm)

    def saved_queries(self) -> list[dict]:
        rows = self.registry("queries").orderBy(F.lower("name")).collect()
        return [{**r.asDict(), "spec": json.loads(r["spec"]), "inputs": inputs_of(json.loads(r["spec"]))}
                for r in rows]

    # ------------------------------------------------------------- lineage

    def edges(self) -> DataFrame:
        """(child, parent) for every slice; one saved without recorded inputs
        falls back to its base, unless it came from hand-written SQL."""
        slices = self.registry("slices")
        by_hand = F.get_json_object("spec", "$.mode").eqNullSafe("sql")
        recorded = F.when(F.size("inputs") > 0, F.col("inputs")).when(
            ~by_hand & F.col("source").isNotNull(), F.array("source")).otherwise(F.array().cast("array<string>"))
        return slices.select(F.col("name").alias("child"), F.explode(recorded).alias("parent"))

    def dependents(self, name: str) -> DataFrame:
        return dependents(self.edges(), name)

    def staleness(self) -> DataFrame:
        return staleness(self._cuts(), self._loads(), self.edges())

    def _cuts(self) -> DataFrame:
        return self.registry("slices").select("name", F.col("created_at").alias("cut_at"))

    def _loads(self) -> DataFrame:
        return self.registry("sources").select("name", "loaded_at")

    def relations(self) -> DataFrame:
        """Every source and slice with its lineage and staleness; ``note``
        joins all its ``reasons``."""
        states = self.staleness()
        why = (self.reasons(states).groupBy("name")
               .agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("note")))
        text = F.lit(None).cast("string")
        sources = self.registry("sources").select(
            "name", F.lit("source").alias("kind"), F.col("n_rows").alias("rows"),
            F.col("loaded_at").alias("at"), F.col("loaded_by").alias("owner"), "csv_path", "parquet_path",
            "text_cols", F.col("name").alias("base"), F.array().cast("array<string>").alias("inputs"),
            F.lit("fresh").alias("staleness"), text.alias("note"))
        edges = self.edges().groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("all_inputs"))
        slices = (self.registry("slices").join(states, "name").join(why, "name", "left")
                  .join(edges, F.col("name") == F.col("child"), "left").select(
            "name", F.lit("slice").alias("kind"), F.col("n_rows").alias("rows"),
            F.col("created_at").alias("at"), "owner", F.col("source_csv").alias("csv_path"), "parquet_path",
            text.alias("text_cols"), F.coalesce("source", "name").alias("base"),
            F.coalesce("all_inputs", F.array().cast("array<string>")).alias("inputs"),
            F.col("state").alias("staleness"), "note"))
        return sources.unionByName(slices).orderBy("kind", "name")

    def reasons(self, states: DataFrame | None = None) -> DataFrame:
        return reasons(self._cuts(), self._loads(), self.edges(), states or self.staleness())

    # ----------------------------------------------------------- snapshots

    def snapshot(self) -> str:
        """Keep the registry as it is. Version folders are never written again,
        so a snapshot names them and copies none; ``vacuum`` spares them."""
        stamp = f"{_now():%Y%m%d-%H%M%S-%f}"
        for table in SNAPSHOT:    # one without its last table is not complete
            self.registry(table).coalesce(1).write.parquet(f"{self.root}/snapshots/{stamp}/registry/{table}")
        return stamp

    def _kept(self, stamp: str, table: str) -> DataFrame:
        return self.spark.read.schema(REGISTRY[table]).parquet(f"{self.root}/snapshots/{stamp}/registry/{table}")

    def drop_snapshot(self, stamp: str) -> None:
        """Forget a snapshot; what only it held goes with the next ``vacuum``."""
        self._snapshot(stamp)
        target, fs = self._fs(f"{self.root}/snapshots/{stamp}")
        fs.delete(target, True)

    def _snapshot(self, stamp: str) -> str:
        if not stamp or "/" in stamp or not self._exists(f"{self.root}/snapshots/{stamp}/registry/{SNAPSHOT[-1]}/_SUCCESS"):
            raise SpecError(f"no complete snapshot is called {stamp!r}")
        return stamp

    def references(self) -> DataFrame:
        """(path, held_by, times): each version folder that is still needed,
        and by what: this store, a snapshot of it, or a store restored from one."""
        held = [(self.root, self.registry("slices"), self.registry("sources"))]
        held += [(f"snapshot {s['name']}", self._kept(s["name"], "slices"), self._kept(s["name"], "sources"))
                 for s in self.snapshots()]
        parts = [part.select(F.lit(by).alias("by"), F.col(path).alias("path"))
                 for by, slices, sources in held
                 for part, path in ((slices, "parquet_path"), (sources, "parquet_path"), (sources, "rejects_path"))]
        for other in self.registry("holders").collect():
            parts.append(Store(self.spark, other["name"]).references()
                         .select(F.explode(F.transform("held_by", _said_by(other["name"]))).alias("by"), "path"))
        every = functools.reduce(DataFrame.unionByName, parts).filter(F.col("path").isNotNull())
        return every.groupBy("path").agg(F.array_sort(F.collect_set("by")).alias("held_by")).withColumn(
            "times", F.size("held_by"))

    def vacuum(self, older_than: dt.timedelta = dt.timedelta(days=7)) -> list[str]:
        """Remove version folders that nothing refers to and name them. Younger
        ones stay: a save may be under way, or a reader still at work."""
        needed = {r["path"] for r in self.references().select("path").collect()}
        limit, gone = f"{_now() - older_than:%Y%m%dT%H%M%S}", []
        for kind in ("sources", "slices", "rejects"):
            for name in self._inside(f"{self.root}/{kind}"):
                for version in self._inside(f"{self.root}/{kind}/{name}"):
                    path = f"{self.root}/{kind}/{name}/{version}"
                    if path not in needed and version.split("-")[0] <= limit:
                        target, fs = self._fs(path)
                        fs.delete(target, True)
                        gone.append(path)
        return sorted(gone)

    def _inside(self, path: str) -> list[str]:
        folder, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()] if fs.exists(folder) else []

    def snapshots(self) -> list[dict]:
        """Complete snapshots, newest first: name, files, bytes, created."""
        folder, fs = self._fs(f"{self.root}/snapshots")
        if not fs.exists(folder):
            return []
        out = []
        for status in fs.listStatus(folder):
            path = status.getPath()
            if not self._exists(f"{path}/registry/{SNAPSHOT[-1]}/_SUCCESS"):
                continue
            held = fs.getContentSummary(path)
            out.append({"name": path.getName(), "files": held.getFileCount(), "bytes": held.getLength(),
                        "created": dt.datetime.fromtimestamp(status.getModificationTime() / 1000, dt.timezone.utc)})
        return sorted(out, key=lambda s: s["name"], reverse=True)

    def restore(self, stamp: str, root: str) -> "Store":
        """A new store at ``root`` holding what the snapshot held. It reads this
        store's version folders, which are kept for as long as it needs them."""
        self._snapshot(stamp)
        fresh = Store(self.spark, root)
        if any(fresh._exists(fresh._log(table)) for table in REGISTRY):
            raise SpecError(f"{root} already holds a store")
        self._record("holders", name=fresh.root)
        for table in SNAPSHOT:
            for entry in self._kept(stamp, table).collect():
                fresh._record(table, **entry.asDict())
        return fresh
