"""Sinks: line files, logs, versioned tables, keyed upserts, views that know their sources, pages."""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators.sets import upsert
from skeinflow.runtime import ship
from skeinflow.sources.readers import exists


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON Lines; the commit protocol makes a failed write leave nothing behind."""
    df.write.mode("append" if append else "overwrite").json(path)


def _read_text(spark: SparkSession, path: str) -> str | None:
    return "".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()) if exists(spark, path) else None


def _put_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A small file, written beside its place and moved there in one step: readers see the old one, the new one, never none.

    Without ``replace`` a file that is there already makes it fail.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if replace else getattr(kind, "NONE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fresh, target, options)


def write_document(spark: SparkSession, path: str, payload) -> None:
    """One small JSON document, replaced in one step."""
    _put_text(spark, path, json.dumps(payload, ensure_ascii=False, indent=1))


class VersionedTable:
    """Parquet parts in folders of their own, and numbered versions that list the parts in force.

    Parts are written whole before a version names them, so readers see the old or the new version.
    ``append`` adds a part and rewrites nothing. Version files are never replaced: of two writers that
    begin from the same version the second one fails instead of undoing the first.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _latest(self) -> tuple[int, dict]:
        numbers = self._versions()
        if not numbers:
            return 0, {"parts": [], "before": None}
        return numbers[-1], self._version(numbers[-1])

    def _version(self, number: int) -> dict:
        return json.loads(_read_text(self.spark, f"{self.root}/versions/{number:08}.json"))

    def _publish(self, after: int, version: dict) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        _put_text(self.spark, f"{self.root}/versions/{after + 1:08}.json", json.dumps(version), replace=False)

    def _part(self, df: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def read(self) -> DataFrame:
        parts = self._latest()[1]["parts"]
        if not parts:
            raise FileNotFoundError(f"{self.root} has no version")
        return self.spark.read.option("mergeSchema", len(parts) > 1).parquet(*[f"{self.root}/{p}" for p in parts])

    def write(self, df: DataFrame) -> None:
        """A version of these rows alone."""
        now, _ = self._latest()
        self._publish(now, {"parts": [self._part(df)], "before": now or None})

    def append(self, df: DataFrame) -> None:
        """A version with these rows added."""
        now, version = self._latest()
        self._publish(now, {"parts": [*version["parts"], self._part(df)], "before": now or None})

    def undo(self) -> None:
        """The version before the one in force, as a new version."""
        now, version = self._latest()
        if not version["before"]:
            raise ValueError("there is no earlier version")
        self._publish(now, self._version(version["before"]))

    def upsert(self, changes: DataFrame, key: str, order: Sequence[str]) -> dict[str, int]:
        """Rows of ``changes`` replace those of the same key; counts of what was updated and added."""
        now = self.read()
        known = now.select(F.col(key).alias("_k")).distinct().withColumn("_known", F.lit(1))
        fresh = changes.select(F.col(key).alias("_k")).distinct().join(known, "_k", "left")
        counts = fresh.agg(F.count(F.lit(1)).alias("n"), F.count("_known").alias("updated")).collect()[0]
        self.write(upsert(now, changes, key, order))
        return {"updated": counts["updated"], "added": counts["n"] - counts["updated"]}


class Transaction:
    """Writes to several versioned tables that hold together: if one fails, those done before it are undone."""

    def __init__(self) -> None:
        self.done: list[VersionedTable] = []

    def __enter__(self) -> Transaction:
        return self

    def write(self, target: VersionedTable, df: DataFrame) -> None:
        target.write(df)
        self.done.append(target)

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.rollback()

    def rollback(self) -> None:
        """Also for undoing a finished transaction: its tables go back to the versions before it."""
        while self.done:
            self.done.pop().undo()


def view(spark: SparkSession, path: str, sources: dict[str, str], build) -> DataFrame:
    """A stored result that is built again when the fingerprint of one of its sources changes.

    ``sources`` maps names to fingerprints of content or version, never times of files.
    """
    stamp = json.dumps(sources, sort_keys=True)
    if _read_text(spark, f"{path}.sources.json") != stamp:
        build().write.mode("overwrite").parquet(path)
        _put_text(spark, f"{path}.sources.json", stamp)
    return spark.read.parquet(path)


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's content, whatever the order of its rows."""
    row = df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).collect()[0]
    return f"{row['n']}:{row['s']}:{row['x']}"


def with_counters(df: DataFrame, name: str, **counters):
    """``df`` and an Observation that has the counters once an action on it has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *[expr.alias(k) for k, expr in counters.items()]), seen


def pages(df: DataFrame, path: str, slug: str, title: str, text: str) -> DataFrame:
    """HTML pages as rows ``slug, html``, rendered by the executors and written as a table, many pages to a file.

    Returns the search index ``name, slug, path, excerpt``.
    """
    ship(df.sparkSession)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts = "".join(f"<p>{html.escape(p)}</p>" for p in (body or "").split("\n") if p.strip())
                out.append(f"<!doctype html><title>{html.escape(name or '')}</title><h1>{html.escape(name or '')}</h1>{parts}")
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], names=["slug", "html"])

    df.select(slug, title, text).mapInArrow(render, "slug string, html string").write.mode("overwrite").parquet(path)
    return df.select(F.col(title).alias("name"), F.col(slug).alias("slug"), F.concat(F.col(slug), F.lit(".html")).alias("path"), F.substring(text, 1, 160).alias("excerpt"))
