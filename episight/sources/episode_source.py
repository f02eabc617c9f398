"""Directories of episodes as a Spark data source: ``spark.read.format("episodes")``
and ``df.write.format("episodes")``, after ``register(spark)``.

Reading plans partitions from the footers of the Parquet files: each is a range
of episodes of about ``rowsPerPartition`` rows, so that an episode is never cut,
a partition's rows come in order of episode and frame, and partitions are in
order too; nothing is sorted over the whole.  Row groups that a pushed filter
on episode_index rules out aren't opened.  Image columns, as
``meta/info.json`` declares them, are left in the files.

Writing stages a file a task in a folder of the run.  The commit moves the
files of the tasks that succeeded to data/, and its last step, the manifest's
rename, makes them part of the data set.  A failed task or job changes neither.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .lerobot import canonical

MANIFEST, INFO = "meta/manifest.json", "meta/info.json"
EPISODE, FRAME = "episode_index", "frame_index"
#: Parts of column names that mean pixels where a feature doesn't say what it holds.
IMAGE_WORDS = ("image", "video", "camera", "rgb", "depth")
LAYOUTS = ("parquet", "npz", "csv", "jsonl")


def filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if re.match(r"^[a-z][a-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def read_json(files, path: str) -> dict | None:
    from pyarrow.fs import FileType

    if files.get_file_info(path).type != FileType.File:
        return None
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def image_columns(info: dict) -> set[str]:
    """The features of ``meta/info.json`` that hold pictures: their dtype is image or
    video, or they have an encoding, or their name says so."""
    out = set()
    for name, feature in info.get("features", {}).items():
        if isinstance(feature, dict):
            encoded = "encoding" in (feature.get("info") or {})
            if feature.get("dtype") in ("image", "video") or encoded or any(w in name.lower() for w in IMAGE_WORDS):
                out.add(name)
    return out


class Layout:
    """What a directory holds: its data files and, of their columns, those to be read."""

    def __init__(self, options):
        self.files, self.root = filesystem(options["path"].rstrip("/"))
        self.info = read_json(self.files, f"{self.root}/{INFO}")
        self.images = options.get("images", "false").lower() == "true"
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else None

    def data_files(self) -> list[str]:
        """Those of the manifest, if there is one; else all below data/, else those at the top."""
        from pyarrow.fs import FileSelector, FileType

        manifest = read_json(self.files, f"{self.root}/{MANIFEST}")
        if manifest is not None:
            return [f"{self.root}/{f['path']}" for f in manifest["files"]]
        for top, deep in ((f"{self.root}/data", True), (self.root, False)):
            found = self.files.get_file_info(FileSelector(top, allow_not_found=True, recursive=deep))
            names = sorted(f.path for f in found if f.type == FileType.File and f.path.endswith(".parquet"))
            if names:
                return names
        raise ValueError(f"no Parquet files below {self.root}")

    def footer(self, path: str):
        import pyarrow.parquet as pq

        with self.files.open_input_file(path) as f:
            return pq.read_metadata(f)

    def named(self, schema) -> dict[str, str]:
        """Column as read -> column in the files.  ``observation.x`` is read as obs_
        and its canonical name; if two meet in one the last wins."""
        import pyarrow as pa

        if self.info is not None:
            dropped = image_columns(self.info)
        else:
            dropped = {f.name for f in schema if pa.types.is_binary(f.type) or pa.types.is_large_binary(f.type) or pa.types.is_struct(f.type)}
        out = {}
        for name in schema.names:
            if self.images or name not in dropped:
                out["obs_" + canonical(name.removeprefix("observation.")) if name.startswith("observation.") else name] = name
        if self.columns is not None:
            if missing := [c for c in self.columns if c not in out]:
                raise ValueError(f"no column {', '.join(missing)}")
            out = {c: out[c] for c in self.columns}
        return out

    def schema(self) -> StructType:
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        own = self.footer(self.data_files()[0]).schema.to_arrow_schema()
        named = self.named(own)
        return from_arrow_schema(pa.schema([own.field(old).with_name(new).remove_metadata() for new, old in named.items()]))


@dataclass
class EpisodeRange(InputPartition):
    """Episodes from ``low`` up to ``high``, and the row groups that may hold some of them."""

    low: int
    high: int
    groups: list[tuple[str, list[int]]]


class EpisodeReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.schema = dict(options), schema
        self.rows = int(options.get("rowsPerPartition", "500000"))
        self.low, self.high = -(1 << 63), (1 << 63) - 1
        #: (column, comparison, value): kept rows meet all of them
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            kind = kinds.get(type(f))
            if isinstance(f, IsNotNull) and f.attribute in ((EPISODE,), (FRAME,)):
                self.tests.append((f.attribute[0], "known", None))
                continue
            whole = isinstance(getattr(f, "value", None), int) and not isinstance(getattr(f, "value", None), bool) or kind == "in" and all(isinstance(x, int) for x in f.value)
            if kind is None or not whole or len(f.attribute) != 1 or f.attribute[0] not in (EPISODE, FRAME):
                yield f
                continue
            self.tests.append((f.attribute[0], kind, list(f.value) if kind == "in" else f.value))
            if f.attribute[0] == EPISODE:
                least, most = (min(f.value, default=0), max(f.value, default=-1)) if kind == "in" else (f.value, f.value)
                if kind in ("==", "in", ">", ">="):
                    self.low = max(self.low, least + (kind == ">"))
                if kind in ("==", "in", "<", "<="):
                    self.high = min(self.high, most - (kind == "<"))

    def partitions(self):
        layout = Layout(self.options)
        paths = layout.data_files()
        with ThreadPoolExecutor(16) as pool:  # footers only
            footers = list(pool.map(layout.footer, paths))
        found = []  # (first episode, last episode, rows, file, row group)
        for path, footer in zip(paths, footers):
            place = footer.schema.to_arrow_schema().get_field_index(EPISODE)
            inside = re.search(rf"/{EPISODE}=(\d+)/", path)
            for g in range(footer.num_row_groups):
                group = footer.row_group(g)
                if place < 0:
                    if not inside:
                        raise ValueError(f"{path} has no column {EPISODE}")
                    least = most = int(inside[1])
                else:
                    column = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == EPISODE)
                    known = column.statistics is not None and column.statistics.has_min_max
                    least, most = (column.statistics.min, column.statistics.max) if known else (self.low, self.high)
                if least <= self.high and most >= self.low:
                    found.append((least, most, group.num_rows, path, g))
        found.sort(key=lambda x: (x[0], x[1], x[3], x[4]))
        cuts, rows = [], 0
        for least, _, n, _, _ in found:  # a new range starts with an episode that no row group before reaches from
            if rows >= self.rows and least > (cuts[-1] if cuts else found[0][0]):
                cuts.append(least)
                rows = 0
            rows += n
        first, last = (max(self.low, found[0][0]), min(self.high, max(f[1] for f in found))) if found else (0, -1)
        edges = [first, *[c for c in cuts if first < c <= last], last + 1]
        out = []
        for low, high in zip(edges, edges[1:]):
            groups: dict[str, list[int]] = {}
            for least, most, _, path, g in found:
                if least < high and most >= low:
                    groups.setdefault(path, []).append(g)
            if groups:
                out.append(EpisodeRange(low, high, list(groups.items())))
        return out or [EpisodeRange(0, 0, [])]

    def read(self, partition: EpisodeRange):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        layout, want, tables = Layout(self.options), to_arrow_schema(self.schema), []
        for path, groups in partition.groups:
            with layout.files.open_input_file(path) as f:
                file = pq.ParquetFile(f)
                # names as they are in this file; the plan's schema says which ones
                named = {new: old for new, old in layout.named(file.schema_arrow).items() if new in want.names}
                needed = list(dict.fromkeys([*named.values(), *[c for c in (EPISODE, FRAME) if c in file.schema_arrow.names]]))
                t = file.read_row_groups(groups, columns=needed)
            if EPISODE not in t.column_names:
                t = t.append_column(EPISODE, pa.array([int(re.search(rf"/{EPISODE}=(\d+)/", path)[1])] * t.num_rows, pa.int64()))
            keep = pc.and_(pc.greater_equal(t[EPISODE], partition.low), pc.less(t[EPISODE], partition.high))
            for column, kind, value in self.tests:
                ops = {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}
                if kind == "known":
                    meets = pc.is_valid(t[column])
                else:
                    meets = pc.is_in(t[column], pa.array(value, t[column].type)) if kind == "in" else ops[kind](t[column], value)
                keep = pc.and_(keep, meets)
            t = t.filter(keep)
            order = [t[c] for c in (EPISODE, FRAME) if c in t.column_names]
            back = {new: t[old] for new, old in named.items()} | ({EPISODE: t[EPISODE]} if EPISODE in want.names else {})
            columns = [back[n].cast(want.field(n).type) if n in back else pa.nulls(t.num_rows, want.field(n).type) for n in want.names]
            tables.append(pa.table([*columns, *order], names=[*want.names, *[f"_{k}" for k in range(len(order))]]))
        if not tables:
            return
        keys = [n for n in ("_0", "_1") if all(n in t.column_names for t in tables)]
        whole = pa.concat_tables([t.select([*want.names, *keys]) for t in tables]).sort_by([(k, "ascending") for k in keys])
        yield from whole.select(want.names).to_batches(max_chunksize=10_000)


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: path, rows, first and last episode."""

    files: list[tuple[str, int, int | None, int | None]]


class EpisodeWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.layout = options.get("layout", "parquet")
        if self.layout not in LAYOUTS:
            raise ValueError(f"layout is one of {', '.join(LAYOUTS)}")
        self.key = options.get("key", EPISODE)
        if self.layout == "npz" and self.key not in schema.names:
            raise ValueError(f"files by episode need the column {self.key}")
        self.schema, self.run = schema, uuid.uuid4().hex[:12]
        self.staging = f"_staging/{self.run}"

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}-{self.run}"
        files, root = filesystem(self.path)
        files.create_dir(f"{root}/{self.staging}", recursive=True)
        done: list[tuple[str, int, int | None, int | None]] = []
        began: list[str] = []
        try:
            write = self._by_episode if self.layout == "npz" else self._by_task
            for entry in write(files, root, name, iterator, began):
                done.append(entry)
        except BaseException:
            for path in began:  # what a failed task has begun goes, if the abort wasn't faster
                with suppress(FileNotFoundError):
                    files.delete_file(f"{root}/{self.staging}/{path}")
            raise
        return Written(done)

    def _span(self, batch, low, high):
        import pyarrow.compute as pc

        if self.key in batch.schema.names and batch.num_rows:
            ends = pc.min_max(batch.column(self.key)).as_py()
            if isinstance(ends["min"], int):
                return (ends["min"] if low is None else min(low, ends["min"])), (ends["max"] if high is None else max(high, ends["max"]))
        return low, high

    def _by_task(self, files, root, name, iterator, began) -> Iterator[tuple]:
        import pyarrow as pa
        import pyarrow.csv as pc
        import pyarrow.parquet as pq

        rows, low, high, out, path = 0, None, None, None, f"{name}.{self.layout}"
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                if out is None:
                    began.append(path)
                    stream = files.open_output_stream(f"{root}/{self.staging}/{path}")
                    out = pq.ParquetWriter(stream, b.schema) if self.layout == "parquet" else pc.CSVWriter(stream, b.schema) if self.layout == "csv" else stream
                if self.layout == "jsonl":
                    out.write("".join(json.dumps(r, default=str) + "\n" for r in b.to_pylist()).encode())
                else:
                    out.write_table(pa.Table.from_batches([b]))
                rows += b.num_rows
                low, high = self._span(b, low, high)
        finally:
            if out is not None:
                out.close()
                stream.close()
        if out is not None:
            yield path, rows, low, high

    def _by_episode(self, files, root, name, iterator, began) -> Iterator[tuple]:
        """A file for each run of equal episodes; no more than one episode is held."""
        import io

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list = []

        def flush():
            if not held:
                return
            t = pa.Table.from_batches(held)
            episode = t[self.key][0].as_py()
            path = f"episode_{episode:06d}-{name}.npz"
            began.append(path)
            arrays = {c: np.array(t[c].to_pylist()) for c in t.column_names if c != self.key}
            buffer = io.BytesIO()
            np.savez(buffer, **arrays)
            with files.open_output_stream(f"{root}/{self.staging}/{path}") as f:
                f.write(buffer.getvalue())
            held.clear()
            yield path, t.num_rows, episode, episode

        for b in iterator:
            if not b.num_rows:
                continue
            key = b.column(self.key)
            edges = [0, *(pc.indices_nonzero(pc.not_equal(key[1:], key[:-1])).to_numpy() + 1).tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:]):
                if held and held[-1].column(self.key)[0].as_py() != key[s].as_py():
                    yield from flush()
                held.append(b.slice(s, e - s))
        yield from flush()

    def commit(self, messages) -> None:
        files, root = filesystem(self.path)
        old = read_json(files, f"{root}/{MANIFEST}")
        entries = [{"path": f"data/{p}", "rows": n, "first": a, "last": z} for m in messages if m is not None for p, n, a, z in m.files]
        files.create_dir(f"{root}/data", recursive=True)
        for e in entries:
            files.move(f"{root}/{self.staging}/{e['path'].removeprefix('data/')}", f"{root}/{e['path']}")
        kept = [] if self.overwrite or old is None else old["files"]
        manifest = {"layout": self.layout, "columns": self.schema.names, "rows": sum(e["rows"] for e in kept + entries), "files": kept + entries}
        files.create_dir(f"{root}/meta", recursive=True)
        staged = f"{root}/{MANIFEST}.{self.run}"
        with files.open_output_stream(staged) as f:
            f.write(json.dumps(manifest).encode())
        files.move(staged, f"{root}/{MANIFEST}")
        if self.overwrite and old is not None:
            for e in old["files"]:
                files.delete_file(f"{root}/{e['path']}")
        self.abort([])

    def abort(self, messages) -> None:
        """Removes what this run has staged (a task that is killed later may leave a file there, never in data/)."""
        files, root = filesystem(self.path)
        with suppress(OSError):
            files.delete_dir(f"{root}/{self.staging}")


class EpisodeSource(DataSource):
    """Options: path; ``images`` (read them too), ``columns`` (of the result, comma-joined),
    ``rowsPerPartition``; for writing ``layout`` (parquet, csv, jsonl: a file a task; npz: a file an
    episode, of rows that lie together) and ``key`` (the episode column)."""

    @classmethod
    def name(cls) -> str:
        return "episodes"

    def schema(self) -> StructType:
        return Layout(self.options).schema()

    def reader(self, schema: StructType) -> EpisodeReader:
        return EpisodeReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> EpisodeWriter:
        return EpisodeWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known; filters reach its partitions only with this setting."""
    spark.dataSource.register(EpisodeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- formats ------------------------------------------------------------------


class EpisodeFormat:
    """What a further format of episodes implements: a name, whether a path
    holds it, and its frames (episode_index, frame_index, timestamp, action, obs_...)."""

    name = ""

    def can_read(self, files, path: str) -> bool:
        raise NotImplementedError

    def load(self, spark: SparkSession, path: str, **options) -> DataFrame:
        raise NotImplementedError


class ParquetEpisodes(EpisodeFormat):
    """A directory with ``meta/info.json``, a manifest, or Parquet files of frames."""

    name = "episodes"

    def can_read(self, files, path: str) -> bool:
        from pyarrow.fs import FileSelector, FileType

        if any(files.get_file_info(f"{path}/{x}").type == FileType.File for x in (INFO, MANIFEST)):
            return True
        if files.get_file_info(path).type != FileType.Directory:
            return False
        found = [f for top in (f"{path}/data", path) for f in files.get_file_info(FileSelector(top, allow_not_found=True, recursive=top != path))]
        return any(f.path.endswith(".parquet") for f in found)

    def load(self, spark: SparkSession, path: str, **options) -> DataFrame:
        register(spark)
        return spark.read.format("episodes").options(**options).load(path)


class EpisodeLines(EpisodeFormat):
    """JSON lines, an episode each: episode_index, timestamp and action as arrays of its steps."""

    name = "episode_lines"

    def can_read(self, files, path: str) -> bool:
        from pyarrow.fs import FileSelector, FileType

        if files.get_file_info(path).type == FileType.File:
            return path.endswith(".jsonl")
        return any(f.path.endswith(".jsonl") for f in files.get_file_info(FileSelector(path, allow_not_found=True)))

    def load(self, spark: SparkSession, path: str, **options) -> DataFrame:
        from pyspark.sql import functions as F

        rows = spark.read.schema("episode_index long, timestamp array<double>, action array<array<float>>").json(path)
        step = F.posexplode(F.arrays_zip("timestamp", "action")).alias("frame_index", "s")
        return rows.select("episode_index", step).select("episode_index", F.col("frame_index").cast("long").alias("frame_index"), "s.timestamp", "s.action")


#: Looked through in this order.
FORMATS: list[EpisodeFormat] = [ParquetEpisodes(), EpisodeLines()]


def register_format(kind: EpisodeFormat, first: bool = False) -> None:
    """Add a format; one of the same name is replaced."""
    FORMATS[:] = [f for f in FORMATS if f.name != kind.name]
    FORMATS.insert(0 if first else len(FORMATS), kind)


def load(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """The frames below ``path``, by the named format or the first that can read it."""
    files, inside = filesystem(path.rstrip("/"))
    for kind in FORMATS:
        if kind.name == format or format is None and kind.can_read(files, inside):
            return kind.load(spark, path, **options)
    raise ValueError(f"no format reads {path}" if format is None else f"no format {format}")


# --- sinks --------------------------------------------------------------------


def write_by_episode(rows: DataFrame, path: str, key: str = "ep", order: str = "step", mode: str = "overwrite") -> dict:
    """A npz file an episode (all columns but the key as arrays in order) and a manifest; returns the manifest."""
    register(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, key).sortWithinPartitions(key, order).write.format("episodes").option("layout", "npz").option("key", key).mode(mode).save(path)
    files, root = filesystem(path)
    return read_json(files, f"{root}/{MANIFEST}")


def write_label_sheet(sample: DataFrame, path: str) -> None:
    """What a reviewer gets and what is kept from them: ``path``/sheet has CSV rows
    (item_id, dataset, ep, label, notes), label and notes empty, in an order that tells nothing;
    ``path``/key has JSON lines with stratum and inclusion_prob.  ``sample`` is of ``blind_sample``."""
    from pyspark.sql import functions as F

    register(sample.sparkSession)
    blank = F.lit("")
    sheet = sample.orderBy("item_key").select(F.col("item_key").alias("item_id"), "dataset", "ep", blank.alias("label"), blank.alias("notes"))
    sheet.write.format("episodes").option("layout", "csv").option("key", "ep").mode("overwrite").save(f"{path}/sheet")
    key = sample.select(F.col("item_key").alias("item_id"), "dataset", "ep", "stratum", "inclusion_prob")
    key.write.format("episodes").option("layout", "jsonl").option("key", "ep").mode("overwrite").save(f"{path}/key")
