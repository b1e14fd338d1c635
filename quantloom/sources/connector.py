"""A data source `bars`: one partition for each symbol, filters on symbol and date pushed into the listing and the files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .bars import BAR_SCHEMA, OHLCV

FORMATS = (".csv", ".parquet")


@dataclass
class Place(InputPartition):
    """The files of a symbol."""

    symbol: str
    files: tuple[str, ...]


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, str, int]]:
    """(symbol, file, time of change) of {SYMBOL}.csv, {SYMBOL}.parquet and the files in symbol={SYMBOL} folders."""
    from pyarrow import fs

    system, root = _system(path)
    out = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
        parts = info.path.removeprefix(root).strip("/").split("/")
        if not info.is_file or not info.base_name.endswith(FORMATS) or any(p.startswith(("_", ".")) for p in parts):
            continue
        folder = next((p[len("symbol=") :] for p in parts[:-1] if p.startswith("symbol=")), None)
        if folder is not None or len(parts) == 1:
            name = folder if folder is not None else info.base_name.rsplit(".", 1)[0]
            out.append((unquote(name).upper(), info.path, info.mtime_ns or 0))
    return sorted(out)


def _table(system, file: str, first: dt.date | None, last: dt.date | None) -> pa.Table:
    """date and prices of a file between two days; the names of its columns count without case."""
    import pyarrow.compute as pc
    from pyarrow import csv, parquet

    if file.endswith(".csv"):
        with system.open_input_stream(file) as f:
            raw = csv.read_csv(f, convert_options=csv.ConvertOptions(strings_can_be_null=True))
    else:
        with system.open_input_file(file) as f:
            raw = parquet.ParquetFile(f).read()
    names = {c.lower(): c for c in raw.column_names}
    day = pc.cast(raw.column(names["date"]), pa.date32())
    columns = [day] + [pc.cast(raw.column(names[c]), pa.float64()) if c in names else pa.nulls(len(raw), pa.float64()) for c in OHLCV]
    table = pa.table(columns, names=["date", *OHLCV])
    mask = None
    if first:
        mask = pc.greater_equal(day, pa.scalar(first, pa.date32()))
    if last:
        until = pc.less_equal(day, pa.scalar(last, pa.date32()))
        mask = until if mask is None else pc.and_(mask, until)
    return table if mask is None else table.filter(mask)


def _batches(path: str, place: Place, first: dt.date | None, last: dt.date | None) -> Iterator[pa.RecordBatch]:
    system, _ = _system(path)
    schema = pa.schema([("symbol", pa.string()), ("date", pa.date32()), *[(c, pa.float64()) for c in OHLCV]])
    for file in place.files:
        table = _table(system, file, first, last)
        whole = pa.table([pa.array([place.symbol] * len(table), pa.string()), *table.columns], schema=schema)
        yield from whole.to_batches()


class BarsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.symbols, self.first, self.last = path, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Symbols choose among the listed files, days among their rows; Spark evaluates all other filters."""
        day = dt.timedelta(days=1)
        for f in filters:
            match f:
                case EqualTo(("symbol",), value) if isinstance(value, str):
                    self._only({value})
                case In(("symbol",), values) if all(isinstance(v, str) for v in values):
                    self._only(set(values))
                case EqualTo(("date",), value) if value is not None:
                    self._within(value, value)
                case GreaterThanOrEqual(("date",), value):
                    self._within(value, None)
                case GreaterThan(("date",), value):
                    self._within(value + day, None)
                case LessThanOrEqual(("date",), value):
                    self._within(None, value)
                case LessThan(("date",), value):
                    self._within(None, value - day)
                case _:
                    yield f

    def _only(self, symbols: set[str]) -> None:
        self.symbols = symbols if self.symbols is None else self.symbols & symbols

    def _within(self, first: dt.date | None, last: dt.date | None) -> None:
        self.first = max(filter(None, (self.first, first)), default=None)
        self.last = min(filter(None, (self.last, last)), default=None)

    def partitions(self) -> list[Place]:
        files: dict[str, list[str]] = {}
        for symbol, file, _ in listed(self.path):
            if self.symbols is None or symbol in self.symbols:
                files.setdefault(symbol, []).append(file)
        return [Place(s, tuple(f)) for s, f in files.items()]

    def read(self, partition: Place | None) -> Iterator[pa.RecordBatch]:
        """Without a file to read Spark asks once for none."""
        return _batches(self.path, partition, self.first, self.last) if partition is not None else iter(())


class BarsStream(DataSourceStreamReader):
    """Files by the time they were written; an offset is the last one's time and all names of that time."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"time": -1, "names": []}

    def latestOffset(self) -> dict:
        found = listed(self.path)
        last = max((t for *_, t in found), default=-1)
        return {"time": last, "names": sorted(f for _, f, t in found if t == last)}

    def partitions(self, start: dict, end: dict) -> list[Place]:
        after = lambda f, t, offset: t > offset["time"] or t == offset["time"] and f not in offset["names"]
        return [Place(s, (f,)) for s, f, t in listed(self.path) if after(f, t, start) and not after(f, t, end)]

    def read(self, partition: Place) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition, None, None)

    def commit(self, end: dict) -> None:
        pass


class Bars(DataSource):
    """spark.read.format("bars").load(path): symbol, date and prices of CSV and Parquet files, read where a task runs, so
    that the path must be one that executors reach: file:, hdfs:, s3: or a folder they share."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return BAR_SCHEMA

    def reader(self, schema: StructType) -> BarsReader:
        return BarsReader(self.options["path"])

    def streamReader(self, schema: StructType) -> BarsStream:
        return BarsStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(Bars)
