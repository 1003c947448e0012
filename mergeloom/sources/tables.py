"""Source tables: CSV with detected dialect and encoding, workbooks, Parquet."""

from __future__ import annotations

import codecs
import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mergeloom.operators.union import SourceTable
from mergeloom.plans.contracts import Mapping, TargetSchema, load_schema
from mergeloom.sources.xlsx import Workbook, XlsxSource, header_names

ENCODINGS = ("utf-8-sig", "utf-8", "cp1254", "latin-1")
DELIMITERS = ",;\t|"
PREVIEW = 4096
SUFFIXES = (".csv", ".xlsx", ".parquet")


class SourceError(ValueError):
    """A file that cannot be read as asked."""


def sniff(path: str | Path) -> tuple[str, str]:
    """(encoding, delimiter) of a CSV file, from its first characters; a comma where nothing tells."""
    raw = Path(path).read_bytes()[: PREVIEW * 4] if Path(path).stat().st_size <= PREVIEW * 4 else open(path, "rb").read(PREVIEW * 4)
    for encoding in ENCODINGS:
        try:
            text = codecs.getincrementaldecoder(encoding)().decode(raw)[:PREVIEW]
            break
        except UnicodeDecodeError:
            continue
    try:
        return encoding, csv.Sniffer().sniff(text, DELIMITERS).delimiter
    except csv.Error:
        return encoding, ","


class LegacyCsvSource(DataSource):
    """CSV in an encoding that Spark's reader lacks.  Options: path, encoding, delimiter.  A file is one partition."""

    @classmethod
    def name(cls) -> str:
        return "legacy_csv"

    def _rows(self):
        with open(self.options["path"], encoding=self.options["encoding"], newline="") as f:
            yield from csv.reader(f, delimiter=self.options["delimiter"])

    def schema(self) -> StructType:
        names = header_names(next(self._rows(), []))
        return StructType([*[StructField(n, StringType()) for n in names], StructField("_row_idx", LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        rows, width = self._rows, len(schema) - 1

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(0)]

            def read(self, partition):
                cells = rows()
                next(cells, None)
                for i, row in enumerate(cells):
                    if row:
                        yield (*[x if x != "" else None for x in (row + [""] * width)[:width]], i)

        return Reader()


def _register(spark: SparkSession) -> None:
    for source in (XlsxSource, LegacyCsvSource):
        spark.dataSource.register(source)


def _decodes(path: str | Path, encoding: str) -> bool:
    decoder = codecs.getincrementaldecoder(encoding)()
    with open(path, "rb") as f:
        try:
            while block := f.read(1 << 20):
                decoder.decode(block)
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            return False
    return True


def read_csv(spark: SparkSession, path: str | Path, fall_through: bool = False) -> DataFrame:
    """Text cells, empty ones NULL, and _row_idx.

    UTF-8 files go through Spark's reader, in splits unless a line has an odd
    number of quotes, as lines that end within a cell have; other encodings are
    decoded in Python.  A file whose first bytes are UTF-8 and whose later ones
    are not is an error, or is read in the next encoding if it may fall through.
    """
    encoding, delimiter = sniff(path)
    uri = Path(path).resolve().as_uri()
    line, odd = F.col("value"), False
    if encoding in ("utf-8-sig", "utf-8"):
        quotes = F.char_length(line) - F.char_length(F.replace(line, F.lit('"'), F.lit("")))
        sound, odd = spark.read.text(uri).agg(F.bool_and(F.is_valid_utf8(line)), F.bool_or(quotes % 2 == 1)).first()
        if sound is False:
            if not fall_through:
                raise SourceError(f"{path}: begins as UTF-8 and goes on as something else")
            encoding = next(e for e in ENCODINGS[2:] if _decodes(path, e))
    if encoding not in ("utf-8-sig", "utf-8"):
        _register(spark)
        return spark.read.format("legacy_csv").options(path=str(path), encoding=encoding, delimiter=delimiter).load()
    with open(path, encoding="utf-8-sig", newline="") as f:
        names = header_names(next(csv.reader(f, delimiter=delimiter), []))
    if not names:
        raise SourceError(f"{path}: no header")
    schema = StructType([StructField(n, StringType()) for n in names])
    df = spark.read.schema(schema).csv(uri, header=True, sep=delimiter, quote='"', escape='"', multiLine=bool(odd), enforceSchema=True)
    # Splits of one file are of one size, the last one smaller: partitions follow their order, and ids that of partitions.
    return df.withColumn("_row_idx", F.monotonically_increasing_id())


#: Rows that one file of a table has at most, for the numbers of its rows.
FILE_ROWS = 1 << 40


def read_parquet(spark: SparkSession, path: str | Path) -> DataFrame:
    """The table with _row_idx: the order of its files' paths, and in each that of its rows."""
    df = spark.read.parquet(Path(path).resolve().as_uri())
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = df.select(F.col("_metadata.file_path").alias("__file")).distinct()
    numbered = files.withColumn("__n", F.row_number().over(Window.orderBy("__file")) - 1)  # a row for each file
    row = F.col("__n") * F.lit(FILE_ROWS) + F.col("__row")
    return placed.join(F.broadcast(numbered), "__file").select(*[F.col(f"`{c}`") for c in df.columns if c != "_row_idx"], row.cast("long").alias("_row_idx"))


def read_tables(spark: SparkSession, path: str | Path, sheet: str | None = None, fall_through: bool = False) -> list[SourceTable]:
    """All tables of a file.  A workbook's are labelled book.xlsx#Sheet if more than one is read."""
    path = Path(path)
    if not path.exists():
        raise SourceError(f"{path}: no such file")
    suffix = path.suffix.lower()
    if suffix == ".csv":
        return [SourceTable(path.name, path.name, read_csv(spark, path, fall_through))]
    if suffix == ".parquet":
        return [SourceTable(path.name, path.name, read_parquet(spark, path))]
    if suffix != ".xlsx":
        raise SourceError(f"{path}: only {', '.join(SUFFIXES)} files are read")
    names = list(Workbook(path.read_bytes()).sheets)
    if sheet is not None:
        if sheet not in names:
            raise SourceError(f"{path} has no sheet {sheet!r}; it has {', '.join(names)}")
        names = [sheet]
    _register(spark)
    read = lambda n: spark.read.format("xlsx").options(path=str(path.resolve()), sheet=n).load()
    return [SourceTable(path.name, path.name if len(names) == 1 else f"{path.name}#{n}", read(n), i) for i, n in enumerate(names)]


def locate_sources(mapping: Mapping, mapping_path: str | Path) -> list[Path]:
    """Files of a plan in the order of first mention: beside it, in the working folder, or by name beside it."""
    beside, found, lost = Path(mapping_path).parent, [], []
    for name in mapping.files():
        hit = next((p for p in (beside / name, Path(name), beside / Path(name).name) if p.is_file() or p.is_dir()), None)
        (found if hit else lost).append(hit or name)
    if lost:
        raise SourceError(f"not found: {', '.join(map(str, lost))}")
    return found


def locate_schema(given: str | Path | None, mapping_path: str | Path) -> TargetSchema:
    places = [Path(given)] if given else [Path(mapping_path).parent / "schema.yaml", Path("schema.yaml")]
    hit = next((p for p in places if p.is_file()), None)
    if hit is None:
        raise SourceError(f"no schema at {', '.join(map(str, places))}")
    return load_schema(hit)
