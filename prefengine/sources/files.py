"""Readers and writers of the record files: JSON lines, JSON arrays, CSV, workbooks, caches and reports."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prefengine.schemas import CONVERSATION  # noqa: F401 - the usual schema of a record file

def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, broken lines); blank lines are skipped."""
    full = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r")).select("r.*")
    return rows.filter("_broken is null").drop("_broken"), rows.filter("_broken is not null").select("_broken")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """The elements of one JSON array per file, whatever the file is called; of a limit the first ones (below 0: none).

    A file whose text does not begin with [ is no list, and refused.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).head()
    if first is not None and first[0] != "[":
        raise ValueError(f"{path} must hold a JSON list")
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows if limit is None else rows.limit(max(0, limit))


def read_splits(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """One table of several files with the name of each as ``split``."""
    out = None
    for name, path in paths.items():
        part = read_json_lines(spark, path, schema)[0].withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def read_trainer_state(spark: SparkSession, path: str) -> DataFrame:
    """(step, values): the log history of a trainer-state file, one row for each entry."""
    entry = T.MapType(T.StringType(), T.DoubleType())
    state = spark.read.schema(T.StructType([T.StructField("log_history", T.ArrayType(entry))])).option("multiLine", True).json(path)
    return state.select(F.explode("log_history").alias("values")).select(F.col("values")["step"].alias("step"), "values")


def write_json_lines(df: DataFrame, path: str, append: bool = False, order: list[Column] | None = None) -> None:
    """One JSON line for each row; with ``order`` the files, in the order of their names, hold the rows in that order."""
    df = df if order is None else df.orderBy(*order)  # by ranges, no single task
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """With a header in a fixed order; reports are small, so they become one file."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row table as an indented JSON object."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a report is one row")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(json.loads(rows[0]), ensure_ascii=False, indent=2), encoding="utf-8")


class WorkbookSource(DataSource):
    """spark.read.format("workbook").option("columns", "a,b").load(path): the first sheet of an .xlsx file.

    Every named column must be in the header row; cells are strings, missing ones null, and ``row_idx`` counts from 0.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("row_idx", T.LongType()),
                             *(T.StructField(c.strip(), T.StringType()) for c in self.options["columns"].split(","))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], schema.names[1:])


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition):
        header: dict[int, str] | None = None
        for cells in sheet_rows(self.path):
            if header is None:
                header = {i: v for i, v in cells.items() if v in self.columns}
                if lacking := set(self.columns) - set(header.values()):
                    raise ValueError(f"{self.path} has no column {', '.join(sorted(lacking))}")
                n = 0
                continue
            row = dict.fromkeys(self.columns)
            row.update({header[i]: v for i, v in cells.items() if i in header})
            yield (n, *(row[c] for c in self.columns))
            n += 1


def sheet_rows(path: str):
    """{column number: text} of each row of the first sheet, in order."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        sheet = min(n for n in book.namelist() if n.startswith("xl/worksheets/sheet"))
        with book.open(sheet) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{ns}row":
                    continue
                cells = {}
                for at, c in enumerate(row.iter(f"{ns}c")):
                    letters = "".join(x for x in c.get("r", "") if x.isalpha())
                    column = at
                    if letters:
                        column = 0
                        for x in letters:
                            column = column * 26 + ord(x) - 64
                        column -= 1
                    v = c.find(f"{ns}v")
                    text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else None if v is None else v.text
                    if c.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    if text is not None:
                        cells[column] = text
                row.clear()
                yield cells
