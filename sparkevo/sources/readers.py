"""Readers for tabular files and sinks for results; every path goes through Spark's readers and writers."""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.frame import onehot_class
from .arrays import ArraySource

#: Column names that mark a target, and the readers of file endings.
TARGETS = ("label", "target", "class", "y", "output", "category")
FORMATS = {"csv": "csv", "txt": "text", "data": "text", "nna": "nna", "npz": "npz", "json": "json", "parquet": "parquet", "orc": "orc"}


def detect_format(path: str) -> str:
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending in ("arff", "xls", "xlsx"):
        raise ValueError(f".{ending} files are not supported")
    if ending not in FORMATS:
        raise ValueError(f"unknown ending .{ending}")
    return FORMATS[ending]


def detect_delimiter(line: str) -> str | None:
    """',' or tab by their number in a line; None stands for runs of white space."""
    counts = {",": line.count(","), "\t": line.count("\t"), None: line.count(" ")}
    return max(counts, key=lambda d: counts[d]) if any(counts.values()) else None


def detect_target(columns: Sequence[str]) -> str | None:
    named = [c for c in columns if c.lower() in TARGETS]
    return named[0] if named else columns[-1] if columns else None


@dataclass
class Dataset:
    """frame with a label column and features; metadata as found."""

    frame: DataFrame
    features: list[str]
    metadata: dict


def split_target(df: DataFrame, target: str | int | None = None, exclude: Sequence[str] = ()) -> Dataset:
    """Name, position or guess of the target column becomes label; excluded columns go, absent ones are no error."""
    df = df.drop(*exclude)
    name = df.columns[target] if isinstance(target, int) else target or detect_target(df.columns)
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    features = [c for c in df.columns if c != name]
    return Dataset(df.withColumnRenamed(name, "label"), features, {"target": name, "n_features": len(features)})


def read_csv(spark: SparkSession, path: str, schema: str | None = None, delimiter: str = ",", header: bool = True, target=None, exclude: Sequence[str] = ()) -> Dataset:
    reader = spark.read.option("header", header).option("sep", delimiter)
    return split_target(reader.csv(path, schema=schema) if schema else reader.csv(path, inferSchema=True), target, exclude)


def first_line(spark: SparkSession, path: str) -> str:
    """The first line with data of a file, for a look at its form."""
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#")).limit(1).collect()
    return rows[0].value if rows else ""


def _fields(spark: SparkSession, path: str, delimiter: str | None):
    split = r"\s+" if delimiter is None else r"\s*,\s*|\s+" if delimiter == "auto" else rf"\s*[{delimiter}]\s*"
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return lines.select(F.split(F.trim("value"), split).alias("p"))


def read_numbers(spark: SparkSession, path: str, width: int | None = None, target: int = -1, delimiter: str | None = "auto") -> Dataset:
    """Separated numbers, one row a line; blank lines, # lines and short or odd lines are left out.

    delimiter: a character, None for white space, auto for commas or white space. width is the first line's where it is not
    given. Labels become whole numbers where all of them are.
    """
    fields = _fields(spark, path, delimiter)
    if width is None:
        width = fields.agg(F.first(F.size("p"))).first()[0] or 0
    numbers = fields.filter(F.size("p") >= width).select(*[F.col("p")[i].try_cast("double").alias(f"f_{i}") for i in range(width)]).dropna()
    found = split_target(numbers, target % width)
    odd = found.frame.filter(F.col("label") != F.rint("label")).limit(1).count()
    return found if odd else replace(found, frame=found.frame.withColumn("label", F.col("label").cast("bigint")))


def read_onehot(spark: SparkSession, path: str, features: int = 27, flags: int = 7) -> Dataset:
    """Numbers whose last flags columns mark the class: label is the first greatest flag, -1 without one.

    The width that most lines have decides: where it is another, the last column of that width is the label. Longer lines
    are read as far as the width, shorter ones left out; metadata counts both as odd_lines.
    """
    fields, width = _fields(spark, path, "auto"), features + flags
    sizes = fields.groupBy(F.size("p").alias("size")).agg(F.count(F.lit(1)).alias("n"))  # a row a width
    usual = sizes.orderBy(F.desc("n"), F.desc(F.col("size") == width), F.desc("size")).first()
    seen = usual["size"] if usual else width
    odd = {"odd_lines": sizes.filter(F.col("size") != seen).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]}
    if seen != width:
        found = read_numbers(spark, path, seen)
        return replace(found, metadata=found.metadata | odd)
    numbers = fields.filter(F.size("p") >= width).select(*[F.col("p")[i].try_cast("double").alias(f"f_{i}") for i in range(width)]).dropna()
    names = [f"f_{i}" for i in range(width)]
    return Dataset(numbers.select(*names[:features], onehot_class(names[features:]).alias("label")), names[:features], {"target": "one-hot", "n_features": features} | odd)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and row, the 0-based place of every line of the file or files, which follow each other by name.

    Lines are counted by the blocks of files that Spark reads, so no task numbers more than a block.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    counts = counts.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return lines.withColumn("inside", inside).join(counts, ["file", "block"]).select("value", (F.col("before") + F.col("inside")).alias("row"))


def read_pair(spark: SparkSession, features: str, labels: str) -> Dataset:
    """Features and labels (-1 or 1, then anything) of two files, matched by line: label 0 for -1 and 1 else; gaps are null."""
    parts = numbered_lines(spark, features).select("row", F.split(F.trim("value"), r"\s+").alias("p"))
    width = parts.agg(F.max(F.size("p"))).first()[0] or 0
    names = [f"f_{i}" for i in range(width)]
    number = lambda i: F.when(~F.isnan(F.get("p", F.lit(i)).try_cast("double")), F.get("p", F.lit(i)).try_cast("double"))
    marks = numbered_lines(spark, labels).select("row", F.when(F.split(F.trim("value"), r"\s+")[0].try_cast("int") == -1, 0).otherwise(1).alias("label"))
    frame = parts.select("row", *[number(i).alias(n) for i, n in enumerate(names)]).join(marks, "row")
    missing, n = frame.agg(F.sum(sum((F.col(c).isNull().cast("bigint") for c in names), F.lit(0))), F.count(F.lit(1))).first()
    return Dataset(frame, names, {"target": "label", "n_features": width, "missing": missing or 0, "missing_percent": 100 * (missing or 0) / max(1, n * width)})


def read_union(spark: SparkSession, paths: Sequence[str], shift: int = 0, **options) -> Dataset:
    """The rows of all files, which read_numbers takes, with shift added to labels (-1 makes labels from 1 begin at 0)."""
    parts = [read_numbers(spark, p, **options) for p in paths]
    frame = parts[0].frame
    for p in parts[1:]:
        frame = frame.unionByName(p.frame)
    return replace(parts[0], frame=frame.withColumn("label", F.col("label") + shift))


def read_npz(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """part (train, test), row, features (flattened) and label of archives of X_train, y_train, X_test and y_test; a partition a range of rows."""
    spark.dataSource.register(ArraySource)
    files = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # a name a file; contents are not read
    options = {"paths": "\n".join(sorted(files))} | ({"range": str(range_bytes)} if range_bytes else {})
    return spark.read.format("npz_rows").options(**options).load().select("part", "row", "features", "label")


def read(spark: SparkSession, path: str | Sequence[str], kind: str | None = None, **options) -> Dataset | DataFrame:
    """A file by its ending, or as kind: csv, text and data by the delimiter of their first line, nna, npz, and Spark's own.

    union and pair take several files: rows of all, or features and labels by line.
    """
    if kind == "union":
        return read_union(spark, [path] if isinstance(path, str) else path, **options)
    if kind == "pair":
        return read_pair(spark, *path, **options)
    if not isinstance(path, str):
        raise ValueError(f"several files need the kind union or pair, not {kind!r}")
    kind = kind or detect_format(path)
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "text":
        line = first_line(spark, path)
        delimiter = detect_delimiter(line)
        if delimiter in (",", "\t") and any(x.strip().lower() not in ("", "nan") and not _is_number(x) for x in line.split(delimiter)):
            return read_csv(spark, path, delimiter=delimiter, **options)
        return read_numbers(spark, path, delimiter=delimiter if delimiter in (",", "\t") else None, **options)
    if kind == "nna":
        return read_onehot(spark, path, **options)
    if kind == "npz":
        return read_npz(spark, path)
    return spark.read.format(kind).load(path)


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def run_path(base: str, now: datetime.datetime | None = None) -> str:
    """A folder of its own for the results of a run, named by time."""
    return f"{base.rstrip('/')}/run_{now or datetime.datetime.now():%Y%m%d_%H%M%S}"


def write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """What write_metadata stored; {} where there is nothing, or no JSON."""
    try:
        return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    except Exception:  # a missing or broken file says nothing
        return {}


class Registry:
    """Datasets by name; a dataset's sources are tried by priority until one can be read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.sources, self.info = spark, {}, {}

    def register(self, name: str, path: str | Sequence[str], priority: int = 0, kind: str | None = None, options: dict | None = None, **metadata) -> None:
        """A source of a dataset: a file, or the files of a union or pair, with the options of its reader."""
        self.sources.setdefault(name, []).append((priority, path, kind, options or {}))
        self.info.setdefault(name, {}).update(metadata)

    def names(self) -> list[str]:
        return sorted(self.sources)

    def describe(self, name: str) -> dict:
        """Metadata and sources of a dataset; {} for an unknown one."""
        return self.info.get(name, {}) | {"sources": [s[1] for s in sorted(self.sources[name], key=lambda s: s[0])]} if name in self.sources else {}

    def exists(self, path: str | Sequence[str]) -> bool:
        if not isinstance(path, str):
            return all(self.exists(p) for p in path)
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)

    def available(self) -> list[str]:
        """Datasets with a source that is there."""
        return [n for n in self.names() if any(self.exists(s[1]) for s in self.sources[n])]

    def load(self, name: str, **options) -> DataFrame:
        """A table of the session by that name, or the first source that can be read."""
        if name not in self.sources and self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        errors = []
        for _, path, kind, own in sorted(self.sources.get(name, []), key=lambda s: s[0]):
            try:
                found = read(self.spark, path, kind, **(own | options))
                return found.frame if isinstance(found, Dataset) else found
            except Exception as e:  # the next source may do
                errors.append(f"{path}: {e}")
        raise ValueError(f"no source of {name!r} can be read: {'; '.join(errors) or 'none registered'}")
