"""Sources of raw records: object listings, dumps, tar archives, tailed files, lines from a socket, catalogs and CSV."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: The columns of a dumped record, in order.
DUMP_COLUMNS = (
    ("severity", "string"), ("level", "int"), ("timestamp", "double"), ("hostname", "string"), ("rolename", "string"), ("pid", "int"), ("username", "string"), ("system", "string"),
    ("facility", "string"), ("detector", "string"), ("partition", "string"), ("run", "bigint"), ("errcode", "bigint"), ("errline", "int"), ("errsource", "string"), ("message", "string"),
)
DUMP_DDL = ", ".join(f"`{n}` {t}" for n, t in DUMP_COLUMNS)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
_TOKEN = re.compile(r"'((?:[^'\\]|\\.|'')*)'|([^,()'\s][^,()']*)|([,()])", re.S)


def listing(spark: SparkSession, path: str, pattern: str = "*", least: int = 1000, most: int | None = None, limit: int | None = None) -> DataFrame:
    """path and length of objects above `least` bytes (and at most `most`); contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length").where(F.col("length") > least)
    if most is not None:
        found = found.where(F.col("length") <= most)
    return found.orderBy("path").limit(limit) if limit else found


def dump_rows(statement: str) -> Iterator[list]:
    """The value lists of one extended INSERT: quoted text with escapes and doubled quotes, NULL, and numbers."""
    head = re.search(r"\bVALUES\b", statement, re.I)
    row: list | None = None
    for m in _TOKEN.finditer(statement, head.end()) if head else ():
        text, bare, mark = m.groups()
        if mark == "(":
            row = []
        elif mark == ")":
            if row is not None:
                yield row
            row = None
        elif row is not None and text is not None:
            row.append(re.sub(r"\\(.)|''", lambda e: "'" if e[0] == "''" else _ESCAPES.get(e[1], e[1]), text, flags=re.S))
        elif row is not None and bare is not None:
            bare = bare.strip()
            row.append(None if bare.upper() == "NULL" else float(bare) if re.search(r"[.eE]", bare) else int(bare))


def _typed(row: list) -> tuple | None:
    if len(row) != len(DUMP_COLUMNS):
        return None
    cast = {"string": str, "int": int, "bigint": int, "double": float}
    try:
        return tuple(None if v is None else cast[t](v) for v, (_, t) in zip(row, DUMP_COLUMNS, strict=True))
    except ValueError:
        return None


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Records of SQL dumps with one INSERT a line; gzip is read as it is, and rows of another width are skipped."""
    lines = spark.read.text(path).where(F.col("value").startswith("INSERT"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [t for line in batch["value"] for r in dump_rows(line) if (t := _typed(r)) is not None]
            yield pd.DataFrame(rows, columns=[n for n, _ in DUMP_COLUMNS]).astype({"level": "Int32", "pid": "Int32", "run": "Int64", "errcode": "Int64", "errline": "Int32"})

    return lines.mapInPandas(run, DUMP_DDL)


def read_tar(spark: SparkSession, path: str, files: int = 4, lines: int = 2000) -> DataFrame:
    """archive, member, number and line of the first daily text log and some output members of each archive.

    An archive is streamed once by one task; its length is checked by the listing, and members are cut at `lines`.
    """
    archives = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                daily, output, rows = False, 0, []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:
                    for member in tar:
                        base = member.name.rpartition("/")[2]
                        is_daily = re.fullmatch(r"dds_\d{4}-\d{2}-\d{2}\.\d+\.log", base) is not None
                        if not member.isfile() or (daily if is_daily else output >= files or not re.search(r"_(out|err)\.log$", base)):
                            continue
                        daily, output = daily or is_daily, output + (not is_daily)
                        handle = tar.extractfile(member)
                        for k, raw in enumerate(handle or ()):
                            if k >= lines:
                                break
                            rows.append((name, member.name, k, raw.decode("utf-8", "replace").rstrip("\n")))
                yield pd.DataFrame(rows, columns=["archive", "member", "number", "line"])

    return archives.mapInPandas(run, "archive string, member string, number long, line string")


def tail(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """A stream of lines with the file they are from; the checkpoint remembers which files are done."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", per_trigger).format("text").load(path)
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived"))


def json_lines(lines: DataFrame, schema: str | T.StructType, column: str = "value") -> DataFrame:
    """Fields of JSON lines; a line that isn't JSON keeps its text in _corrupt_record."""
    ddl = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*ddl.fields, T.StructField("_corrupt_record", T.StringType())])
    return lines.select(F.from_json(column, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")


def strict_fields(lines: DataFrame, known: Sequence[str], column: str = "value") -> DataFrame:
    """Lines whose JSON object has no key but the known ones; the others are what a strict mapping rejects."""
    keys = F.json_object_keys(column)
    return lines.where(keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, known)))) == 0))


def socket_lines(spark: SparkSession, host: str = "localhost", port: int = 5170) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Samples from CSV with a header; what isn't a number is 0.0."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in columns])


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or none of its rows if there is no such table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def union_all(*tables: DataFrame) -> DataFrame:
    """Tables of different columns as one; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
