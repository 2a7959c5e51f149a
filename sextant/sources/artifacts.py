"""Reading and writing files: JSON artifacts, text lines, archives, event streams as text, paged sources."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TASK = "key string, pr bigint, title string, mergedAt timestamp, branch string, files array<struct<f string, add bigint, del bigint>>, jiraTitle string, issueType string"
MODULE = "name string, path string, files int, classes array<string>, summary string"


def read_task_index(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of changes, or several files of them; fields that are missing are NULL, broken files give NULL rows."""
    return spark.read.schema(TASK).option("multiLine", True).json(path)


def read_modules(spark: SparkSession, path: str) -> DataFrame:
    """The modules of an envelope {generatedAt, commit, modules: [...]}."""
    return spark.read.schema(f"generatedAt string, commit string, modules array<struct<{MODULE.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array')}>>").option("multiLine", True).json(path).select(F.inline("modules"))


def read_map_lines(spark: SparkSession, path: str, dropped: str = "Classes:") -> DataFrame:
    """Lines of a text file without those that start with ``dropped``."""
    return spark.read.text(path).where(~F.ltrim("value").startswith(dropped))


def split_pairs(lines: DataFrame, separator: str = "|||", value: str = "value") -> DataFrame:
    """(path, summary) of lines ``path ||| summary``; other lines are left out."""
    return lines.where(F.contains(value, F.lit(separator))).select(F.trim(F.substring_index(value, separator, 1)).alias("path"), F.trim(F.expr(f"substring({value}, locate('{separator}', {value}) + {len(separator)})")).alias("summary"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of KEY=VALUE lines; blank lines and comments are left out, the first = parts."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#") & F.contains(line, F.lit("="))).select(F.trim(F.substring_index(line, "=", 1)).alias("name"), F.trim(F.expr("substring(trim(value), locate('=', trim(value)) + 1)")).alias("value"))


def read_archives(spark: SparkSession, path: str, roots: tuple[str, ...] = (), endings: tuple[str, ...] = (), errors: bool = False) -> DataFrame:
    """(archive, path, content) of the text files in .tar.gz archives, without their first folder.

    Only paths under one of ``roots`` and with one of ``endings`` are unpacked (an empty tuple allows all). Long names
    are read; a broken archive gives the members before the break. With ``errors`` there is a fourth column ``error``,
    and a broken archive has a row more that holds it, without path and content.
    """

    columns = ["archive", "path", "content"] + ["error"] * errors

    def unpack(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
                        for member in tar:
                            inner = member.name.partition("/")[2]
                            if member.isfile() and inner and (not roots or inner.startswith(roots)) and (not endings or inner.endswith(endings)):
                                rows.append((name, inner, tar.extractfile(member).read().decode("utf-8", "replace"), None))
                except (tarfile.TarError, EOFError, OSError) as e:
                    if errors:
                        rows.append((name, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["archive", "path", "content", "error"])[columns]

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(unpack, ", ".join(f"{c} string" for c in columns))


def read_deltas(lines: DataFrame) -> DataFrame:
    """(stream, text): the deltas of server-sent events joined in order.

    ``lines``: stream, seq, value. Lines without 'data: ', the end mark and broken JSON are skipped.
    """
    data = lines.where(F.col("value").startswith("data: ") & (F.trim("value") != "data: [DONE]"))
    delta = F.get_json_object(F.expr("substring(value, 7)"), "$.delta")
    parts = data.select("stream", "seq", delta.alias("delta")).where("delta is not null")
    return parts.groupBy("stream").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("text"))


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Replace a folder of parquet files, in folders by the column ``by`` if given."""
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)


class Pages(DataSource):
    """Rows of a paged source, here folders of JSON pages ``page-<n>.json``: one partition per page, a short page is the last.

    Options: path, size (rows of a full page, 100), schema.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return self.options.get("schema", "page int, item string")

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("size", "100"))

    def partitions(self) -> list[InputPartition]:
        import os

        have = {int(f[5:-5]) for f in os.listdir(self.path) if f.startswith("page-") and f.endswith(".json")}
        out, n = [], 1
        while n in have:
            out.append(InputPartition(n))
            n += 1
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(f"{self.path}/page-{partition.value}.json") as f:
            for item in json.load(f):
                yield partition.value, json.dumps(item)
