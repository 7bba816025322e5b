"""Files as tables: posting CSVs, plain texts of unknown encoding, word-processor files, snapshots."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of posting CSVs and what loading calls them.
CSV_COLUMNS = {
    "人工智能关键词": "ai_keyword", "企业名称": "company", "招聘岗位": "title", "工作城市": "city", "工作区域": "work_area", "最低月薪": "salary_min", "最高月薪": "salary_max",
    "职位描述": "description", "学历要求": "education", "要求经验": "experience", "招聘人数": "job_count", "招聘类别": "recruitment_category", "初级分类": "industry",
    "来源平台": "source_platform", "公司地点": "company_location", "工作地点": "work_location", "招聘发布日期": "posting_date", "招聘结束日期": "closing_date",
    "招聘发布年份": "posting_year", "招聘结束年份": "closing_year", "来源": "source_reference",
}
NUMBERS = {"salary_min": "decimal(15,2)", "salary_max": "decimal(15,2)", "posting_year": "int", "closing_year": "int"}
ENTRY_LIMIT = 8 << 20
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_postings_csv(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Postings of one CSV export: known columns renamed, numbers coerced (words such as 面议 become null), one row per content."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = {c.strip().lstrip("﻿"): c for c in raw.columns}
    lowered = {k.lower(): v for k, v in names.items()}
    columns = []
    for shown, name in CSV_COLUMNS.items():
        column = names.get(shown) or lowered.get(name)
        value = F.col(f"`{column}`") if column else F.lit(None).cast("string")
        columns.append((F.nullif(F.regexp_replace(value, r"[^0-9.]", ""), F.lit("")).try_cast(NUMBERS[name]) if name in NUMBERS else F.trim(value)).alias(name))
    rows = raw.select(*columns).withColumn("source_dataset", F.lit(dataset))
    text = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("title", "description", "company")])
    keyed = rows.withColumn("content_hash", F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256))
    return keyed.dropDuplicates(["source_dataset", "content_hash"])


def decode_text(data: bytes) -> str:
    """Text of unknown encoding: by its mark, else UTF-8 unless much of it is broken, else GB18030."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    text = data.decode("utf-8", "replace")
    broken = text.count("�")
    return text if broken <= max(2, len(text) // 50) else data.decode("gb18030", "replace")


def docx_text(data: bytes) -> str:
    """Paragraphs and table rows (cells joined by ' | ') of a word-processor file; empty for anything else."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            info = z.getinfo("word/document.xml")
            if info.file_size > ENTRY_LIMIT:
                return ""
            root = ElementTree.fromstring(z.read(info))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""

    def inline(node) -> str:
        out = []
        for x in node.iter():
            out.append({f"{_WORD}t": x.text or "", f"{_WORD}tab": "\t", f"{_WORD}br": "\n"}.get(x.tag, ""))
        return "".join(out)

    lines = []
    for block in root.iter(f"{_WORD}body"):
        for child in block:
            if child.tag == f"{_WORD}p":
                lines.append(inline(child))
            elif child.tag == f"{_WORD}tbl":
                lines += [" | ".join(inline(c).strip() for c in row.iter(f"{_WORD}tc")) for row in child.iter(f"{_WORD}tr")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _extract(paths: pd.Series, contents: pd.Series) -> pd.Series:
    return pd.Series([docx_text(c) if p.lower().endswith(".docx") else decode_text(c) for p, c in zip(paths, contents, strict=True)])


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of the files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.pandas_udf(_extract, "string")("path", "content").alias("text"))


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete versions of a snapshot, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(where))
    return [n for n in names if n.startswith("v-") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))]


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write a new version of a snapshot below ``path``; its folder's name.

    A version is a folder of its own and counts from the moment its last file, the mark of
    success, is there, so that readers see the old or the new version as a whole and a failed
    write changes nothing. Old versions stay until they are removed by hand.
    """
    known = _versions(df.sparkSession, path)
    version = f"v-{int(known[-1].split('-')[1]) + 1 if known else 1:012d}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{version}")
    return version


def read_snapshot(spark: SparkSession, path: str, bundled: DataFrame | None = None) -> DataFrame:
    """The newest complete version of a snapshot; ``bundled`` where there is none yet."""
    known = _versions(spark, path)
    if known:
        return spark.read.parquet(f"{path}/{known[-1]}")
    if bundled is None:
        raise FileNotFoundError(f"no snapshot below {path}")
    return bundled


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, driver: str | None = None) -> DataFrame:
    """A database table in ``parts`` ranges of its key, read side by side; filters and columns are pushed to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return (reader.option("driver", driver) if driver else reader).load()


def query_jdbc(spark: SparkSession, url: str, query: str, driver: str | None = None) -> DataFrame:
    """The rows of one statement, run by the database: a list, one row or a single number."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    return (reader.option("driver", driver) if driver else reader).load()


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", batch: int = 1000, driver: str | None = None) -> None:
    """Rows into a database table, in batches of ``batch`` a statement."""
    writer = df.write.format("jdbc").option("url", url).option("dbtable", name).option("batchsize", batch)
    (writer.option("driver", driver) if driver else writer).mode(mode).save()
