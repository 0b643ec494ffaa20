"""Readers of section corpora, documents, ledgers and binary files."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import magic_type
from ..operators.refs import canonical, identity

SECTION_FOLDER = r"[^/]*Pt\d+-Chap\d+-sec\d+"


def markdown(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The markdown files under the roots. They are listed once, here, however often the table is read."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").format("binaryFile").load(roots)


def sections(spark: SparkSession, roots: list[str], raw: bool = False, files: DataFrame | None = None) -> DataFrame:
    """[S1][S3][S5] One row per section folder under the roots: the first markdown file by name.

    ``raw`` takes the unpolished variant; the polished one leaves raw and content files out. Undecodable bytes are
    replaced. Roots are read as one listing, and keep their order in ``pos``; several variants can share ``files``, that listing.
    """
    files = markdown(spark, roots) if files is None else files
    path = F.col("path")
    name, folder = F.regexp_extract(path, r"([^/]+)$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    wanted = name.endswith("_raw.md") if raw else ~name.rlike(r"_raw|_content")
    rows = files.select(path.alias("path"), folder.alias("folder"), name.alias("name"), F.col("content").cast("string").alias("text")).where(wanted & folder.rlike(r"Pt\d+-Chap\d+-sec\d+"))
    first = Window.partitionBy("folder").orderBy("name", "path")
    ident = identity(F.col("folder"))
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1").withColumn("i", ident)
    return rows.select(canonical(F.col("i.pt"), F.col("i.ch"), F.col("i.sec")).alias("section_id"), "i.pt", "i.ch", "i.sec", "text", F.length("text").alias("chars"), "path", F.lit("raw" if raw else "polished").alias("variant"))


def lookup(ids: DataFrame, found: DataFrame, key: str = "section_id") -> DataFrame:
    """[S2] The text of each id, empty for an unknown one."""
    return ids.join(found.select(key, "text"), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def listed(found: DataFrame, pt: int, ch: int | None = None) -> DataFrame:
    """[S4] Ids of a part, or of a chapter of it, in numeric order."""
    rows = found.where(F.col("pt") == pt)
    return (rows if ch is None else rows.where(F.col("ch") == ch)).orderBy("pt", "ch", "sec").select("section_id")


def xml_sections(spark: SparkSession, paths: list[str], part: int = 217) -> DataFrame:
    """[S6] Sections of subparts and appendices of a regulation's XML, their texts put together without tags.

    A file that isn't well-formed gives one row, with its ``path`` and the parser's ``error``, which others have as null.
    """

    def text_of(node) -> str:
        return re.sub(r"\s+", " ", " ".join(t.strip() for t in node.itertext() if t.strip())).strip()

    def read(batches):
        names = ["section_id", "part", "subpart", "sec", "appendix", "head", "text", "path", "error"]
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    root = ET.fromstring(content)
                except ET.ParseError as error:
                    rows.append((*[None] * 7, path, str(error)))
                    continue
                for sub in root.iter("DIV6"):
                    if sub.get("TYPE") != "SUBPART":
                        continue
                    for sec in sub.iter("DIV8"):
                        if sec.get("TYPE") == "SECTION":
                            number = re.sub(r"^.*?\.", "", sec.get("N", ""))
                            rows.append((f"Pt{part}.Subpart{sub.get('N')}.Sec{part}.{number}", part, sub.get("N"), number, None, (sec.findtext("HEAD") or "").strip(), text_of(sec), path, None))
                for app in root.iter("DIV9"):
                    m = re.search(r"Appendix\s+([A-Z])", app.get("N", "") + " " + (app.findtext("HEAD") or ""), re.IGNORECASE)
                    letter = m.group(1).upper() if m else app.get("N", "")
                    rows.append((f"Pt{part}.App{letter}", part, None, None, letter, (app.findtext("HEAD") or "").strip(), text_of(app), path, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if n == "part" else pa.string()) for k, n in enumerate(names)], names)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    rows = files.mapInArrow(read, "section_id string, part int, subpart string, sec string, appendix string, head string, text string, path string, error string")
    return rows.withColumn("chars", F.length("text"))


def json_documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """[S7] Whole-file JSON arrays or objects."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """[S8] One object a line; blank lines are passed over."""
    return spark.read.schema(schema).json(path)


def ledger(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """[S10] CSV with a header, quoted commas and line breaks."""
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def parse_range(path: Column) -> Column:
    """[S12] Bucket, key, offset and length of ``s3://bucket/key?bytes=offset,length``; no range is all of it."""
    get = lambda k: F.regexp_extract(path, r"^s3a?://([^/]+)/([^?]*)(?:\?bytes=(-?\d+),(-?\d+))?$", k)
    number = lambda k, missing: F.when(get(k) == "", missing).otherwise(get(k)).cast("long")
    return F.struct(get(1).alias("bucket"), get(2).alias("key"), number(3, "0").alias("offset"), number(4, "-1").alias("length"))


def byte_range(content: Column, offset: Column, length: Column) -> Column:
    """Bytes of a column from an offset on; a negative length means to the end. Files are read by ``bytefiles``."""
    return F.when(length < 0, F.substr(content, offset.cast("int") + 1)).otherwise(F.substr(content, offset.cast("int") + 1, length.cast("int")))


def binary_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """[S14] Files with the type that their first bytes tell."""
    return spark.read.format("binaryFile").load(paths).select("path", "content", magic_type(F.col("content")).alias("kind"))
