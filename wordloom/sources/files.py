"""Files into tables of texts, and tables into files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge


def decoded(data: bytes) -> str | None:
    """UTF-8 (with or without a mark), else GBK, else null."""
    for encoding in ("utf-8-sig", "gbk"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return None


class _Paragraphs(HTMLParser):
    """Collects the text between tags, with a line's end at the end of each paragraph; tolerates what is no well-formed XML."""

    def __init__(self):
        super().__init__()
        self.pieces: list[str] = []

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "w:p":
            self.pieces.append("\n")


def docx_text(data: bytes) -> str | None:
    """The text of a .docx file, one line a paragraph (null: no such file)."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            parser = _Paragraphs()
            parser.feed(archive.read("word/document.xml").decode("utf-8", errors="ignore"))
    except (zipfile.BadZipFile, KeyError):
        return None
    parser.close()
    return "".join(parser.pieces)


def listed(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, size of all files below root in order of path without regard to case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size")).orderBy(F.lower("path"), "path")


def read_documents(spark: SparkSession, root: str, glob: str = "*.{md,txt,docx}") -> DataFrame:
    """path, size, text of all files below root, whatever their encoding (null: unreadable). Only the bytes need Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, data = batch.column("path").to_pylist(), batch.column("content").to_pylist()
            texts = [docx_text(d) if p.lower().endswith(".docx") else decoded(d) for p, d in zip(paths, data)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size"), pa.array(texts, pa.string())], names=["path", "size", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size"), "content").mapInArrow(run, "path string, size long, text string")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """book (the path), text of UTF-8 files, one row a file, without Python."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("book"), F.col("value").alias("text"))


def read_projects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records, one file each, without the corrupt ones, oldest first."""
    found = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return found.filter("_corrupt is null").drop("_corrupt").orderBy("created_at")


def read_gold_corpus(spark: SparkSession, path: str) -> DataFrame:
    """ord, title, gist, points (array of summary, tone, theme_tags) of a gold corpus, a JSON object with its chapters' summaries."""
    point = "struct<summary:string,tone:string,theme_tags:array<string>>"
    schema = f"summaries array<struct<order:int,title:string,gist:string,plot_points:array<{point}>>>"
    each = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("summaries").alias("s"))
    return each.select(F.col("s.order").alias("ord"), "s.title", "s.gist", F.col("s.plot_points").alias("points"))


def read_gold_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, query, relevant_orders of a JSON object with gold cases."""
    schema = "cases array<struct<case_id:string,query:string,relevant_orders:array<int>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("cases"))


def write_knowledge_base(spark: SparkSession, root: str, out: str) -> None:
    """Takes in the files below root: chunks and manifest as Parquet."""
    files = read_documents(spark, root, "*")
    manifest = knowledge.manifest(files)
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    kept = files.join(spark.read.parquet(f"{out}/manifest").filter("included").select("path"), "path", "left_semi")
    chunks = knowledge.chunks(kept.filter("text is not null"), "path")
    chunks.withColumn("doc_id", knowledge.chunk_id(F.col("path"), F.col("index"))).write.mode("overwrite").parquet(f"{out}/chunks")
