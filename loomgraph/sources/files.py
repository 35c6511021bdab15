"""Scans of local files and registries, and sinks for vectors, text and pages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = (
    "case_name string, url string, title string, source_type string, author string, date_published string, contains_verdict boolean, "
    "verdict_position string, manual_fallback string, credibility_signals struct<peer_reviewed: boolean, citation_count: int, author_h_index: int, known_reliable: boolean>"
)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """``url, title, source_type, text, char_count`` of whole text files; the title is the file's stem."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("text"))
    stem = F.regexp_extract("url", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.select("url", stem.alias("title"), F.lit("local").alias("source_type"), "text", F.length("text").alias("char_count"))


def read_pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """``url, text`` of PDF files, pages joined by a blank line; needs the optional ``pypdf``."""
    try:
        import pypdf  # noqa: F401
    except ImportError as missing:
        raise RuntimeError("reading PDF files needs pypdf") from missing

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pypdf

        for batch in batches:
            texts = ["\n\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages) for content in batch["content"]]
            yield pd.DataFrame({"url": batch["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "url string, text string")


def read_registry(spark: SparkSession, path: str, case_name: str | None = None) -> DataFrame:
    """A source registry file (JSON, or YAML where the optional parser is installed).

    The file holds ``case_name`` and a list ``sources``; a missing file raises. Registries are
    written by hand and small.
    """
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(raw)
    else:
        data = json.loads(raw)
    name = case_name or data.get("case_name")
    rows = [json.dumps({**s, "source_type": s.get("source_type", s.get("type")), "case_name": name}, default=str) for s in data.get("sources", [])]
    parsed = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "ord int, row string")
    return parsed.select("ord", F.from_json("row", REGISTRY).alias("s")).select("ord", "s.*")


def first_sources(registry: DataFrame, most: int) -> DataFrame:
    """The first ``most`` sources in the registry's order."""
    return registry.orderBy("ord").limit(most)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors by claim as Parquet; replaces an earlier version."""
    vectors.select("id", "vector").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored vectors, or nothing if none were stored."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.parquet(path) if exists else None


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines of any result, nested columns kept."""
    df.write.mode("overwrite").json(path)


def write_site(pages: dict[str, str], folder: str) -> None:
    """Rendered pages into a folder on the driver."""
    for name, page in pages.items():
        target = Path(folder, name)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(page, encoding="utf-8")
