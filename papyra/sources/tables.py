"""Readers: parquet tables, structured-document JSON, text fields, raw files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One structured document a file: header, pages, curricula.
STRUCTURED_DOC = (
    "schema_version int, "
    "document struct<filename:string, source_url:string, program:string, department:string, page_count:int, pages_needing_ocr:array<int>>, "
    "pages array<struct<page_number:int, text:string, extraction_status:string>>, "
    "curricula array<struct<year:string, semester:int, academic_year:string, department:string, source_page:int, "
    "courses:array<struct<code:string, name:string, category:string, credits:int>>>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def structured_docs(spark: SparkSession, glob: str) -> DataFrame:
    """Structured documents; a file that cannot be parsed gives no row."""
    docs = spark.read.schema(STRUCTURED_DOC).option("multiLine", True).option("mode", "DROPMALFORMED").json(glob)
    return docs.where(F.col("document.filename").isNotNull())


def doc_pages(docs: DataFrame) -> DataFrame:
    """One row per page with text: ``filename, source_url, page, text``."""
    each = docs.select("document.filename", "document.source_url", F.explode("pages").alias("p"))
    return each.select("filename", "source_url", F.col("p.page_number").alias("page"), F.trim("p.text").alias("text")).where("text <> ''")


def extraction_status(text: Column, has_image: Column) -> Column:
    """What a page needs: nothing, character recognition, or no text at all."""
    found = F.trim(F.coalesce(text, F.lit(""))) != ""
    return F.when(found, "text_extracted").when(has_image, "image_only_requires_ocr").otherwise("no_text")


def to_structured(pages: DataFrame, schema_version: int = 1) -> DataFrame:
    """Structured documents from rows ``filename, source_url, program, department, page, text, has_image``."""
    status = extraction_status(F.col("text"), F.col("has_image"))
    rows = pages.withColumn("status", status)
    page = F.struct(F.col("page").cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"), F.col("status").alias("extraction_status"))
    grouped = rows.groupBy("filename", "source_url", "program", "department").agg(
        F.sort_array(F.collect_list(page)).alias("pages"),
        F.sort_array(F.collect_list(F.when(F.col("status") == "image_only_requires_ocr", F.col("page").cast("int")))).alias("pages_needing_ocr"),
        F.max("page").cast("int").alias("page_count"),
    )
    head = F.struct("filename", "source_url", "program", "department", "page_count", "pages_needing_ocr")
    return grouped.select(F.lit(schema_version).alias("schema_version"), head.alias("document"), "pages")


def sitemap_urls(xml: Column) -> Column:
    """Locations listed in a sitemap."""
    return F.regexp_extract_all(xml, F.lit(r"<loc>\s*(.*?)\s*</loc>"), F.lit(1))


def is_pdf(content: Column) -> Column:
    """Whether bytes start as a PDF file does."""
    return F.substring(content, 1, 4) == F.lit("%PDF").cast("binary")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """Cached chunks whose id, text and source are all given."""
    given = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("id", "text", "source")]
    return chunks.where(given[0] & given[1] & given[2])


def fresh(cache: DataFrame, version: int, as_of: Column, max_age_days: int = 7) -> DataFrame:
    """Cache rows of the wanted version that are not older than the limit at ``as_of``."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("saved_at")
    return cache.where((F.col("version") == version) & (age <= max_age_days * 86400))


#: What a crawl leaves behind to resume from: visited addresses and the file records found so far, by address.
CRAWL_STATE = "visited array<string>, pdfs map<string, struct<hash_id:string, title:string, source_page:string, depth:int>>"


def resume_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``url`` of the visited pages, and ``url, hash_id, title, source_page, depth`` of the files found.

    A state that is missing or cannot be parsed gives empty tables, so a crawl starts anew.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    reader = spark.read.schema(CRAWL_STATE).option("multiLine", True).option("mode", "DROPMALFORMED")
    state = reader.json(path) if there else spark.createDataFrame([], CRAWL_STATE)
    visited = state.select(F.explode("visited").alias("url")).where("url is not null").distinct()
    return visited, state.select(F.explode("pdfs").alias("url", "r")).where("r is not null").select("url", "r.*")


def unvisited(links: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Links that a resumed crawl has still to read, each once."""
    return links.dropDuplicates([url]).join(visited.select(F.col("url").alias(url)), url, "left_anti")
