"""Inputs: raw pages, robots bodies, inventories and statuses as tables, in any format Spark reads."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

RAW_PAGES = "site string, ord int, url string, final_url string, http_status int, headers map<string,string>, html string"
RAW_ROBOTS = "site string, fetch_status int, body string"
LINKS = "site string, ord int, url string, http_status int, from_page string, anchor_text string"
ANCHORS = "site string, ord int, url string, http_status int, confirmed_by string"


def read(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table of one of the schemas above from parquet, json, orc or csv files."""
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(path)


def raw_pages(pages: DataFrame) -> DataFrame:
    """Rows of RAW_PAGES from a crawl table (page_id, url, html): status 200, one site for each host."""
    url = F.col("url")
    return pages.select(
        "page_id", urls.host(url).alias("site"), F.col("page_id").cast("int").alias("ord"), "url", url.alias("final_url"), F.lit(200).alias("http_status"),
        F.create_map().cast("map<string,string>").alias("headers"), "html",
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Only on one machine (a local master) may that setting be missing.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "lakelens-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lakelens-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet and read again: later readers prune its columns, and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df on at least as many tasks as there are cores: files of one row group are dealt out, large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
