"""Text files, and tables that are replaced as a whole."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, schema: str, quoted: bool = False) -> DataFrame:
    """A tab-separated file with a header; quotes are ordinary characters unless `quoted`."""
    return spark.read.csv(path, schema=schema, sep="\t", header=True, quote='"' if quoted else "", enforceSchema=False)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated files with a header, in place of what was there; nulls are empty."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", nullValue="", emptyValue="")


def export_csv(df: DataFrame, path: str, order: list[Column], most: int = 100_000) -> None:
    """The first `most` rows by `order` as quoted CSV (an export with a documented limit)."""
    df.orderBy(*order).limit(most).write.mode("overwrite").csv(path, header=True, escape='"')


def day_first(text: Column) -> Column:
    """A day written dd/mm/yyyy (or with - or .) as a date; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "[-.]", "/"), F.lit("d/M/yyyy")).cast("date")


def canonical_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text with its columns in name order and nulls left out: equal rows give equal bytes."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a table beside the present one and swaps them, so readers see the old or the new one, never a part."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    Path = spark._jvm.org.apache.hadoop.fs.Path
    here, new, old = Path(path), Path(f"{path}.new"), Path(f"{path}.old")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(new, here)
    fs.delete(old, True)


def sitemap(paths: list[str], root: str) -> str:
    """A sitemap of the given paths in order."""
    urls = "".join(f"<url><loc>{escape(root.rstrip('/') + p)}</loc></url>" for p in paths)
    return f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{urls}</urlset>'
