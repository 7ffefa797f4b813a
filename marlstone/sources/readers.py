"""Sources: parquet, CSV in several encodings, JSON payloads, tables in web pages, binary files, polygons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.guards import GuardError, require_columns


def read_parquet(spark: SparkSession, path: str, schema: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A parquet table under an explicit schema, or its own, with the columns that are asked for."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """All columns as text with blanks kept, by position under the given names; a byte order mark goes.

    Encodings beyond the standard ones, such as MS949, need spark.sql.legacy.javaCharsets.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.option("header", True).option("encoding", encoding).option("enforceSchema", True).schema(schema).csv(path).fillna("")


def read_union(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """All parquet files that match a pattern, each row with its file in source_file."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(pattern).select("*", F.col("_metadata.file_path").alias("source_file"))


def json_rows(payloads: DataFrame, text: str, item: str, code: str = "resultCode", listed: str = "list", good: str = "00") -> DataFrame:
    """Rows of JSON envelopes {code, list}, with the payload's digest; envelopes of another code give none."""
    parsed = F.from_json(F.col(text), f"struct<`{code}`: string, `{listed}`: array<struct<{item}>>>")
    kept = payloads.withColumn("_p", parsed).where(F.col(f"_p.{code}") == good)
    others = [c for c in payloads.columns if c != text]
    return kept.select(*others, F.sha2(text, 256).alias("payload_sha256"), F.inline(f"_p.{listed}"))


def typed_rows(payloads: DataFrame, key: str, text: str, fields: Mapping[str, str]) -> DataFrame:
    """(key, position, fields) of JSON arrays of objects; text that doesn't fit a type is null."""
    items = F.from_json(F.col(text), "array<map<string,string>>")
    rows = payloads.select(key, F.posexplode(items).alias("position", "_m"))
    return rows.select(key, "position", *(F.regexp_replace(F.col("_m")[name], ",", "").try_cast(kind).alias(name) if kind != "string" else F.col("_m")[name].alias(name) for name, kind in fields.items()))


def html_rows(pages: DataFrame, key: str, html: str, width: int) -> DataFrame:
    """(key, table_no, row_no, cells): the rows of the tables of web pages, padded with empty cells to a width.

    For regular tables: no tables within tables and no merged cells.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    tables = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1)
    t = pages.select(key, F.posexplode(tables).alias("table_no", "_t"))
    r = t.select(key, "table_no", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row_no", "_r"))
    cells = F.transform(F.regexp_extract_all("_r", F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), clean)
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(cells))))
    return r.select(key, "table_no", "row_no", padded.alias("cells"))


def labelled_table(pages: DataFrame, key: str, html: str, labels: Sequence[str]) -> DataFrame:
    """(key, row_no, labels...): the rows after a header row with just these labels."""
    rows = html_rows(pages, key, html, len(labels))
    is_head = F.slice("cells", 1, len(labels)) == F.array(*map(F.lit, labels))
    heads = rows.where(is_head).groupBy(key, "table_no").agg(F.min("row_no").alias("_h"))
    body = rows.join(heads, [key, "table_no"]).where(F.col("row_no") > F.col("_h"))
    return body.select(key, "row_no", *(F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(labels)))


def disclosure_record(pages: DataFrame, key: str, html: str, titles: Sequence[str], total: str) -> DataFrame:
    """(key, titles..., availability) from title/value cells of each page's only row that starts with `total`."""
    rows = html_rows(pages, key, html, len(titles) + 1)
    hit = rows.where(F.get("cells", F.lit(0)) == total)
    per = hit.groupBy(key).agg(F.count("*").alias("_n"), F.first("cells").alias("_c"))
    out = pages.select(key).distinct().join(per, key, "left")
    state = F.when(F.col("_n").isNull(), "NO_TOTAL").when(F.col("_n") > 1, "SEVERAL_TOTALS").otherwise("AVAILABLE")
    return out.withColumn("availability", state).select(key, *(F.when(F.col("availability") == "AVAILABLE", F.get("_c", F.lit(i))).alias(t) for i, t in enumerate(titles, 1)), "availability")


def crosswalk_pairs(rows: DataFrame, old: str, new: str, keep: Column) -> DataFrame:
    """Distinct pairs of codes of the rows that count; a pair with a missing code is left out."""
    return rows.where(keep).select(F.trim(old).alias(old), F.trim(new).alias(new)).where(f"{old} <> '' and {new} <> ''").distinct()


def read_polygons(spark: SparkSession, path: str, ident: str, crs: str, dated: str) -> DataFrame:
    """(ident, ring): polygons with columns crs and base_date that must be the expected ones."""
    df = spark.read.parquet(path)
    require_columns(df, [ident, "ring", "crs", "base_date"])
    odd = df.where((F.col("crs") != crs) | (F.col("base_date") != dated) | F.col("crs").isNull() | F.col("base_date").isNull()).limit(1).collect()
    if odd:
        raise GuardError(f"polygon {odd[0][ident]} is not {crs} of {dated}")
    return df.select(ident, "ring")


def decoded(files: DataFrame, legacy: str = "MS949") -> DataFrame:
    """binaryFile rows with `text`: UTF-8 where the bytes are that, else a legacy encoding."""
    utf8 = F.col("content").cast("string")
    return files.withColumn("text", F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode("content", legacy)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compared_manifests(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state): UNCHANGED, CHANGED, ADDED or REMOVED."""
    b, a = before.select("path", F.col("sha256").alias("_b")), after.select("path", F.col("sha256").alias("_a"))
    state = F.when(F.col("_b").isNull(), "ADDED").when(F.col("_a").isNull(), "REMOVED").when(F.col("_a") == F.col("_b"), "UNCHANGED").otherwise("CHANGED")
    return b.join(a, "path", "full").select("path", state.alias("state"))
