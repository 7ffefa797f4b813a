"""Queries over page tables and JSON columns, and of work selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers as S
from ..sources.sinks import next_batch
from .registry import query, table


@query("json_envelopes", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256('{\"resultCode\":\"00\",\"list\":[' || props || ']}') AS payload_sha256 FROM events WHERE event_type <> 'error'")
def json_envelopes(spark, d):
    """IO5, IO6: rows of JSON envelopes with the digest of their payload; a bad result code gives none."""
    code = F.when(F.col("event_type") == "error", "99").otherwise("00")
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"resultCode":"'), code, F.lit('","list":['), "props", F.lit("]}")).alias("payload"))
    return S.json_rows(e, "payload", "k: bigint").select("event_id", "k", "payload_sha256")


@query("page_cells", r"SELECT page_id, COUNT(*) AS items FROM (SELECT page_id, UNNEST(regexp_extract_all(html, '<li[^>]*>', 0)) AS x FROM pages) GROUP BY 1")
def page_cells(spark, d):
    """IO7, IO8: elements of web pages as rows."""
    p = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<li[^>]*>"), 0)).alias("x"))
    return p.groupBy("page_id").agg(F.count("*").alias("items"))


@query("html_tables", "SELECT c_custkey AS page, 1 AS row_no, c_name AS name, c_mktsegment AS segment FROM customer")
def html_tables(spark, d):
    """IO7: the rows under a labelled header in tables of web pages; here each customer's page has one."""
    cell = lambda tag, c: F.concat(F.lit(f"<{tag} class='x'>"), c, F.lit(f"</{tag}>\n"))
    row = lambda tag, *cells: F.concat(F.lit("<tr>"), *(cell(tag, c) for c in cells), F.lit("</tr>"))
    c = table(spark, d, "customer")
    html = F.concat(F.lit("<html><table>"), row("th", F.lit("name"), F.lit(" <b>segment</b> ")), row("td", F.col("c_name"), F.col("c_mktsegment")), F.lit("</table></html>"))
    return S.labelled_table(c.select(F.col("c_custkey").alias("page"), html.alias("html")), "page", "html", ["name", "segment"])


@query("code_pairs", "SELECT DISTINCT p_brand AS old, p_type AS new FROM part WHERE p_size <= 5")
def code_pairs(spark, d):
    """IO9: distinct pairs of codes from a crosswalk."""
    return S.crosswalk_pairs(table(spark, d, "part").withColumnsRenamed({"p_brand": "old", "p_type": "new"}), "old", "new", F.col("p_size") <= 5)


@query("work_selection", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, MIN(o_orderstatus) AS status, COUNT(*) AS attempts FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE status IS NULL OR (status <> 'F' AND status <> 'O') OR (status = 'O' AND attempts < 6)")
def work_selection(spark, d):
    """X9, IO15: what is left to do, with a limit on repeated attempts."""
    state = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderstatus").alias("status"), F.count("*").alias("attempts"))
    return next_batch(table(spark, d, "customer").select("c_custkey"), state, "c_custkey", ("F",), ("O",), 6)


@query("table_manifest", "SELECT 'orders' AS name, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS checksum FROM orders UNION ALL SELECT 'customer', COUNT(*), CAST(SUM(c_custkey) AS BIGINT) FROM customer")
def table_manifest(spark, d):
    """IO16, G9: rows and checksums of tables to be released."""
    one = lambda name, key: table(spark, d, name).agg(F.count("*").alias("n"), F.sum(key).alias("checksum")).select(F.lit(name).alias("name"), "n", "checksum")
    return one("orders", "o_orderkey").unionByName(one("customer", "c_custkey"))
