"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate.

A page's lines are the texts between block-level tags of its HTML, without scripts, styles and comments, trimmed and
with white space collapsed. For each host and line, the pages with the line are divided by the host's pages. The page
whose line is judged counts for neither, as it says nothing about repetition: (n - 1) / (N - 1), which is n / N for all but
small hosts and drops nothing of a host's only page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import cut, only, table

#: Share of a host's other pages from which a line is boilerplate.
RATIO = 0.1
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = r"(?i)\n|</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
TAG = r"<[^<>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
SPACES = r"[ \t\r\n\f]+"
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; the empty string where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def lines_of(html: Column) -> Column:
    """The lines of a page in order, empty ones left out."""
    plain = F.regexp_replace(html, HIDDEN, "")
    lines = F.transform(F.split(plain, BLOCK), lambda x: _text(x))
    return F.coalesce(F.filter(lines, lambda x: x != ""), F.array().cast("array<string>"))


def _text(x: Column) -> Column:
    x = F.regexp_replace(x, TAG, "")
    for a, b in ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, SPACES, " "))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """page_id, host, n_lines, n_dropped and text (the lines that stay, joined by line feeds) for every row of pages.

    1. One pass shreds the pages into lines, which are written to the shared folder.
    2. Host and hash of each page's distinct lines are counted: partial counts, then an exchange of 16 bytes for each line
       that a partition has seen of a host; no text moves. Lines on more than ``ratio`` of the other pages
       make one array of hashes a host: about a page's lines / ratio at most, however many pages it has.
    3. These arrays are written, so their size decides whether they are broadcast or joined by host, where adaptive
       skew handling splits a hot host's pages. A page's lines that are among them are found by one hash lookup a line.

    A line counts once a page, and each row is a page, repeated ones too. A null or empty page has no lines and an
    empty text; a null or unreadable URL has the empty host, whose pages are a site like another. A ratio that is
    met exactly doesn't drop; ties have no effect; other columns are left out; no rows give no rows.
    """
    pages = only(pages, "page_id", "url", "html")
    shredded, _ = cut(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")))
    total = shredded.groupBy("host").agg(F.count("*").alias("n_pages"))
    seen = shredded.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    common = seen.where("n > 1").join(total, "host").where(F.col("n") - 1 > F.lit(ratio) * (F.col("n_pages") - 1))
    boilerplate, _ = cut(common.groupBy("host").agg(F.collect_list("line").alias("bad")))
    found = F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), "bad")
    kept = F.when(F.col("found").isNull() | (F.size("found") == 0), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("found", F.xxhash64(x))))
    return (
        shredded.join(boilerplate, "host", "left")
        .withColumn("found", found)
        .withColumn("kept", kept)
        .select("page_id", "host", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_dropped"), F.concat_ws("\n", "kept").alias("text"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "pages"))


def _sql() -> str:
    quoted = {x: "'" + x.replace("'", "''") + "'" for pair in ENTITIES for x in pair}
    text = f"regexp_replace(x, '{TAG}', '', 'g')"
    for a, b in ENTITIES:
        text = f"replace({text}, {quoted[a]}, {quoted[b]})"
    text = f"trim(regexp_replace({text}, '{SPACES}', ' ', 'g'))"
    return f"""
WITH shredded AS (
  SELECT row_number() OVER () AS row_id, page_id, coalesce(regexp_extract(lower(url), '{HOST}', 1), '') AS host,
         list_filter(list_transform(string_split_regex(regexp_replace(html, '{HIDDEN}', '', 'g'), '{BLOCK}'), lambda x: {text}), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS n_pages FROM shredded GROUP BY host),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT row_id, host, unnest(lines) AS line FROM shredded) GROUP BY host, line),
bad AS (SELECT host, line FROM seen JOIN totals USING (host) WHERE n - 1 > {RATIO} * (n_pages - 1)),
flat AS (SELECT row_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM shredded),
kept AS (SELECT row_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM flat ANTI JOIN bad USING (host, line) GROUP BY row_id)
SELECT page_id, host, CAST(coalesce(len(lines), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(lines), 0) - coalesce(n, 0) AS INTEGER) AS n_dropped, coalesce(text, '') AS text
FROM shredded LEFT JOIN kept USING (row_id)
"""


ORACLE_SQL = _sql()
