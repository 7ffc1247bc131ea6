"""Removal of lines that a large share of a site's pages hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import query, table
from corroborate.session import stage

#: What is no text in a page, and all other tags.
_HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
_TAG = r"<[^>]*>"
_HOST = r"^[a-zA-Z]+://([^/:?#]+)"


def html_lines(html: Column) -> Column:
    """The text between the tags of a page, a line each, without blank ones."""
    text = F.regexp_replace(F.regexp_replace(html, _HIDDEN, "\n"), _TAG, "\n")
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def host(url: Column) -> Column:
    """The host of an address in lower case; null if it has none."""
    found = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(found != "", found)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def drop_boilerplate(pages: DataFrame, site: Column, lines: Column, ratio: float = 0.1, least: int = 3, keep_whole: bool = False) -> DataFrame:
    """``pages`` with ``site``, ``lines`` and ``kept``: without the lines that ``least`` pages of the site hold, and more than ``ratio`` of them.

    A page counts once for each of its different lines, whatever their number.
    Lines are compared by a 64-bit hash of their trimmed text. A line on fewer
    than ``least`` pages is no boilerplate, so sites of one or two pages keep
    everything, as do pages without a site. Blank lines are kept and not
    counted. With ``keep_whole`` a page that would lose its last line is left
    as it is: a copy, which near-duplicate removal is for. Columns of ``pages``
    named ``site``, ``lines`` or ``kept`` are replaced.

    Line counts are added up within tasks before the shuffle, so a line on a
    third of all pages is one row per task. A site has at most its mean number
    of lines per page divided by ``ratio`` lines to drop; they meet its pages
    as one array. Null lines stay null; repeated rows are pages of their own.
    """
    rows = pages.select(F.struct("*").alias("page"), site.alias("site"), lines.alias("lines"))
    filled = F.filter("lines", lambda line: F.trim(line) != "")
    counts = rows.where("site is not null").select("site", F.explode(F.array_distinct(F.transform(filled, _key))).alias("key")).groupBy("site", "key").agg(F.count("*").alias("n"))
    totals = rows.where("site is not null").groupBy("site").agg(F.count("*").alias("total"))
    common = counts.where(F.col("n") >= least).join(totals, "site").where(f"n > total * {ratio}D")
    # written first: Spark then knows its size, and sends it to the pages only where it is small
    marks = stage(common.groupBy("site").agg(F.collect_list("key").alias("marks")).withColumnRenamed("site", "of"), "boilerplate")
    joined = rows.join(marks, rows["site"] == marks["of"], "left")
    kept = F.when(F.col("marks").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda line: (F.trim(line) == "") | ~F.array_contains("marks", _key(line))))
    if keep_whole:
        kept = F.when(F.exists(kept, lambda line: F.trim(line) != ""), kept).otherwise(F.col("lines"))
    own = [F.col(f"page.`{c}`").alias(c) for c in pages.columns if c not in ("site", "lines", "kept")]
    return joined.select("page", "site", "lines", kept.alias("kept")).select(*own, "site", "lines", "kept")


def clean_documents(docs: DataFrame, text_col: str = "text", site_col: str = "source", ratio: float = 0.1, least: int = 3) -> DataFrame:
    """The columns of ``docs`` with lines common to a site taken out of the text, and ``n_chars`` to match; no row goes."""
    plain = docs.select(F.struct("*").alias("row"))
    found = drop_boilerplate(plain, F.col(f"row.`{site_col}`"), F.split(F.col(f"row.`{text_col}`"), "\n"), ratio, least, keep_whole=True)
    text = F.array_join("kept", "\n")
    columns = []
    for name in docs.columns:
        if name == text_col:
            columns.append(text.alias(name))
        elif name == "n_chars":
            columns.append(F.coalesce(F.length(text), F.col("row.n_chars")).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(f"row.`{name}`").alias(name))
    return found.select(*columns)


LINES_SQL = r"""
WITH p AS (
    SELECT page_id, nullif(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '') AS host,
           list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
    FROM pages),
l AS (SELECT host, unnest(list_distinct(lines)) AS line FROM p WHERE host IS NOT NULL),
c AS (SELECT host, line, count(*) AS n FROM l GROUP BY host, line),
t AS (SELECT host, count(*) AS total FROM p WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT c.host, list(line) AS marks FROM c JOIN t USING (host) WHERE n >= 3 AND n > total * 0.1::DOUBLE GROUP BY c.host),
k AS (SELECT page_id, p.host, lines, CASE WHEN marks IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(marks, x)) END AS kept FROM p LEFT JOIN m ON p.host = m.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_removed, array_to_string(kept, chr(10)) AS text FROM k
"""


@query("op3_lines", LINES_SQL)
def op3_lines(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = drop_boilerplate(pages, host(F.col("url")), html_lines(F.col("html")))
    return found.select("page_id", F.col("site").alias("host"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("text"))
