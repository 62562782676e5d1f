"""Removal of boilerplate lines that spread over many sites.

The number of distinct sites of a line is estimated by HyperLogLog sketches, one per line
hash, merged by aggregation.  Lines whose estimate lies near the threshold get an exact
distinct count, so the decision is that of exact counts unless a sketch is off by more
than six standard errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecohort.storage import written

#: A line found on this many sites or more is removed everywhere.
MIN_SITES = 4
LG_K = 12
_ERROR = 1.04 / 2 ** (LG_K / 2)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(line: Column, min_chars: int) -> Column:
    """Hash of a line without outer blanks; null if it is too short to be removed."""
    trimmed = F.trim(line)
    return F.when(F.length(trimmed) >= min_chars, F.xxhash64(trimmed))


def widespread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = 1,
                     text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Hashes (``line``) of lines that occur on at least ``min_sites`` sites; null is no site."""
    hashes = F.filter(
        F.array_distinct(F.transform(_lines(F.col(text_col)), lambda x: _hash(x, min_chars))), lambda h: h.isNotNull()
    )
    seen = docs.where(F.col(site_col).isNotNull()).select(
        F.xxhash64(F.col(site_col)).alias("site"), F.explode(hashes).alias("line")
    )
    seen = written(seen.groupBy("line", "site").agg(F.lit(1).alias("one")).drop("one"), "line_sites")
    sketches = seen.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    guess = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(1.0, 6 * _ERROR * min_sites)
    guess = written(guess.where(F.col("sites") >= min_sites - margin), "line_spread")
    near = guess.where(F.col("sites") <= min_sites + margin).select("line")
    exact = (
        seen.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites"))
        .where(F.col("sites") >= min_sites).select("line")
    )
    return exact.union(guess.where(F.col("sites") > min_sites + margin).select("line"))


def remove_widespread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = 1,
                            id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, text without widespread lines.

    Lines are compared without outer blanks (tabs and carriage returns count as text); lines under ``min_chars`` characters always
    stay, by default blank ones only.  A null text stays null with no lines; a text that loses all lines is empty.  Rows
    without a site lose lines, but count for no line.  Repeated rows are treated alike; a null
    id is an id like any other.  Other columns are not read.
    """
    wide = written(widespread_lines(docs, min_sites, min_chars, text_col, site_col), "wide_lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("_row"))
    found = (
        rows.select("_row", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: _hash(x, min_chars)))).alias("line"))
        .join(wide, "line", "left_semi")  # both sides are shuffled, so a line of a third of all rows can be split
        .groupBy("_row").agg(F.collect_set("line").alias("_gone"))
    )
    gone = F.coalesce("_gone", F.array().cast("array<bigint>"))
    marked = rows.join(found, "_row", "left").withColumn("_gone", gone).withColumn("_all", _lines(F.col("text")))
    stays = lambda x: ~F.coalesce(F.array_contains("_gone", _hash(x, min_chars)), F.lit(False))
    marked = marked.withColumn("_kept", F.filter("_all", stays))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_all")).cast("bigint")
    return marked.select(
        "doc_id", n.alias("n_lines"), (F.size("_all") - F.size("_kept")).cast("bigint").alias("n_removed"),
        F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n")).alias("text"),
    )


SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT source, trim(unnest(lines), ' ') AS line FROM d WHERE source IS NOT NULL),
w AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM x WHERE trim(line, ' ') NOT IN (SELECT line FROM w) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(lines) END AS n_lines, len(lines) - coalesce(n, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(t, '') END AS text
FROM d LEFT JOIN k USING (doc_id)
"""
