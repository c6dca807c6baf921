"""URL filters with dated lists: a temporal join (op 10).

Additions and removals of a list become validity intervals; a capture is judged by the entries
that were active when it was fetched. A host matches an entry for itself or a parent domain,
the longest entry first. Hosts and fetch times are made distinct before they meet the list, so
a host with a third of all captures costs one row for each time it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
#: (domain, action, date) as a publisher dates them.
ENTRIES = (
    ("spam-farm.example.org", "add", "2024-01-20"),
    ("cheap-pills.example.com", "add", "2024-02-01"),
    ("cheap-pills.example.com", "remove", "2024-05-15"),
    ("cheap-pills.example.com", "add", "2024-08-01"),
    ("www.cheap-pills.example.com", "add", "2024-06-01"),
    ("tionsh.example.net", "add", "2023-11-01"),
    ("tionsh.example.net", "remove", "2024-10-01"),
    ("ththan.example.net", "add", "2024-03-10"),
    ("ththan.example.net", "add", "2024-04-10"),
    ("ththan.example.net", "remove", "2024-07-07"),
    ("casino-bonus.example.net", "add", "2024-01-01"),
)


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL without a trailing dot; null if there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")
    return F.when(found != "", found)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, valid_from, valid_to) from (domain, action, dated): a domain is listed from an
    addition to the next removal, half-open, null if none followed. An addition to a listed
    domain and a removal of an unlisted one change nothing; on one day a removal comes first.
    Entries with a null in any of the three are left out."""
    order = Window.partitionBy("domain").orderBy("dated", F.desc("action"))
    clean = entries.where("domain is not null and dated is not null and action in ('add', 'remove')").select(F.regexp_replace(F.lower("domain"), r"\.$", "").alias("domain"), "action", "dated").distinct()
    turns = clean.withColumn("_last", F.lag("action").over(order)).where("action = 'add' and coalesce(_last, 'remove') = 'remove' or action = 'remove' and _last = 'add'")
    spans = turns.withColumn("valid_to", F.lead("dated").over(order)).where("action = 'add'")
    return spans.where("valid_to is null or valid_to > dated").select("domain", F.col("dated").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, at: str = "fetched") -> DataFrame:
    """``captures`` (url and a time ``at``) plus host, blocked, entry and listed_since.

    A URL without host and a null time match nothing: not blocked, nulls. The list may have
    any size; it joins by domain, as parents of each distinct host.
    """
    taken = [c for c in captures.columns if c.lower() not in ("host", "blocked", "entry", "listed_since")]
    rows = captures.select(*taken, host(F.col("url")).alias("host"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.where(F.col("host").isNotNull() & F.col(at).isNotNull()).select("host", F.col(at).alias("_at")).distinct()
    asked = asked.select("host", "_at", F.explode(parents).alias("domain"))
    active = asked.join(intervals(entries), "domain").where("_at >= valid_from and (valid_to is null or _at < valid_to)")
    best = active.groupBy("host", "_at").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "valid_from")).alias("best"))
    found = best.select("host", F.col("_at").alias(at), F.col("best.domain").alias("entry"), F.col("best.valid_from").alias("listed_since"))
    out = rows.join(found, ["host", at], "left")
    return out.select(*taken, "host", F.col("entry").isNotNull().alias("blocked"), "entry", "listed_since")


def op10_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; they carry no fetch time, so page_id deals them over the days of 2024."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched"))
    values = ", ".join(f"('{d}', '{a}', DATE '{t}')" for d, a, t in ENTRIES)
    out = judge(captures, spark.sql(f"SELECT * FROM VALUES {values} AS t(domain, action, dated)"))
    return out.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "host", "blocked", "entry", F.col("listed_since").cast("string").alias("listed_since"))


OP10_SQL = f"""
WITH raw AS (SELECT * FROM (VALUES {", ".join(f"('{d}', '{a}', DATE '{t}')" for d, a, t in ENTRIES)}) AS t(domain, action, dated)),
turns AS (SELECT *, lag(action) OVER (PARTITION BY domain ORDER BY dated, action DESC) AS last_action FROM raw),
kept AS (SELECT * FROM turns WHERE (action = 'add' AND coalesce(last_action, 'remove') = 'remove') OR (action = 'remove' AND last_action = 'add')),
spans AS (SELECT * FROM (SELECT domain, action, dated AS valid_from, lead(dated) OVER (PARTITION BY domain ORDER BY dated, action DESC) AS valid_to FROM kept) WHERE action = 'add'),
c AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
      nullif(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\\.$', ''), '') AS host FROM pages),
m AS (SELECT c.page_id, c.url, c.fetched, c.host, s.domain, s.valid_from,
      row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.domain) DESC NULLS LAST) AS k
      FROM c LEFT JOIN spans s ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain)) AND c.fetched >= s.valid_from AND (s.valid_to IS NULL OR c.fetched < s.valid_to))
SELECT page_id, url, CAST(fetched AS VARCHAR) AS fetched, host, domain IS NOT NULL AS blocked, domain AS entry, CAST(valid_from AS VARCHAR) AS listed_since FROM m WHERE k = 1
"""
