"""URL filters of dated lists, evaluated as of each capture's fetch time.

List entries are dated additions and removals. They become validity intervals,
``[valid_from, valid_to)``, and a capture is blocked where one of its keys, the
host, any parent domain or a path prefix, has a blocking interval that holds its fetch
time. DataFrame operations only: the keys of both sides meet in an equality
join with the interval as a further condition, and hosts of many captures are
split by salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
FOREVER = "9999-12-31"


def validity(entries: DataFrame) -> DataFrame:
    """``pattern, category, valid_from, valid_to`` from ``pattern, category, action, day``.

    An ``add`` opens an interval that the pattern's and category's next entry on
    a later day ends; a ``remove`` ends the open one. Entries of one day count
    once, a ``remove`` over an ``add``. Patterns hold hosts in lower case. A second ``add`` changes nothing but where
    the interval is cut. Rows with a null field or another action are left out.
    """
    sound = entries.select(
        F.trim("pattern").alias("pattern"), "category", "action", F.col("day").cast("date").alias("day")).where(
        "pattern is not null and category is not null and day is not null and action in ('add', 'remove')")
    daily = sound.groupBy("pattern", "category", "day").agg(F.max("action").alias("action"))
    # One window a pattern and category: as many rows as that pattern has dated changes.
    order = Window.partitionBy("pattern", "category").orderBy("day")
    return daily.withColumn("next", F.lead("day").over(order)).where("action = 'add'").select(
        "pattern", "category", F.col("day").alias("valid_from"),
        F.coalesce("next", F.to_date(F.lit(FOREVER))).alias("valid_to"))


def url_parts(url: str = "url") -> dict[str, "F.Column"]:
    """Host without user, port, case and leading www., and the path without query and fragment."""
    rest = F.regexp_replace(F.trim(F.col(url)), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    return {"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)}


def url_keys(host: str = "host", path: str = "path") -> "F.Column":
    """Patterns that may name a URL: the host, its parent domains of two labels or
    more, and the host with each path prefix that ends at a slash or is the whole path."""
    labels = F.split(F.col(host), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, n), "."))
    steps = F.split(F.col(path), "/")
    m = F.size(steps)
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.concat(
        F.col(host), F.array_join(F.slice(steps, 1, i), "/"), F.when(i < m, F.lit("/")).otherwise("")))
    prefixes = F.when(F.col(path) != "", prefixes).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(domains, prefixes))


def url_filters(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """``page_id, host, fetched, categories, blocked`` of every capture row.

    ``captures`` has ``page_id``, ``url`` and ``fetched`` (a date); further columns
    are ignored. ``categories`` are the sorted categories of the entries active at
    the fetch, none of them twice. Every row is judged by its own URL and date, whatever
    its key, which may be null or stand in several rows. A null url or date meets
    nothing. Empty tables give no rows, or nothing blocked.
    """
    # Host and path become plain columns here, so that the keys do not parse the URL again.
    parsed = captures.select(F.col(key).alias("page_id"), F.col("fetched").cast("date").alias("fetched"),
                             *[c.alias(k) for k, c in url_parts().items()])
    # What a capture meets follows from host, path and date; copies of one are judged once.
    own = ["host", "path", "fetched"]
    asked = parsed.where("host <> '' and fetched is not null").select(*own, F.explode(url_keys()).alias("pattern")).withColumn(
        "salt", F.pmod(F.xxhash64("path", "fetched"), F.lit(SALTS)).cast("int"))
    listed = validity(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = asked.join(listed, ["pattern", "salt"]).where("fetched >= valid_from and fetched < valid_to")
    found = met.groupBy(*own).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    return parsed.join(found, own, "left").select(
        "page_id", "host", "fetched",
        F.array_join(F.coalesce("categories", F.array().cast("array<string>")), ",").alias("categories"),
        F.col("categories").isNotNull().alias("blocked"))


def derived_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch date spread over three years by their id."""
    day = F.expr("date_add(date'2022-01-01', cast(pmod(page_id * 7919, 1096) as int))")
    return pages.select("page_id", "url", day.alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, domains and paths.

    About every seventh host, and the URL of every fortieth page, is listed; each
    is removed some time later, and a part of them is added again.
    """
    parsed = pages.select("page_id", *[c.alias(k) for k, c in url_parts().items()]).where("host <> ''")
    code = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    hosts = parsed.select(F.col("host").alias("pattern")).distinct().where(code("pattern") % 7 == 0).withColumn(
        "category", F.when(code("pattern") % 2 == 0, "adult").otherwise("gambling"))
    paths = parsed.where("page_id % 40 = 0 and path <> ''").select(
        F.concat("host", "path").alias("pattern")).distinct().withColumn("category", F.lit("takedown"))
    base = hosts.union(paths).withColumn("code", code("pattern"))
    first = F.expr("date_add(date'2022-01-01', cast(code % 500 as int))")
    return base.select("pattern", "category", F.explode(F.array(
        F.struct(F.lit("add").alias("action"), first.alias("day")),
        F.struct(F.lit("remove").alias("action"), F.date_add(first, F.expr("cast(30 + code % 300 as int)")).alias("day")),
        F.struct(F.when(F.col("code") % 3 == 0, "add").otherwise("remove").alias("action"),
                 F.date_add(first, F.expr("cast(400 + code % 100 as int)")).alias("day")))).alias("e")).select(
        "pattern", "category", "e.*")
