"""Boilerplate lines by their frequency on a site.

Pages are grouped by host.  A line is boilerplate on a host if more than ``ratio`` of the
host's pages contain it and at least ``least_pages`` do (two, so that the only page of a
host does not lose all its lines); such lines are dropped.

Only hashes of lines are shuffled for the counts, combined before the shuffle, so a host
with a third of all pages is counted in parts.  A host has at most (lines a page) / ratio
boilerplate lines, so its list fits a row.  The lists are written once and measured: up to
``BROADCAST_BYTES`` of them go to all tasks and pages stay where they are; more are joined
by host, with copies of a list by the host's share of all pages (``SPLITS``), so that no key
holds more than a bounded share.  A line is looked up in its host's sorted list by halving,
so the work on a page grows with its lines, not with lines times boilerplate lines.

Defined results: a null page text is empty and has no lines; a page without a host keeps
its lines; repeated pages (and rows without a page_id) count as often as they occur; a line
repeated on a page counts once for the ratio and is dropped wherever it stands; a line on
exactly ``ratio`` of the pages stays; pages of any length are read whole; an empty table
gives no rows.  Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.common import stored
from fieldsift.llm.license_scan import LOWER, UPPER

RATIO = 0.3
LEAST_PAGES = 2
#: Lists of up to this size are sent to all tasks.
BROADCAST_BYTES = 8 << 20
#: A key of the join holds about this part of all pages, or ``KEY_PAGES`` if that is more.
SPLITS, KEY_PAGES = 65_536, 64
_HIDDEN = r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->"
_BLOCKS = (
    r"(?i)</?(address|article|aside|blockquote|body|br|div|dd|dl|dt|footer|form|h[1-6]|head|"
    r"header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>"
)
_TAGS = "<[^>]*>"
_HOST = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"
_BLANKS = " \t\x0b\x0c\r"


def page_lines(html: Column) -> Column:
    """The visible lines of a page, without blank ones."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCKS, "\n"), _TAGS, "")
    trimmed = F.transform(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(_BLANKS)))
    return F.filter(trimmed, lambda s: s != "")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.translate(url, UPPER, LOWER), _HOST, 1)
    return F.when(host != "", host)


def boilerplate(pages: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """(host, pages, hashes): a host's page count and the sorted hashes of the lines to drop."""
    known = pages.where("host IS NOT NULL")
    totals = known.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hashes = F.array_distinct(F.transform(page_lines(F.col("html")), lambda s: F.xxhash64(s)))
    counts = (
        known.select("host", F.explode(hashes).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("found"))
        .where(F.col("found") >= least_pages)
    )
    return (
        counts.join(totals, "host")
        .where(F.col("found") > F.col("pages") * F.lit(ratio))
        .groupBy("host")
        .agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list("line")).alias("hashes"))
    )


def holds(ordered: Column, value: Column) -> Column:
    """Is the value in a sorted array that is not empty?  Halves the range once a step."""
    size = F.size(ordered)
    # The last place whose entry is not above the value, found bit by bit from the highest.
    steps = F.sequence(F.length(F.bin(size)) - 1, F.lit(0))

    def step(place: Column, bit: Column) -> Column:
        further = place + F.call_function("shiftleft", F.lit(1), bit)
        return F.when(
            (further <= size) & (F.get(ordered, further - 1) <= value), further
        ).otherwise(place)

    place = F.reduce(steps, F.lit(0), step)
    return F.coalesce(F.get(ordered, place - 1) == value, F.lit(False))


def with_lists(pages: DataFrame, lists: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Every page with its host's list as ``hashes``, null where there is none."""
    held = lists.agg(F.sum(F.size("hashes") * 8 + F.octet_length("host") + 16)).first()[0] or 0
    if held <= broadcast_bytes:
        return pages.join(F.broadcast(lists.select("host", "hashes")), "host", "left")
    share = F.greatest(pages.agg(F.count(F.lit(1)) / SPLITS).scalar(), F.lit(float(KEY_PAGES)))
    counted = lists.withColumn("copies", F.ceil(F.col("pages") / share).cast("int"))
    # At most SPLITS hosts have more than one share, so this side is bounded.
    large = counted.where("copies > 1").select(F.col("host").alias("large"), "copies")
    spot = F.xxhash64("page_id", "html")
    dealt = pages.join(F.broadcast(large), F.col("host") == F.col("large"), "left").select(
        *pages.columns,
        # Pages without a host find no list; keys of their own keep them spread.
        F.when(F.col("host").isNull(), spot)
        .otherwise(F.pmod(spot, F.coalesce("copies", F.lit(1))))
        .alias("copy"),
    )
    spread = counted.select(
        F.col("host").alias("listed"),
        "hashes",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)).alias("number"),
    )
    # A stand-in key for pages without a host, as null keys would all meet in one task.
    key = F.coalesce("host", F.concat(F.lit("\n"), F.col("copy").cast("string")))
    dealt = dealt.withColumn("key", key)
    on = (F.col("key") == F.col("listed")) & (F.col("copy") == F.col("number"))
    return dealt.join(spread, on, "left").select(*pages.columns, "hashes")


def cleaned(
    pages: DataFrame,
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per page: host, line counts and the text that is left."""
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("html").cast("string").alias("html"),
        host_of(F.col("url").cast("string")).alias("host"),
    )
    lists = stored(boilerplate(own, ratio, least_pages), "boilerplate")
    met = with_lists(own, lists, broadcast_bytes)
    kept = F.when(F.col("hashes").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda s: ~holds(F.col("hashes"), F.xxhash64(s)))
    )
    return (
        met.withColumn("lines", page_lines(F.col("html")))
        .withColumn("kept", kept)
        .select(
            "page_id",
            "host",
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
            F.array_join("kept", "\n").alias("text"),
        )
    )


def oracle(ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    """The same in DuckDB SQL, with the text as its md5."""
    blanks = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    nullif(regexp_extract(translate(url, '{UPPER}', '{LOWER}'), '{_HOST}', 1), '') AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(
      coalesce(html, ''), '{_HIDDEN}', '', 'g'), '{_BLOCKS}', chr(10), 'g'), '{_TAGS}', '', 'g'),
      chr(10)), lambda s: trim(s, {blanks})), lambda s: s <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS pages FROM p WHERE host IS NOT NULL GROUP BY host),
c AS (SELECT host, line, count(*) AS found FROM (
    SELECT host, unnest(list_distinct(lines)) AS line FROM p WHERE host IS NOT NULL)
  GROUP BY host, line HAVING count(*) >= {least_pages}),
b AS (SELECT host, list(line) AS gone FROM c JOIN t USING (host)
  WHERE found > pages * {ratio} GROUP BY host),
k AS (SELECT page_id, host, lines, CASE WHEN gone IS NULL THEN lines
    ELSE list_filter(lines, lambda s: NOT list_contains(gone, s)) END AS kept
  FROM p LEFT JOIN b USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
  md5(coalesce(array_to_string(kept, chr(10)), '')) AS text_md5
FROM k"""
