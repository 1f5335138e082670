"""Line dedup by site-relative frequency.

Within a host, a line that stands on more than a share of the host's pages is boilerplate and is
removed from them.  Texts stay whole until the end: only hashes of distinct lines are counted, only
the hashes of boilerplate lines travel back, and each text is rebuilt in its own row.  A page
receives at most as many hashes as its host has boilerplate lines, which is at most the host's mean
number of lines a page divided by the ratio.

A page that boilerplate lines would leave without any text keeps it all: whole-page copies belong
to near-duplicate removal.  The ratio holds for hosts of every size, a line on one page only is never
boilerplate; a `min_pages` above 1 lets hosts of fewer pages keep everything.  Lines that are empty or white space are never counted nor removed.  A null host is a
host of its own; null texts stay null; repeated rows count as pages; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.1
MIN_PAGES = 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line hash, pages, host_pages) of the lines above the ratio."""
    rows = docs.select(F.col(host).alias("h"), F.col(text).alias("t"))
    pages = rows.groupBy("h").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= min_pages)
    lines = rows.select("h", F.explode(F.array_distinct(_lines(F.col("t")))).alias("line")).where("trim(line) <> ''")
    counts = lines.groupBy("h", F.xxhash64("line").alias("a"), F.hash("line").alias("b")).agg(F.count("*").alias("n"))
    # hosts are few against lines; either side may be broadcast by its measured size
    return counts.where("n > 1").join(pages, counts["h"].eqNullSafe(pages["h"])) \
        .where(F.col("n") > ratio * F.col("host_pages")).select(counts["h"], "a", "b", F.col("n").alias("pages"), "host_pages")


def dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
          min_pages: int = MIN_PAGES) -> DataFrame:
    """The documents with boilerplate lines removed, all columns kept.

    Texts that lose a line are found through a digest of host and text, so that repeated rows
    need no key.
    """
    own = F.struct(F.col(host), F.col(text))
    keyed = docs.withColumns({"__a": F.xxhash64(own), "__b": F.hash(own)})
    lines = keyed.select("__a", "__b", F.col(host).alias("__h"), F.explode(F.array_distinct(_lines(F.col(text)))).alias("__line")) \
        .where("trim(__line) <> ''").select("__a", "__b", "__h", F.xxhash64("__line").alias("__la"), F.hash("__line").alias("__lb"))
    common = boilerplate(docs, host, text, ratio, min_pages)
    hits = lines.join(common, lines["__h"].eqNullSafe(common["h"]) & (lines["__la"] == common["a"]) & (lines["__lb"] == common["b"]))
    drops = hits.groupBy("__a", "__b").agg(F.collect_set("__la").alias("__drop"))
    joined = keyed.join(drops, ["__a", "__b"], "left")
    kept = F.filter(_lines(F.col(text)), lambda x: (F.trim(x) == "") | ~F.array_contains("__drop", F.xxhash64(x)))
    left = joined.withColumn("__kept", F.when(F.col("__drop").isNotNull(), F.concat_ws("\n", kept)))
    return left.withColumn(text, F.when(F.trim(F.translate("__kept", "\n", "")) != "", F.col("__kept")).otherwise(F.col(text))) \
        .select(*docs.columns)
