"""Duplicate removal and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import first_filled
from .signals import best_per_key


def best_per_url(df: DataFrame, quality: Column, url: str = "url") -> DataFrame:
    return best_per_key(df, url, quality)


def by_normal_url(df: DataFrame, url: str = "url") -> DataFrame:
    """The first row of each URL without regard to case and closing slashes."""
    key = F.rtrim(F.lower(F.trim(F.col(url))), F.lit("/"))
    w = W.partitionBy(key).orderBy("seq")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def distinct_paragraphs(text: Column, least: int = 20) -> Column:
    """Lines of at least `least` characters, the first of those alike but for case, joined again."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), lambda x: F.trim(x)), lambda p: F.length(p) >= least)
    keys = F.transform(lines, F.lower)
    kept = F.filter(F.transform(lines, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: F.array_position(keys, F.lower(x["p"])) == x["i"] + 1)
    return F.array_join(F.transform(kept, lambda x: x["p"]), "\n")


def identity(url: Column, member: Column, date: Column, title: Column) -> Column:
    """A trimmed URL, else member|date|title."""
    return F.coalesce(F.nullif(F.trim(url), F.lit("")), F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (member, date, title))))


def upsert(old: DataFrame, new: DataFrame, key: Column, date: str = "published_at") -> DataFrame:
    """New rows take the places of old ones of the same identity; newest dates first, then the places."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True).withColumn("_key", key)
    rank = W.partitionBy("_key").orderBy(F.col("_new").desc(), F.col("seq").desc())
    place = W.partitionBy("_key")
    out = both.withColumn("_place", F.min(F.struct("_new", "seq")).over(place)).withColumn("_rn", F.row_number().over(rank)).filter("_rn = 1")
    return out.orderBy(F.coalesce(F.col(date), F.lit("")).desc(), "_place").drop("_new", "_key", "_place", "_rn")


def recent_feed(items: DataFrame, as_of: Column, days: int = 14, most: int = 320) -> DataFrame:
    """Recent dated items, one of each identity, with shortened summaries that do not repeat the title."""
    from ..functions.columns import shortened

    rows = items.filter(F.col("published").isNotNull() & (F.to_date("published") >= F.date_sub(as_of, days)))
    rows = rows.withColumn("_key", identity(F.col("url"), F.col("member"), F.col("published"), F.col("title")))
    first = rows.withColumn("_rn", F.row_number().over(W.partitionBy("_key").orderBy("seq"))).filter("_rn = 1").drop("_rn", "_key")
    summary = F.when(F.trim("summary") == F.trim("title"), "").otherwise(shortened(F.coalesce("summary", F.lit("")), most))
    return first.withColumn("summary", summary).orderBy(F.col("published").desc(), "seq")


def source_types(source_type: Column, url: Column, source: Column) -> Column:
    """A given type, else the board by its address or name, else a regional bank."""
    board = F.lower(F.coalesce(url, F.lit(""))).contains("federalreserve.gov") | F.lower(F.coalesce(source, F.lit(""))).contains("board of governors")
    return F.coalesce(first_filled(source_type), F.when(board, "FED_BOARD").otherwise("REGIONAL_FED"))


def strip_suffix(title: Column, source: Column) -> Column:
    """A headline without ` - Outlet` at its end."""
    return F.when(F.endswith(title, F.concat(F.lit(" - "), source)), F.substring(title, F.lit(1), F.length(title) - F.length(source) - 3)).otherwise(title)
