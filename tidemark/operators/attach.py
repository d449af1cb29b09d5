"""Rows with what is known of their entity: roster attributes, crossed dates, signals with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_filled
from . import signals

#: Columns of momentum on events and what they are without a result.
MOMENTUM_DEFAULTS = {"momentum_label": "INSUFFICIENT", "momentum_confidence": "INSUFFICIENT", "momentum_recent_count": 0, "momentum_previous_count": 0, "momentum_total_important_count": 0}
#: Columns of a cross check on articles and what they are without a result.
CROSS_DEFAULTS = {"speech_sample_count": 0, "news_label": "INSUFFICIENT", "news_article_count": 0, "news_usable_count": 0, "news_cluster_count": 0, "news_confidence": "LOW", "cross_check": "NEWS_INSUFFICIENT"}
#: Columns of all signals on events and what they are without a result.
EVENT_DEFAULTS = {
    "model_stance": "INSUFFICIENT", "model_confidence": "INSUFFICIENT", "model_evidence_count": 0, "recent_signal": "INSUFFICIENT", "recent_signal_confidence": "INSUFFICIENT",
    "aux_speech_label": "INSUFFICIENT", "aux_speech_count": 0, "recent_news_label": "INSUFFICIENT", "recent_news_confidence": "LOW", "recent_news_usable_count": 0,
    "final_stance": "INSUFFICIENT", "final_confidence": "INSUFFICIENT", "final_model_weight": 0.0, "final_recent_weight": 0.0, "final_signal_conflict": False, "final_reason": signals.REASONS["none"],
    **MOMENTUM_DEFAULTS, "news_count": 0, "news_usable_count": 0, "news_label": "INSUFFICIENT", "news_confidence": "LOW",
}


def attach_member(articles: DataFrame, members: DataFrame, key: str = "member_id") -> DataFrame:
    """Roster attributes on articles found for a member by a search, which makes the match certain."""
    fields = {"member_name_en": "name_en", "member_name_ko": "name_ko", "member_role_en": "role_en", "member_role_ko": "role_ko", "member_voter": "voter"}
    people = members.select(key, *(F.col(c).alias(n) for n, c in fields.items() if c in members.columns))
    kept = [c for c in articles.columns if c not in {*fields, "member_match_score", "speaker_raw", "source", "source_type"}]
    out = articles.select(*kept).join(people, key, "left")
    return out.withColumns({"member_match_score": F.lit(100), "speaker_raw": F.col("member_name_en"), "source": F.lit("Yonhap Infomax"), "source_type": F.lit("INFOMAX")})


def crossed_dates(df: DataFrame, found: Column) -> DataFrame:
    """published_at and date, each filled with a date found in the article where it is missing, neither overwritten."""
    return df.withColumns({c: F.coalesce(first_filled(F.col(c)), found) for c in ("published_at", "date")})


def own_momentum(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Every row with the momentum of the list that it is in, here its `member`."""
    return attach_momentum(df, signals.momentum(df, digits))


def attach_momentum(df: DataFrame, results: DataFrame) -> DataFrame:
    r = results.select(
        "member", "momentum_score", "momentum_label", "momentum_confidence", F.col("recent_avg").alias("momentum_recent_avg"), F.col("previous_avg").alias("momentum_previous_avg"),
        F.col("recent_count").alias("momentum_recent_count"), F.col("previous_count").alias("momentum_previous_count"), F.col("important_count").alias("momentum_total_important_count"),
    )
    return filled(df.join(r, "member", "left"), MOMENTUM_DEFAULTS)


def attach_cross_checks(df: DataFrame, results: DataFrame) -> DataFrame:
    """Articles with their member's cross check of speech and news."""
    return filled(df.join(results, "member", "left"), CROSS_DEFAULTS)


def filled(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in defaults.items() if c in df.columns})


def settled_stance(current: DataFrame) -> DataFrame:
    """current_stance() where having no score counts as a neutral 0."""
    score_ = F.coalesce("speech_score", F.lit(0.0))
    return current.select("member", score_.alias("speech_score"), F.when(F.col("speech_score").isNull(), "NEUTRAL").otherwise(F.col("speech_label")).alias("speech_label"), "sample_count")
