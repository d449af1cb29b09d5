"""Attribution of texts to a roster of entities."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import alias_list
from ..functions.phrases import found_numbers

#: Roster rows that make one automaton; a larger roster is gone through in slices of so many.
ROSTER_SLICE = 20_000


def search_terms(name_en: Column, name_ko: Column, role_en: Column, role_ko: Column, aliases: Column) -> Column:
    """Distinct terms of an entity in order: names, roles, aliases, and a surname of four letters or more."""
    last = F.element_at(F.split(F.trim(name_en), r"\s+"), -1)
    terms = F.concat(F.array(name_en, name_ko, role_en, role_ko), alias_list(aliases), F.array(F.when(F.length(last) >= 4, last)))
    return F.array_distinct(F.filter(terms, lambda t: t.isNotNull() & (F.trim(t) != "")))


def roster(df: DataFrame) -> DataFrame:
    """A roster with its search terms."""
    return df.withColumn("terms", search_terms(F.col("name_en"), F.col("name_ko"), F.col("role_en"), F.col("role_ko"), F.col("aliases")))


def special_match(rows: list[tuple[str, object]], url: Column, speaker: Column, title: Column, text: Column, text_chars: int = 3000) -> Column:
    """struct(member_id, match_score, member_group) for terms that stand for an entity wherever they occur: 100 in the URL or the
    speaker, 80 in the title or the text's beginning; the first term that fits, null if none."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    body = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, text_chars)))
    found = lambda i, n: F.struct(F.lit(i).alias("member_id"), F.lit(n).alias("match_score"), F.lit("FOMC").alias("member_group"))
    sure = [F.when(low(url).contains(t.lower()) | low(speaker).contains(t.lower()), found(i, 100)) for t, i in rows]
    likely = [F.when(body.contains(t.lower()), found(i, 80)) for t, i in rows]
    return F.coalesce(*sure, *likely)


def attribute(articles: DataFrame, members: DataFrame, key: str = "seq", special: Column | None = None, text_chars: int = 3000) -> DataFrame:
    """articles with member_id, match_score, member_group: the best-scoring entity, the first of the roster among equals.

    All terms of a slice of the roster are one automaton that reads each text once, so the cost of a row grows with what it
    holds, not with the roster; there is no join and no shuffle.  A larger roster is gone through in slices of ROSTER_SLICE.
    special: a struct(member_id, match_score, member_group) that goes before, where not null.
    """
    kind = members.schema["member_id"].dataType
    order = W.orderBy("member_id")  # over the roster, small beside the articles
    numbered = members.withColumn("_slice", F.floor((F.row_number().over(order) - 1) / ROSTER_SLICE).cast("int"))
    person = numbered.select("_slice", "member_id", F.lower("name_en").alias("en"), F.lower("name_ko").alias("ko"), F.transform("terms", F.lower).alias("terms"))
    slices = range(max(1, -(-members.count() // ROSTER_SLICE)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    hay = F.lower(F.concat_ws(" ", text("speaker_raw"), text("title"), F.substring(text("text"), 1, text_chars), text("url")))
    spoken = F.lower(text("speaker_raw"))
    out = articles.withColumn("_hay", hay).withColumn("_said", spoken)
    for k in slices:
        people = person.filter(F.col("_slice") == k).orderBy("member_id").drop("_slice").collect()  # ROSTER_SLICE rows at most
        best = _best_of([tuple(r) for r in people], kind)(F.col("_hay"), F.col("_said"))
        new = F.when(best["s"] > 0, F.struct((-best["s"]).alias("s"), best["m"].alias("m")))
        out = out.withColumn("_best", new if k == 0 else F.least("_best", new))
    found = F.when(F.col("_best.s") < 0, F.struct(F.col("_best.m").alias("member_id"), (-F.col("_best.s")).alias("match_score"), F.lit("FOMC").alias("member_group")))
    none = F.struct(F.lit(None).cast(members.schema["member_id"].dataType).alias("member_id"), F.lit(0).alias("match_score"), F.lit("UNMATCHED").alias("member_group"))
    chosen = F.coalesce(*([special] if special is not None else []), found, none)
    return out.withColumn("_m", chosen).select(*(c for c in articles.columns if c not in ("member_id", "match_score", "member_group")), "_m.*")


def _best_of(people: list[tuple], kind):
    """A function of texts and speakers that gives each row's best entity (m) and its points (s): 10 for a full name and 3 for
    another term in the text, 20 for the English name in the speaker; the first among equals, in the order given."""
    terms: dict[str, dict[int, int]] = {}
    names: dict[str, list[int]] = {}
    for i, (_, en, ko, own) in enumerate(people):
        for t in own:
            points = terms.setdefault(t, {})
            points[i] = points.get(i, 0) + (10 if t in (en, ko) else 3)
        if en:
            names.setdefault(en, []).append(i)
    words, worth = tuple(terms), list(terms.values())
    called, whose = tuple(names), list(names.values())
    ids = [p[0] for p in people]

    @F.arrow_udf(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("m", kind)]))
    def best(hays: pa.Array, spoken: pa.Array) -> pa.Array:
        scores, found = [], []
        for hay, said in zip(hays.to_pylist(), spoken.to_pylist()):
            points: dict[int, int] = {}
            for j in found_numbers(words, hay):
                for i, n in worth[j].items():
                    points[i] = points.get(i, 0) + n
            for j in found_numbers(called, said) if said else ():
                for i in whose[j]:
                    points[i] = points.get(i, 0) + 20
            top = min(((-n, i) for i, n in points.items()), default=(0, None))
            scores.append(-top[0])
            found.append(None if top[1] is None else ids[top[1]])
        return pa.StructArray.from_arrays([pa.array(scores, pa.int32()), pa.array(found, to_arrow_type(kind))], names=["s", "m"])

    return best
