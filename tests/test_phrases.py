"""Phrases and rosters in one pass against plain substring tests."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import let
from tidemark.functions.phrases import Phrases
from tidemark.operators import entity


def test_phrases_are_substrings(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab 금é") for _ in range(rng.randrange(1, n)))
    lexicon = {word(6): rng.randrange(-3, 9) for _ in range(60)} | {"": 7, "aa": 1, "aaa": 2}
    groups = {f"g{k}": rng.sample(list(lexicon), 4) for k in range(9)} | {"none": []}
    known = Phrases(lexicon, *groups.values())
    texts = [None, "", "aaaa", *(word(40) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("h", known.hits(F.col("t")))
    h = F.col("h")
    got = df.select("k", known.weight(h, lexicon).alias("w"), let(h, lambda x: known.labels(x, groups)).alias("g"), known.any(h, list(lexicon)[:5]).alias("a"), known.found(h, [(p, F.lit(p)) for p in lexicon]).alias("f")).collect()
    for r in got:
        t = texts[r.k]
        there = [p for p in lexicon if t is not None and p in t]
        assert r.w == sum(lexicon[p] for p in there) and r.f == there and r.a == any(p in there for p in list(lexicon)[:5])
        assert r.g == [g for g, ps in groups.items() if any(p in there for p in ps)]


@pytest.mark.parametrize("piece", [20_000, 7])
def test_rosters_of_any_size(spark, monkeypatch, piece):
    monkeypatch.setattr(entity, "ROSTER_SLICE", piece)
    rng = random.Random(3)
    names = ["Ann Lee", "Bob Stone", "Ann Stone", "Li", "Park", "김", "Stone"]
    people = [(100 - i, f"{rng.choice(names)}{'' if rng.random() < 0.4 else i}", rng.choice(["김", "박", ""]), f"role {i % 5}", None, rng.choice(["x|y z", "", None, "Q|q"])) for i in range(40)]
    roster = entity.roster(spark.createDataFrame(people, "member_id long, name_en string, name_ko string, role_en string, role_ko string, aliases string"))
    said = [None, "", *(p[1] for p in people[:9]), "nobody"]
    rows = [(k, rng.choice(said), rng.choice([None, "on stone", "role 3 speaks"]), " ".join(rng.choice([*names, "q", "y z", "word"]) for _ in range(rng.randrange(6))), f"http://x.org/{rng.choice(['park', 'z'])}") for k in range(120)]
    df = spark.createDataFrame(rows, "seq long, speaker_raw string, title string, text string, url string")
    terms = {r.member_id: (r.name_en.lower(), r.name_ko.lower(), [t.lower() for t in r.terms]) for r in roster.collect()}
    for r in entity.attribute(df, roster).collect():
        hay = " ".join(x or "" for x in (r.speaker_raw, r.title, r.text, r.url)).lower()
        points = {i: sum((10 if t in (en, ko) else 3) for t in own if t in hay) + (20 if en and en in (r.speaker_raw or "").lower() else 0) for i, (en, ko, own) in terms.items()}
        most = max(points.values())
        want = (min(i for i, n in points.items() if n == most), most, "FOMC") if most else (None, 0, "UNMATCHED")
        assert (r.member_id, r.match_score, r.member_group) == want
