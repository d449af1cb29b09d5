"""The pipeline's stages on a small table, each held against a plain model of what it must decide."""

import random
import zlib

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.queries import tokenizer_path

from .test_operators import SCHEMA, WORD, brute_links, labelled


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of which it is known which are toxic (1), junk (2), near copies or share passages, and labels of some."""
    rng = random.Random(6)
    normal = labelled(4)[2]
    passage = [f"{rng.choice(normal)}{k}" for k in range(60)]
    rows, kinds = [], {}
    for k in range(420):
        w, kind = [rng.choice(normal) + rng.choice(["", "", "s", "er"]) for _ in range(rng.randrange(30, 80))], 0
        if k % 7 == 0:
            kind = 1
            for _ in range(4):
                w.insert(rng.randrange(30), rng.choice(["idiot", "stupid", "moron", "trash"]))
        elif k % 7 == 1:
            kind, w = 2, [x + rng.choice(["%%%", "###", "|"]) for x in w]
        elif k % 5 == 0:
            w[10:10] = passage
        if kind == 0 and k % 11 == 0 and k > 20:
            w = (rows[k - 3][1] if kinds[k - 3] == 0 else " ".join(w)).split()
            w[-1] = "changed"
        rows.append((k, " ".join(w), "en", f"s{k % 4}", len(" ".join(w))))
        kinds[k] = kind
    for k, t in ((600, None), (601, ""), (602, rows[2][1]), (603, rows[2][1])):
        rows.append((k, t, None, None, None))
        kinds[k] = 0
    sf = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.withColumn("extra", F.lit(1)).repartition(3).write.parquet(f"{sf}/documents.parquet")
    labels = spark.createDataFrame([(k, int(kinds[k] != 2), int(kinds[k] == 1)) for k in range(420) if k % 3], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{sf}/labels.parquet")
    return sf, kinds


def plain_repeats(docs):
    """Kept words of each document, by windows of 13 words that start in a smaller one."""
    words = {i: WORD.findall(t or "") for i, t in docs.items()}
    least, out = {}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - 12):
            least.setdefault(tuple(words[i][p : p + 13]), i)
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - 12):
            if least[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def test_stages_equal_plain_models(spark, corpus):
    from tokenizers import Tokenizer

    sf, kinds = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "near copies", "repeated passages", "packing"]
    state = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == list(cp.COLUMNS)
        state[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(state["toxicity"]) == {k for k, kind in kinds.items() if kind != 1}
    assert set(state["quality"]) - {600, 601} == {k for k, kind in kinds.items() if kind == 0} - {600, 601}
    classes = brute_links({i: WORD.findall(t or "") for i, t in state["quality"].items()})
    assert set(state["near copies"]) == {c for c, _ in classes.values()} < set(state["quality"])
    want = plain_repeats(state["near copies"])
    assert {i: t or "" for i, t in state["repeated passages"].items()} == want and any(want[i] != " ".join((t or "").split()) for i, t in state["near copies"].items())
    assert docs.filter(F.length(F.coalesce("text", F.lit(""))) != F.col("n_chars")).count() == 0
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in want.items()}
    for packed in (cp.STAGES[-1][1](spark, docs, sf), cp.run(spark, sf)):
        seen = {}
        for r in packed.collect():
            x = ids[r.doc_id][r.start : r.start + r.length]
            assert len(x) == r.length and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
            seen.setdefault(r.doc_id, []).append((r.start, r.length))
        assert set(seen) == set(ids)
        for i, parts in seen.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == len(ids[i])


def test_repeated_and_missing_ids(spark, corpus):
    sf, _ = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id in (2, 3, 4, 9)")
    docs = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == list(cp.COLUMNS) and docs.count() > 0
    assert docs.count() <= 4  # one of each text
    assert cp.STAGES[-1][1](spark, docs, sf).count() > 0


def test_empty(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").filter("false")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, corpus[0]).count() == 0
