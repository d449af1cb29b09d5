"""Toxicity in other scripts than Latin: letters are told apart, insults are caught, clean words are left alone."""

import random

import numpy as np
import pytest

from tidemark.llm import toxicity

SCRIPTS = {"cyrillic": ("абвгдежзиклмнопрстуфхцчшщыэюя", ["дурак", "мерзавец"]), "greek": ("αβγδεζηθικλμνξοπρστυφχψω", ["βλακας", "ηλιθιος"]), "hangul": ("가나다라마바사아자차카타파하고노도로모보소오조", ["바보자식", "멍청아"]), "hebrew": ("אבגדהוזחטיכלמנסעפצקרשת", ["טיפששלי", "מטומטם"])}


def test_letters_differ():
    kernel = toxicity.Kernel()
    assert len({tuple(sorted(kernel.features(w).items())) for w in ("дурак", "слово", "мирно", "Слова", "λόγος", "바보자", "平和")}) == 7
    assert kernel.features("ДУРАК") == kernel.features("дурак") and kernel.features("ｉｄｉｏｔ") == kernel.features("idiot")
    code, pos, owner = toxicity.letters(["平和", "ab"])
    assert owner.tolist() == [0] * 5 + [1] * 3 and len(set(pos.tolist())) == 8 and code[0] == 0 and code.max() < 32


def test_splitting_is_one_for_training_and_scoring():
    assert toxicity.units_of("a b c d\te") == ["a b", "c d", "e"]


@pytest.mark.parametrize("script", SCRIPTS)
def test_insults_of_other_scripts_are_caught(spark, script):
    alphabet, insults = SCRIPTS[script]
    rng = random.Random(5)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for k in range(900):
        w, toxic = [rng.choice(words) for _ in range(rng.randrange(20, 60))], k % 6 == 0
        if toxic:
            bad = rng.choice(insults)
            if k % 4 == 0:
                cut = rng.randrange(1, len(bad))
                bad = bad[:cut] + rng.choice("*.-") + bad[cut:]
            w.insert(rng.randrange(len(w)), bad)
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels[:600], "doc_id long, toxic int")
    # fit() itself keeps the labels of the held-out third away
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, toxicity.fit(docs, known)).collect()}
    bad, good = [got[k] for k in range(600, 900) if k % 6 == 0], [got[k] for k in range(600, 900) if k % 6]
    assert np.mean(bad) >= 0.9 and np.mean(good) <= 0.02
