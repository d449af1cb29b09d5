"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A *unit* is a word, or a run of three or more one-letter words joined.  Units are folded to lower case; whatever is no
letter only widens gaps; its beginning counts as a letter.  Letters of all scripts have codes: 26 base letters with some
accented ones apart, other alphabets go round the same codes by their numbers, and signs of scripts with thousands of them are
two codes each.  The kernel counts common subsequences of three and of four letters, each weighted by decay to the power of
the span that it takes in either unit, spans bounded by `reach` letters, so insults with gaps or inserted
characters stay close to their plain form.  Landmarks are units; Nystroem features of the kernel go into a linear
support vector machine.  Because the features are linear in the landmarks' subsequence weights, the trained machine
folds into two tables of subsequence weights, and a unit is scored by one pass over its letters.

Training is on labelled sentences, each as toxic as its most toxic unit: those of clean documents are clean, and of a toxic
document's sentences those are toxic that hold a witness.  Witnesses are at first the units with a telling stem (a run of
letters that toxic documents have and clean ones have not), later also the most toxic unit of a toxic document that has
none.  Over rounds the machine is trained on the units that the sentences stand by, and says anew which they are.
A document's score is a logistic function, calibrated on labelled documents that the machine has not seen, of its
highest unit score and its share of units over the margin.

Labels are learnt from a bounded sample (`max_toxic` and `max_clean` documents, the least by a hash of their id, of at most
`max_bytes` of text); all documents are scored on whole texts.

Edge cases: a null or empty text has no units and scores the calibrated base; labels that are null or of ids without a
document are ignored, and rows without an id are scored but not learnt from; an id labelled twice is toxic if any label is,
and an id with several texts teaches its least one; a text longer than the bound on bytes is scored but teaches nothing;
with no usable label of either class all scores are 0; repeated rows score alike; an empty table gives no rows; only id and
text are read, so other columns cannot clash, and keep_clean() returns all of them.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lean, written
from ._text import mix64, ragged, row_slices, text_buffer

#: Labelled documents that are learnt from at most, by class, and the bytes of their texts.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 2500, 4500, 48 << 20
LANDMARKS, DECAY, REACH = 160, 0.9, 5
#: Unit scores over which units are counted for a document's score.
EDGES = (-0.3, 0.0, 0.3, 0.6, 0.9, 1.1, 1.3)
SLICE_BYTES = 6 << 20
_LETTERS = 32  # 0 a unit's beginning, 1-26 base letters, 27-30 accented vowels and the like, 31 any other sign
_MARKED = ("é", "èêë", "áàâäãåóòôöõ", "íìîïúùûüñçß")
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
#: Letters of other scripts go round these codes by their numbers, so neighbours in an alphabet differ; from WIDE on, where
#: scripts have thousands of signs, a sign is two of them.
_ROUND, _WIDE = 30, 0x2E80
#: Units of a fit, beside all witnesses: frequent and other clean ones from the start, those that a round errs on, and most
#: negatives of a round.  They bound what is learnt from the bounded sample of labelled documents, not what is scored.
FREQUENT_UNITS, OTHER_UNITS, HARD_UNITS, NEGATIVE_UNITS = 3000, 9000, 1500, 30_000


def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    """Of each sign its code, and whether it is two."""
    out, two = np.zeros(0x10000, np.int32), np.zeros(0x10000, bool)
    for c in range(len(out)):
        ch = _LEET.get(chr(c), chr(c))
        base = unicodedata.normalize("NFKD", ch.lower())[:1]
        marked = next((27 + k for k, group in enumerate(_MARKED) if ch.lower() in group), 0) if c < 0x250 else 0
        if marked or "a" <= base <= "z":
            out[c] = marked or ord(base) - 96
        elif c < 0x250:
            out[c] = 31 if ch.isalpha() else 0
        elif ch.isalpha():
            out[c], two[c] = 1 + ord(ch.lower()[0]) % _ROUND, c >= _WIDE
        elif not 0x2000 <= c < 0x2C00:
            out[c] = 0 if unicodedata.category(ch)[0] in "MPZC" else 31
    return out, two


_FOLD, _TWO = _fold_table()


def letters(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter codes, positions, owners) of all units' letters, in order; a unit's beginning is a letter of its own, 0."""
    points = np.frombuffer(("\n" + "\n".join(units) if units else "").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(points < 0x10000, _FOLD[np.minimum(points, 0xFFFF)], 31)
    begins = points == 10
    wide = (points < 0x10000) & _TWO[np.minimum(points, 0xFFFF)]
    if wide.any():
        place = np.repeat(np.arange(len(points)), 1 + wide)
        second = np.diff(place, prepend=-1) == 0
        points, begins = points[place], begins[place]
        code = np.where(second, 1 + points.astype(np.int64) // _ROUND % _ROUND, code[place])
    owner = np.cumsum(begins) - 1
    at = np.flatnonzero(code.astype(bool) | begins)
    return code[at], at, owner[at]


class Kernel:
    """Bounded gap-weighted subsequences of three and four letters."""

    def __init__(self, decay: float = DECAY, reach: int = REACH):
        self.power = decay ** np.arange(1, 65, dtype=np.float32)
        self.steps = [(a, b) for b in range(2, reach + 1) for a in range(1, b)]
        self.reach = reach

    def _walk(self, code: np.ndarray, pos: np.ndarray, owner: np.ndarray):
        """(weight, index of the subsequence, length) for each shape, by first letter; weight 0 across units."""
        n = len(code)
        for last in range(2, self.reach + 1):
            m = n - last
            if m <= 0:
                return
            weight = np.where(owner[:m] == owner[last:], self.power[np.minimum(pos[last:] - pos[:m], 63)], np.float32(0))
            head, tail = code[:m] * _LETTERS, code[last:]
            for a in range(1, last):
                two = (head + code[a : a + m]) * _LETTERS
                yield weight, two + tail, 3
                for b in range(a + 1, last):
                    yield weight, (two + code[b : b + m]) * _LETTERS + tail, 4

    def features(self, unit: str) -> dict[int, float]:
        """The unit's normalised subsequence weights; four-letter indices follow the three-letter ones."""
        out: dict[int, float] = {}
        code, pos, owner = letters([unit])
        for weight, index, length in self._walk(code, pos, owner):
            for i, w in zip((index + (length == 4) * _LETTERS**3).tolist(), weight.tolist()):
                out[i] = out.get(i, 0.0) + w
        norm = sum(v * v for v in out.values()) ** 0.5
        return {i: v / norm for i, v in out.items()} if norm else {}

    def scale(self, units: list[str]) -> np.ndarray:
        """1 over the norm of each unit's subsequence weights, 0 for units without any.  A subsequence that occurs again adds
        up before it is squared; only units that repeat a letter can have one."""
        out = np.zeros(len(units))
        for lo in range(0, len(units), 8192):
            part = units[lo : lo + 8192]
            code, pos, owner = letters(part)
            square = np.zeros(len(code), np.float32)
            seen = np.unique(owner.astype(np.int64) << 5 | code, return_counts=True)
            again = np.zeros(len(part), dtype=bool)
            again[seen[0][seen[1] > 1] >> 5] = True
            keys, weights = [], []
            for weight, index, length in self._walk(code, pos, owner):
                own = owner[: len(weight)]
                both = again[own] & (weight > 0)
                square[: len(weight)] += np.where(both, 0, weight * weight)
                keys.append((own[both].astype(np.int64) << 21 | index[both] + (length == 4) * _LETTERS**3))
                weights.append(weight[both])
            norm = np.bincount(owner, square, len(part)) if len(code) else np.zeros(len(part))
            if keys and (found := np.concatenate(keys)).size:
                order = np.argsort(found)
                found = found[order]
                first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                norm += np.bincount(found[first] >> 21, np.add.reduceat(np.concatenate(weights)[order].astype(np.float64), first) ** 2, len(part))
            out[lo : lo + 8192] = np.divide(1, np.sqrt(norm), out=np.zeros(len(part)), where=norm > 0)
        return out

    def apply(self, units: list[str], table: np.ndarray, exact: bool = True) -> np.ndarray:
        """Inner product of each unit's subsequences with a table of weights, over the unit's norm if `exact`."""
        out = np.zeros(len(units))
        for lo in range(0, len(units), 8192):  # letters of a block stay in the processor's cache
            part = units[lo : lo + 8192]
            code, pos, owner = letters(part)
            total = np.zeros(len(code), np.float32)
            three, four = table[: _LETTERS**3], table[_LETTERS**3 :]
            for weight, index, length in self._walk(code, pos, owner):
                total[: len(weight)] += weight * (three if length == 3 else four).take(index)
            out[lo : lo + 8192] = np.bincount(owner, total, len(part)) if len(code) else 0
        return out * self.scale(units) if exact else out


def table_of(features: list[dict[int, float]], by: np.ndarray) -> np.ndarray:
    out = np.zeros(_LETTERS**3 + _LETTERS**4, np.float32)
    for f, b in zip(features, by.tolist()):
        for i, v in f.items():
            out[i] += b * v
    return out


def squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 25) -> tuple[np.ndarray, float]:
    """A linear support vector machine by Newton steps on the squared hinge loss."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    reg = ridge * np.eye(len(w))
    reg[-1, -1] = 1e-6
    for _ in range(rounds):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        new = np.linalg.solve(a.T @ x[on] + reg, a.T @ y[on])
        done = np.abs(new - w).max() < 1e-7
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights, the last for the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


_SENTENCE = re.compile(r"[.!?。]+\s|\n")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_ONE_LETTER = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]?[\x20\x09-\x0D]+){2,}[^\W\d_](?!\w)")


def units_of(text: str) -> list[str]:
    """Words of a text and its joined runs of one-letter words."""
    out = [u for u in _BLANK.split(text) if u]  # as scoring splits them
    out += ["".join(m.group().split()) for m in _ONE_LETTER.finditer(text)]
    return out


class Model:
    """Subsequence tables, bias, margin and calibration of a trained machine."""

    def __init__(self, table: np.ndarray, bias: float, calibration: np.ndarray):
        self.table, self.bias, self.calibration, self.kernel = table, bias, calibration, Kernel()

    def unit_scores(self, units: list[str]) -> np.ndarray:
        return self.kernel.apply(units, self.table) + self.bias if units else np.zeros(0)

    def probability(self, shape: np.ndarray) -> np.ndarray:
        x = np.hstack([shape, np.ones((len(shape), 1))]) @ self.calibration
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def doc_shape(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: whether and how many units are over each of EDGES, absolute and by length, and the length."""
    n = np.diff(first)
    out = []
    for edge in EDGES:
        before = np.concatenate([[0], np.cumsum(scores >= edge)])
        over = before[first[1:]] - before[first[:-1]]
        out += [over > 0, np.log1p(over), np.log1p(200 * over / np.maximum(n, 20))]
    return np.column_stack([*out, -np.log1p(np.maximum(n, 20))]).astype(float)


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights of doc_shape(), none below 0: more toxic units never lower a score."""
    use = np.ones(x.shape[1], dtype=bool)
    while True:
        w = logistic(x[:, use], y, weight)
        bad = w[:-1] < 0
        if not bad.any():
            break
        use[np.flatnonzero(use)[bad]] = False
    out = np.zeros(x.shape[1] + 1)
    out[:-1][use], out[-1] = w[:-1], w[-1]
    return out


def variants(unit: str, rng: np.random.Generator, count: int) -> list[str]:
    """The unit with a letter or a mark inserted."""
    cut = rng.integers(1, max(2, len(unit)), count)
    ins = rng.choice(list("abcdefghijklmnopqrstuvwxyz*.-_"), count)
    return [unit[:c] + i + unit[c:] for c, i in zip(cut.tolist(), ins.tolist())]


def stems(units: list[str], sizes: tuple[int, ...] = (4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """(unit, stem) of all runs of so many letters, folded, in all units."""
    code, _, owner = letters(units)
    code = code.astype(np.int64)
    who, what = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in sizes:
        m = len(code) - size + 1
        if m > 0:
            run = np.full(m, size, np.int64)
            for k in range(size):
                run = run << 5 | code[k : k + m]
            one = owner[:m] == owner[size - 1 :]
            who.append(owner[:m][one])
            what.append(run[one])
    return np.concatenate(who), np.concatenate(what)


def by_chance(kinds: int, n_toxic: int, n_clean: int) -> int:
    """Of how many documents, all toxic, chance would make one of so many kinds of things a part."""
    return max(3, int(np.ceil(np.log(max(kinds, 1)) / np.log((n_toxic + n_clean) / n_toxic))))


def telling_stems(unit: np.ndarray, stem: np.ndarray, doc: np.ndarray, doc_unit: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Stems that toxic documents have and clean ones have not, found one by one: each is the one that most toxic documents
    have that hold none of those before.  (unit, stem): which units have which; (doc, doc_unit): which documents have which."""
    n_toxic, n_clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    order = np.argsort(unit, kind="stable")
    unit, stem = unit[order], np.unique(stem[order], return_inverse=True)[1]
    lo, hi = np.searchsorted(unit, doc_unit), np.searchsorted(unit, doc_unit, "right")
    held, of = [], []
    for k in range(0, len(doc), 1 << 18):  # working memory does not follow the sample
        part = slice(k, k + (1 << 18))
        size = hi[part] - lo[part]
        pairs = np.unique(np.repeat(doc[part], size) << 32 | stem[ragged(lo[part], size)])
        held.append(pairs >> 32)
        of.append(pairs & 0xFFFFFFFF)
    pairs = np.unique(np.concatenate(held) << 32 | np.concatenate(of)) if held else np.zeros(0, np.int64)
    held, of = pairs >> 32, pairs & 0xFFFFFFFF
    kinds = int(stem.max()) + 1 if len(stem) else 0
    bad = toxic[held]
    in_toxic, in_clean = np.bincount(of[bad], minlength=kinds), np.bincount(of[~bad], minlength=kinds)
    fit = (in_toxic >= by_chance(kinds, n_toxic, n_clean)) & (in_toxic * n_clean >= 6 * n_toxic * np.maximum(in_clean, 0.3))
    use = bad & fit[of]
    held, of = held[use], of[use]
    found, least = [], max(2, n_toxic // 300)
    while len(of):
        new = np.bincount(of, minlength=kinds)
        best = int(np.argmax(new - in_clean * (3 * n_toxic / n_clean)))
        if new[best] < least:
            break
        found.append(best)
        rest = ~np.isin(held, held[of == best])
        held, of = held[rest], of[rest]
    rank = np.full(kinds, -1)
    rank[found] = np.arange(len(found))
    out = np.full(int(unit.max()) + 1 if len(unit) else 0, len(found))
    telling = rank[stem] >= 0
    np.minimum.at(out, unit[telling], rank[stem[telling]])
    return out


class Sentences:
    """Labelled documents as sentences of numbered units."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        flat, self.first, docs = array("i"), [0], array("i")
        for k, text in enumerate(texts):
            for s in _SENTENCE.split(text.lower()):
                found = units_of(s)
                if found:
                    flat.extend([number.setdefault(u, len(number)) for u in found])
                    self.first.append(len(flat))
                    docs.append(k)
        self.units = list(number)
        self.flat, self.first, self.doc = np.array(flat, np.int64), np.array(self.first), np.array(docs, np.int64)

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """Which document holds which unit, once each."""
        pairs = np.unique(np.repeat(self.doc, np.diff(self.first)) << 32 | self.flat)
        return pairs >> 32, pairs & 0xFFFFFFFF

    def origins(self, docs: int) -> np.ndarray:
        """A number of each document that most of its near copies share: the least hash of its sentences."""
        out = np.full(docs, (1 << 64) - 1, np.uint64)
        if len(self.flat):
            with np.errstate(over="ignore"):
                np.minimum.at(out, self.doc, mix64(np.add.reduceat(mix64(self.flat.astype(np.uint64) + np.uint64(1)), self.first[:-1])))
        return np.unique(out, return_inverse=True)[1]

    def tops(self, score: np.ndarray) -> np.ndarray:
        """The unit of each sentence that has its highest score."""
        if not len(self.flat):
            return np.zeros(0, np.int64)
        value = score[self.flat]
        best = np.repeat(np.maximum.reduceat(value, self.first[:-1]), np.diff(self.first))
        at = np.where(value == best, np.arange(len(value)), len(value))
        return self.flat[np.minimum.reduceat(at, self.first[:-1])]


def train(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 3, stands_for: tuple[float, float] = (1, 1)) -> Model | None:
    """Fit on labelled texts; every third is kept for calibration, where a clean and a toxic one count as many documents as
    they stand for, so that probabilities keep to the table's classes."""
    if not len(texts) or toxic.all() or not toxic.any():
        return None
    calibrate = np.arange(len(texts)) % 3 == 2
    if toxic[~calibrate].all() or not toxic[~calibrate].any() or toxic[calibrate].all() or not toxic[calibrate].any():
        calibrate[:] = False
    own = np.flatnonzero(~calibrate)
    said, bad = Sentences([texts[k] for k in own]), toxic[own]
    if not said.units:
        return None
    doc, unit = said.held()
    in_toxic, in_clean = (np.bincount(unit[bad[doc] == y], minlength=len(said.units)) for y in (True, False))
    rank = telling_stems(*stems(said.units), doc, unit, bad)
    rank = np.append(rank, np.full(len(said.units) - len(rank), rank.max(initial=0) + 1))
    n_toxic, n_clean = int(bad.sum()), int((~bad).sum())
    # witnesses at first: units with a telling stem, which clean documents seldom hold
    clear = (in_toxic > 0) & (in_toxic * n_clean >= 6 * n_toxic * np.maximum(in_clean, 0.01))
    witness = (rank < rank.max(initial=0)) & clear
    # and those that so many toxic documents hold, near copies counted once, that it cannot be chance
    origin = np.unique(unit[bad[doc]] << 32 | said.origins(len(own))[doc[bad[doc]]])
    often = np.bincount(origin >> 32, minlength=len(in_toxic))
    witness |= clear & (often >= by_chance(len(said.units), n_toxic, n_clean))
    if not witness.any():
        best = np.lexsort((in_clean, -in_toxic))[:20]
        witness[best[in_toxic[best] > 0]] = True
    kernel, rng = Kernel(), np.random.default_rng(0)
    # landmarks: of each stem's units the most frequent, turn by turn, then frequent and rare clean units
    turns = np.flatnonzero(witness)[np.lexsort((np.flatnonzero(witness), -in_toxic[witness], rank[witness]))]
    turn = np.concatenate([np.arange(c) for c in np.unique(rank[turns], return_counts=True)[1]]) if len(turns) else turns
    marks = turns[np.lexsort((rank[turns], turn))][: landmarks // 2].tolist()
    clean = np.flatnonzero((in_clean > 0) & ~witness)
    often = clean[np.argsort(-in_clean[clean], kind="stable")]
    pool = np.concatenate([often[:FREQUENT_UNITS], rng.permutation(clean)[:OTHER_UNITS]])
    marks += pool[: landmarks // 4].tolist() + pool[::-1][: landmarks - landmarks // 4 - len(marks)].tolist()
    feats = [f for f in (kernel.features(said.units[u]) for u in dict.fromkeys(marks)) if f]
    if not feats:
        return None
    value, vector = np.linalg.eigh(np.array([[sum(v * g.get(i, 0.0) for i, v in f.items()) for g in feats] for f in feats]))
    keep = value > 1e-6
    root = vector[:, keep] / np.sqrt(value[keep])
    known: dict[str, np.ndarray] = {}

    def nystroem(units: list[str]) -> np.ndarray:
        new = [u for u in dict.fromkeys(units) if u not in known]
        if new:
            products, one = np.zeros((len(new), len(feats)), np.float32), np.zeros(_LETTERS**3 + _LETTERS**4, np.float32)
            for j, f in enumerate(feats):  # one landmark's table at a time
                at = list(f)
                one[at] = list(f.values())
                products[:, j] = kernel.apply(new, one, exact=False)
                one[at] = 0
            products *= kernel.scale(new)[:, None]
            known.update(zip(new, (products @ root).astype(np.float32)))
        return np.array([known[u] for u in units])

    grown = {u: variants(said.units[u], rng, 6) for u in turns[np.lexsort((rank[turns], turn))][:60].tolist()}
    score = np.where(witness, 1.0, -1.0) * (1 + 1e-3 * in_toxic)
    hard = np.zeros(0, np.int64)
    for _ in range(rounds):
        # a sentence is as toxic as its most toxic unit: toxic ones hold a witness, clean ones are all those of clean documents
        top, of_toxic = said.tops(score), bad[said.doc]
        pos_sent = np.bincount(top[of_toxic & witness[top]], minlength=len(score))
        neg_sent = np.bincount(top[~of_toxic & ~witness[top]], minlength=len(score))
        pos = np.flatnonzero((pos_sent > 0) | (witness & (in_toxic > 0)))
        neg = np.unique(np.concatenate([pool, hard, np.flatnonzero(neg_sent)]))
        neg = neg[~witness[neg]]
        if len(neg) > NEGATIVE_UNITS:  # the sentences' units that the machine errs on most
            neg = neg[np.argsort(-score[neg], kind="stable")[:NEGATIVE_UNITS]]
        more = [(v, max(int(pos_sent[u]), 1) / 6) for u in pos.tolist() for v in grown.get(u, [])]
        units = [said.units[u] for u in pos.tolist()] + [v for v, _ in more] + [said.units[u] for u in neg.tolist()]
        y = np.array([1.0] * (len(pos) + len(more)) + [-1.0] * len(neg))
        weight = np.concatenate([np.clip(np.maximum(pos_sent, in_toxic)[pos], 1, 300), [w for _, w in more], np.sqrt(np.clip(np.maximum(neg_sent, in_clean)[neg], 1, 30))]).astype(float)
        weight[y > 0] *= 0.5 * weight[y < 0].sum() / max(weight[y > 0].sum(), 1e-9)
        w, bias = squared_hinge(nystroem(units), y, weight, ridge=3e-4 * weight.sum())
        table = table_of(feats, root @ w)
        score = kernel.apply(said.units, table) + bias
        hard = clean[np.argsort(-score[clean], kind="stable")[:HARD_UNITS]]
        # a toxic document without a witness gives its most toxic unit, if no clean document holds it
        holds = np.zeros(len(bad), dtype=bool)
        holds[doc[witness[unit]]] = True
        mine = bad[doc] & ~holds[doc] & (in_clean[unit] == 0) & (score[unit] > 0)
        d, u = doc[mine], unit[mine]
        order = np.lexsort((u, -score[u], d))
        witness[u[order][np.unique(d[order], return_index=True)[1]]] = True
    own = np.flatnonzero(calibrate if calibrate.any() else ~calibrate)
    known.clear()
    shapes = []
    for k in own.tolist():
        found = units_of(texts[k].lower())
        s = kernel.apply(found, table) + bias if found else np.zeros(0)
        shapes.append(doc_shape(s, np.array([0, len(found)]))[0])
    return Model(table, bias, calibrated(np.array(shapes), toxic[own].astype(float), np.where(toxic[own], stands_for[1], stands_for[0]).astype(float)))


@lean
def _score(batches: Iterable[pa.RecordBatch], model: Model | None, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        _, offsets = text_buffer(texts)
        for lo, hi in row_slices(offsets + 64 * np.arange(len(offsets)), SLICE_BYTES):
            part = pc.fill_null(texts.slice(lo, hi - lo), "").cast(pa.large_string())
            if model is None:
                p = np.zeros(hi - lo)
            else:
                words = pc.ascii_split_whitespace(part)
                first = (words.offsets.to_numpy() - words.offsets[0].as_py()).astype(np.int64)
                found = words.flatten().dictionary_encode()
                unique = [u.replace("\n", " ") for u in found.dictionary.to_pylist()]
                scores = model.unit_scores(unique)[found.indices.to_numpy()] if unique else np.zeros(0)
                shape = doc_shape(scores, first)
                alone = np.array([len(u) <= 2 for u in unique] + [False])[found.indices.to_numpy()]
                alone[2:] &= alone[1:-1] & alone[:-2]
                for k in sorted(set((np.searchsorted(first, np.flatnonzero(alone), "right") - 1).tolist())):  # texts that may spell words out
                    text = part[k].as_py().lower()
                    extra = ["".join(m.group().split()) for m in _ONE_LETTER.finditer(text)]
                    if extra:
                        both = np.concatenate([scores[first[k] : first[k + 1]], model.unit_scores(extra)])
                        shape[k] = doc_shape(both, np.array([0, len(both)]))[0]
                p = model.probability(shape)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "score", "predicted"])


def sampled(docs: DataFrame, some: DataFrame, max_bytes: int) -> DataFrame:
    """docs (i, x, ...) of the ids in `some` (i, ...), a bounded number, one row an id (the least), in the order of a hash of
    the id while their texts stay within max_bytes."""
    rows = docs.join(F.broadcast(some.select("i")), "i").groupBy("i").agg(F.min(F.struct(*(c for c in docs.columns if c != "i"))).alias("r")).select("i", "r.*")
    rows = written(rows, "sample")
    sizes = rows.select("i", F.octet_length("x").alias("n"), F.xxhash64("i").alias("h")).toPandas().sort_values(["h", "i"])  # as many as ids
    fits = sizes[sizes["n"] <= max_bytes // 8]
    keep = fits["i"][fits["n"].cumsum() <= max_bytes].tolist()
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(int(k),) for k in keep], "i long")), "i").join(F.broadcast(some), "i")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> Model | None:
    """A machine from the labelled documents whose crc32(id) mod 3 is not 1, a bounded sample of them."""
    named = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(F.col(label_col)).alias("t"))
    named = named.filter(F.crc32(F.col("i").cast("string").cast("binary")) % 3 != 1)
    count = {x["t"]: x["count"] for x in named.groupBy("t").count().collect() if x["t"] in (0, 1)}
    order = [F.xxhash64("i"), F.col("i")]
    some = named.filter("t = 1").orderBy(*order).limit(max_toxic).unionByName(named.filter("t = 0").orderBy(*order).limit(max_clean))
    known = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("i", "x", "t"))))
        toxic = np.array([r[2] == 1 for r in rows], dtype=bool)
        stands_for = max(1.0, count.get(0, 0) / max(int((~toxic).sum()), 1)), max(1.0, count.get(1, 0) / max(int(toxic.sum()), 1))
        model = train([r[1] for r in rows], toxic, stands_for=stands_for)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task trains, on at most max_toxic + max_clean rows and max_bytes; the driver gets the machine alone
    got = sampled(known, some, max_bytes).select("i", "x", "t").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None


def toxicity(docs: DataFrame, model: Model | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted for each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _score(it, sent.value, threshold), f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(text_col)], names=["id", "text"])
            found = pa.Table.from_batches(_score([two], sent.value, threshold)) if batch.num_rows else None
            if found is not None:
                yield batch.filter(pc.equal(found["predicted"], 0).combine_chunks())

    return docs.mapInArrow(run, docs.schema)
