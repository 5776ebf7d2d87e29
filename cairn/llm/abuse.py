"""Abusive, hateful or sexual content (problem 8).

Method: nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes; votes weighted by
closeness give a calibrated score and its evidence. Texts are folded first (case, compatibility forms,
look-alikes, digits inside words, everything but letters dropped), so that common disguises do not matter, and
cut into windows at punctuation and line ends; long windows are cut further, with overlaps. Terms are letter
runs within a window, two letters of scripts without small letters and five of others, hashed to ``TERMS``
slots; a shorter window is one term.

Every window of every labelled text, abusive and benign, is an example in the index. The label belongs to the
whole text, though: which windows of an abusive text are the abusive ones is told by editing. A window stays an
example of abuse if its neighbours in other labelled texts agree, and if its terms are more usual in abusive texts
than anywhere; the other windows of abusive texts vote as benign. Every window of every document is then compared
with the examples: one that by the largest weights of its terms cannot reach the least cosine to any example of
abuse has no such neighbour, so leaving it out changes no score. A document's vote is that of its worst window.

Votes become probabilities by a logistic curve fitted to votes on held-out labels: the labelled texts are dealt
into ``FOLDS`` parts, and each part is scored by examples edited and counted without it. ``reliability`` reports
those held-out scores against the labels.

Frequencies are counted per window over all different texts, so that neither the length of texts nor copies
change how common a term is. The fit takes at most ``MAX_LABELLED`` labelled texts of each class and about
``MAX_WINDOWS`` windows of each (smallest hashes); all that is sent to the tasks has these bounds or ``TERMS`` slots.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.lookalikes import CYRILLIC_ALIKE, CYRILLIC_LATIN, GREEK_ALIKE, GREEK_LATIN
from cairn.runtime import settle

#: Slots of the hashed term space.
TERMS = 1 << 19
#: Labelled texts of either class, and windows of them, that the fit may take.
MAX_LABELLED, MAX_WINDOWS = 4000, 250_000
#: Neighbours of either class that vote, the least cosine of one that counts, and the score from which a text is a case.
NEIGHBOURS, LEAST_COSINE, CASE = 15, 0.35, 0.5
#: Weight of a benign vote that every window has.
PRIOR = 0.1
#: Texts without a label speak for benign with so many times the weight that makes their windows as many as abusive ones.
SUSPECT = 10
#: Deviations that the number of benign windows with a term allows for its rate.
SPREAD = 3
#: An example of abuse has at least this share of neighbours and of its own terms on its side; of terms more if it has
#: no abusive neighbour in another text.
AGREE, TYPICAL, TYPICAL_ALONE = 0.25, 0.5, 0.54
#: What tells of a window: 1, its vote, the weight of its abusive neighbours (logarithm), the cosine of the nearest, the
#: length of its own vector (logarithm), how typical the nearest is; with the coefficients where labels tell nothing else.
USUAL_CURVE = (-9.0, 6.0, 0.5, 2.0, 0.5, 4.0)
#: How firmly the coefficients stay near those.
STIFF = 0.5
#: How often the worst windows of abusive texts are chosen anew.
ROUNDS = 5
#: Share of benign marks that may be wrong: so many texts marked benign, the worst ones, do not count for the curve.
WRONG = 0.005
#: Parts of the labelled texts for held-out scores.
FOLDS = 4
#: Letters of half a long window.
HALF = 64
#: Examples of a block of the index.
BLOCK = 32
# Digits and signs that stand for letters inside words.
LEET, LEET_LETTERS = "013457@$", "oieastas"
# Marks that end a window anywhere, unless a digit follows, and only before a blank or a line's end.
_ENDS, _ENDS_NO_DIGIT, _ENDS_BLANK = "\n\r|。！？；：，、…!?;", ",:", "."


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Folded code point of every code point of the basic plane, 0 for what is dropped."""
    table = np.zeros(0x110000, np.uint32)
    alike = dict(zip(CYRILLIC_ALIKE + GREEK_ALIKE, CYRILLIC_LATIN + GREEK_LATIN, strict=True))
    for cp in range(0x10000):
        c = unicodedata.normalize("NFKC", alike.get(chr(cp), chr(cp)))[:1]
        c = alike.get(c, c).casefold()[:1]
        if c and c.isalpha():
            table[cp] = ord(c)
    table[0x20000:0x32000] = np.arange(0x20000, 0x32000)
    return table


def _latin(c: np.ndarray) -> np.ndarray:
    return ((c >= 97) & (c <= 122)) | ((c >= 0xDF) & (c <= 0x24F))


def _isin(raw: np.ndarray, marks: str) -> np.ndarray:
    out = np.zeros(len(raw), bool)
    for m in marks:
        out |= raw == ord(m)
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded letter, text, window) of all letters; windows are numbered over all texts.

    A window of a single letter goes with its single neighbours, or else with the window before it. Less than five
    Latin letters beside digits are a code and left out.
    """
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.repeat(np.arange(len(texts)), sizes)
    c = _fold_table()[raw]
    latin = _latin(c)
    for sign, letter in zip(LEET, LEET_LETTERS, strict=True):
        at = np.flatnonzero(raw == ord(sign))
        at = at[(at > 0) & (at < len(raw) - 1)]
        at = at[latin[at - 1] & latin[at + 1]]
        c[at] = ord(letter)
    after = np.r_[raw[1:], 10]
    blank = (after <= 32) | (after == 0xA0) | (after == 0x3000)
    ends = _isin(raw, _ENDS) | (_isin(raw, _ENDS_NO_DIGIT) & ~((after >= 48) & (after <= 57))) | (_isin(raw, _ENDS_BLANK) & blank)
    window = np.cumsum(ends)
    keep = c > 0
    coded = np.bincount(window, (raw >= 48) & (raw <= 57) & ~keep) > 0
    few = np.bincount(window, np.where(c >= 0x2E80, 5, keep)) < 5
    keep &= ~(coded & few)[window]
    c, owner, window = c[keep], owner[keep], window[keep]
    if not len(c):
        return c, owner, window
    first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    size, of = np.diff(np.r_[first, len(c)]), owner[first]
    single = size == 1
    same = np.r_[False, of[1:] == of[:-1]]
    follows = np.r_[single[1:] & same[1:], False]
    goes = single & same & ~(~np.r_[False, single[:-1]] & follows)  # all but those that begin a run of single letters
    window = np.repeat(np.cumsum(~goes), size)
    first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    size = np.diff(np.r_[first, len(c)])
    if (size > 2 * HALF).any():
        half = (np.arange(len(c)) - np.repeat(first, size)) // HALF
        most = np.repeat(np.maximum(0, np.where(size > 2 * HALF, -(-size // HALF) - 2, 0)), size)
        base = np.repeat(np.r_[0, np.cumsum(most[first] + 1)[:-1]], size)
        a, b = base + np.minimum(half, most), base + np.maximum(0, np.minimum(half - 1, most))
        twice = np.flatnonzero((a != b) & (most > 0))
        window = np.r_[np.where(most > 0, a, base), b[twice]]
        c, owner = np.r_[c, c[twice]], np.r_[owner, owner[twice]]
        order = np.argsort(window, kind="stable")
        c, owner, window = c[order], owner[order], window[order]
        window = np.cumsum(np.r_[True, window[1:] != window[:-1]])
    return c, owner, window - window[0]


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, term, count) of the terms of every window, sorted, and the text of each window."""
    c, owner, window = letters(texts)
    n = len(c)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    text = owner[np.r_[True, window[1:] != window[:-1]]]
    size = np.bincount(window)
    pad, own = np.r_[c.astype(np.uint64), np.zeros(4, np.uint64)], np.r_[window, np.full(4, -1)]
    at = [np.where(own[k : n + k] == window, pad[k : n + k], np.uint64(0)) for k in range(5)]
    mult = np.uint64(0x9E3779B97F4A7C15)
    wide = (at[0] >= 0x2E80) | (at[1] >= 0x2E80)
    h2 = at[0] * mult + at[1]
    h = np.where(wide, h2, ((h2 * mult + at[2]) * mult + at[3]) * mult + at[4])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    term = ((h >> np.uint64(40)) % np.uint64(TERMS)).astype(np.int64)
    begins = np.r_[True, window[1:] != window[:-1]]
    fits = np.where(wide, at[1] > 0, at[4] > 0) | (begins & ~wide & (size[window] < 5))
    key, count = np.unique(window[fits] * TERMS + term[fits], return_counts=True)
    return key // TERMS, key % TERMS, count, text


def _parts(texts: list[str], size: int = 200_000) -> Iterator[tuple[int, list[str]]]:
    first, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= size:
            yield first, texts[first : i + 1]
            first, chars = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def window_frequencies(documents: DataFrame, text: str = "text") -> DataFrame:
    """(term int, df bigint): in how many windows of different texts each term slot occurs; term -1 counts the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, part in _parts(batch.column(0).to_pylist()):
                _, term, _, of = windows(part)
                total += np.bincount(term, minlength=TERMS)
                n += len(of)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[n, total[at]])], ["term", "df"])

    return documents.select(text).filter(F.length(text) > 0).distinct().mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _unit(of: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of unit length, and each window's length before."""
    w = (1 + np.log(count)) * idf[term]
    norm = np.maximum(np.sqrt(np.bincount(of, w * w, minlength=size)), 1e-9)
    return w / norm[of], norm


class BlockMaxIndex:
    """Examples as unit TF-IDF vectors, in blocks with the largest weight of each term in the block.

    ``of`` numbers the example of each posting, from 0 and sorted. Examples are put in the order of their rarest
    term, so that those of a block are alike and its largest weights are close to theirs.
    """

    def __init__(self, of: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.size = int(of[-1]) + 1 if len(of) else 0
        lead = np.zeros(self.size, np.int64)
        if self.size:
            order = np.lexsort((weight, of))
            lead = term[order][np.r_[np.flatnonzero(of[1:] != of[:-1]), len(of) - 1]]
        self.names = np.argsort(lead, kind="stable")
        place = np.empty(self.size, np.int64)
        place[self.names] = np.arange(self.size)
        at = place[of]
        order = np.argsort(at, kind="stable")
        at, term, weight = at[order], term[order], weight[order]
        self.begin = np.searchsorted(at, np.arange(0, self.size + BLOCK, BLOCK))
        self.term, self.weight, self.who = term.astype(np.int32), weight, (at % BLOCK).astype(np.int8)
        key = term * (self.size // BLOCK + 1) + at // BLOCK
        order = np.lexsort((-weight, key))
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])[: len(key)]
        held = order[first] if len(key) else order
        self.block_of, self.most = (at[held] // BLOCK).astype(np.int32), weight[held]
        self.starts = np.searchsorted(term[held], np.arange(TERMS + 1)).astype(np.int32)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, least: float, query: np.ndarray) -> list[tuple[float, int]]:
        """The k examples of highest cosine, at least ``least``. ``query`` is a zero array of TERMS slots."""
        if not self.size:
            return []
        n = self.starts[term + 1] - self.starts[term]
        at = np.repeat(self.starts[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        bound = np.bincount(self.block_of[at], np.repeat(weight, n) * self.most[at], minlength=-(-self.size // BLOCK))
        hopeful = np.flatnonzero(bound >= least - 1e-9)
        query[term] = weight
        best: list[tuple[float, int]] = []
        for b in hopeful[np.argsort(-bound[hopeful], kind="stable")].tolist():
            floor = best[-1][0] if len(best) == k else least
            if bound[b] < floor - 1e-9:
                break  # no later block can hold a nearer example
            i, j = self.begin[b], self.begin[b + 1]
            cos = np.bincount(self.who[i:j], query[self.term[i:j]] * self.weight[i:j])
            near = np.flatnonzero(cos >= floor)
            if len(near):
                best = sorted([*best, *((float(cos[x]), int(self.names[b * BLOCK + x])) for x in near)], key=lambda x: (-x[0], x[1]))[:k]
        query[term] = 0
        return best


@dataclass
class Examples:
    """Different windows of labelled texts: postings, and for each window how many texts of each class and fold
    hold it, and one abusive text that does (-1 if none)."""

    of: np.ndarray
    term: np.ndarray
    count: np.ndarray
    bad: np.ndarray  # windows x FOLDS
    good: np.ndarray
    doc: np.ndarray
    fold: np.ndarray  # of ``doc``

    def begins(self) -> np.ndarray:
        return np.searchsorted(self.of, np.arange(len(self.doc) + 1))


@dataclass
class Model:
    idf: np.ndarray
    abuse: BlockMaxIndex
    benign: BlockMaxIndex
    votes: tuple[np.ndarray, np.ndarray, np.ndarray]  # texts of either class with each example of abuse, and with each benign one
    source: np.ndarray  # document of each example of abuse
    most: np.ndarray  # largest weight of each term in an example of abuse
    typical: np.ndarray  # of each example of abuse
    curve: np.ndarray = field(default_factory=lambda: np.array(USUAL_CURVE))
    held_out: list[tuple[int, float, int]] = field(default_factory=list)  # (doc_id, score, label)

    def vote(self, term: np.ndarray, weight: np.ndarray, mass: float, query: np.ndarray) -> tuple[np.ndarray | None, int]:
        """What is known of a window by its neighbours (see ``FEATURES``), None if none is abusive, and the nearest abusive one."""
        near = self.abuse.nearest(term, weight, NEIGHBOURS, LEAST_COSINE, query)
        if not near:
            return None, -1
        bad, good, plain = self.votes
        yes = sum(c * c * bad[i] for c, i in near)
        no = sum(c * c * good[i] for c, i in near) + sum(c * c * plain[i] for c, i in self.benign.nearest(term, weight, NEIGHBOURS, LEAST_COSINE, query))
        return np.array([1.0, yes / (yes + no + PRIOR), np.log(yes), near[0][0], np.log(mass), self.typical[near[0][1]]]), near[0][1]

    def votes_of(self, of: np.ndarray, term: np.ndarray, count: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, int]]:
        """(window, features, nearest example) of every window that has a neighbour among the examples of abuse."""
        if not len(of):
            return
        w, mass = _unit(of, term, count, self.idf, size)
        bound = np.bincount(of, w * self.most[term], minlength=size)
        begin, query = np.searchsorted(of, np.arange(size + 1)), np.zeros(TERMS)
        for i in np.flatnonzero(bound >= LEAST_COSINE - 1e-6).tolist():
            at = slice(begin[i], begin[i + 1])
            x, why = self.vote(term[at], w[at], mass[i], query)
            if x is not None:
                yield i, x, why

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.curve)))

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[int | None]]:
        """Score of each text and the labelled document nearest to its most abusive window; a text without such neighbours scores 0."""
        scores, evidence = np.zeros(len(texts)), [None] * len(texts)
        for first, part in _parts(texts):
            of, term, count, text = windows(part)
            for i, x, why in self.votes_of(of, term, count, len(text)):
                doc, p = first + int(text[i]), float(self.probability(x))
                if p > scores[doc]:
                    scores[doc], evidence[doc] = p, int(self.source[why])
        return scores, evidence


def typical(x: Examples, df: np.ndarray, total: int, folds: list[int], weight: np.ndarray) -> np.ndarray:
    """Of each window, how much of its weight lies on terms more usual in windows of abusive texts than anywhere."""
    bad, good = x.bad[:, folds].sum(1), x.good[:, folds].sum(1)
    held, plain = (np.bincount(x.term, n[x.of], minlength=TERMS) for n in (bad, good))
    # Where abuse itself makes a term frequent, its usual rate is the highest that the benign texts with it allow.
    rate = np.minimum(np.maximum(df, 1) / max(1, total), (plain + SPREAD * np.sqrt(plain) + SPREAD) / max(1, good.sum()))
    usual = rate * max(1, bad.sum())  # expected, were abusive texts like all others
    share = held / np.maximum(held + SUSPECT * usual, 1e-9)
    return np.bincount(x.of, weight * weight * share[x.term], minlength=len(x.doc))


def edited(x: Examples, idf: np.ndarray, df: np.ndarray, total: int, folds: list[int]) -> Model:
    """The model of the labelled texts of some folds."""
    size = len(x.doc)
    weight, _ = _unit(x.of, x.term, x.count, idf, size)
    own = typical(x, df, total, folds, weight)
    bad, good = x.bad[:, folds].sum(1), x.good[:, folds].sum(1)
    begin, query = x.begins(), np.zeros(TERMS)
    whole = _index(x, weight, np.flatnonzero(bad + good > 0))
    keep = np.zeros(size, bool)
    for i in np.flatnonzero((bad > 0) & (own >= TYPICAL)).tolist():
        at = slice(begin[i], begin[i + 1])
        yes = no = 0.0
        for c, j in whole[0].nearest(x.term[at], weight[at], 2 * NEIGHBOURS, LEAST_COSINE, query):
            j = whole[1][j]
            yes += c * c * (bad[j] - (x.doc[j] == x.doc[i]))
            no += c * c * good[j]
        keep[i] = yes + PRIOR >= AGREE * (yes + no + 2 * PRIOR) and (yes > 0 or own[i] >= TYPICAL_ALONE)
    kept, rest = np.flatnonzero(keep), np.flatnonzero(~keep & (bad + good > 0))
    most = np.zeros(TERMS, np.float32)
    on = keep[x.of]
    np.maximum.at(most, x.term[on], weight[on].astype(np.float32))
    return Model(idf, _index(x, weight, kept)[0], _index(x, weight, rest)[0], (bad[kept], good[kept], (bad + good)[rest]), x.doc[kept], most, own[kept])


def _index(x: Examples, weight: np.ndarray, which: np.ndarray) -> tuple[BlockMaxIndex, np.ndarray]:
    number = np.full(len(x.doc), -1)
    number[which] = np.arange(len(which))
    on = number[x.of] >= 0
    return BlockMaxIndex(number[x.of[on]], x.term[on], weight[on].astype(np.float32)), which


def benign_weight(x: Examples, df: np.ndarray, total: int, model: Model) -> float:
    """How many times more benign windows than abusive ones a labelled one stands for, abuse being over-sampled.

    Abusive ones are as many times more in all texts as the terms of examples of abuse that several labelled texts
    hold; benign ones as all windows.
    """
    bad, good = x.bad.sum(1), x.good.sum(1)
    held = np.bincount(x.term, bad[x.of], minlength=TERMS)
    at = np.flatnonzero((model.most > 0) & (held >= 2))
    more = float(np.median(df[at] / held[at])) if len(at) else 1.0
    return max(1.0, total / max(1.0, good.sum()) / max(1.0, more))


def logistic(x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of the probability of abuse, by Newton's method; with few labels they stay near ``USUAL_CURVE``."""
    usual = np.array(USUAL_CURVE)
    beta = usual.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + STIFF * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (weight * (labels - p)) - STIFF * (beta - usual))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def examples(rows: pa.Table) -> tuple[Examples, dict[int, int], list[tuple[np.ndarray, np.ndarray]]]:
    """Examples of rows (doc, toxic, fold, term, count), a row per window; labels by document; and by fold the
    (document, example) pairs of its windows."""
    doc, toxic, fold = (rows[c].to_numpy() for c in ("doc", "toxic", "fold"))
    terms, counts = rows["term"].combine_chunks(), rows["count"].combine_chunks()
    first = terms.offsets.to_numpy()
    term, count = terms.values.to_numpy(zero_copy_only=False).astype(np.int64), counts.values.to_numpy(zero_copy_only=False).astype(np.int64)
    known: dict[bytes, int] = {}
    which = np.empty(len(doc), np.int64)
    kept = []
    for r in range(len(doc)):
        key = term[first[r] : first[r + 1]].tobytes() + count[first[r] : first[r + 1]].tobytes()
        which[r] = known.setdefault(key, len(known))
        if which[r] == len(kept):
            kept.append(r)
    n = len(kept)
    sizes = np.array([first[r + 1] - first[r] for r in kept], np.int64)
    at = np.concatenate([np.arange(first[r], first[r + 1]) for r in kept]) if n else np.zeros(0, np.int64)
    bad, good, a_doc, a_fold = np.zeros((n, FOLDS)), np.zeros((n, FOLDS)), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    once = np.unique(np.stack([which, doc, toxic, fold]), axis=1) if n else np.zeros((4, 0), np.int64)
    np.add.at(bad, (once[0][once[2] == 1], once[3][once[2] == 1]), 1)
    np.add.at(good, (once[0][once[2] == 0], once[3][once[2] == 0]), 1)
    for w, d, t, f in once.T[::-1]:
        if t == 1:
            a_doc[w], a_fold[w] = d, f
    x = Examples(np.repeat(np.arange(n), sizes), term[at], count[at], bad, good, a_doc, a_fold)
    by_fold = [(once[1][once[3] == f], once[0][once[3] == f]) for f in range(FOLDS)]
    return x, dict(zip(doc.tolist(), toxic.tolist(), strict=True)), by_fold


def fit(rows: pa.Table, df: np.ndarray, total: int) -> Model:
    """The model of windows of labelled texts, and of frequencies over ``total`` windows."""
    idf = (np.log((1 + total) / (1 + np.minimum(df, total))) + 1e-3).astype(np.float32)
    x, label, by_fold = examples(rows)
    begin, docs_of, seen = x.begins(), [], []
    for f in range(FOLDS):
        docs, at = by_fold[f]
        part = edited(x, idf, df, total, [g for g in range(FOLDS) if g != f])
        used, back = np.unique(at, return_inverse=True)
        n = begin[used + 1] - begin[used]
        pos = np.repeat(begin[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = {i: v for i, v, _ in part.votes_of(np.repeat(np.arange(len(used)), n), x.term[pos], x.count[pos], len(used))}
        for d, i in zip(docs.tolist(), back.tolist(), strict=True):
            if i in found:
                docs_of.append(d)
                seen.append(found[i])
    model = edited(x, idf, df, total, list(range(FOLDS)))
    score = dict.fromkeys(label, 0.0)
    if seen:
        m, d = np.array(seen), np.array(docs_of)
        y = np.array([label[k] for k in docs_of], float)
        weight = np.where(y == 1, 1.0, benign_weight(x, df, total, model))
        for _ in range(ROUNDS):  # of an abusive text only the worst window tells of abuse
            p = model.probability(m)
            order = np.lexsort((-p, d))
            worst = np.zeros(len(d), bool)
            worst[order[np.r_[True, d[order][1:] != d[order][:-1]]]] = True
            doubted = order[(worst & (y == 0) & (p > 0.5))[order]]
            doubted = doubted[np.argsort(-p[doubted], kind="stable")][: math.ceil(WRONG * len(label))]
            used = (worst | (y == 0)) & ~np.isin(d, d[doubted])
            model.curve = logistic(m[used], y[used], weight[used])
        for d, p in zip(docs_of, model.probability(m).tolist(), strict=True):
            score[d] = max(score[d], p)
    model.held_out = [(d, score[d], y) for d, y in sorted(label.items())]
    return model


def majority(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): what most marks of a document say; repeated rows count once, null marks and ties not."""
    marks = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "annotator", "toxic").distinct()
    mean = marks.groupBy("doc_id").agg(F.avg(F.when(F.col("toxic") > 0, 1.0).otherwise(0.0)).alias("m")).filter("m <> 0.5")
    return mean.select("doc_id", (F.col("m") > 0.5).cast("int").alias("toxic"))


def labelled_windows(texts: DataFrame) -> DataFrame:
    """(doc, toxic, fold, no, term, count): the windows of labelled texts (doc_id, text, toxic)."""
    schema = "doc bigint, toxic int, fold int, no int, term array<int>, count array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, toxic, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            for first, part in _parts(batch.column(1).to_pylist()):
                of, term, count, text = windows(part)
                held, n = np.unique(of, return_counts=True)
                offsets = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
                row = first + text[held]
                cols = [pa.array(doc[row]), pa.array(toxic[row], pa.int32()), pa.array(fold[row], pa.int32()), pa.array(held, pa.int32())]
                cols += [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (term, count)]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "toxic", "fold", "no", "term", "count"])

    fold = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(FOLDS)).cast("int")
    return texts.select("doc_id", "text", "toxic", fold.alias("fold")).mapInArrow(run, schema)


def fitted(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_windows: int = MAX_WINDOWS) -> Model:
    """The model of all texts' frequencies and of a bounded sample of the labelled ones; copies are one text,
    labelled as most of them are."""
    marked = majority(labels).join(documents.select("doc_id", "text"), "doc_id").filter("length(text) > 0")
    marked = marked.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("m")).filter("m <> 0.5")
    marked = marked.select("doc_id", "text", (F.col("m") > 0.5).cast("int").alias("toxic"))
    parts = [marked.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for t in (1, 0)]
    found = settle(labelled_windows(parts[0].unionByName(parts[1])))
    n = dict(found.groupBy("toxic").agg(F.count("*")).collect())  # two rows
    if max(n.values(), default=0) > max_windows:
        share = F.when(F.col("toxic") == 1, max_windows / n.get(1, 1)).otherwise(max_windows / n.get(0, 1))
        found = found.filter(F.pmod(F.xxhash64("doc", "no"), F.lit(1 << 20)) < share * (1 << 20))
    rows = found.select("doc", "toxic", "fold", "term", "count").toArrow()  # about max_windows rows of either class
    df = np.zeros(TERMS + 1, np.int64)
    for batch in window_frequencies(documents).toArrow().to_batches():  # at most TERMS rows and one
        df[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return fit(rows, df[:TERMS], int(df[TERMS]))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence): every row's score in [0, 1]; null texts and texts without letters score 0 without evidence."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, evidence = sent.value.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(evidence, pa.int64())], ["doc_id", "score", "evidence"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, evidence bigint")


def rates(documents: DataFrame, scores: DataFrame, case: float = CASE) -> DataFrame:
    """(source, documents, cases, rate) of every source, null being one; a document counts once."""
    rows = documents.select("doc_id", "source").distinct().join(scores.groupBy("doc_id").agg(F.max("score").alias("score")), "doc_id")
    n, k = F.count("*"), F.sum((F.col("score") >= case).cast("bigint"))
    return rows.groupBy("source").agg(n.alias("documents"), k.alias("cases"), (k / n).alias("rate"))


def reliability(model: Model, bins: int = 10) -> list[tuple[float, int, float, float]]:
    """(lower bound, texts, mean score, share marked abusive) of each tenth of the held-out scores that occurs."""
    if not model.held_out:
        return []
    p = np.array([h[1] for h in model.held_out])
    y = np.array([h[2] for h in model.held_out])
    at = np.minimum((p * bins).astype(int), bins - 1)
    return [(b / bins, int((at == b).sum()), float(p[at == b].mean()), float(y[at == b].mean())) for b in np.unique(at).tolist()]
