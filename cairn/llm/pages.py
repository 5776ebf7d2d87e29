"""Noise in text from scanned pages (problem 3).

Method: a vocabulary is counted over all records that are not scanned. A Levenshtein automaton of each unknown
word of a scanned page, kept as bit vectors of its states, is run over the vocabulary's trie, which yields every
word within the distance; candidates are ranked by how often they stand beside the neighbouring words, by
confusable shapes, distance and frequency. In scripts
without blanks the vocabulary is one of character pairs, and a misread character is one whose pairs are
unknown while another fits between its neighbours. Then page furniture is removed: page numbers, and running titles,
which are told by the file's name and by lines that come again at the top or bottom of a file's pages. Cut words are
joined and the lines are reflowed into paragraphs.

Spark counts the vocabulary and the lines that come again, and runs over the pages. What is sent to the tasks holds
entries of at least a fixed share of all occurrences only, so that its size is bounded by 1 / ``LEAST_SHARE`` entries of
a kind at any scale; the trie is sent as arrays, one number of each kind for a node, and answers that are kept for
words seen again are dropped beyond ``KEPT``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import settle

#: Entries below this share of all words (pairs, characters, forms) are not known.
LEAST_SHARE = 5e-7
#: Forms of tokens with digits below this share of all such tokens are not those of codes or models.
FORM_SHARE = 5e-4
#: What an edit that no confusion explains costs, in powers of e of the counts of neighbouring words.
EDIT_COST = 3.0
#: Marks with which a word can be cut at the end of a line. Fixed values.
CUT_MARKS = "-\u00ad\u2010\u2011\u00ac"
#: Width of a scanned page in characters, and the share of its lines that may be wider.
WIDEST, WIDER = 82, 0.05
#: Lines at the top and at the bottom of a page that may be furniture; a line is if it comes again on so many pages of a
#: file, and on this share of them.
EDGE, AGAIN, AGAIN_SHARE = 2, 3, 0.3
#: Files whose recurring lines are sent to all tasks (each has some 13 at most), and keys over which a file is spread beyond.
SENT, SALTS = 50_000, 64
#: Answers that a task keeps for words and pairs it has seen.
KEPT = 200_000
_WORD = re.compile(r"[^\W\d_]+(?:[-'\u2019][^\W\d_]+)*")
_CODE = re.compile(r"[A-Za-z0-9]+(?:[-.][A-Za-z0-9]+)*")
_ENDS = "\u3002\uff0e.!?\uff01\uff1f;\uff1b:\uff1a|\u201d\u2026"
# Dashes of hyphen length, and invisible characters.
_DASHES = {**dict.fromkeys(map(ord, "\u00ad\u2010\u2011\u2012\u2013\u2212\ufe63"), "-"), **dict.fromkeys(map(ord, "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"), None)}
# Letters that stand for misread digits.
_AS_DIGITS = str.maketrans("OoQDlIiZzSsBbGgq", "0000111225588699")
_CAPTION = re.compile(r"^(?:\u8868|\u56fe|table|tabelle|tab\.?|fig\.?|figure|abb\.?|abbildung|bild)\s*[0-9]+(?:[-.][0-9]+)*\.?$", re.I)
# What stands for a digit on a page number that was misread. Fixed values.
_D = "[0-9OoQlI|SsBZzgqb]"
_NUMBER = rf"(?:(?=[^\s]*[0-9OIl]){_D}{{1,4}}|[ivxlc]{{1,7}}|[IVXLC]{{1,7}})"
_PAGE_NO = re.compile(
    rf"^[-\u2013\u2014\u2212~_\u00b7\u2022.|*=\[(<\s]*(?:(?:\u7b2c|\w{{4,5}}|[psPS]\s*\.|[Pp]g\.?)\s*)?{_NUMBER}\s*[\u9875\u9801]?\s*(?:(?:of|von|/|\u5171|,|\uff0c)\s*\u5171?\s*{_D}{{1,5}}\s*[\u9875\u9801]?)?[-\u2013\u2014\u2212~_\u00b7\u2022.|*=\])>\s]*$"
)
_PAGE_WORDS = ("page", "seite", "blatt")


def near(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two short strings is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def is_wide(c: str) -> bool:
    return "\u2e80" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff"


def looks_scanned(text: str) -> bool:
    """Whether the lines are broken at a page's width: short, many, and mostly in mid-sentence."""
    rows = [x for x in text.split("\n") if x.strip()]
    if len(rows) < 4 or sum(len(x) > WIDEST for x in rows) > WIDER * len(rows) or sum(x.startswith("|") for x in rows) > 0.3 * len(rows):
        return False
    widest = max(len(x) for x in rows if len(x) <= WIDEST)
    full = [x for x in rows if len(x) >= 0.72 * widest]
    inner = sum(x.rstrip()[-1] not in _ENDS for x in full)
    return len(full) >= 3 and 2 * len(full) >= len(rows) and inner >= 0.5 * len(full)


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", s).lower() if c.isalnum())


def is_page_number(line: str) -> bool:
    s = unicodedata.normalize("NFKC", line).strip()
    if not s or not _PAGE_NO.match(s):
        return False
    words = re.findall(r"[^\W\d_]{4,}", s)
    return all(any(near(w.lower(), p, 1) for p in _PAGE_WORDS) or re.fullmatch("[ivxlcIVXLC]+", w) for w in words)


def titles(file_name: str | None) -> list[str]:
    """What a running title of the file may read, as letters and digits only."""
    if not file_name:
        return []
    stem = file_name.rsplit("/", 1)[-1]
    stem = stem[: stem.rfind(".")] if "." in stem else stem
    parts = [p for p in re.split(r"[_]+", stem) if p]
    out = []
    if len(parts) >= 2:
        out.append(_plain(parts[0] + parts[1]))
    words = [p for p in re.split(r"[_\s]+", stem) if p]
    for k in range(1, min(5, len(words)) + 1):
        if len(t := _plain("".join(words[:k]))) >= 6:
            out.append(t)
    return [t for t in dict.fromkeys(out) if len(t) >= 6]


def is_title(line: str, candidates: list[str]) -> bool:
    """Whether a line is a running title, with misread characters, a service name or a page number."""
    s = _plain(line)
    if len(s) < 6:
        return False
    for t in candidates:
        most = 1 + (len(t) >= 10)
        third, head = len(t) // 3, s[: len(t) + 2]
        if not (t[:third] in head or t[third : 2 * third] in head or t[2 * third :] in head):
            continue  # two edits leave one of three parts as it is
        if any(near(s[:n], t, most) for n in (len(t), len(t) - 1, len(t) + 1)) and len(s) <= len(t) + 26:
            return True
    return False


def form(token: str) -> str:
    """The form of a token with digits: runs of digits, capitals and small letters as 0, A and a."""
    out = []
    for c in token:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _one_form(text: str) -> str:
    """The text with compatibility forms, dashes and invisible characters brought to one form, so that a code
    written with another dash is not taken for two."""
    return unicodedata.normalize("NFKC", text).translate(_DASHES)


def _pair_stream(text: str) -> np.ndarray:
    """Code points with digits and other letters taken together, for pairs of characters."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cp = np.where((cp >= 48) & (cp <= 57), 48, cp)
    low = cp | 32
    return np.where((low >= 97) & (low <= 122), 65, cp)


def _wide_at(cp: np.ndarray) -> np.ndarray:
    return ((cp >= 0x2E80) & (cp <= 0x2FFF)) | ((cp >= 0x3040) & (cp <= 0x9FFF)) | ((cp >= 0xF900) & (cp <= 0xFAFF))


@dataclass(frozen=True)
class Trie:
    """Words as arrays: the children of node k are the nodes ``first[k]`` to ``first[k + 1]``, each with its character and
    the count of the word that ends there, or 0. Node 0 is the root; nodes are numbered level by level."""

    first: np.ndarray
    char: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(words: dict[str, int]) -> Trie:
        live = sorted(w for w in words if w)
        parent, depth, nodes = np.zeros(len(live), np.int64), 0, 1
        children, char, count = [np.zeros(0, np.int64)], [np.zeros(1, np.uint32)], [np.zeros(1, np.int64)]
        while live:
            c = np.fromiter((ord(w[depth]) for w in live), np.uint32, len(live))
            new = np.r_[True, (parent[1:] != parent[:-1]) | (c[1:] != c[:-1])]
            node = nodes + np.cumsum(new) - 1
            ends = np.fromiter((len(w) == depth + 1 for w in live), bool, len(live))
            n = np.zeros(int(new.sum()), np.int64)
            n[node[ends] - nodes] = [words[w] for w, e in zip(live, ends.tolist(), strict=True) if e]
            children.append(parent[new])
            char.append(c[new])
            count.append(n)
            nodes, depth = nodes + len(n), depth + 1
            live, parent = [w for w, e in zip(live, ends.tolist(), strict=True) if not e], node[~ends]
        parents = np.concatenate(children)  # of node 1 onwards, in order
        first = 1 + np.searchsorted(parents, np.arange(nodes + 1))
        return Trie(first.astype(np.int32), np.concatenate(char), np.concatenate(count))


@dataclass
class Vocabulary:
    """What is known of clean text."""

    words: dict[str, int]
    forms: set[str]
    characters: set[str]
    pairs: np.ndarray  # sorted keys first << 32 | second
    pair_counts: np.ndarray
    models: dict[str, set[str]] = field(default_factory=dict)  # by form, of forms whose tokens are few and frequent
    trie: Trie | None = None
    by_right: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    follows: dict[str, int] = field(default_factory=dict)  # "word next"
    memo: dict = field(default_factory=dict)
    memo_pair: dict = field(default_factory=dict)

    def prepare(self) -> Vocabulary:
        self.trie = self.trie or Trie.of(self.words)
        if not self.by_right:
            for key, n in zip(self.pairs.tolist(), self.pair_counts.tolist(), strict=True):
                self.by_right.setdefault(key & 0xFFFFFFFF, []).append((key >> 32, n))
        return self

    def within(self, word: str, most: int) -> list[tuple[str, int, int]]:
        """(candidate, distance, count) of every word of the vocabulary within the edit distance.

        State k of the automaton is a bit vector: bit i is set if the candidate so far can be read as the
        first i characters of the word with k edits.
        """
        n = len(word)
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << (i + 1)
        end, full = 1 << n, (1 << (n + 1)) - 1
        start, state = [], 1
        for _ in range(most + 1):
            start.append(state)
            state |= state << 1 & full
        first, char, count = (memoryview(x) for x in (self.trie.first, self.trie.char, self.trie.count))
        found, stack = [], [(0, "", tuple(start))]
        while stack:
            node, prefix, states = stack.pop()
            for child in range(first[node], first[node + 1]):
                c = chr(char[child])
                hit, new, before, before_new = at.get(c, 0), [], 0, 0
                for s in states:
                    t = s << 1 & hit
                    if new:  # insert, replace, skip
                        t |= before | (before << 1 | before_new << 1) & full
                    new.append(t)
                    before, before_new = s, t
                if any(new):
                    if count[child]:
                        for k, s in enumerate(new):
                            if s & end:
                                found.append((prefix + c, k, count[child]))
                                break
                    stack.append((child, prefix + c, tuple(new)))
        return found

    def candidates(self, word: str) -> list[tuple[str, float, int]]:
        """(candidate, cost, count) of the words that an unknown one may be a misreading of: all within one edit,
        and those within two that one confusion explains."""
        if word not in self.memo:
            found = []
            if len(self.memo) >= KEPT:
                self.memo.clear()
            if len(word) >= 3:
                found = [(w, 0 if _one_confusion(word, w) else EDIT_COST, n) for w, distance, n in self.within(word, 1) if distance]
                if len(word) >= 5:
                    have = {x[0] for x in found} | {word}
                    found += [(w, 0, self.words[w]) for w in _confused(word) - have if w in self.words]
                found = [x for x in found if len(word) > 3 or x[2] >= 20]
            self.memo[word] = found
        return self.memo[word]

    def correction(self, word: str, left: str = "", right: str = "") -> str | None:
        """The most likely intended word of an unknown one between two others, or None if no candidate is close enough."""

        def rank(x: tuple[str, float, int]) -> tuple:
            beside = self.follows.get(f"{left} {x[0]}", 0), self.follows.get(f"{x[0]} {right}", 0)
            return x[1] - sum(np.log1p(beside)), x[1], -x[2], x[0]

        found = self.candidates(word.lower())
        return min(found, key=rank)[0] if found else None

    def no_model(self, token: str) -> bool:
        """Whether a token has the form of models but is none of them."""
        known = self.models.get(form(token))
        return known is not None and token not in known

    def known_pairs(self, cp: np.ndarray) -> np.ndarray:
        key = cp[:-1] << 32 | cp[1:]
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        return self.pairs[at] == key if len(self.pairs) else np.ones(len(key), bool)

    def count(self, a: int, b: int) -> int:
        key = a << 32 | b
        i = int(np.searchsorted(self.pairs, key))
        return int(self.pair_counts[i]) if i < len(self.pairs) and self.pairs[i] == key else 0

    def between(self, left: int, right: int) -> tuple[int, int, float]:
        """The wide character that best fits between two, its weight, and its share of what precedes the right one."""
        at = (left, right)
        if at not in self.memo_pair:
            best, total = (0, 0), 0
            if len(self.memo_pair) >= KEPT:
                self.memo_pair.clear()
            for c, n in self.by_right.get(right, ()):
                total += n
                if is_wide(chr(c)) and (m := self.count(left, c)):
                    best = max(best, (min(n, m), c))
            share = self.count(best[1], right) / total if best[1] else 0.0
            self.memo_pair[at] = (best[1], best[0], share)
        return self.memo_pair[at]


# Letters that scanning takes for one another, longer spellings among them.
CONFUSIONS = (("rn", "m"), ("cl", "d"), ("ri", "n"), ("li", "h"), ("vv", "w"), ("ii", "u"), ("in", "m"), ("l", "i"), ("l", "1"), ("o", "0"), ("s", "5"), ("b", "8"), ("e", "c"), ("t", "f"), ("h", "b"), ("q", "g"), ("ni", "m"), ("ci", "d"), ("i", "1"), ("u", "v"), ("a", "o"), ("z", "2"), ("g", "9"), ("ii", "\u00fc"), ("a:", "\u00e4"), ("o:", "\u00f6"), ("u:", "\u00fc"))


def _confused(seen: str) -> set[str]:
    """All spellings that differ from one by one confusion at one place; they are within two edits."""
    out = set()
    for pair in CONFUSIONS:
        for a, b in (pair, pair[::-1]):
            i = seen.find(a)
            while i >= 0:
                out.add(seen[:i] + b + seen[i + len(a) :])
                i = seen.find(a, i + 1)
    return out


def _one_confusion(seen: str, meant: str) -> bool:
    """Whether the two differ by one confusion at one place."""
    i = 0
    while i < min(len(seen), len(meant)) and seen[i] == meant[i]:
        i += 1
    j = 0
    while j < min(len(seen), len(meant)) - i and seen[-1 - j] == meant[-1 - j]:
        j += 1
    for p in (0, 1):
        for q in (0, 1):
            a, b = seen[max(0, i - p) : len(seen) - max(0, j - q)], meant[max(0, i - p) : len(meant) - max(0, j - q)]
            if any((a, b) in ((x, y), (y, x)) for x, y in CONFUSIONS):
                return True
    return False


class Page:
    """A record's lines with what is wrong with each."""

    def __init__(self, text: str, candidates: list[str], voc: Vocabulary, again: Iterable[str] = ()):
        self.lines, self.voc = text.split("\n"), voc
        n = len(self.lines)
        held = [i for i, x in enumerate(self.lines) if x.strip()]
        edge, again = {*held[:EDGE], *held[-EDGE:]}, set(again)
        self.title = [is_title(x, candidates) or (i in edge and not is_page_number(x) and edge_form(x) in again) for i, x in enumerate(self.lines)]
        self.number = [not self.title[i] and is_page_number(x) for i, x in enumerate(self.lines)]
        self.caption = [bool(_CAPTION.match(x.strip())) for x in self.lines]
        self.body = [i for i, x in enumerate(self.lines) if x.strip() and not (self.title[i] or self.number[i] or self.caption[i])]
        wide = sum(is_wide(c) for c in text)
        self.wide = wide > 0.25 * max(1, sum(c.isalpha() for c in text))
        self.cut: dict[int, tuple[int, str]] = {}  # line -> (next line, joined word)
        self.glyph: dict[int, list[tuple[str, str]]] = {i: [] for i in range(n)}
        self._cuts()
        self._strays()
        self._words()
        if self.wide:
            self._wide_characters()

    def _cuts(self) -> None:
        for a, b in zip(self.body, self.body[1:], strict=False):
            left, right = self.lines[a].rstrip(), self.lines[b].lstrip()
            if len(left) < 2 or left[-1] not in CUT_MARKS or not right or not right[0].isalpha() or not left[-2].isalpha():
                continue
            head = re.search(r"[^\s]+$", left[:-1])[0].lstrip("(\u201c\u201e\"'")
            tail = re.match(r"[^\W_]+", right)[0]
            if left[-1] == "-" and not self._is_cut(head, tail, re.match(r"[^\s,.;:!?]+", right)[0]):
                continue
            self.cut[a] = (b, head + tail)

    def _is_cut(self, head: str, tail: str, token: str) -> bool:
        words, joined = self.voc.words, (head + tail).lower()
        if joined in words:
            return True
        compound = f"{head}-{tail}".lower()
        if compound in words or f"{head}-{token}".lower() in words:
            return False
        if tail[0].isupper() or any(c.isdigit() for c in head):
            return False
        last = head.rsplit("-", 1)[-1].lower()
        if "-" in head and last + tail.lower() in words:
            return True
        if last in words and tail.lower() in words and self.voc.correction(joined) is None:
            return False
        return True

    def _strays(self) -> None:
        for i in self.body + [i for i in range(len(self.lines)) if self.caption[i]]:
            x = self.lines[i].rstrip()
            if i in self.cut or (x and x[-1] in CUT_MARKS and len(x) > 1 and x[-2].isalpha()):
                x = x[:-1]
            for c in dict.fromkeys(x):
                if c not in self.voc.characters and not is_wide(c) and not c.isalnum() and not c.isspace():
                    self.glyph[i].append((c, ""))

    def _tokens(self) -> Iterator[tuple[int, str, list[int]]]:
        """(line, token, further lines) over the body, tokens that go on in the next line joined."""
        carry = None
        for k, i in enumerate(self.body):
            x = self.lines[i]
            if self.wide:
                nxt = self.body[k + 1] if k + 1 < len(self.body) else None
                if carry and (rest := re.match(r"[-.][A-Za-z0-9]+(?:[-.][A-Za-z0-9]+)*", x)):
                    yield carry[1][0], carry[0].rstrip("-.") + rest[0], [*carry[1], i]
                    carry, x = None, " " * rest.end() + x[rest.end() :]
                found = list(_CODE.finditer(x))
                for m in found:
                    tok, own = m[0], [i]
                    if carry and m.start() == 0:
                        tok, own, carry = carry[0] + tok, [*carry[1], i], None
                    if m.end() == len(x) and nxt is not None or (nxt is not None and (x[m.end() :] == "-" or x[m.end() :] == "." and tok[-1].isdigit())):
                        carry = (tok + x[m.end() :], own)
                        continue
                    yield own[0], tok, own
                if carry and (not found or found[0].start() > 0) and carry[1][-1] != i:
                    yield carry[1][0], carry[0].rstrip("-."), carry[1]
                    carry = None
                continue
            words = x.rstrip().split()
            if carry is not None and words:
                words = [w for w in (words[0][len(carry) :], *words[1:]) if w]
                carry = None
            if i in self.cut and words:
                head = words.pop()[:-1]
                nxt = self.lines[self.cut[i][0]].split()[0]
                carry = nxt
                yield i, head + nxt, [i, self.cut[i][0]]
            elif i not in self.cut and words and words[-1][-1] in CUT_MARKS and len(words[-1]) > 1:
                words.pop()  # a compound or code that goes on in the next line
            for w in words:
                yield i, w, [i]
        if carry and isinstance(carry, tuple):
            yield carry[1][0], carry[0].rstrip("-."), carry[1]

    def _words(self) -> None:
        voc = self.voc
        for i, token, left, right in self._unseen():
            if any(c.isdigit() for c in token):
                core = "".join(c for c in token if c in voc.characters or c.isalnum())
                for t in _CODE.findall(core):
                    if not any(c.isdigit() for c in t) or not any(c.isalpha() for c in t):
                        continue
                    fixed = voc.correction(t.lower()) if sum(c.isdigit() for c in t) <= 2 and len(t) > 3 else None
                    word = fixed is not None and sum(c.isdigit() for c in t) == 1 and _one_confusion(t.lower(), fixed)
                    if word or form(t) not in voc.forms or voc.no_model(t):
                        self.glyph[i].append((t, fixed or self._digits(t)))
                continue
            clean = "".join(c for c in token if c.isalpha() or c in "-'\u2019")
            clean = clean.strip("-'\u2019")
            if len(clean) < 3 or any(is_wide(c) for c in clean):
                continue
            if clean.lower() in voc.words or all(p.lower() in voc.words or len(p) < 3 for p in clean.split("-")):
                if clean != token.strip("-'\u2019") and token.lower() not in voc.words and clean.lower() not in voc.words:
                    self.glyph[i].append((token, clean))
                continue
            if "-" in clean and (fixed := voc.correction(clean, left, right)):
                self.glyph[i].append((clean, fixed))
                continue
            parts = clean.split("-")
            for p in parts:
                beside = (left, right) if len(parts) == 1 else ()
                if len(p) >= 3 and p.lower() not in voc.words and (fixed := voc.correction(p, *beside)):
                    self.glyph[i].append((p, fixed))

    def _digits(self, token: str) -> str:
        """The token with its last run of letters read as digits, if that gives a number or a code; else empty."""
        head, tail = re.match(r"(.*?)([A-Za-z0-9.]*)$", token).groups()
        read = head + tail.translate(_AS_DIGITS)
        return read if read.replace(".", "").isdigit() or form(read) in self.voc.forms else ""

    def _unseen(self) -> Iterator[tuple[int, str, str, str]]:
        """(line, unknown token, word before, word after)"""
        tokens = list(self._tokens())
        words = [_WORD.findall(t.lower()) for _, t, _ in tokens]
        after, right = [""] * len(tokens), ""
        for k in range(len(tokens) - 1, -1, -1):
            after[k], right = right, words[k][0] if words[k] else right
        left = last = ""
        for (i, token, own), found, right in zip(tokens, words, after, strict=True):
            left, last = last, found[-1] if found else last
            core = token.strip(".,;:!?()[]\"'\u201c\u201d\u201e\u00bb\u00ab\u3002\uff0c\uff1b\uff1a\uff08\uff09")
            if not core or core.lower() in self.voc.words:
                continue
            if len(own) > 1:  # which part is misread: the one without which the rest would be known
                head_len = len(self.lines[own[0]].rstrip().split()[-1]) - 1 if not self.wide else 0
                fixed = self.voc.correction(core, left, right) if not any(c.isdigit() for c in core) else None
                low = core.lower()
                if fixed:
                    same = 0
                    while same < min(len(low), len(fixed)) and low[same] == fixed[same]:
                        same += 1
                    yield (own[1] if same >= head_len and not self.wide else own[0]), core, left, right
                    continue
                if not self.wide:
                    continue
                tail = re.match(r"[-.]?[A-Za-z0-9]+(?:[-.][A-Za-z0-9]+)*", self.lines[own[-1]])[0]
                read = core[: -len(tail)] + tail.translate(_AS_DIGITS)
                if core.endswith(tail) and read != core and form(read) in self.voc.forms:
                    i = own[-1]
            yield i, core, left, right

    def _wide_characters(self) -> None:
        text, where = [], []
        for i in self.body:
            text.append(self.lines[i])
            where += [i] * len(self.lines[i])
        joined = "".join(text)
        if len(joined) < 3:
            return
        cp = _pair_stream(joined)
        wide = _wide_at(cp)
        known = self.voc.known_pairs(cp)
        bad = np.flatnonzero(~known & (wide[:-1] | wide[1:]))
        done: set[int] = set()
        for k in bad.tolist():
            both = k + 1 < len(known) and not known[k + 1]
            for x, strict in ((k + 1, not both), (k, True)):
                if x in done or not wide[x] or not 0 < x < len(cp) - 1:
                    continue
                l, r = int(cp[x - 1]), int(cp[x + 1])
                if x == k and x - 1 >= 0 and not known[x - 1]:
                    continue  # the pair before it was unknown too: looked at already
                c, weight, share = self.voc.between(l, r)
                if not c or c == cp[x]:
                    continue
                # one unknown pair: the other must be rare beside what is usual there
                own = min(self.voc.count(l, int(cp[x])) or 0, self.voc.count(int(cp[x]), r) or 0)
                side = max(self.voc.count(l, int(cp[x])), self.voc.count(int(cp[x]), r))
                if strict and (share < 0.6 or side * 4 > weight):
                    continue
                if weight > 20 * own and weight >= 3:
                    done.add(x)
                    self.glyph[where[x]].append((joined[x], chr(c)))
                    break

    def noise(self) -> list[tuple[int, str]]:
        out = []
        for i in range(len(self.lines)):
            if self.title[i]:
                out.append((i, "header"))
            elif self.number[i]:
                out.append((i, "pageno"))
            else:
                if i in self.cut:
                    out.append((i, "hyphen"))
                if self.glyph[i]:
                    out.append((i, "glyph"))
        return out

    def repaired(self) -> str:
        """The text without page furniture, cut words joined, misread characters replaced, in paragraphs."""
        widest = max((len(self.lines[i]) for i in self.body), default=0)
        paragraphs, now, glue = [], "", ""
        for i, x in enumerate(self.lines):
            if self.title[i] or self.number[i]:
                continue
            for seen, meant in self.glyph[i]:
                if meant and len(seen) == len(meant) == 1:
                    x = x.replace(seen, meant)
                elif seen and not any(c.isalnum() for c in seen):
                    x = x.replace(seen, meant)
                elif meant:
                    x = re.sub(rf"(?<!\w){re.escape(seen)}(?!\w)", lambda m, w=meant: w.capitalize() if m[0][:1].isupper() and w.isalpha() else w, x)
            s = x.strip() if not self.wide else x.strip("\r")
            if not s.strip() or self.caption[i]:
                paragraphs += [p for p in (now, s.strip()) if p]
                now, glue = "", ""
                continue
            if i in self.cut:
                s = s.rstrip()[:-1]
            now += glue + s
            joins = self.wide or i in self.cut or re.search(r"\w-$", s.rstrip())
            glue = "" if joins else " "
            if s.rstrip()[-1:] and s.rstrip()[-1] in _ENDS and len(s) < 0.8 * widest:
                paragraphs.append(now)
                now, glue = "", ""
        return "\n".join(p.strip() for p in [*paragraphs, now] if p.strip())


def records(parents: DataFrame, sections: DataFrame, documents: DataFrame) -> DataFrame:
    """(record_table, record_id, text, file, page): all blocks and sections, repeated rows once.

    ``page`` is 1 where the record is known to be a page image, 0 where it is known not to be or has no
    page, null where its lines must tell. Null ids and texts are left out.
    """
    p = parents.filter("parent_id is not null and text is not null")
    pdf = F.lower(F.coalesce("source", F.lit(""))).endswith(".pdf")
    p = p.select(
        F.lit("parents").alias("record_table"), F.col("parent_id").alias("record_id"), "text", F.col("source").alias("file"), F.when(F.col("page_start").isNotNull() & ~pdf, 1).alias("page")
    )
    names = documents.filter("doc_ref is not null").groupBy(F.col("doc_ref").alias("doc_id")).agg(F.min("filename").alias("file"))
    s = sections.filter("section_id is not null and text is not null").join(names, "doc_id", "left")
    image = (F.col("kind") == "image") | (F.element_at("extra", "origin") == "page_image")
    flat = F.col("kind").isin("text", "table")
    s = s.select(F.lit("sections").alias("record_table"), F.col("section_id").alias("record_id"), "text", "file", F.when(image, 1).when(flat, 0).alias("page"))
    return p.unionByName(s)


def is_scanned(text: str, page: int | None) -> bool:
    return page == 1 or (page is None and looks_scanned(text))


def vocabulary_counts(rows: DataFrame) -> DataFrame:
    """(kind, entry, n): words, forms, models, characters, pairs of characters and of words of the records that are not scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, forms, models, chars, pairs, follows = (Counter() for _ in range(6))
        for batch in batches:
            texts = [t for t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not is_scanned(t, p)]
            for first in range(0, len(texts), 200):
                joined = "\n".join(texts[first : first + 200])
                for line in joined.lower().split("\n"):
                    found = _WORD.findall(line)
                    words.update(found)
                    follows.update(f"{a} {b}" for a, b in zip(found, found[1:], strict=False) if not (is_wide(a[0]) or is_wide(b[0])))
                codes = [t for t in _CODE.findall(_one_form(joined)) if not t.isdigit() and not t.isalpha()]
                forms.update(map(form, codes))
                models.update(t for t in codes if t.isalnum())
                cp = _pair_stream(joined)
                wide = _wide_at(cp)
                key, n = np.unique((cp[:-1] << 32 | cp[1:])[wide[:-1] | wide[1:]], return_counts=True)
                pairs.update(dict(zip(key.tolist(), n.tolist(), strict=True)))
                odd = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
                c, n = np.unique(odd, return_counts=True)
                chars.update(dict(zip(map(chr, c.tolist()), n.tolist(), strict=True)))
        for kind, counts in (("word", {w: n for w, n in words.items() if not is_wide(w[0])}), ("form", forms), ("model", models), ("char", chars), ("pair", pairs), ("follow", follows)):
            entry = [str(k) for k in counts]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(entry), pa.string()), pa.array(entry, pa.string()), pa.array(list(counts.values()), pa.int64())], ["kind", "entry", "n"])

    return rows.select("text", "page").mapInArrow(run, "kind string, entry string, n bigint").groupBy("kind", "entry").agg(F.sum("n").alias("n"))


def vocabulary(rows: DataFrame) -> Vocabulary:
    """The entries of at least ``LEAST_SHARE`` (forms: ``FORM_SHARE``) of their kind, and at least two occurrences (three for forms)."""
    counts = vocabulary_counts(rows)
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    is_form = F.col("kind") == "form"
    least = F.greatest(F.when(is_form, 3).otherwise(2), F.ceil(F.col("total") * F.when(is_form, FORM_SHARE).otherwise(LEAST_SHARE)))
    kept = counts.join(F.broadcast(totals), "kind").filter(F.col("n") >= least).select("kind", "entry", "n").toPandas()  # six totals; at most 1 / LEAST_SHARE entries of a kind
    by = {k: dict(zip(g.entry, g.n, strict=True)) for k, g in kept.groupby("kind")}
    pairs, forms = by.get("pair", {}), set(by.get("form", {}))
    keys = np.array([int(k) for k in pairs], np.int64)
    order = np.argsort(keys)
    return Vocabulary(by.get("word", {}), forms, set(by.get("char", {})), keys[order], np.array(list(pairs.values()), np.int64)[order], closed(by.get("model", {}), forms), Trie.of(by.get("word", {})), follows=by.get("follow", {}))


def closed(tokens: dict[str, int], forms: set[str], repeats: int = 10, rare: float = 0.01) -> dict[str, set[str]]:
    """The tokens of each known form whose tokens stand ``repeats`` times on average, as the names of models do
    and numbers of orders do not; tokens with less than ``rare`` of that average are none of them."""
    by: dict[str, dict[str, int]] = {}
    for t, n in tokens.items():
        by.setdefault(form(t), {})[t] = n
    mean = {f: sum(g.values()) / len(g) for f, g in by.items() if f in forms}
    return {f: {t for t, n in by[f].items() if n >= rare * m} for f, m in mean.items() if m >= repeats}


def edge_form(line: str) -> str:
    """What is compared of lines at the edges of pages: letters only, so that page numbers make no difference."""
    return "".join(c for c in _plain(line) if not c.isdigit())


def edges(text: str) -> list[str]:
    """The forms, of at least six letters, of the first and last lines of a page, none twice."""
    rows = [x for x in text.split("\n") if x.strip()]
    return [f for f in dict.fromkeys(map(edge_form, [*rows[:EDGE], *rows[-EDGE:]])) if len(f) >= 6]


def furniture(rows: DataFrame) -> DataFrame:
    """(file, again): of each file the forms of lines that come again at the top or bottom of its scanned pages; hardly more
    than ``2 * EDGE / AGAIN_SHARE`` of them. Counts of a page's own lines are all that is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, file, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file is not None and is_scanned(text, page):
                    seen.update((file, f) for f in ["", *edges(text)])
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], ["file", "form", "n"])

    counts = rows.select("text", "file", "page").mapInArrow(run, "file string, form string, n bigint").groupBy("file", "form").agg(F.sum("n").alias("n")).filter(F.col("n") >= AGAIN)
    pages_of = F.max(F.when(F.col("form") == "", F.col("n"))).over(Window.partitionBy("file"))
    often = counts.withColumn("pages", pages_of).filter((F.col("form") != "") & (F.col("n") >= AGAIN_SHARE * F.col("pages")))
    return often.groupBy("file").agg(F.collect_list("form").alias("again"))


def _pages(rows: DataFrame, voc: Vocabulary, schema: str, emit) -> DataFrame:  # noqa: ANN001
    sent = rows.sparkSession.sparkContext.broadcast(voc)
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value.prepare()
        for batch in batches:
            out = []
            for table, key, text, file, page, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if is_scanned(text, page):
                    out += emit(table, key, Page(text, titles(file), v, again or ()))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [pa.int32() if "int" in x else pa.string() for x in schema.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    known = with_furniture(rows, settle(furniture(rows)))
    return known.select("record_table", "record_id", "text", "file", "page", "again").mapInArrow(run, schema)


def with_furniture(rows: DataFrame, again: DataFrame) -> DataFrame:
    """``rows`` with ``again`` of their file. It is sent to all tasks as long as it is of ``SENT`` files at most; beyond that,
    a file's rows are spread over ``SALTS`` keys, so that a file of a third of all rows is not one task."""
    if again.limit(SENT + 1).count() <= SENT:
        return rows.join(F.broadcast(again), "file", "left")
    salt = F.pmod(F.xxhash64("record_id"), F.lit(SALTS))
    spread = again.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.withColumn("__salt", salt).join(spread, ["file", "__salt"], "left").drop("__salt")


def noise(rows: DataFrame, voc: Vocabulary) -> DataFrame:
    """(record_table, record_id, line_no, noise) of the scanned records; a repeated row counts once."""
    schema = "record_table string, record_id string, line_no int, noise string"
    return _pages(rows, voc, schema, lambda t, k, p: [(t, k, i, n) for i, n in p.noise()]).distinct()


def repaired(rows: DataFrame, voc: Vocabulary) -> DataFrame:
    """(record_table, record_id, text) of the scanned records, as continuous paragraphs."""
    schema = "record_table string, record_id string, text string"
    return _pages(rows, voc, schema, lambda t, k, p: [(t, k, p.repaired())]).distinct()
