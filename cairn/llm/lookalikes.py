"""One consistent form of texts that look alike (problem 5).

Method: look-alike classes by union-find over strings and code points. Every code point that occurs in the
corpus is joined to its compatibility form, to its decomposed spelling, to the Latin letter it resembles, to
the plain blank, to the hyphen or to nothing, as applies; classes are transitive. The representative of a
class is its most frequent code point in the corpus; a class that has a string of several characters is
represented by that string's own representatives, so that every spelling ends in the same place. Texts are
rewritten greedily (leftmost, longest) by a multi-pattern automaton, then composed.

The corpus is counted and rewritten by Spark; what reaches the driver is one count per code point in use,
which Unicode bounds to 1,114,112 rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets beside the Latin letters they look like.
CYRILLIC_ALIKE = "АВЕЅІЈКМНОРСТХУԌԚԜҮаеѕіјорсухһԁԛԝѵ"
CYRILLIC_LATIN = "ABESIJKMHOPCTXYGQWYaesijopcyxhdqwv"
GREEK_ALIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιανρυκϳϲϹ"
GREEK_LATIN = "ABEZHIKMNOPTYXoiavpukjcC"
ARMENIAN_ALIKE = "օսհոցզՏՍՕԼ"
ARMENIAN_LATIN = "ouhngqSUOL"
# Dashes that are as long as a hyphen.
HYPHENS = "\u2010\u2011\u2212\u2043\ufe63\uff0d\u02d7"
# Characters without a shape of their own.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f"
    "\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069"
    "\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f\ufeff"
)


def relatives(c: str) -> list[str]:
    """The strings that code point ``c`` is to be read as, by each kind of likeness."""
    if c in INVISIBLE:
        return [""]
    if c == "\t" or unicodedata.category(c) == "Zs":
        return [" "]
    if c in HYPHENS:
        return ["-"]
    out = [unicodedata.normalize("NFKC", c), unicodedata.normalize("NFD", c)]
    for alike, latin in ((CYRILLIC_ALIKE, CYRILLIC_LATIN), (GREEK_ALIKE, GREEK_LATIN), (ARMENIAN_ALIKE, ARMENIAN_LATIN)):
        if (i := alike.find(c)) >= 0:
            out.append(latin[i])
    return [s for s in out if s != c]


class Classes:
    """Union-find over strings, one string being the name of each class."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        root = s
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while s != root:
            self.parent[s], s = root, self.parent[s]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)


def rewrites(counts: dict[str, int]) -> dict[str, str]:
    """What each string of a class of two or more is rewritten to, from the corpus's code point counts."""
    classes, todo, met = Classes(), list(counts), set(counts)
    while todo:
        c = todo.pop()
        for s in relatives(c):
            classes.union(c, s)
            for x in s:
                if x not in met:
                    met.add(x)
                    todo.append(x)
    members: dict[str, list[str]] = {}
    for s in list(classes.parent):
        members.setdefault(classes.find(s), []).append(s)

    memo: dict[str, str] = {}

    def represent(s: str) -> str:
        if s not in classes.parent:
            return s
        root = classes.find(s)
        if root not in memo:
            own = members[root]
            if "" in own:
                memo[root] = ""
            elif longer := [x for x in own if len(x) > 1]:
                spelt = min(longer, key=lambda x: (-len(x), x))
                memo[root] = unicodedata.normalize("NFC", "".join(represent(x) if x != s else x for x in spelt))
            else:
                memo[root] = min(own, key=lambda x: (-counts.get(x, 0), x))
        return memo[root]

    return {s: r for s in classes.parent if s and (r := represent(s)) != s}


def automaton(table: dict[str, str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for s, r in table.items():
        a.add_word(s, (len(s), r))
    if table:
        a.make_automaton()
    return a


def rewrite(text: str, a: ahocorasick.Automaton) -> str:
    """``text`` with every pattern replaced, leftmost and longest first, in composed form."""
    if len(a):
        out, done = [], 0
        for end, (size, r) in a.iter_long(text):
            out += (text[done : end + 1 - size], r)
            done = end + 1
        if done:
            out.append(text[done:])
            text = "".join(out)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def code_point_counts(df: DataFrame, text: str) -> DataFrame:
    """(cp int, n bigint): occurrences of every code point in all rows of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            joined = "".join(t for t in batch.column(0).to_pylist() if t).encode("utf-32-le", "surrogatepass")
            part = np.bincount(np.frombuffer(joined, np.uint32))
            total[: len(part)] += part
        cps = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cps, pa.int32()), pa.array(total[cps])], ["cp", "n"])

    return df.select(text).mapInArrow(run, "cp int, n bigint").groupBy("cp").agg(F.sum("n").alias("n"))


def corpus_rewrites(*columns: tuple[DataFrame, str]) -> dict[str, str]:
    """The rewriting table of one corpus of several text columns."""
    counts: dict[str, int] = {}
    for df, text in columns:
        for cp, n in code_point_counts(df, text).collect():  # one row per code point: bounded by Unicode
            counts[chr(cp)] = counts.get(chr(cp), 0) + n
    return rewrites(counts)


def canonical(df: DataFrame, text: str, table: dict[str, str], out: str = "canonical") -> DataFrame:
    """``df`` with the column ``out``, the consistent form of ``text``. Null stays null, empty stays empty."""

    @F.pandas_udf("string")
    def form(s):  # noqa: ANN001, ANN202
        a = _automaton(tuple(sorted(table.items())))
        return s.map(lambda t: None if t is None else rewrite(t, a))

    return df.withColumn(out, form(F.col(text)))


_AUTOMATA: dict[int, tuple[tuple, ahocorasick.Automaton]] = {}


def _automaton(items: tuple) -> ahocorasick.Automaton:
    at = hash(items)
    if at not in _AUTOMATA or _AUTOMATA[at][0] != items:
        _AUTOMATA[at] = (items, automaton(dict(items)))
    return _AUTOMATA[at][1]


def reading_pairs(df: DataFrame, key: str, text: str, table: dict[str, str]) -> DataFrame:
    """(key_a, key_b) of the records whose texts differ as stored but have the same consistent form.

    Null and empty texts are in no pair; repeated rows count once. Stored texts are paired first, each
    spelling once per class, and only then joined to the records that hold them: copies of a popular
    text are never compared with one another.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text")).filter("key is not null and length(text) > 0")
    # forms go by 128 bits of hashes, spellings by 64 within a form
    form = (F.xxhash64("canonical").alias("form"), F.xxhash64(F.lit(5), "canonical").alias("form2"))
    rows = canonical(rows, "text", table).select("key", *form, F.xxhash64("text").alias("spelt"))
    rows = rows.distinct()
    spellings = rows.select("form", "form2", "spelt").distinct()
    a, b = spellings.withColumnRenamed("spelt", "spelt_a"), spellings.withColumnRenamed("spelt", "spelt_b")
    pairs = a.join(b, ["form", "form2"]).filter("spelt_a < spelt_b")
    left = rows.select(F.col("key").alias("k1"), "form", "form2", F.col("spelt").alias("spelt_a"))
    right = rows.select(F.col("key").alias("k2"), "form", "form2", F.col("spelt").alias("spelt_b"))
    both = pairs.join(left, ["form", "form2", "spelt_a"]).join(right, ["form", "form2", "spelt_b"]).filter("k1 <> k2")
    return both.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b")).distinct()
