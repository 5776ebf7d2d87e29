"""Near-duplicate records with small edits (problem 1).

Method: binary trie self-join over bit sketches. A text's set of character runs is hashed to ``PASSES * BINS``
minimum hashes; their lowest bits make a 128-bit sketch, in which two sets of similarity s differ in about
(1 - s) / 2 of the bits, and unlike ones in half of them. Sketches hang in a forest of binary tries. In each of
``trees`` tries the path from the root begins with the bits of a few whole minimum hashes, where no difference is
allowed, and goes on with the sketch. Below such a path, node pairs are traversed together, ``STEP_BITS`` bits a step,
adding up the differing bits. The error budget grows with the depth: at every depth it is what pairs at the threshold
stay within but for a few in a million, so that unlike pairs are left after some 40 bits and not only near the leaves.
Paths of single texts are compressed: what remains of two of them is compared at once. Pairs of leaves that stay within
the budget are verified against the exact sets.

Spark shuffles the rows by path, so that each group is one trie node. Paths that many texts share are found before,
from counts within batches, and their texts are spread by a hash over blocks of about ``BLOCK`` texts; so is any other
node of more than ``BLOCK`` texts, without being held. Every pair of blocks is a group of its own, so no group grows with
the data; a text of such a node of n is sent to n / ``BLOCK`` groups. Copies of a text take part once. ``path`` and
``trees`` follow from the number of records (``Shape.fitted``), such that the chance of missing a pair at the threshold
is below 0.001 (tests measure recall against brute force).

Texts are told apart by a 64-bit hash: among a billion different texts the chance that any two share one is 0.03.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.runtime import settle

#: Texts of one trie node that are joined in one group.
BLOCK = 8192
#: Bits that a step of the traversal goes down, and deviations from the mean that the error budget allows at each depth.
STEP_BITS, DEVIATIONS = 4, 4.0
#: Shared root paths, and ids of texts in pairs, that are sent to all tasks; more are joined by shuffling.
SENT = 1_000_000
#: Texts of a batch that are counted together to find paths that many share.
COUNTED = 20_000
#: Steps of compressed paths that are compared at once.
PATH_STEPS = 8
#: Node pairs that a step of the traversal expands at once.
STEP = 1_000_000
#: Unicode white space. Fixed values.
WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
SKETCH_BITS = 128
#: Chance with which a pair at the threshold may be missed.
MISSED = 0.001


@dataclass(frozen=True)
class Shape:
    """How texts of a field become sets, and how those are sketched."""

    run: int  # characters of a run
    threshold: float
    passes: int
    bins: int
    path: int  # minimum hashes of a trie's root path
    trees: int

    @property
    def budgets(self) -> np.ndarray:
        """The most differing bits down to each depth, a multiple of ``STEP_BITS``, of the sketch."""
        p, depth = (1 - self.threshold) / 2, np.arange(STEP_BITS, SKETCH_BITS + 1, STEP_BITS)
        return np.ceil(depth * p + DEVIATIONS * np.sqrt(depth * p * (1 - p))).astype(np.int64)

    def fitted(self, records: int) -> Shape:
        """The shape for so many records: each hash of the root path cuts by about a hundred the unlike texts that share
        it by chance, and the trees are so many that a pair at the threshold is missed with a chance below ``MISSED``."""
        path = max(self.path, math.ceil(math.log(max(2, records), 100)))
        if path == self.path:
            return self
        trees = math.ceil(math.log(MISSED) / math.log(1 - self.threshold**path))
        return replace(self, path=path, trees=trees, passes=max(self.passes, -(-path * trees // self.bins)))


BLOCKS = Shape(run=8, threshold=0.6, passes=8, bins=16, path=3, trees=32)
NAMES = Shape(run=3, threshold=0.7, passes=40, bins=4, path=4, trees=40)


def squeezed(text: str) -> str:
    """Lower case without white space."""
    return WHITE.sub("", text.lower())


def stem(name: str) -> str:
    """Lower-case file name without its last extension."""
    name = name.lower()
    dot = name.rfind(".")
    return name[:dot] if dot > 0 else name


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of ``n`` code points of every text, and the text each belongs to."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(cps) - n + 1), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + cps[k : k + len(h)]
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
    fits = np.arange(len(h)) <= (np.cumsum(sizes) - n)[owner]
    return _mix(h[fits]), owner[fits]


def signatures(texts: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the trie paths (trees columns, int64), the sketch (2 columns, uint64), and whether it has runs."""
    total = shape.passes * shape.bins
    mins = np.empty((len(texts), total), np.uint64)
    some = np.zeros(len(texts), bool)
    bits = np.uint64(64 - shape.bins.bit_length() + 1)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < 100_000):
            size += len(texts[j])
            j += 1
        h, owner = _run_hashes(texts[i:j], shape.run)
        some[i:j] = np.bincount(owner, minlength=j - i) > 0
        for p in range(shape.passes):
            g = _mix(h + np.uint64((p + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            m = np.full((j - i) * shape.bins, _MAX)
            np.minimum.at(m, owner * shape.bins + (g >> bits).astype(np.int64), g)
            mins[i:j, p * shape.bins : (p + 1) * shape.bins] = m.reshape(j - i, shape.bins)
        i = j
    # An empty bin borrows from the next filled one of its pass, told apart by the distance.
    by_pass = mins.reshape(-1, shape.bins)
    empty = by_pass == _MAX
    for far in range(1, shape.bins):
        if not empty.any():
            break
        take = np.roll(by_pass, -far, axis=1)
        ok = empty & (take != _MAX) & ~np.roll(empty, -far, axis=1)
        by_pass = np.where(ok, _mix(take + np.uint64(far)), by_pass)
        empty &= ~ok
    mins = by_pass.reshape(len(texts), total)
    low = (_mix(mins[:, :SKETCH_BITS]) & np.uint64(1)).astype(np.uint8)
    sketch = np.packbits(low, axis=1).view(">u8").astype(np.uint64)
    paths = np.empty((len(texts), shape.trees), np.uint64)
    # Each tree takes one value of each of `path` stretches of the signature, so that its values differ.
    for t in range(shape.trees):
        k = np.full(len(texts), t + 1, np.uint64)
        for r in range(shape.path):
            k = _mix(k * np.uint64(0xD6E8FEB86659FD93) + mins[:, (t * shape.path + r) % total])
        paths[:, t] = k
    return paths.view(np.int64), sketch, some


def trie_pairs(steps: np.ndarray, roots: np.ndarray, frontier: tuple[np.ndarray, np.ndarray], budgets: np.ndarray, left: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) within the error budget of every depth, by joint traversal of node pairs.

    ``steps``: sketches as numbers of ``STEP_BITS`` bits, a row each, sorted within each root. ``roots``: first row of
    each root. ``frontier``: the pairs of roots to traverse together, a root with itself for a self-join. ``budgets``:
    the most differing bits down to each depth. ``left`` takes (depth, pairs of rows that were looked at, pairs that
    stayed) for reports.
    """
    n, depth = steps.shape
    new = np.zeros(n, bool)
    new[roots] = True
    starts, child_of = [np.flatnonzero(new)], []
    for level in range(depth):
        step = np.zeros(n, bool)
        step[1:] = steps[1:, level] != steps[:-1, level]
        new = new | step
        starts.append(np.flatnonzero(new))
        first = np.searchsorted(starts[level + 1], starts[level])
        child_of.append(np.r_[first, len(starts[level + 1])])
    ends = [np.r_[s[1:], n] for s in starts]
    found_i, found_j = [], []

    def note(level: int, seen: np.ndarray, kept: np.ndarray) -> None:
        if left is not None:
            left.append((level + 1, int(seen.sum()), int(seen[kept].sum())))

    def finish(level: int, i: np.ndarray, j: np.ndarray, err: np.ndarray) -> None:
        """Pairs of single rows: what remains of their paths is compared at once, some steps at a time."""
        while level < depth and len(i):
            to = min(depth, level + PATH_STEPS)
            e = err[:, None] + np.cumsum(np.bitwise_count(steps[i, level:to] ^ steps[j, level:to]), axis=1, dtype=np.int64)
            ok = e <= budgets[level:to]
            stays = np.logical_and.accumulate(ok, axis=1)
            seen = np.ones(len(i), bool)
            for k in range(to - level):
                note(level + k, seen, stays[:, k])
                seen = stays[:, k]
            keep = stays[:, -1]
            i, j, err, level = i[keep], j[keep], e[keep, -1], to
        if len(i):
            found_i.append(i)
            found_j.append(j)

    stack = [(0, *frontier, np.zeros(len(frontier[0]), np.int64))]
    while stack:
        level, u, v, err = stack.pop()
        if level == depth:  # equal paths all the way: every row of one with every row of the other
            nu, nv = ends[level][u] - starts[level][u], ends[level][v] - starts[level][v]
            size = nu * nv
            pair = np.repeat(np.arange(len(u)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            a, b = starts[level][u][pair] + at // nv[pair], starts[level][v][pair] + at % nv[pair]
            keep = (u != v)[pair] | (a < b)
            found_i.append(a[keep])
            found_j.append(b[keep])
            continue
        kids = child_of[level]
        nu, nv = kids[u + 1] - kids[u], kids[v + 1] - kids[v]
        size = nu * nv
        if len(u) > 1 and size.sum() > STEP:
            half = len(u) // 2
            stack += [(level, u[:half], v[:half], err[:half]), (level, u[half:], v[half:], err[half:])]
            continue
        pair = np.repeat(np.arange(len(u)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        a, b = kids[u][pair] + at // nv[pair], kids[v][pair] + at % nv[pair]
        own = (u == v)[pair]
        s, e = starts[level + 1], ends[level + 1]
        held = e - s
        keep = ~own | (a < b) | ((a == b) & (held[a] > 1))
        a, b, pair = a[keep], b[keep], pair[keep]
        total = err[pair] + np.bitwise_count(steps[s[a], level] ^ steps[s[b], level])
        keep = total <= budgets[level]
        note(level, np.where(a == b, held[a] * (held[a] - 1) // 2, held[a] * held[b]), keep)
        a, b, total = a[keep], b[keep], total[keep]
        single = (held[a] == 1) & (held[b] == 1)
        if single.any():
            finish(level + 1, s[a[single]], s[b[single]], total[single])
        if not single.all():
            stack.append((level + 1, a[~single], b[~single], total[~single]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i) if found_i else none), (np.concatenate(found_j) if found_j else none)


def _steps(s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Sketches as numbers of ``STEP_BITS`` = 4 bits, in order."""
    both = np.ascontiguousarray(np.stack([s1, s2], axis=1).astype(">i8")).view(np.uint8).reshape(len(s1), -1)
    out = np.empty((len(s1), 2 * both.shape[1]), np.uint8)
    out[:, 0::2], out[:, 1::2] = both >> 4, both & 15
    return out


def _join_sorted(key: np.ndarray, side: np.ndarray, tid: np.ndarray, s1: np.ndarray, s2: np.ndarray, budgets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within each key; where a key has rows of two sides, only pairs across them."""
    u1, u2 = s1.view(np.uint64), s2.view(np.uint64)
    order = np.lexsort((u2, u1, side, key))
    key, side, tid, s1, s2 = key[order], side[order], tid[order], s1[order], s2[order]
    n = len(key)
    change = np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])]
    roots = np.flatnonzero(change)
    sizes = np.diff(np.r_[roots, n])
    r = np.arange(len(roots))
    paired = np.zeros(len(roots), bool)
    if len(roots) > 1:
        paired[1:] = (key[roots[1:]] == key[roots[:-1]])
    across = r[paired]
    alone = ~paired & ~np.r_[paired[1:], False] & (sizes > 1)
    u = np.concatenate([r[alone], across - 1])
    v = np.concatenate([r[alone], across])
    i, j = trie_pairs(_steps(s1, s2), roots, (u, v), budgets)
    return tid[i], tid[j]


_OUT = "a bigint, b bigint, key bigint, chunk int, s1 bigint, s2 bigint"


def _emit(a, b, key=None, chunk=None, s1=None, s2=None) -> pa.RecordBatch:  # noqa: ANN001
    n = len(a)
    long, null = pa.int64(), pa.nulls
    cols = [pa.array(a, long), null(n, long) if b is None else pa.array(b, long)]
    if key is None:
        cols += [null(n, long), null(n, pa.int32()), null(n, long), null(n, long)]
    else:
        cols += [pa.array(np.full(n, key), long), pa.array(np.full(n, chunk), pa.int32()), pa.array(s1, long), pa.array(s2, long)]
    return pa.RecordBatch.from_arrays(cols, ["a", "b", "key", "chunk", "s1", "s2"])


def _blocks(cols: list, rows: slice, chunk: int) -> Iterator[pa.RecordBatch]:
    for s in range(rows.start, rows.stop, BLOCK):
        e = min(rows.stop, s + BLOCK)
        yield _emit(cols[1][s:e], None, cols[0][s], chunk, cols[2][s:e], cols[3][s:e])
        chunk += 1


def _join_small_nodes(budgets: np.ndarray):  # noqa: ANN202
    """Over rows sorted by path: pairs of every node of at most BLOCK texts; larger nodes are passed on in
    numbered blocks (b null), never held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 4
        hot, chunk = None, 0  # a large node that earlier batches began, and its next block
        for last, batch in _with_end(batches):
            cols = kept if batch is None else [np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept)]
            if hot is not None and len(cols[0]):
                m = int(np.searchsorted(cols[0], hot, "right"))
                for out in _blocks(cols, slice(0, m), chunk):
                    yield out
                    chunk += 1
                cols = [c[m:] for c in cols]
                if len(cols[0]):
                    hot = None
            key = cols[0]
            if not len(key):
                kept = cols
                continue
            cut = len(key) if last else int(np.searchsorted(key, key[-1], "left"))  # the last path may go on
            if len(key) - cut > BLOCK:
                hot, chunk = key[-1], 0
                for out in _blocks(cols, slice(cut, len(key)), 0):
                    yield out
                    chunk += 1
                cols = [c[:cut] for c in cols]
            kept = [c[cut:] for c in cols]
            if not cut:
                continue
            key = key[:cut]
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[begins, cut])
            for g in np.flatnonzero(sizes > BLOCK):
                yield from _blocks(cols, slice(int(begins[g]), int(begins[g] + sizes[g])), 0)
            rows = np.repeat((sizes > 1) & (sizes <= BLOCK), sizes)
            if rows.any():
                k, t, s1, s2 = (c[:cut][rows] for c in cols)
                a, b = _join_sorted(k, np.zeros(len(k), np.int8), t, s1, s2, budgets)
                if len(a):
                    yield _emit(np.minimum(a, b), np.maximum(a, b))

    return run


def _with_end(batches: Iterator) -> Iterator[tuple[bool, object]]:
    for b in batches:
        yield False, b
    yield True, None


def _join_block_pairs(budgets: np.ndarray):  # noqa: ANN202
    """Over rows sorted by block pair (g): pairs across the two blocks, or within one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 5
        for last, batch in _with_end(batches):
            cols = kept if batch is None else [np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept)]
            g = cols[0]
            if not len(g):
                continue
            cut = len(g) if last else int(np.searchsorted(g, g[-1], "left"))
            if cut:
                a, b = _join_sorted(*(c[:cut] for c in cols), budgets)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            kept = [c[cut:] for c in cols]

    return run


def signed(texts: DataFrame, prepare, shape: Shape) -> DataFrame:  # noqa: ANN001
    """(tid, paths, s1, s2): one row per distinct text that has runs. ``texts`` has (tid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                paths, sketch, some = signatures([prepare(t) for t in part.column(1).to_pylist()], shape)
                paths = paths[some]
                offsets = pa.array(np.arange(len(paths) + 1, dtype=np.int32) * shape.trees)
                lists = pa.ListArray.from_arrays(offsets, pa.array(paths.reshape(-1)))
                tid = pa.array(part.column(0).to_numpy(zero_copy_only=False)[some])
                s = np.ascontiguousarray(sketch[some]).view(np.int64)
                yield pa.RecordBatch.from_arrays([tid, lists, pa.array(s[:, 0]), pa.array(s[:, 1])], ["tid", "paths", "s1", "s2"])

    rows = texts.select("tid", "text").mapInArrow(run, "tid bigint, paths array<bigint>, s1 bigint, s2 bigint")
    return rows.dropDuplicates(["tid"])


def shared_paths(signed_rows: DataFrame) -> DataFrame:
    """(key, n): root paths that more than ``BLOCK`` texts share, with about their number. Counted within batches, where a
    path of many texts stands more than once, so that hardly more than the shared ones are shuffled; one that is missed
    is cut into blocks later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for last, batch in _with_end(batches):
            kept += [] if batch is None else [batch.column(0).flatten().to_numpy(zero_copy_only=False)]
            if kept and (last or sum(map(len, kept)) >= COUNTED * 32):
                key, n = np.unique(np.concatenate(kept), return_counts=True)
                kept = []
                yield pa.RecordBatch.from_arrays([pa.array(key[n > 1]), pa.array(n[n > 1])], ["key", "n"])

    return signed_rows.select("paths").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK)


def candidate_pairs(signed_rows: DataFrame, shape: Shape) -> DataFrame:
    """(a, b) with a < b: distinct text pairs whose sketches the trie self-join keeps. ``signed_rows`` is settled."""
    shared = settle(shared_paths(signed_rows))
    n = shared.limit(SENT + 1).count()
    shared = F.broadcast(shared) if n <= SENT else shared
    rows = signed_rows.select(F.explode("paths").alias("key"), "tid", "s1", "s2")
    alone = rows.join(shared, "key", "left_anti") if n else rows
    first = settle(alone.repartition("key").sortWithinPartitions("key").mapInArrow(_join_small_nodes(shape.budgets), _OUT))
    small = first.filter("b is not null").select("a", "b")
    large = first.filter("b is null").select("key", "chunk", F.col("a").alias("tid"), "s1", "s2")
    spread = large.join(large.groupBy("key").agg((F.max("chunk") + 1).alias("blocks")), "key")
    if n:
        held = rows.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        held = held.select("key", F.pmod(F.xxhash64("tid", "key"), "blocks").cast("int").alias("chunk"), "tid", "s1", "s2", "blocks")
        spread = spread.unionByName(held)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("g"), (F.col("chunk") > F.col("other")).cast("tinyint").alias("side"), "tid", "s1", "s2"
    )
    spread = spread.repartition("g").sortWithinPartitions("g")
    across = spread.mapInArrow(_join_block_pairs(shape.budgets), "a bigint, b bigint")
    return small.unionByName(across).distinct()


def verified(pairs: DataFrame, texts: DataFrame, prepare, shape: Shape) -> DataFrame:  # noqa: ANN001
    """The pairs (a, b) whose exact sets of runs are at least as similar as the threshold. ``pairs`` is settled. Only texts of
    pairs are shuffled, as long as their ids are few enough to be sent to all tasks."""
    used = settle(pairs.select(F.col("a").alias("tid")).unionByName(pairs.select(F.col("b").alias("tid"))).distinct())
    few = used.limit(SENT + 1).count() <= SENT
    held = texts.join(F.broadcast(used) if few else used, "tid", "left_semi").groupBy("tid").agg(F.min("text").alias("text"))
    both = pairs.join(held.select(F.col("tid").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(held.select(F.col("tid").alias("b"), F.col("text").alias("tb")), "b")
    n, threshold = shape.run, shape.threshold

    def runs(text: str) -> set[str]:
        t = prepare(text)
        return {t[i : i + n] for i in range(len(t) - n + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, seen = [], ("", set())
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if y != seen[0]:
                    seen = (y, runs(y))
                p, q = runs(x), seen[1]
                same = len(p & q)
                keep.append(same >= threshold * (len(p) + len(q) - same) - 1e-9 and same > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


@dataclass(frozen=True)
class NearDuplicates:
    """Result of the operator: ``members`` (key, tid), one row per record; ``links`` (a, b), similar texts."""

    members: DataFrame
    links: DataFrame


def near_duplicates(df: DataFrame, key: str, text: str, prepare, shape: Shape) -> NearDuplicates:  # noqa: ANN001
    """Near-duplicate texts of ``df``.

    Records with a null key or text take no part. Repeated rows count once. Equal texts share a ``tid``
    (a 64-bit hash of the text) and are not linked pairwise. Texts shorter than a run have no runs and so
    only equal texts are like them.
    """
    rows = df.select(df[key].alias("key"), F.xxhash64(df[text]).alias("tid"), df[text].alias("text")).filter("key is not null and text is not null")
    members = rows.select("key", "tid").distinct()
    shape = shape.fitted(df.count())
    pairs = settle(candidate_pairs(settle(signed(rows, prepare, shape)), shape))
    links = settle(verified(pairs, rows.select("tid", "text"), prepare, shape))
    return NearDuplicates(members, links)


def record_pairs(found: NearDuplicates) -> DataFrame:
    """(key_a, key_b): all pairs of records with equal or similar texts, smaller key first."""
    m = found.members
    left = m.select(F.col("key").alias("k1"), F.col("tid").alias("a"))
    right = m.select(F.col("key").alias("k2"), F.col("tid").alias("b"))
    similar = found.links.join(left, "a").join(right, "b").filter("k1 <> k2").select("k1", "k2")
    copied = m.groupBy("tid").agg(F.count("*").alias("n")).filter("n > 1").select("tid")
    copies = m.join(copied, "tid", "left_semi")
    equal = copies.select("tid", F.col("key").alias("k1")).join(copies.select("tid", F.col("key").alias("k2")), "tid").filter("k1 < k2").select("k1", "k2")
    return similar.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b")).unionByName(equal.select(F.col("k1").alias("key_a"), F.col("k2").alias("key_b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(tid, class_id) of every linked text: the smallest tid that links lead to.

    Each round takes the smallest label among neighbours and then the label's own label, so chains
    shorten by doubling; every round is cut off in the checkpoint folder.
    """
    edges = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("tid"), F.least("a", "m").alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.tid).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.tid == near.a).select("tid", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = step.select(F.col("tid").alias("label"), F.col("label").alias("upper"))
        step = step.join(up, "label").select("tid", "old", F.least("label", "upper").alias("label"))
        step = settle(step)
        if step.filter("old <> label").isEmpty():
            return step.select("tid", F.col("label").alias("class_id"))
        labels = step.select("tid", "label")


def classes(found: NearDuplicates) -> DataFrame:
    """(key, class_id, links): one row per record; ``links`` counts the different texts similar to its own."""
    ends = found.links.select(F.col("a").alias("tid")).unionByName(found.links.select(F.col("b").alias("tid")))
    degree = ends.groupBy("tid").agg(F.count("*").alias("links"))
    groups = components(found.links)
    m = found.members.join(groups, "tid", "left").join(degree, "tid", "left")
    return m.select("key", F.coalesce("class_id", "tid").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
