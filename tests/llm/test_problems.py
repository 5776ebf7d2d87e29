"""The training-data operators against brute force, round trips and held-out labels, and on awkward input."""

import itertools
import json
import os
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import abuse, bpe, lines, lookalikes, mixing, neardup, pages, queries, splitting

DATA = "/root/testdata/sf0.001"
LONG = "水泵坏了 the pump is broken。" * 4000


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


# --- problem 1


def brute_pairs(data, prepare, n, threshold):
    forms = {k: prepare(t) for k, t in data if k is not None and t is not None}
    sets = {k: {t[i : i + n] for i in range(len(t) - n + 1)} for k, t in forms.items()}
    text = dict((k, t) for k, t in data if k is not None and t is not None)
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if text[a] == text[b] or (same and same >= threshold * (len(sets[a]) + len(sets[b]) - same) - 1e-9):
            out.add((a, b))
    return out


def edited(rng, text, share):
    words = text.split(" ")
    for _ in range(max(1, int(len(words) * share))):
        i = rng.randrange(len(words))
        words[i] = rng.choice(["alpha", "beta", "gamma", "水泵", words[i] * 2])
    return " ".join(words)


def near_data(n=60):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 150])))
        out.append((f"k{i:03d}", base))
        out += [(f"k{i:03d}v{j}", edited(rng, base, share)) for j, share in enumerate((0.02, 0.08, 0.15))]
    return out + [("e1", ""), ("e2", ""), ("s1", "abc"), ("s2", "abc"), ("s3", "abd"), ("n1", None), (None, "abc"), ("L1", LONG), ("L2", LONG + "x"), ("k000", out[0][1])]


def test_near_duplicates_against_brute_force(spark):
    data = near_data()
    df = frame(spark, data, "key string, text string").withColumn("tid", F.lit(1)).withColumn("a", F.lit("clash"))
    found = neardup.near_duplicates(df, "key", "text", neardup.squeezed, neardup.BLOCKS)
    got = {tuple(r) for r in neardup.record_pairs(found).collect()}
    want = brute_pairs(dict(data).items(), neardup.squeezed, 8, 0.6)
    assert got == want
    classes = {r.key: r for r in neardup.classes(found).collect()}
    assert len(classes) == len({k for k, t in data if k is not None and t is not None})
    for a, b in want:
        assert classes[a].class_id == classes[b].class_id
    assert classes["s1"].class_id == classes["s2"].class_id != classes["s3"].class_id


def test_large_trie_nodes_are_cut_into_blocks(spark, monkeypatch):
    data = near_data(20)
    df = frame(spark, data, "key string, text string")
    whole = {tuple(r) for r in neardup.record_pairs(neardup.near_duplicates(df, "key", "text", neardup.squeezed, neardup.BLOCKS)).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 2)
    rows = [(1, i, int(s1), int(s2)) for i, (s1, s2) in enumerate(np.random.default_rng(2).integers(-(2**62), 2**62, (40, 2)))] + [(2, 100, 5, 5), (2, 101, 5, 4)]
    import pyarrow as pa

    loose = np.full(32, 128)

    def batches():
        for part in (rows[:7], rows[7:9], rows[9:]):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], ["key", "tid", "s1", "s2"])

    out = [r for b in neardup._join_small_nodes(loose)(batches()) for r in b.to_pylist()]
    assert {(r["a"], r["b"]) for r in out if r["b"] is not None} == {(100, 101)}
    hot = [r for r in out if r["b"] is None]
    assert sorted(r["a"] for r in hot) == list(range(40)) and max(sum(1 for r in hot if r["chunk"] == c) for c in {r["chunk"] for r in hot}) <= 2
    pairs = []
    for i, j in itertools.combinations_with_replacement(sorted({r["chunk"] for r in hot}), 2):
        part = [(0, int(r["chunk"] == j and i != j), r["a"], r["s1"], r["s2"]) for r in hot if r["chunk"] in (i, j)]
        g = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], ["g", "side", "tid", "s1", "s2"])
        pairs += [(r["a"], r["b"]) for b in neardup._join_block_pairs(loose)(iter([g])) for r in b.to_pylist()]
    assert sorted(pairs) == list(itertools.combinations(range(40), 2))
    assert whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**16 - 1), min_size=2, max_size=40), st.lists(st.integers(0, 6), min_size=8, max_size=8))
def test_trie_join_is_exact(values, more):
    budgets = np.cumsum(more)
    bits = sorted(v << 16 | (v ^ 0x5A5A) for v in values)
    steps = np.array([[b >> (28 - 4 * k) & 15 for k in range(8)] for b in bits], np.uint8)
    i, j = neardup.trie_pairs(steps, np.array([0]), (np.array([0]), np.array([0])), budgets)

    def close(a, b):
        return all((a >> (28 - 4 * k) ^ b >> (28 - 4 * k)).bit_count() <= budgets[k] for k in range(8))

    want = {(a, b) for a, b in itertools.combinations(range(len(bits)), 2) if close(bits[a], bits[b])}
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


def test_trie_join_prunes_early():
    # of unlike texts hardly any pair is left at half of the depth; pairs at the threshold stay
    rng = np.random.default_rng(8)
    s = rng.integers(-(2**63), 2**63, (3000, 2))
    order = np.lexsort((s[:, 1].view(np.uint64), s[:, 0].view(np.uint64)))
    left = []
    neardup.trie_pairs(neardup._steps(*s[order].T), np.array([0]), (np.array([0]), np.array([0])), neardup.BLOCKS.budgets, left)
    share = {}
    for depth, seen, stay in left:
        share[depth] = share.get(depth, 0) + stay
    every = 3000 * 2999 / 2
    assert share[2] > 0.99 * every  # 8 bits tell little
    assert share[8] < 0.6 * every and share[12] < 0.3 * every and share[16] < 0.12 * every and share[24] < 0.01 * every
    flips = rng.random((100_000, 128)) < (1 - neardup.BLOCKS.threshold) / 2
    errors = flips.reshape(len(flips), 32, 4).sum(2).cumsum(1)
    assert (errors > neardup.BLOCKS.budgets).any(1).mean() < 1e-3


def test_shape_follows_the_number_of_records():
    for shape in (neardup.BLOCKS, neardup.NAMES):
        for n in (0, 10**5, 10**7, 10**9, 10**11):
            s = shape.fitted(n)
            assert (1 - s.threshold**s.path) ** s.trees <= neardup.MISSED and s.passes * s.bins >= s.path * s.trees
    assert neardup.BLOCKS.fitted(10**9).path > neardup.BLOCKS.fitted(10**5).path == 3


def test_shared_paths_are_spread(spark, monkeypatch):
    # a third of the texts are variants of one: their paths are found before the shuffle and the result is the same
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    data = [(f"h{i}", " ".join([*base[:60], f"variant{i}", *base[60:]])) for i in range(60)] + [(f"o{i}", " ".join(rng.choice(words) for _ in range(60))) for i in range(100)]
    df = frame(spark, data, "key string, text string").coalesce(1)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = df.select("key", F.xxhash64("text").alias("tid"), "text")
    shared = neardup.shared_paths(neardup.signed(rows, neardup.squeezed, neardup.BLOCKS)).collect()
    assert shared and all(8 < r.n <= 60 for r in shared)
    got = {tuple(r) for r in neardup.record_pairs(neardup.near_duplicates(df, "key", "text", neardup.squeezed, neardup.BLOCKS)).collect()}
    assert got == brute_pairs(data, neardup.squeezed, 8, 0.6) and len(got) >= 60 * 59 / 2


def test_no_near_duplicates_in_empty_tables(spark):
    found = neardup.near_duplicates(frame(spark, [], "key string, text string"), "key", "text", neardup.squeezed, neardup.BLOCKS)
    assert neardup.record_pairs(found).count() == 0 and neardup.classes(found).count() == 0


# --- problem 2


def brute_lines(data):
    blocks = {}
    for doc, block, text in data:
        if doc is not None and block is not None:
            blocks.setdefault((doc, block), text)
    out = set()
    for d in {d for d, _ in blocks}:
        mine = {b: t for (x, b), t in blocks.items() if x == d}
        where = {}
        for b, t in mine.items():
            for line in {lines.line_form(x) for x in (t or "").split("\n") if x.strip() and not x.startswith("|")}:
                where.setdefault(line, set()).add(b)
        hot = {k for k, v in where.items() if len(v) >= 4 and len(v) >= 0.15 * len(mine)}
        out |= {(b, i) for b, t in mine.items() for i, x in enumerate((t or "").split("\n")) if x.strip() and not x.startswith("|") and lines.line_form(x) in hot}
    return out


def line_data():
    rng = random.Random(7)
    data = []
    for d in range(3):
        for b in range(20):
            body = [rng.choice(["Share: Mail", "ＳＨＡＲＥ:  mail", "share:mail", "12", "345", "| cell |", "", "  ", f"own line {rng.choice('abcdefghij')}{b}"]) for _ in range(6)]
            data.append((f"d{d}", f"d{d}b{b}", "\n".join(body)))
    return data + data[:5] + [("d0", "null", None), (None, "x", "Share: Mail"), ("d0", None, "Share: Mail"), ("d9", "one", LONG), ("d9", "two", "")]


def marks(state):
    return {(r.block, n) for r in state.marked.collect() for n in r.line_nos}


def test_repeated_lines_against_brute_force(spark):
    data = line_data()
    df = frame(spark, data, "doc_id string, parent_id string, text string").withColumn("source", F.lit("clash")).withColumn("line", F.lit(0)).withColumn("block", F.lit("x"))
    step = lines.advance(None, df)
    got = marks(step.state)
    assert got == brute_lines(data)
    clean = {(r.parent_id, r.text) for r in lines.removed(df, step.state.marked).collect()}
    want = {(b, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if d is None or b is None or (b, i) not in got)) for d, b, t in data}
    assert clean == want
    none = lines.advance(None, df.limit(0))
    assert none.state.marked.count() == none.rebuild.count() == none.crossed.count() == 0


def test_deltas_give_what_one_batch_gives(spark, tmp_path):
    # three deltas, one of which sends blocks again with other texts, against one batch of the last texts
    schema = "doc_id string, parent_id string, text string"
    data = [r for r in line_data() if r[0] is not None and r[1] is not None]
    data = list({b: (d, b, t) for d, b, t in data}.values())
    parts = [[r for i, r in enumerate(data) if i % 3 == k] for k in range(3)]
    parts[2] += [(d, b, "Share: Mail\nquite another text") for d, b, _ in parts[0][:6]] + [("d1", parts[1][0][1], None)]
    last = {}
    state, clean, before = None, None, set()
    for k, part in enumerate(parts):
        last.update({b: (d, b, t) for d, b, t in part})
        now = frame(spark, list(last.values()), schema)
        step = lines.advance(state, frame(spark, part, schema))
        state = step.state
        assert marks(state) == brute_lines(last.values())
        hits = {tuple(r) for r in state.hits.collect()}
        assert {(r.source, r.line): r.crossed for r in step.crossed.collect()} == {**{h: 1 for h in hits - before}, **{h: -1 for h in before - hits}}
        before = hits
        clean = lines.removed(now, state.marked) if clean is None else lines.rebuilt(clean, now, step)
        assert {tuple(r) for r in clean.collect()} == {tuple(r) for r in lines.removed(now, state.marked).collect()}
        crossed = {(r.source, r.line) for r in step.crossed.collect()}
        touched = {r.block for r in state.places.collect() if (r.source, r.line) in crossed} | {b for _, b, _ in part}
        assert {r.block for r in step.rebuild.collect()} == touched
        if k < 2:
            lines.save(state, str(tmp_path / f"v{k}"))
            state = lines.load(spark, str(tmp_path / f"v{k}"))
    whole = lines.advance(None, frame(spark, list(last.values()), schema)).state
    for name in ("blocks", "places", "counts", "hits", "marked"):
        a, b = ({json.dumps(r.asDict(), sort_keys=True) for r in getattr(x, name).collect()} for x in (state, whole))
        assert a == b, name
    # a delta that crosses nothing leaves the other blocks alone
    quiet = lines.advance(state, frame(spark, [("d7", "new", "nothing like it")], schema))
    assert quiet.crossed.count() == 0 and [r.block for r in quiet.rebuild.collect()] == ["new"]


# --- problem 3

WORDS = "the default response time moves from to and prevents wrong hardware verdict battery tray pressure valve quick-release clip before exchange considered movement tightened".split()


def vocabulary():
    pairs = "蓝牙天线接触不良，产品经理可烘干排水泵，次日由主管抽查。" * 30
    cp = pages._pair_stream(pairs)
    key, n = np.unique(cp[:-1] << 32 | cp[1:], return_counts=True)
    return pages.Vocabulary({w: 50 for w in WORDS}, {"A0-0", "A0Aa"}, set(" .,;:-'|" + pairs), key, n).prepare()


PAGE = "Page 4 of 31\nHalb-X45Pro FilterSwap | Halbrook Service\nThe default response time moves from 7 to 9, and the wrong hard-\nware verdict prevents the battery tray movernent. The pressure val¬\nve is considered tightened, and the quick-\nrelease clip moves from 1O1 to 9 before the exch~ange is conside-\nred, and the pressurc valve moves.\nTable 7\n- 4 -"


def test_page_noise():
    p = pages.Page(PAGE, pages.titles("/kb/Halb-X45Pro_FilterSwap_Guide_ABC_20240101-Z.pdf"), vocabulary())
    assert pages.looks_scanned("\n".join(["The default response time moves from seven to nine and the"] * 5)) and not pages.looks_scanned("One line.\nTwo.\nThree.\nFour.")
    assert sorted(p.noise()) == [(0, "pageno"), (1, "header"), (2, "hyphen"), (3, "glyph"), (3, "hyphen"), (5, "glyph"), (5, "hyphen"), (6, "glyph"), (8, "pageno")]
    text = p.repaired()
    assert "hardware verdict" in text and "valve is considered" in text and "movement" in text and "quick-release clip" in text and "exchange" in text and "Page 4" not in text


def test_wide_page_noise():
    text = "— 12 —\n蓝牙天线接触不良，产\n品经理可烘干排水泵，次日\n甲主管抽查。蓝牙天线接\n触不良，产品经理可烘干排\n水泵，次日由主管抽查。蓝"
    p = pages.Page(text, [], vocabulary())
    assert p.noise() == [(0, "pageno"), (3, "glyph")] and "由主管" in p.repaired() and p.repaired().startswith("蓝牙")


def test_models_and_codes_on_pages():
    models = pages.closed({**{f"X{i}": 40 for i in (3, 12, 31)}, "X8": 1, "5A": 900, **{f"QA{i}": 1 for i in range(30)}}, {"A0"}, repeats=3)
    assert models == {"A0": {"X3", "X12", "X31", *(f"QA{i}" for i in range(30)), "X8"}}
    assert pages.closed({"X3": 500, "X12": 500, "X8": 2}, {"A0"}) == {"A0": {"X3", "X12"}}
    assert pages.closed({f"QA{i}": 2 for i in range(30)}, {"A0"}) == {}
    voc = vocabulary()
    voc.forms |= {"A0", "A-0"}
    voc.models = {"A0": {"X31"}}
    text = "蓝牙天线接触不良，产品经理可烘干 X31\n蓝牙天线接触不良，产品经理可烘干 VZ\n-417O，次日由主管抽查。X3l 蓝牙天线\n接触不良，产品经理 9l 可烘干，X13 蓝牙天"
    p = pages.Page(text, [], voc)
    assert [(i, n) for i, n in p.noise() if n == "glyph"] == [(2, "glyph"), (3, "glyph")]
    assert "X31 蓝牙天线" in p.repaired() and "91 可烘干" in p.repaired()
    latin = pages.Page("The rn0ves from 7 to 9 and m0ves to the battery tray\nbefore the quick-reiease clip", [], voc)
    assert ("m0ves", "moves") in latin.glyph[0] and ("quick-reiease", "quick-release") in latin.glyph[1]


def test_forms_are_counted_in_one_form(spark):
    rows = frame(spark, [("parents", str(i), f"Code VZ\u22125{i} and VZ\u20115{i} and VZ-\uff15{i}.", None, 0) for i in range(5)], "record_table string, record_id string, text string, file string, page int")
    assert pages.vocabulary(rows).forms == {"A-0"}


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(WORDS), st.integers(0, 30), st.sampled_from("abcdefghijklmnopqrstuvwxyz-"), st.integers(0, 2))
def test_levenshtein_automaton_is_complete(word, at, letter, kind):
    at %= len(word)
    seen = (word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + word[at + 1 :])[kind]
    voc = vocabulary()
    for most in (1, 2):
        got = {(w, k) for w, k, _ in voc.within(seen, most)}
        want = {(w, k) for w in WORDS for k in range(most + 1) if pages.near(seen, w, k) and not (k and pages.near(seen, w, k - 1))}
        assert got == want


def test_page_records(spark):
    p = frame(spark, [("p1", PAGE, "/x/Halb-X45Pro_FilterSwap_G.txt", 4, "d"), ("p1", PAGE, "/x/Halb-X45Pro_FilterSwap_G.txt", 4, "d"), ("p2", None, None, None, None), ("p3", "", None, 1, "d"), ("p4", LONG, None, None, "d")], "parent_id string, text string, source string, page_start int, file string")
    s = frame(spark, [("s1", "d1", PAGE, "image", None), ("s2", None, "x", None, {"origin": "page_image"}), (None, "d1", "x", "text", {})], "section_id string, doc_id string, text string, kind string, extra map<string,string>")
    d = frame(spark, [("d1", "Halb-X45Pro_FilterSwap_Guide.pdf"), ("d1", None), (None, "x")], "doc_ref string, filename string")
    rows = pages.records(p, s, d)
    voc = pages.vocabulary(rows)
    got = {tuple(r) for r in pages.noise(rows, voc).collect()}
    assert {("parents", "p1", 1, "header"), ("sections", "s1", 1, "header"), ("sections", "s1", 8, "pageno")} <= got
    assert pages.noise(rows, voc).count() == len(got)
    assert pages.noise(rows.limit(0), pages.vocabulary(rows.limit(0))).count() == 0


def test_misread_words_are_ranked_with_their_neighbours(spark):
    clean = "do not change the filter\nthe charge is low\nopen the door now\nthe floor is wet\nmit einem Tuch\neinen Filter\nthe brown cat sat\na car was here\n" * 30
    data = [("p", "clean", clean, None, 0)]
    rows = frame(spark, data, "record_table string, record_id string, text string, file string, page int")
    voc = pages.vocabulary(rows).prepare()
    page = pages.Page("do not charige the filter\nopen the cloor now\nmit einern Tuch\nthe brown cax sat\na cax was here", [], voc)
    assert page.repaired() == "do not change the filter open the door now mit einem Tuch the brown cat sat a car was here"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abcé水", min_size=1, max_size=7), min_size=1, max_size=40), st.text("abcé水", min_size=1, max_size=8), st.integers(0, 2))
def test_trie_gives_all_words_within_a_distance(words, word, most):
    voc = pages.Vocabulary({w: 1 + i for i, w in enumerate(sorted(words))}, set(), set(), np.zeros(0, np.int64), np.zeros(0, np.int64)).prepare()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(w, distance(word, w), voc.words[w]) for w in words if distance(word, w) <= most}
    got = voc.within(word, most)
    assert set(got) == want and len(got) == len(want)


def test_no_length_keeps_lines_and_words_out(monkeypatch):
    voc = vocabulary()
    long = "".join(chr(97 + i * 7 % 26) for i in range(60))
    voc = pages.Vocabulary({**voc.words, long: 50}, voc.forms, voc.characters, voc.pairs, voc.pair_counts).prepare()
    assert voc.correction(long[:30] + "q" + long[31:]) == long  # words over 40 letters
    assert pages.is_page_number("-" * 40 + " 12 " + "-" * 40)
    monkeypatch.setattr(pages, "KEPT", 3)
    for w in ("abx", "cdx", "efx", "ghx", "ijx"):
        voc.candidates(w)
    assert len(voc.memo) <= 3
    body = [f"the pump moves on from {i} to {i + 1} and so the next line" for i in range(40)]
    assert pages.looks_scanned("\n".join(body)) and pages.looks_scanned("\n".join([*body, "x" * 200]))
    assert not pages.looks_scanned("\n".join([*body[:5], *("y" * 200 for _ in range(5))]))


def test_lines_that_come_again_are_furniture(spark, monkeypatch):
    # a running title that the file's name does not tell, with page numbers, at the top; one file without
    body = "\n".join(f"the pump moves on and the next line follows {i}" for i in range(4))
    rows = [("parents", f"p{i}", f"Household Devices Annual {i}\n{body}\n{'last words ' + str(i) if i == 3 else 'plain end of page ' + 'abcdefgh'[i] * 6}", "/kb/x9.pdf", 1) for i in range(6)]
    rows += [("parents", "q", f"Household Devices Annual 1\n{body}", "/kb/y.pdf", 1), ("parents", "r", "Household Devices Annual 2", None, 1), ("parents", "s", "", "/kb/x9.pdf", 0)]
    df = frame(spark, rows, "record_table string, record_id string, text string, file string, page int")
    again = {r.file: set(r.again) for r in pages.furniture(df).collect()}
    assert set(again) == {"/kb/x9.pdf"} and "householddevicesannual" in again["/kb/x9.pdf"]
    found = {(r.record_id, r.line_no) for r in pages.noise(df, vocabulary()).filter("noise = 'header'").collect()}
    assert {(f"p{i}", 0) for i in range(6)} <= found and not {k for k in found if k[0] in "qr"}
    monkeypatch.setattr(pages, "SENT", 0)  # more files than are sent
    assert {(r.record_id, r.line_no) for r in pages.noise(df, vocabulary()).filter("noise = 'header'").collect()} == found
    assert pages.noise(df.limit(0), vocabulary()).count() == 0


# --- problem 4


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。.\n,x" + "́", max_size=3000), st.one_of(st.none(), st.text(alphabet="h> ", max_size=400)))
def test_pieces_are_within_the_limit_and_lose_nothing(text, crumb):
    out = splitting.split_item(text, crumb, limit=300, overlap=40)
    n = len(crumb) + 1 if crumb and len(crumb) + 1 >= 220 else 0  # such a breadcrumb is cut with the text
    whole = (crumb + "\n" + text) if n else text
    assert "".join(whole[b + n : e + n] for b, e, _, _ in out) == whole
    assert all(len(p) <= 300 for *_, p in out)
    assert n or not crumb or all(p.startswith(crumb + "\n") for *_, p in out)
    for (b0, *_), (b, e, back, p) in zip(out, out[1:]):
        assert 0 < b - back <= 40 and p.endswith(whole[back + n : e + n]) and b0 < b


def test_pieces(spark):
    data = [("a", "x" * 1600, None), ("b", "x" * 1601, ""), ("c", "x" * 1590, "0123456789"), ("d", None, None), ("e", "", "c" * 1700), ("f", LONG, "h > i"), ("f", LONG, "h > i"), (None, LONG, None)]
    df = frame(spark, data, "parent_id string, text string, breadcrumb string").withColumn("key", F.lit(1)).withColumn("piece", F.lit(2)).withColumn("char_len", F.lit(5))
    got = splitting.pieces(df).collect()
    assert {r.parent_id for r in got} == {"b", "c", "e", "f", None}
    assert all(len(r.piece) <= 1600 for r in got)
    f = sorted((r for r in got if r.parent_id == "f"), key=lambda r: r.piece_no)
    assert [r.piece_no for r in f] == list(range(len(f))) and "".join(LONG[r.start : r.end] for r in f) == LONG
    assert splitting.pieces(df.limit(0)).count() == 0


# --- problem 5


def test_equal_readings_become_equal_strings(spark):
    same = ["Größe A1 - o.k.", "Größe A1 - o.k.", "Größe A1 ‐ o.k.", "Gr​öße Ａ１ - o.k.", "Größe А1 − ο.k."]
    other = ["größe A1 - o.k.", "Grosse A1 - o.k.", "Größe A2 - o.k.", "GrößeA1 - o.k.", "Größe A1\n- o.k.", "", None]
    data = [(f"k{i}", t) for i, t in enumerate([*same, *other, same[0]])] + [("k0", same[0])]
    df = frame(spark, data, "key string, text string").withColumn("canonical", F.lit("clash")).withColumn("form", F.lit(1))
    rules = lookalikes.corpus_rewrites((df, "text"))
    got = {tuple(r) for r in lookalikes.reading_pairs(df, "key", "text", rules).collect()}
    groups = [f"k{i}" for i in range(len(same))]
    want = {(a, b) for a, b in itertools.combinations(sorted([*groups, "k12"]), 2)} - {("k0", "k12")}
    assert got == want
    assert lookalikes.reading_pairs(df.limit(0), "key", "text", {}).count() == 0
    forms = lookalikes.canonical(df, "text", rules).filter("key = 'k11'").first()
    assert forms["canonical"] is None


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aоeеＡA ̈u-‐不不㎏kg1１​ ", max_size=30))
def test_rewriting_is_stable_and_agrees_with_compatibility_forms(text):
    counts = {c: 1 + ord(c) % 7 for c in "aоeеＡA ̈u-‐不不㎏kg1１​ ü"}
    a = lookalikes.automaton(lookalikes.rewrites(counts))
    once = lookalikes.rewrite(text, a)
    assert lookalikes.rewrite(once, a) == once
    assert lookalikes.rewrite(unicodedata.normalize("NFKC", text), a) == once or "̈" in text


# --- problem 6


def test_ids_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts += [None, "", "aaaaaaaaab" * 300, "<|endoftext|> x", "é" * 3000, " \n\n x", "don't I'LL", "🔧👨‍🔧", LONG]
    df = frame(spark, list(enumerate(texts)) + [(0, texts[0])], "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("key", F.lit(2))
    got = bpe.encode_column(df, "doc_id", "text").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.ids == t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    n = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, "text", ["doc_id"]).collect()}
    assert n == {r.doc_id: len(r.ids) for r in got}
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 49999), max_size=60))
def test_bitmap_gives_ranks_in_order(ranks):
    b = bpe.RankBitmap(50000)
    for r in ranks:
        b.add(r)
    assert [b.pop() for _ in range(len(ranks) + 1)] == [*sorted(ranks), -1]


# --- problem 7


def test_mix_against_plain_python(spark, monkeypatch):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "word " * rng.randint(0, 40)) for i in range(300)]
    data += [(300, "a", None), (301, "b", ""), (302, "a", data[0][2]), (303, "a", LONG[:500])] + data[:3]
    df = frame(spark, data, "doc_id bigint, source string, text string").withColumn("key", F.lit(1)).withColumn("n_tokens", F.lit(1)).withColumn("range", F.lit(0))
    targets = frame(spark, [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("gone", 0.1, 3), ("a", 0.5, 1), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(df, targets, total_tokens=4000)
    rows = drawn.collect()
    sh = {r.source: r for r in shares.collect()}
    texts = {}
    for i, s, t in data:
        if s in ("a", "b", "c") and t:
            texts.setdefault((s, t), i)
            texts[s, t] = min(texts[s, t], i)
    assert {(r.source, r.doc_id) for r in rows} <= {(s, i) for (s, _), i in texts.items()}
    caps = {"a": 1, "b": 4, "c": 2}
    assert all(1 <= r.copies <= caps[r.source] for r in rows)
    for s in ("a", "b", "c"):
        mine = [r for r in rows if r.source == s]
        assert sh[s].tokens == sum(r.n_tokens * r.copies for r in mine)
        biggest = max(r.n_tokens for r in mine)
        assert abs(sh[s].tokens - sh[s].budget) <= biggest / 2 + 1
    assert sh["gone"].tokens == 0 and not sh["gone"].in_reach
    assert sum(r.actual_share for r in sh.values()) == pytest.approx(1)
    again = {(r.doc_id, r.copies) for r in mixing.mix(df, targets, total_tokens=4000)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    assert mixing.mix(df.limit(0), targets)[0].count() == 0 and mixing.mix(df, targets.limit(0))[1].count() == 0


# --- problem 8


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(4)
    dense = np.zeros((150, 400))
    for i in range(150):
        dense[i, rng.choice(400, rng.integers(3, 30), replace=False)] = rng.random()
        dense[i] *= rng.random(400) + 0.1
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    of, term = np.nonzero(dense)
    index, query = abuse.BlockMaxIndex(of, term, dense[of, term]), np.zeros(abuse.TERMS)
    for q in range(0, 150, 7):
        cos = dense @ dense[q]
        want = sorted(((c, i) for i, c in enumerate(cos) if c >= 0.1), key=lambda x: (-x[0], x[1]))[:7]
        at = np.flatnonzero(dense[q])
        got = index.nearest(at, dense[q, at], 7, 0.1, query)
        assert [i for _, i in got] == [i for _, i in want] and not query.any()
    none = np.zeros(0, np.int64)
    assert abuse.BlockMaxIndex(none, none, np.zeros(0)).nearest(at, dense[q, at], 7, 0.1, query) == []


def test_windows_of_a_text():
    def cut(text):
        c, _, window = abuse.letters([text])
        return ["".join(map(chr, c[window == i])) for i in range(window.max(initial=-1) + 1)]

    assert cut("Go to HELL, you! 你是蠢，猪。听见没有。操,你,妈") == ["gotohell", "you", "你是蠢猪", "听见没有", "操你妈"]
    assert cut("shut up m0r.on v1.5 | R2-77 | Ok") == ["shutupmoronv", "ok"]
    assert cut("") == cut("12 ... \u200b") == []
    long = "abcdefghij" * 40
    parts = cut(long)
    assert all(len(p) <= 3 * abuse.HALF for p in parts) and all(p in long for p in parts)
    assert all(any(long[i : i + abuse.HALF] in p for p in parts) for i in range(0, len(long) - 2 * abuse.HALF, abuse.HALF))
    two = abuse.windows(["one two three. four five six", "", "x", "seven eight nine"])
    assert two[3].tolist() == [0, 0, 2, 3] and set(two[0].tolist()) <= {0, 1, 2, 3}


def test_scores_do_not_depend_on_the_length_of_texts(spark):
    # the same windows in texts five and twenty times as long: same examples, same finds
    rng = random.Random(11)
    plain = ["the pump moves from {} to {}", "please replace the filter within {} days and note {}", "把滤芯单独静置 {} 分钟后再检查 {}"]
    rows = []
    for i in range(3000):
        body = [rng.choice(plain).format(rng.randint(1, 99), i) for _ in range(4)]
        if i % 60 == 0:
            body.insert(2, rng.choice(INSULTS).format(rng.choice(NAMES)))
        rows.append((i, "a", "\n".join(body)))
    lab = frame(spark, [(i, "x", int(i % 60 == 0)) for i in range(0, 1500, 5)], "doc_id bigint, annotator string, toxic int")
    model = abuse.fitted(frame(spark, rows, "doc_id bigint, source string, text string"), lab)
    assert model.abuse.size and model.benign.size  # both classes are in the index
    y = np.array([h[2] for h in model.held_out])
    p = np.array([h[1] for h in model.held_out])
    assert (p[y == 1] >= abuse.CASE).mean() >= 0.9 and (p[y == 0] >= abuse.CASE).mean() <= 0.01
    assert sum(r[1] for r in abuse.reliability(model)) == len(model.held_out)
    for k in (5, 20):
        joined = [(i, "a", "\n".join(r[2] for r in rows[i : i + k])) for i in range(0, 3000, k)]
        d = frame(spark, joined, "doc_id bigint, source string, text string")
        got = {r.doc_id for r in abuse.scored(d, model).filter(F.col("score") >= abuse.CASE).collect()}
        assert got == {i for i in range(0, 3000, k) if any(j % 60 == 0 for j in range(i, i + k))}
        df, total = np.zeros(abuse.TERMS + 1, np.int64), 0
        for r in abuse.window_frequencies(d).collect():
            df[r.term] = r.df
        again = abuse.window_frequencies(frame(spark, rows, "doc_id bigint, source string, text string")).collect()
        assert {r.term: r.df for r in again} == {t if t < abuse.TERMS else -1: int(df[t]) for t in np.flatnonzero(df)}


INSULTS = ["you are a bunch of {} and should go to hell", "shut up you {} nobody wants to hear it", "你们客服全是{}听得懂人话吗快点滚出去", "this {} of a clerk can go and drown himself"]
NAMES = ["morons", "scumbags", "vermin", "人渣", "废物"]


def test_abuse_on_held_out_texts(spark):
    rng = random.Random(9)
    plain = ["the pump moves from {} to {}", "please replace the filter within {} days and note {}", "把滤芯单独静置 {} 分钟后再检查 {}", "the sensor blinked {} times on day {}"]
    docs, labels, truth = [], [], set()
    for i in range(4000):
        body = [rng.choice(plain).format(rng.randint(1, 99), rng.randint(1, 99)) for _ in range(6)]
        if i % 80 == 0:
            line = rng.choice(INSULTS).format(rng.choice(NAMES))
            line = line.replace("o", "0", 1) if i % 160 == 0 else line.upper()
            body.insert(rng.randrange(6), line)
            truth.add(i)
        docs.append((i, rng.choice(["a", "b", None]), "\n".join(body)))
        if i < 2400:
            labels.append((i, "x", int(i in truth) if i % 29 else None))
    docs += [(9000, "a", None), (9001, None, ""), (9002, "a", LONG), docs[0]]
    d = frame(spark, docs, "doc_id bigint, source string, text string").withColumn("score", F.lit(9.0))
    lab = frame(spark, [*labels, labels[0], (None, "x", 1)], "doc_id bigint, annotator string, toxic int")
    scores = abuse.scored(d, abuse.fitted(d, lab))
    got = {r.doc_id: r.score for r in scores.collect()}
    assert set(got) == {r[0] for r in docs} and got[9000] == got[9001] == 0.0
    found = {i for i, s in got.items() if s >= abuse.CASE and i >= 2400}
    want = {i for i in truth if i >= 2400}
    assert len(found & want) >= 0.9 * len(want) and len(found - want) <= 2
    rates = {r.source: r for r in abuse.rates(d, scores).collect()}
    assert sum(r.documents for r in rates.values()) == len({r[0] for r in docs})
    empty = abuse.fitted(d.limit(0), lab.limit(0))
    assert abuse.scored(d, empty).filter("score > 0").count() == 0


@pytest.mark.parametrize("number", ["", " {}"])
def test_abuse_with_many_copies(spark, number):
    # a third of the rows are copies of one abusive text, or differ from each other in a number
    rng = random.Random(3)
    line = "you are a bunch of scumbags and should all go to hell"
    docs = [(i, "a", f"the {rng.choice(['pump', 'valve', 'filter'])} moves from {rng.randint(1, 999)} to {rng.randint(1, 999)} within {i} days") for i in range(800)]
    docs += [(i, "a", line + number.format(i)) for i in range(800, 1200)]
    d = frame(spark, docs, "doc_id bigint, source string, text string")
    lab = frame(spark, [(i, "x", int(i >= 800)) for i in range(0, 1200, 6)], "doc_id bigint, annotator string, toxic int")
    got = {r.doc_id: r.score for r in abuse.scored(d, abuse.fitted(d, lab)).collect()}
    assert {i for i, s in got.items() if s >= abuse.CASE} == set(range(800, 1200))


def test_short_abuse(spark):
    # insults of few letters: a whole text, a sentence, within a sentence
    rng = random.Random(5)
    plain = [f"the {rng.choice(['pump', 'valve', 'filter'])} moves from {rng.randint(1, 999)} to {rng.randint(1, 999)} within {i} days" for i in range(2400)]
    for i in range(0, 2400, 40):
        plain[i] = ["du Idiot", f"{plain[i]}. du Idiot! {plain[i + 1]}", f"{plain[i]} 你个傻逼 {plain[i + 1]}"][i // 40 % 3]
    docs = [(i, "a", t) for i, t in enumerate(plain)]
    d = frame(spark, docs, "doc_id bigint, source string, text string")
    lab = frame(spark, [(i, "x", int(i % 40 == 0)) for i in range(0, 1200, 8)], "doc_id bigint, annotator string, toxic int")
    got = {r.doc_id: r.score for r in abuse.scored(d, abuse.fitted(d, lab)).collect()}
    assert {i for i, s in got.items() if s >= abuse.CASE} == set(range(0, 2400, 40))


def test_vocabulary_files_are_not_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = {f for _, _, files in os.walk(root) for f in files}
    assert not {n for n in names if n.startswith(("byte_bpe", "word_bpe", "piece_bpe"))}
    assert json.loads("{}") == {}
