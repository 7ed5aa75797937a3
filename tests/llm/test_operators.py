"""The training-data operators against brute force and on awkward rows: nulls, empty and long texts, ties, repeats, empty
tables, extra columns with clashing names."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from folioforge.llm import p1_reposts, p2_pairs, p3_scans, p4_canonical, p5_split, p6_visible, p7_names, p8_encode, p9_leaks, p10_encoding, queries
from folioforge.llm.textcore import run_hashes, word_hashes
from tests.conftest import values
from tests.test_queries import compare

STORY = "id string, group_id string, title string, author string, body_text string, ingested_at string, fp string, g bigint, text string, n int"
WORDS = re.compile(r"[^\W_]+")


def stories(spark, rows):
    """Rows of (id, title, author, body); the other columns clash with names inside the operators."""
    return spark.createDataFrame([(i, f"g{i}", t, a, b, "2026-01-01T00:00:00Z", "x", 1, "y", 2) for i, t, a, b in rows], STORY)


def prose(seed, n=120, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def test_word_hashes_agree_with_words():
    texts = [None, "", "Straße, ÉCLAIR_x 3½!", "a-b  c", "日本 語", "ΣΑΣ"] + [" ".join(prose(i)) for i in range(20)]
    h, at = word_hashes(texts)
    seen = {}
    for i, t in enumerate(texts):
        words = [w.lower() for w in WORDS.findall(t or "")]
        own = h[at[i] : at[i + 1]].tolist()
        assert len(own) == len(words)
        for w, x in zip(words, own, strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert len(word_hashes(["x" * 200_000])[0]) == 1
    assert run_hashes(*word_hashes(["a b", "a b c", ""]), 3)[1].tolist() == [0, 0, 1, 1]


def brute_pairs(rows):
    sets = {}
    for i, _, _, b in rows:
        w = [x.lower() for x in WORDS.findall(b or "")]
        if len(w) >= 20:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return sorted((a, b) for a, b in combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b]))


def test_p1_finds_what_brute_force_finds(spark):
    r = random.Random(5)
    rows = [("null", None, None, None), ("empty", "", "", ""), ("short", "t", "a", "one two three")]
    for base in range(12):
        words = prose(base, r.choice((20, 21, 60, 300)))
        rows.append((f"{base}-0", None, None, " ".join(words)))
        for k in range(5):
            new = list(words)
            for _ in range(r.randrange(1, max(2, len(words) // 11))):
                at = r.randrange(len(new))
                kind = r.randrange(4)
                if kind == 0:
                    new[at] = f"x{r.randrange(99)}"
                elif kind == 1:
                    new.insert(at, f"y{r.randrange(99)}")
                elif kind == 2:
                    del new[at]
                else:
                    new = new[at:] + new[:at]
            rows.append((f"{base}-{k + 1}", None, None, ", ".join(new)))
        rows.append((f"{base}-copy", None, None, " ".join(words).upper()))
    rows.append(rows[3])
    table = stories(spark, rows)
    got = values(p1_reposts.reposts(table))
    assert got == brute_pairs(rows) and len(got) > 40
    groups = {r.id: (r.class_id, r.links) for r in p1_reposts.groups(table).collect()}
    assert all(groups[a][0] == groups[b][0] for a, b in got)
    assert len(groups) == len({i for i, _, _, b in rows if b and len(b.split()) >= 20})


def test_p1_of_nothing(spark):
    assert p1_reposts.reposts(stories(spark, [])).count() == 0
    assert p1_reposts.groups(stories(spark, [("a", None, None, None)])).count() == 0


def test_p1_packing_is_exact():
    runs = np.array([1, 5, (1 << p1_reposts.HASH_BITS) - 1], np.uint64)
    g, s, d, q, r = p1_reposts.unpack(p1_reposts.pack(np.array([9, 8], np.uint64), np.array([20, 30]), np.array([0, 1, 1]), runs, np.array([0, 7, 255])))
    assert (g.tolist(), s.tolist(), d.tolist(), q.tolist(), r.tolist()) == ([9, 8], [20, 30], [0, 1, 1], [0, 7, 255], runs.tolist())
    a, b, c = np.array([1, 1, 2, 9]), np.array([5, 4, 7, 3]), np.array([2, 70_000, 1, 4])
    back = [np.concatenate(x).tolist() for x in zip(*(p1_reposts.unpack_pairs(v) for _, v in p1_reposts.pack_pairs(a, b, c, a + 1, True, 3)), strict=True)]
    assert sorted(zip(*back, strict=True)) == [(1, 4, 65535, 2, 1), (1, 5, 2, 2, 1), (2, 7, 1, 3, 1), (9, 3, 4, 10, 1)]


def repetitive():
    """Texts whose runs repeat: over few words, logs, refrains."""
    r = random.Random(3)
    rows = [(f"few{i}", None, None, " ".join(r.choice("alder birch cedar dogwood elm fir gorse holly".split()) for _ in range(1500))) for i in range(4)]
    for i in range(6):
        own = random.Random(i % 3)
        lines = [" ".join(own.choice(x) for x in (("north", "south", "east", "west"), ("gate", "door"), ("open", "shut", "stuck"))) for _ in range(100)]
        rows.append((f"log{i}", None, None, " ".join(lines) + f" entry {i}"))
    refrain = "o the wind and the rain came over the hill and over the sea again "
    return rows + [(f"verse{i}", None, None, " ".join(refrain + " ".join(prose(k + 10 * (i == 2), 12)) for k in range(9))) for i in range(3)]


def test_p1_is_exact_on_repetitive_texts_for_any_number_of_classes_and_hot_runs(spark, monkeypatch):
    rows = repetitive()
    want = brute_pairs(rows)
    assert len(want) > 8
    assert values(p1_reposts.reposts(stories(spark, rows))) == want
    assert values(p1_reposts.reposts(stories(spark, rows), classes=50)) == want
    monkeypatch.setattr(p1_reposts, "HOT_OWNERS", 3)
    monkeypatch.setattr(p1_reposts, "HOT_BLOCK", 2)
    # the hot runs are found by the worker, which takes the module's values from its own import
    blocks = p1_reposts.Postings([p1_reposts.pack(np.arange(1, 10, dtype=np.uint64), np.full(9, 40), np.arange(9), np.zeros(9, np.uint64), np.zeros(9))])
    hot = list(blocks.hot_blocks())
    pairs = {(int(x), int(y)) for data in hot for a, b, _, _ in p1_reposts.hot_pairs(data) for x, y in zip(a, b, strict=True)}
    assert pairs == set(combinations(range(1, 10), 2)) and not len(blocks.owner)


def test_p1_writes_no_pairs_that_only_share_phrases(spark, monkeypatch):
    r = random.Random(8)
    phrases = [" ".join(f"w{r.randrange(500)}" for _ in range(7)) for _ in range(400)]
    rows = [(f"s{i:03}", "t", "a", " ".join(r.choice(phrases) for _ in range(40))) for i in range(300)]
    rows += [(f"e{i}", "t", "a", rows[i][3].replace(" w1", " x", 3)) for i in range(20)]
    cut, written = p1_reposts.cut, []

    def seen(df):
        df = cut(df)
        if "bucket" in df.columns:
            written.extend(len(p1_reposts.unpack_pairs(x.data)[0]) for x in df.where("bucket >= 0 and data is not null").select("data").collect())
        return df

    monkeypatch.setattr(p1_reposts, "cut", seen)
    want = brute_pairs(rows)
    assert values(p1_reposts.reposts(stories(spark, rows))) == want and len(want) >= 20
    assert sum(written) <= 20 * len(want)  # one for each share and a few more; there are 51,040 pairs of stories
    monkeypatch.setattr(p1_reposts, "BROADCAST_IDS", 0)
    assert values(p1_reposts.reposts(stories(spark, rows))) == want


def test_p1_bit_rows_and_ranges_lose_nothing(monkeypatch):
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 40, n)) for n in (1, 2, 20, 33, 100, 160, 700)]
    sets += [np.unique(np.r_[s[len(s) // 8 :], r.integers(0, 1 << 40, len(s) // 8)]) for s in sets]
    n = np.array([len(s) for s in sets])
    rows = p1_reposts.signatures(np.repeat(np.arange(len(sets)), n), np.concatenate(sets).astype(np.uint64), n)
    doc, run = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    o = np.argsort(run, kind="stable")
    data = p1_reposts.pack(np.arange(1, len(sets) + 1, dtype=np.uint64), n, doc[o], run[o].astype(np.uint64), np.zeros(len(o)), np.ones(len(sets)), rows)
    owners = p1_reposts.Owners([data])
    met = 0
    for a, b in combinations(range(len(sets)), 2):
        true = int(p1_reposts.slack(n[a] + n[b], len(np.setxor1d(sets[a], sets[b]))))
        if true >= 0:
            assert owners.slack(np.array([a]), np.array([b]))[0] >= true
            met += 1
    assert met >= 5
    monkeypatch.setattr(p1_reposts, "SORTED_RUNS", 100)
    assert len(list(owners.ranges())) > 10
    whole, parts = p1_reposts.Counts(owners, 1), p1_reposts.Counts(owners, 1)
    assert not list(whole.add(p1_reposts.Postings(owners)))
    for low, high in owners.ranges():
        assert not list(parts.add(p1_reposts.Postings(owners, low, high)))
    one, other = ([x.tolist() for x in next(c.end())] for c in (whole, parts))
    assert one == other and len(one[0]) >= met


@pytest.mark.parametrize("basket,heavy", [(4096, 1024), (4, 6), (4096, 1)])
def test_p2_counts_all_pairs(spark, monkeypatch, basket, heavy):
    monkeypatch.setattr(p2_pairs, "BASKET", basket)
    monkeypatch.setattr(p2_pairs, "HEAVY_PARTS", heavy)
    r = random.Random(2)
    links = [(f"s{r.randrange(40)}", int(r.paretovariate(0.7)) % 30) for _ in range(400)] + [("s1", None), (None, 3)]
    df = spark.createDataFrame([(s, t, 0.5, "x", 1) for s, t in links], "story_id string, tag_id bigint, a double, r string, i int")
    baskets = {}
    for s, t in links:
        if s and t is not None:
            baskets.setdefault(s, set()).add(t)
    want = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    n = Counter(t for b in baskets.values() for t in b)
    got = p2_pairs.lifts(df).collect()
    assert {(x.tag_id_a, x.tag_id_b): x.n_ab for x in got} == dict(want)
    assert all(x.n_a == n[x.tag_id_a] and x.n_b == n[x.tag_id_b] and x.n == len(baskets) for x in got)
    assert p2_pairs.related(df.where("false")).count() == 0


CLEAN = "The lantern was lit and the letter was read again by the harbour while they looked for the difference."


def test_p3_tells_scans_from_other_texts(spark):
    rows = [(f"c{i}", "The Tale", "Ann Author", CLEAN) for i in range(30)]
    rows += [
        ("null", None, None, None), ("empty", "", "", ""), ("long", "t", "a", "z" * 100_000),
        ("cut", "t", "a", "The lan-\ntern was lit and the let¬\nter was read."),
        ("misread", "t", "a", "Tbe lantern wa5 lit and thc letter vvas rcad again by tbe harbour."),
        ("pages", "The Tale", "a", "They read the\nTHE TALE\n[12]\nletter again by the\nTHE TALE\n[13]\nharbour."),
        ("wrapped", "t", "a", "The lantern was lit and\nthe letter was read."), ("verse", "t", "a", "The lantern was lit,\nThe letter was read,\nThe lantern was lit."),
        ("headings", "t", "a", "2.\n\nThe letter was read.\n\nChapter 3\n\nThe lantern was lit.\n\n4.\n\nAgain."), ("slips", "t", "a", "The latnern was lit and the lettre was raed again."),
    ]
    rows.append(rows[33])
    table = stories(spark, rows)
    assert values(p3_scans.affected(table)) == [("cut",), ("misread",), ("pages",)]
    fixed = {r.id: r.body_text for r in p3_scans.repaired(table).collect()}
    assert fixed["cut"] == "The lantern was lit and the letter was read."
    assert fixed["misread"] == "The lantern was lit and the letter was read again by the harbour."
    assert fixed["pages"] == "They read the letter again by the harbour."
    assert p3_scans.affected(stories(spark, [])).count() == 0


@pytest.mark.parametrize("form", ["Page {} of 412", "{} of 412", "{}/412", "- {} / 412 -", "page {} of 4l2b"])
def test_p3_reads_page_numbers_with_a_total(spark, form):
    pages = f"They read the\n{form.format(215)}\nletter again.\n{form.format(216)}\nThe lantern was lit."
    rows = [(f"c{i}", "The Tale", "Ann Author", CLEAN) for i in range(30)] + [("pages", "t", "a", pages), ("share", "t", "a", "The letter was read.\n\n3/4\n\nThe lantern was lit.")]
    table = stories(spark, rows)
    assert values(p3_scans.affected(table)) == [("pages",)]
    assert values(p3_scans.repaired(table)) == [("pages", "They read the letter again. The lantern was lit.")]


def test_p3_takes_one_word_misread_by_shape(spark):
    rows = [(f"c{i}", "The Tale", "Ann Author", CLEAN) for i in range(30)]
    rows += [("shape", "t", "a", "The lantem was lit and the letter was read."), ("unseen", "t", "a", "The lantem\u200b was lit."), ("slip", "t", "a", "The letter was lti and raed agian.")]
    rows += [(f"often{i}", "t", "a", "The harbour was rnade.") for i in range(2)]
    table = stories(spark, rows)
    assert values(p3_scans.affected(table.where("id <> 'unseen'"))) == [("shape",)]
    assert values(p3_scans.affected(table.where("id <> 'shape'"))) == []
    assert values(p3_scans.repaired(table.where("id <> 'unseen'"))) == [("shape", "The lantern was lit and the letter was read.")]


def test_p4_maps_values(spark):
    tags = spark.createDataFrame([(1, "sea witch"), (2, "tea witch"), (3, "haunted house"), (4, None), (5, "ünique thing")], "id bigint, name string")
    texts = ["#HauntedHouse", "house, haunted", "genre: haunted  house", "hauntedhouse", "haun. house", "hautned huose", "Haunted Houses", "sea witch", "sae witch", "quantum house", "haunted", "  ", None, "unique thing", "x" * 5000, "sea witch."]
    rows = spark.createDataFrame([(i, t, "v", 1) for i, t in enumerate(texts)], "id bigint, tag_text string, v string, k int")
    got = {r.id: r.tag_id for r in p4_canonical.resolve(rows, tags).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 8: 1, 9: -1, 10: -1, 13: 5, 14: -1, 15: 1}
    assert p4_canonical.resolve(rows, tags.where("false")).where("tag_id <> -1").count() == 0
    assert p4_canonical.resolve(rows.where("false"), tags).count() == 0


def test_p4_blocks_of_the_reference_give_the_same(spark, monkeypatch):
    tags = spark.createDataFrame([(i, f"entry number{i:02d} word") for i in range(40)], "id bigint, name string")
    rows = spark.createDataFrame([(i, f"Entry-number{i % 50:02d}_wrod") for i in range(100)], "id bigint, tag_text string")
    whole = values(p4_canonical.resolve(rows, tags))
    monkeypatch.setattr(p4_canonical, "REFERENCE_ROWS", 7)
    assert values(p4_canonical.resolve(rows, tags)) == whole


def test_p4_trie_agrees_with_plain_distance():
    def distance(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    r = random.Random(1)
    names = ["".join(r.choice("abc") for _ in range(r.randrange(1, 8))) for _ in range(60)]
    trie = p4_canonical.Trie(list(enumerate(names)), paths=lambda x: [(x, True)])
    asked = ["".join(r.choice("abc") for _ in range(r.randrange(1, 8))) for _ in range(200)] + ["", "zzz", "abc" * 30]
    for most in (1, 2, 3):
        for q, hits in zip(asked, trie.within(asked, most), strict=True):
            assert dict((k, d) for d, k in hits) == {k: distance(q, n) for k, n in enumerate(names) if distance(q, n) <= most}
    long = p4_canonical.Trie([(1, "ab" * 40)])  # beyond a machine word
    assert long.within(["ab" * 39 + "ba", "ba" * 40], 3) == [[(1, 1)], [(2, 1)]]


def test_p4_learns_last_words_that_say_nothing(spark):
    tags = spark.createDataFrame([(k, n) for k, n in enumerate(("sea witch", "lost heir", "old mill", "lost heir motif", "quiet harbour"))], "id bigint, name string")
    texts = ["Sea Witch motif", "old mill motif", "quiet harbour motif", "lost heir motif!", "sea wtich motif", "lost heir recipe", "motif"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, tag_text string")
    assert {r.id: r.tag_id for r in p4_canonical.resolve(rows, tags).collect()} == {0: 0, 1: 2, 2: 4, 3: 3, 4: 0, 5: -1, 6: -1}


def test_p4_all_entries_within_distance(spark):
    tags = spark.createDataFrame([(1, "sea witch"), (2, "tea witch"), (3, "ab")], "id bigint, name string")
    rows = spark.createDataFrame([(1, "Sea  Witch"), (2, "see witch"), (3, "Sea  Witch"), (4, None), (5, " "), (6, "ac")], "id bigint, tag_text string")
    assert values(p4_canonical.matches(rows, tags)) == [("Sea  Witch", 1, 0), ("Sea  Witch", 2, 1), ("see witch", 1, 1), ("see witch", 2, 2)]
    assert p4_canonical.matches(rows, tags.where("false")).count() == 0


def test_p5_pieces_are_whole_and_overlap(spark):
    r = random.Random(3)
    text = "".join(r.choice(["word ", "longer ", "end. ", "\n\n", "x" * 50 + " "]) for _ in range(3000))
    for t in (text, "y" * 20_001, "a b " * 4000, "é" * 4001, "w" * 3999 + " " + "v" * 5000):
        spans = p5_split.cut_points(t)
        assert spans[0][0] == 0 and spans[-1][1] == len(t)
        for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
            assert a < c < b < d and b - a <= 4000 and b - c <= 200
        greedy, at = [], 0  # one cut after another, as the doubled table must give them
        table = dict(spans)
        while True:
            greedy.append((at, table[at]))
            if table[at] == len(t):
                break
            at = next(c for c, _ in spans if c > at)
        assert greedy == spans
    rows = [("a", "t", "x", text), ("a", "t", "x", text), ("b", None, None, None), ("c", "", "", ""), ("d", "", "", "z" * 4000), ("e", "", "", "z" * 4001)]
    assert values(p5_split.oversized(stories(spark, rows))) == [("a",), ("e",)]
    pieces = p5_split.split(stories(spark, rows)).where("id = 'a'").orderBy("piece").collect()
    assert [p.text for p in pieces] == [text[p.start : p.stop] for p in pieces] and len(pieces) == len(p5_split.cut_points(text))
    assert p5_split.split(stories(spark, [])).count() == 0
    assert p5_split.split(stories(spark, rows), oversized_only=False).where("id = 'c'").first().text == ""


def test_p6_normal_form(spark):
    changed = {"Ｔｈｅ": "The", "Кasper's": "Kasper's", "ﬁve": "five", "café": "café", "a b": "a b", "Th﻿e": "The", "𝐟𝐨𝐫 Iv\xado": "for Ivo", "cлово": "слово", "Underthο̂rpe": "Underthôrpe"}
    kept = ["plain  text", "“½ price™” piñata…", "👩‍🚀 🏳️‍🌈", "слово о чём-то", "μm wide", "日本　語", "x² — don’t", "", None, "q" * 50_000]
    rows = [(f"c{i}", t, None, None) for i, t in enumerate(changed)] + [(f"k{i}", None, None, t) for i, t in enumerate(kept)] + [("k0", None, None, kept[0])]
    table = stories(spark, rows)
    assert values(p6_visible.disguised(table)) == [(f"c{i}", "title") for i in range(len(changed))]
    out = {r.id: r for r in p6_visible.normalized(table).collect()}
    assert [out[f"c{i}"].title for i in range(len(changed))] == list(changed.values())
    assert [out[f"k{i}"].body_text for i in range(len(kept))] == kept
    assert p6_visible.disguised(stories(spark, [])).count() == 0


def test_p7_links_spellings(spark):
    one = ["Edwin Barbabrack", "edwin barbabrack", "Edwin  Barbabrack ", "Barbabrack, Edwin", "Barbabrack Edwin", "Eddie Barbabrack", "Edwin Barbabarck", "E. Barbabrack", "EJ Barbabrack", "Dr. Edwin Barbabrack", "by Edwin Barbabrack"]
    other = ["Katherine Barbabrack", "Kate Barbabrack"]
    org = ["The Barbabrack Press Collective", "Barbabrack Press Coll.", "the barbabrack press collective"]
    names = one[:1] * 30 + other[:1] * 10 + org[:1] * 5 + ["Edwin Salsapick"] * 4 + ["Thomas Other"] * 4 + one + other + org + [None, "", " ", "Unknown", "anon.", "Various"]
    table = stories(spark, [(str(i), None, a, None) for i, a in enumerate(names)])
    want = sorted(p for g in (one, other, org) for p in combinations(sorted(g), 2))
    assert values(p7_names.linked(table)) == want
    assert p7_names.linked(stories(spark, [])).count() == 0


def test_p7_learns_short_forms_with_another_beginning(spark):
    surnames = ["Barbabrack", "Salsapick", "Fenkachotte", "Mermopiman", "Zelkisampe"]
    pairs = [(f"Carolina {s}", f"Lina {s}") for s in surnames]
    others = [f"Oswin {s}" for s in surnames[:3]]
    names = [long for long, _ in pairs for _ in range(6)] + [short for _, short in pairs] + others
    table = stories(spark, [(str(i), None, a, None) for i, a in enumerate(names)])
    assert values(p7_names.linked(table)) == sorted(pairs)


def test_p8_equals_the_plain_encoder(spark):
    r = random.Random(4)
    alphabet = "ab '’s\n\t  .!\xa0　é日😩 x1٣<|>"
    texts = [None, "", "   ", "<|endoftext|>", "z" * 30_000] + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(None, "a", [2])], "doc_id bigint, text string, ids array<int>")
    plain = p8_encode.encoder(p8_encode.VOCABULARY)
    got = {x.doc_id: x.ids for x in p8_encode.encode(df).collect()}
    assert got == {i: plain.encode_ordinary(t or "") for i, t in enumerate(texts)} | {None: plain.encode_ordinary("a")}
    assert p8_encode.encode(df.where("false")).count() == 0


def test_p8_cuts_texts_without_blanks():
    r = random.Random(6)
    plain = p8_encode.encoder(p8_encode.VOCABULARY)
    texts = ["x1y2;z=3&q=Ж7/" * 50, "その夜、灯子は木の舟を売った。" * 9, "a''s't!'s\"'re" * 7] + ["".join(r.choice("aZé'’s!?.-0²あЖ日😀\u0301") for _ in range(60)) for _ in range(500)]
    assert all(len(c) > 5 for c in p8_encode.cuts_of(texts[:2], p8_encode.VOCABULARY))
    flat, at = p8_encode.FragmentEncoder().batch(texts)
    assert [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [plain.encode_ordinary(t) for t in texts]


def test_p9_aligns_only_around_seeds_of_a_long_text():
    items = p9_leaks.Items([7], [" ".join(prose(1, 40))], 12)
    items.choose(np.ones(len(items.grams), np.int64))
    filler = [f"f{k}" for k in range(3000)]
    words, at = word_hashes([" ".join(filler + prose(1, 40)[10:30] + filler)])
    runs, _ = run_hashes(words, at, p9_leaks.SEED)
    (((a, b),),) = [own for own in items.stretches(runs, len(words)).values()]
    assert a < 3000 and b > 3020 and b - a < 300
    (result,) = p9_leaks.aligned([(items.words, words[a:b])])
    assert result[:2] == (40, 20) and (result[2] + a, result[3] + a) == (3000, 3020)


def test_p9_equals_brute_force(spark):
    items = [(i, " ".join(prose(100 + i, 40))) for i in range(6)] + [(6, " ".join(prose(100, 40))), (7, None), (8, ""), (9, "too short"), (None, "x")]
    docs = [(0, None), (1, ""), (2, " ".join(prose(9, 50)))]
    for i in range(6):
        w = prose(100 + i, 40)
        docs += [(10 + i, " ".join(prose(i, 30) + w[5:17] + prose(i, 30)).upper()), (20 + i, " ".join(prose(i, 9) + w[5:16])), (30 + i, ", ".join(w[:10] + ["zz"] + w[10:30] + ["yy"] + w[30:]))]
    docs += [docs[5], (99, "\n".join(" ".join(prose(100 + i, 40)) for i in range(6)) * 50)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame([(*x, "s") for x in items], "item_id bigint, text string, suite string")
    want = set()
    for di, t in docs:
        w = WORDS.findall((t or "").lower())
        own = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for ii, s in items:
            v = WORDS.findall((s or "").lower())
            if ii is not None and any(tuple(v[k : k + 12]) in own for k in range(len(v) - 11)):
                want.add((di, ii))
    assert values(p9_leaks.leaked(d, e)) == sorted(want, key=str)
    assert {(20 + i, i) for i in range(6)} <= {(x.doc_id, x.item_id) for x in p9_leaks.alignments(d, e).collect()}
    assert p9_leaks.leaked(d.where("false"), e).count() == 0 and p9_leaks.leaked(d, e.where("false")).count() == 0


@pytest.mark.parametrize("whole", [False, True])
def test_p9_aligns_edited_copies(spark, whole):
    item = prose(7, 60, 10_000)
    edited = [f"new{k}" if k % 10 == 9 else w for k, w in enumerate(item)]
    docs = [(0, " ".join(edited)), (1, " ".join(prose(8, 60)))] + [(2, " ".join(item))] * whole
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id bigint, text string")
    assert values(p9_leaks.alignments(d, e), "doc_id", "item_id", "longest_run") == [(0, 5, 9)] + [(2, 5, 60)] * whole
    assert values(p9_leaks.leaked(d, e)) == [(2, 5)] * whole


def test_p9_alignment_scores_are_right():
    r = random.Random(1)
    pairs = [tuple(np.array([r.randint(1, 4) for _ in range(r.randint(1, 20))], np.uint64) for _ in range(2)) for _ in range(60)]
    for (a, b), (score, longest, _, _) in zip(pairs, p9_leaks.aligned(pairs), strict=True):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        run = np.zeros_like(h)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if same else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                run[i, j] = run[i - 1, j - 1] + 1 if same else 0
        assert (score, longest) == (h.max(), run.max())


GOOD = ["“We walked,” said Zoë — “it’s the café’s crème brûlée.”", "Książę westchnął, a Róża zgubiła żółty zeszyt.", "Поздней осенью Прохор починил чайник.", "¿Dónde está el niño pequeño?", "「白い猫はどこですか」と風太が聞いた。", "Ñandú, Ü, ß, Å und ÄÖ: «Ähnlich», sagt Åke.", "Ù Ú Û — a vowel chart, № 7, “Ã” for nasal a.", "https://example.invalid/a?c=%20d&e=f#g"]


def test_p10_restores_and_leaves_alone(spark):
    wrong = [(GOOD[0], GOOD[0].encode().decode(e)) for e in ("latin_1", "mac_roman")]
    wrong += [(t, t.encode().decode("cp1252")) for t in ("“Ask,” she said".replace("”", "’"), "crème brûlée", "niño")]
    wrong += [(t, t.encode(a).decode(b)) for t, a, b in ((GOOD[2], "cp1251", "cp1252"), (GOOD[2], "cp866", "cp1251"), (GOOD[2], "koi8_r", "cp1251"), (GOOD[1], "iso8859_2", "latin_1"))]
    twice = "crème brûlée".encode().decode("latin_1").encode().decode("latin_1")
    wrong.append(("crème brûlée", twice))
    rows = [(i, t) for i, t in enumerate(GOOD + [None, "", "plain", "x" * 100_000])] + [(100 + i, w) for i, (_, w) in enumerate(wrong)] + [(200, "Schlie�lich"), (200, "Schlie�lich")]
    d = spark.createDataFrame([(*r, True) for r in rows], "doc_id bigint, text string, lost boolean")
    out = {r.doc_id: r.text for r in p10_encoding.restored(d).collect()}
    assert sorted(out) == [100 + i for i in range(len(wrong))] + [200]
    assert [out[100 + i] for i in range(len(wrong))] == [g for g, _ in wrong]
    assert p10_encoding.affected(d.where("false")).count() == 0


def test_p10_entities_and_japanese():
    search = p10_encoding.Search()
    assert search.text("caf&Atilde;&copy; and na&Atilde;&macr;ve") == (True, "café and naïve")
    assert search.text("ein Weg\n\nSch&#195;&#182;n &amp; gut") == (True, "ein Weg\n\nSchön & gut")
    for plain in ("caf&eacute; &amp; &lt;p&gt; &mdash; &copy; 2001", "AT&T & co", "&;&x;&#;"):
        assert search.text(plain) == (False, plain)
    japanese = "その夜、灯子は木の舟を売った。"
    assert search.text(japanese.encode("euc_jp").decode("cp1251")) == (True, japanese)
    assert search.text("한국어 문장입니다. ㅋㅋㅋ") == (False, "한국어 문장입니다. ㅋㅋㅋ")


def test_p10_restores_mixed_paragraphs():
    utf8, mac, russian = "café".encode().decode("cp1252"), "crème brûlée".encode().decode("mac_roman"), "Прохор починил".encode("cp1251").decode("cp1252")
    mixed = [(f"a→b {utf8}", "a→b café"), (f"a→b{utf8}", "a→bcafé"), (f"{utf8} x→y {mac}", "café x→y crème brûlée"), (f"he sa→id {mac}\n{utf8} {russian}", "he sa→id crème brûlée\ncafé Прохор починил")]
    search = p10_encoding.Search()
    assert [search.text(wrong) for wrong, _ in mixed] == [(True, right) for _, right in mixed]
    assert [search.text(t)[0] for t in ("a→b c▒d Ù Ú", "naïve x→y, “Ã”")] == [False, False]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, data, name):
    compare(spark, data, name, queries.queries()[name], queries.oracle_sql()[name])
