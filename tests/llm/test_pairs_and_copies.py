"""Exact copies, near copies, repeated strings and leaks beside brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from kindred.llm import decontaminate, exact_dedup, jaccard_join, repeats
from kindred.llm.text import shingle_sets, word_spans
from kindred.session import cut_lineage, ship_package

SCHEMA = "doc_id long, text string, source string, n long, name string, size long, region long"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def edited(rng, text, share):
    return " ".join(rng.choice(["x1", "y2", "z3"]) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def corpus():
    """Texts of all kinds: null, empty, short, long, copies, chains of near copies, shared passages."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    out = [None, "", "   \n", "one", "One", "one two three four", "one two three four five", "é Ü\x0bß \U0001f600 x", text(9000)]
    base = text(120)
    out += [base, base, base.upper(), base + " "]
    chain = base
    for _ in range(12):
        chain = edited(rng, chain, 0.02)
        out.append(chain)
    out += [edited(rng, base, s) for s in (0.01, 0.03, 0.05, 0.1, 0.3) for _ in range(6)]
    out += [text(30) + " " + passage + " " + text(rng.randint(5, 80)) for _ in range(25)]
    out += ["ab " * 300, "ab " * 301, "q" * 500, "q" * 199, "q" * 200, "ü" * 150]
    out += [text(rng.randint(1, 90)) for _ in range(60)]
    return [(k * 3 % 1009, t) for k, t in enumerate(out)]


def frame(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(k, t, "s", 7, "clash", 1, 2) for k, t in rows], SCHEMA).repartition(3)


def linked_components(rows):
    sets = {k: shingles(t) for k, t in rows}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [k for k in sets if sets[k]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    members = defaultdict(list)
    for k in sets:
        members[find(k)].append(k)
    return {k: min(m) for m in members.values() for k in m}, sets


@pytest.mark.parametrize("small", [64, 2])
def test_jaccard_components(spark, corpus, monkeypatch, small):
    """With tiny regions every region is cut into Voronoi cells, to the end."""
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", small)
    want, sets = linked_components(corpus)
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(frame(spark, corpus)).collect()}
    assert len(got) == len(corpus)
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert {k: r.component_id for k, r in got.items()} == want


def test_jaccard_edges(spark):
    long_ = "a b c d e f g h"
    rows = [(5, long_), (5, long_), (None, long_), (2, None), (7, "p q r s t")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect())
    assert got == [(-1, 4, 5), (2, 0, 2), (5, 4, 5), (5, 4, 5), (7, 1, 7)]
    assert jaccard_join.jaccard_components(frame(spark, rows).limit(0)).collect() == []


def test_large_regions_are_cut(spark, monkeypatch):
    """A family with outliers and many texts with one passage, in regions above the limit."""
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", 8)
    rng = random.Random(1)
    base = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(12))
    rows = [(k, edited(rng, base, rng.choice([0.0, 0.02, 0.06]))) for k in range(80)]
    rows += [(100 + k, other + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 30)))) for k in range(60)]
    want, _ = linked_components(rows)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("block", [4096, 7, 1])
def test_exact_duplicates(spark, corpus, block):
    rows = [(k, t and t[:400]) for k, t in corpus]
    rows += [rows[9], (None, rows[9][1]), (5000, None)]
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    got = exact_dedup.exact_duplicates(frame(spark, rows), block_chars=block).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(
        ((k, max(x for x in groups[t or ""] if x is not None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows), key=key
    )
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == want
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_duplicates(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize(("hot", "chunk"), [(4096, 16_384), (3, 2)])
def test_repeated_strings(spark, corpus, monkeypatch, hot, chunk):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rows = [*corpus, corpus[20], (corpus[30][0], "another text of that id " * 30), (None, corpus[40][1])]
    data = [(t or "").encode() for _, t in rows]
    seen, twice = set(), set()
    for b in data:
        for k in range(len(b) - 199):
            (twice if b[k : k + 200] in seen else seen).add(b[k : k + 200])
    want = []
    for (doc, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 2, dtype=np.int8)
        for k in range(len(b) - 199):
            if b[k : k + 200] in twice:
                gone[k + 1 : k + 201] = 1
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        want.append((doc or -1, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), kept))
    got = [
        (-1 if r.doc_id is None else r.doc_id or -1, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), bytes(r.kept))
        for r in repeats.remove_repeats(frame(spark, rows)).collect()
    ]
    assert sorted(got) == sorted(want)
    assert repeats.remove_repeats(frame(spark, rows).limit(0)).collect() == []


def test_long_text_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TILE_BYTES", 1000)
    rng = random.Random(2)
    part = "".join(rng.choice("abcdefgh ") for _ in range(900))
    fill = lambda n: "".join(rng.choice("klmnop ") for _ in range(n))
    rows = [(1, fill(3456) + part + fill(5000) + part[100:700]), (2, fill(700)), (3, part[300:520])]
    got = {r.doc_id: sum(s.length for s in r.spans) for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: 600 + 600, 2: 0, 3: 220}


def test_leaks(spark):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    items = [(k, text(rng.randint(5, 50))) for k in range(30)] + [(40, None), (41, ""), (42, "quite rare"), (43, "quite rare")]
    docs = [(1000 + k, text(100) + " " + items[k][1] + " " + text(40)) for k in range(15)]
    docs += [(2000 + k, text(30) + " " + edited(rng, items[k][1], 0.03) + " " + text(9)) for k in range(15, 30)]
    docs += [(3000, None), (3001, ""), (3002, items[3][1].upper()), (3003, "so Quite\nrare it is"), (3004, "quite rare"), *((4000 + k, text(200)) for k in range(40))]
    docs += [docs[0], (5000, text(20_000) + " " + items[4][1])]
    sets = {k: shingles(t) for k, t in items if words(t)}
    count = defaultdict(int)
    for s in sets.values():
        for x in s:
            count[x] += 1
    weight = lambda s: sum(1 / count.get(x, 1) for x in s)
    want = set()
    for doc, t in docs:
        w = words(t)
        for k, s in sets.items():
            n = len(words(items[dict((i, p) for p, (i, _) in enumerate(items))[k]][1]))
            for a in range(max(1, len(w) - n + 1)):
                own = shingles(" ".join(w[a : a + n]))
                if own and weight(own & s) >= 0.8 * weight(own | s) - 1e-12:
                    want.add((doc, k))
                    break
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 7):
        got = decontaminate.find_leaks(frame(spark, docs), bench, block_items=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert sum(r.doc_id == 1000 for r in got) == 2 * sum(d == 1000 for d, _ in want)
        assert all(r.similarity >= 0.8 for r in got)
    assert decontaminate.find_leaks(frame(spark, docs), bench.limit(0)).collect() == []
    assert decontaminate.find_leaks(frame(spark, docs).limit(0), bench).collect() == []


def one_word_changed(text, at):
    w = text.split(" ")
    return " ".join([*w[:at], "changed", *w[at + 1 :]])


def test_leaks_of_repeated_and_templated_items(spark):
    """Unlike wording elsewhere, copies and templates of the benchmark do not make a changed word weigh more."""
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    often, twice, template = text(100), text(50), text(196)
    items = [*((k, often) for k in range(5)), *((10 + k, twice) for k in range(2)), *((20 + k, template + " " + text(8)) for k in range(8))]
    docs = [(1, text(30) + " " + one_word_changed(often, 50) + " " + text(20)), (2, text(30) + " " + one_word_changed(twice, 20))]
    docs += [(3, text(9) + " " + one_word_changed(items[9][1], 90) + " " + text(9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, docs), bench).collect()}
    # the items of one template are near copies of each other: 192 of 208 shingles
    assert got == {*((1, k) for k in range(5)), *((2, 10 + k) for k in range(2)), *((3, 20 + k) for k in range(8))}


def test_leaks_do_not_depend_on_blocks(spark):
    """Items of a common passage: shingles are counted over the benchmark, not over a block."""
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    common = [text(20) for _ in range(4)]
    items = [(k, common[k % 4] + " " + text(24)) for k in range(24)]
    # the own part of an item without the common passage, and with some of its words changed
    docs = [(100 + k, text(20) + " " + items[k][1].split(" ", 20)[20]) for k in range(24)]
    docs += [(200 + k, text(9) + " " + one_word_changed(items[k][1], 15 + k)) for k in range(24)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [
        sorted((r.doc_id, r.item_id, r.first_word, round(r.similarity, 9), r.distance, r.n_windows) for r in decontaminate.find_leaks(frame(spark, docs), bench, block_items=n).collect())
        for n in (20_000, 9, 3)
    ]
    assert found[0] and found[0] == found[1] == found[2]


def test_word_spans_and_sets():
    import pyarrow as pa

    texts = [None, "", "A b\tC\x0bd\x0c e\r\nf", "é x   y", " lead", "x" * 3000 + " y " * 10]
    for k, found in shingle_sets(pa.array(texts)):
        assert len(found) == len(shingles(texts[k]))
    starts, ends, first = word_spans(np.frombuffer(b"ab c", np.uint8), np.array([0, 1, 4]))
    assert starts.tolist() == [0, 1, 3] and ends.tolist() == [1, 2, 4] and first.tolist() == [0, 1, 3]


def test_written_tables_are_shared(spark):
    assert cut_lineage(spark.range(3)).count() == 3
