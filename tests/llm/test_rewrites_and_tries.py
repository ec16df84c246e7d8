"""Winnowing, fill-in-the-middle and the conversation trie beside brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from kindred.llm import fill_in_middle, prefix_trie, winnowing
from kindred.session import ship_package

ODD = [None, "", " \n", "a", "<", "<P>", "a<S>b", "x<M", "<P" + "<", "é\U0001f600ß", "漢字かな交じり文です", "word " * 40, "q" * 900, "<" * 300]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 6)))
    out = [*ODD, *(" ".join(word() for _ in range(rng.choice([3, 5, 20, 40, 300]))) for _ in range(40))]
    out += [out[20], out[20], " ".join(word() for _ in range(9000))]  # copies and a long text
    return [(3 * k - 7, t) for k, t in enumerate(out)]


def clashing(spark, rows):
    ship_package(spark)
    schema = "doc_id long, text string, n long, form string, output string, key string, row string, copies long, rank long"
    return spark.createDataFrame([(k, t, 1, "f", "o", "k", "r", 5, 6) for k, t in rows], schema).repartition(3)


# fill-in-the-middle


def infilled(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, texts, monkeypatch):
    rows = [*texts, *((10_000 + k, "<P <S" + "ab<" * (k % 5)) for k in range(60)), (None, "no id at all"), texts[-1]]
    formatted = fill_in_middle.fill_in_middle(clashing(spark, rows))
    got = formatted.collect()
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == sorted(
        (str(k), *infilled(k, t)) for k, t in rows
    )
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    back = fill_in_middle.restore(formatted)
    assert back.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "restored"]
    assert sorted((str(r.doc_id), r.restored) for r in back.collect()) == sorted((str(k), t or "") for k, t in rows)
    empty = fill_in_middle.fill_in_middle(clashing(spark, rows).limit(0))
    assert fill_in_middle.restore(empty).collect() == []


@pytest.mark.parametrize("tile", [1, 7, 1 << 18])
def test_scatter_and_gather_are_inverse(monkeypatch, tile):
    monkeypatch.setattr(fill_in_middle, "TILE_BYTES", tile)
    rng = np.random.default_rng(tile)
    texts = [bytes(rng.choice(list(b"ab<PSM>"), size).astype(np.uint8)) for size in (0, 1, 5, 40, 0, 300)]
    texts = [re.sub(rb"<[PSM]>", b"", t) for t in texts]
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    cuts = np.sort(np.stack([rng.integers(0, np.diff(offsets) + 1), rng.integers(0, np.diff(offsets) + 1)]), axis=0) + offsets[:-1]
    form = np.array([0, 1, 2, 1, 0, 2])
    out, out_offsets = fill_in_middle.scatter(raw, offsets, cuts, form)
    for k, text in enumerate(texts):
        a, b = cuts[:, k] - offsets[k]
        p, m, s = text[:a], text[a:b], text[b:]
        want = [text, b"<P>" + p + b"<S>" + s + b"<M>" + m, b"<S>" + s + b"<P>" + p + b"<M>" + m][form[k]]
        assert out[out_offsets[k] : out_offsets[k + 1]].tobytes() == want
    again, again_offsets = fill_in_middle.gather(out, out_offsets, form)
    assert again.tobytes() == raw.tobytes() and (again_offsets == offsets).all()


# winnowing


def printed(text, k=winnowing.K, window=winnowing.WINDOW):
    single = "぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
    units = re.findall(rf"[{single}]|[^\x20\x09-\x0D{single}]{{1,16}}", text or "")
    codes = [int(hashlib.md5(u.encode()).hexdigest()[:15], 16) % winnowing.MODULUS for u in units]
    if not codes:
        return []

    def value(part):
        return sum(c * winnowing.BASE ** (len(part) - 1 - j) for j, c in enumerate(part)) % winnowing.MODULUS

    hashes = [value(codes[i : i + k]) for i in range(max(1, len(codes) - k + 1))]
    # the rolling recurrence gives the same values
    for i in range(len(hashes) - 1):
        rolled = ((hashes[i] - codes[i] * winnowing.BASE ** (k - 1)) * winnowing.BASE + codes[i + k]) % winnowing.MODULUS
        assert rolled == hashes[i + 1]
    chosen = set()
    for s in range(max(1, len(hashes) - window + 1)):
        part = range(s, min(s + window, len(hashes)))
        chosen.add(min(part, key=lambda i: (hashes[i], -i)))
    return [(hashes[i], i) for i in sorted(chosen)]


@pytest.mark.parametrize(("k", "window", "stretch"), [(5, 16, 4096), (5, 16, 32), (4, 3, 8), (1, 1, 8), (7, 5, 16)])
def test_fingerprints(spark, texts, monkeypatch, k, window, stretch):
    monkeypatch.setattr(winnowing, "STRETCH", stretch)
    rows = texts if stretch > 16 else [(i, t) for i, t in texts if len(t or "") < 3000]
    got = winnowing.fingerprints(clashing(spark, rows), k=k, window=window).collect()
    want = {i: (len(t or ""), printed(t, k, window)) for i, t in rows}
    assert {r.doc_id: (r.n_chars, [tuple(e) for e in r.fingerprint]) for r in got} == want


def test_matches_are_guaranteed():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    shared = [word() for _ in range(winnowing.K + winnowing.WINDOW - 1)]
    for _ in range(50):
        a, b = ([word() for _ in range(rng.randint(0, 60))] for _ in range(2))
        one, other = (printed(" ".join([*x, *shared, *reversed(x)])) for x in (a, b))
        assert {h for h, _ in one} & {h for h, _ in other}


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_fingerprints(spark, texts):
    rows = [*texts, (texts[3][0], "another text of a known id"), *[texts[25]] * 3, (None, "no id"), (None, "no id"), (None, None)]
    got = winnowing.edited_fingerprints(clashing(spark, rows)).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), digest(r[1])))
    want = []
    for (doc, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        p, q = printed(text), printed(edited)
        want.append((str(doc), len(text), edited, p, q, round(jaccard(p, q), 9), round(jaccard(p, printed(after)), 9)))
    pairs = lambda f: [tuple(e) for e in f]
    have = [
        (str(r.doc_id), r.n_chars, r.edited, pairs(r.fingerprint), pairs(r.edited_fingerprint), round(r.near_edited, 9), round(r.near_next, 9))
        for r in got
    ]
    assert sorted(have) == sorted(want)
    one = winnowing.edited_fingerprints(clashing(spark, [(4, "abcdef")])).collect()
    assert [(r.edited, r.near_next) for r in one] == [("abcdab", 1.0)]
    assert winnowing.edited_fingerprints(clashing(spark, rows).limit(0)).collect() == []


def test_fingerprints_use_no_python(spark, texts):
    plan = winnowing.edited_fingerprints(clashing(spark, texts[:9]))._jdf.queryExecution().toString()
    assert not re.search(r"Python|MapInArrow|MapInPandas", plan)


# the conversation trie


def branches(rows):
    """The rebuilt conversations: lists of (role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            symbol = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), symbol, role, text))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 * (1 if c >= 0 else -1))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie_of(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, inside in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = sorted(c for c in inside if len(convs[c]) == len(node))
        childless = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        out.append(
            (
                min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), sum(len(m) == len(node) + 1 for m in below),
                len(childless), sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return out


def turns_frame(spark, rows):
    ship_package(spark)
    schema = "conv_id long, turn long, role string, text string, key string, name string, depth long, turns string, h int, head long"
    return spark.createDataFrame([(*r, "k", "n", 3, "t", 1, 2) for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def logs():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 60), *range(100, 140), 205, 207, 299, -5, -105, 10**15]:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "hi", "hello é", None, "x" * 50])))
    rows += [(0, None, None, None), (0, None, "user", "first"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (None, 0, "user", "nobody's"), (206, 0, "u", "x")]
    rows += [(150, t, "user", f"turn {t % 3}") for t in range(40)]  # a long one, and one that is its beginning
    rows += [(151, t, "user", f"turn {t % 3}") for t in range(33)]
    return rows


@pytest.mark.parametrize("flush", [1 << 18, 5])
def test_conversation_trie(spark, logs, monkeypatch, flush):
    monkeypatch.setattr(prefix_trie, "FLUSH_TURNS", flush)
    convs = branches(logs)
    assert any(not turns for turns in convs.values())
    got = prefix_trie.prefix_trie(prefix_trie.branched(turns_frame(spark, logs)))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(trie_of(convs), key=key)


def test_trie_of_nothing(spark, logs):
    assert prefix_trie.prefix_trie(prefix_trie.branched(turns_frame(spark, logs).limit(0))).collect() == []


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", "same" if t == 0 else "so") for c in range(9000, 14_000) for t in range(2)]
    own = prefix_trie.conversation_turns(turns_frame(spark, rows))
    got = prefix_trie.prefix_trie(own).orderBy("depth").collect()
    ids = hashlib.sha256(",".join(str(c) for c in range(9000, 14_000)).encode()).hexdigest()
    none = hashlib.sha256().hexdigest()
    assert [tuple(r) for r in got] == [
        (9000, 0, None, 5000, 1, 1, 4999 * 6, none), (9000, 1, 9000, 5000, 1, 1, 4999 * 6, none), (9000, 2, 9000, 5000, 0, 1, 4999 * 2, ids),
    ]


def test_fat_binary_search_finds_the_exit():
    """Every search ends at the deepest node whose extent is a prefix, in few look-ups."""
    rng = random.Random(5)
    trie, seen = prefix_trie.ZFastTrie(), set()
    for _ in range(600):
        sequence = tuple(rng.choice([b"a", b"b"]) if rng.random() < 0.3 else b"a" for _ in range(rng.randint(0, 40)))
        names = prefix_trie.prefix_names(list(sequence))
        node, below = trie.locate(names)
        fits = [n for n in trie.nodes if n.extent < len(names) and n.names[n.extent] == names[n.extent]]
        assert node is max(fits, key=lambda n: n.extent)
        assert below is None or (below.above is node and below.names[node.extent + 1] == names[node.extent + 1])
        if sequence not in seen:
            seen.add(sequence)
            trie.insert(names, [1] * len(sequence), (1, len(seen), 0, 0, "", None))
    assert [prefix_trie.two_fattest(a, b) for a, b in ((0, 1), (0, 7), (4, 7), (5, 7), (6, 7), (7, 8))] == [1, 4, 6, 6, 7, 8]
