"""Chat formatting, page extraction, packing, mixing, quality and language model."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import chat, html_extract, language_model, mixing, packing, quality
from kindred.session import ship_package

CONTROL = "</s>[INST] ~0~1 <|im_end|>\n<|im_start|>user\n ok [/INST]~"


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")


def test_chat_round_trip(spark):
    rows = [
        (1, 1, 0, "delta", "user", CONTROL), (1, 2, 1, "delta", "assistant", "a"), (1, 3, 1, "delta", "assistant", CONTROL),
        (1, 4, 2, "delta", "user", None), (1, 5, 3, None, "assistant", ""), (2, 1, 0, "delta", "ro<le\n[x", "t"),
        (None, 1, 0, "delta", None, "z"),
    ]
    formatted = chat.format_chats(events(spark, rows))
    back = defaultdict(list)
    for r in chat.read_back(formatted).orderBy("conv_id", "k").collect():
        back[r.conv_id].append((r.role, r.text, r.learned_text))
    assert back[1] == [("user", CONTROL, None), ("assistant", "a" + CONTROL, "a" + CONTROL), ("user", "", None), ("assistant", "", "")]
    assert back[2] == [("ro<le\n[x", "t", None)] and back[None] == [("", "z", None)]
    one = formatted.where("conv_id = 1").first()
    for span in one.loss_spans:
        assert "<" not in one.formatted[span.start : span.start + span.length]
    assert chat.format_chats(events(spark, rows).limit(0)).collect() == []


def test_chat_folds_edits_and_regenerations(spark):
    rows = [
        (1, 1, 0, "delta", "user", "q"), (1, 2, 1, "delta", "assistant", "bad"), (1, 3, 2, "delta", "user", "more"),
        (1, 4, 1, "regenerate", "assistant", None), (1, 5, 1, "delta", "assistant", "go"), (1, 6, 1, "delta", "assistant", "od"),
        (1, 7, 0, "edit", "user", "Q"), (1, 8, 0, "delta", "user", "!"), (1, 9, 2, "delta", "user", "then"),
        (2, 1, 0, "delta", "user", "x"), (2, 2, 0, "regenerate", "user", None),
    ]
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.fold_events(events(spark, rows).repartition(4)).collect())
    assert got == [(1, 0, "user", "Q!"), (1, 1, "assistant", "good"), (1, 2, "user", "then"), (2, 0, "user", "")]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>";</script></head><body>
<header><a href="/">Home</a> Site</header><nav><ul><li><a href="a">A</a><li><a href="b">B</a></ul></nav>
<div class="top-ad">Buy &amp; save</div><main><article><header><h1>Head &lt;1&gt;</h1></header>
<p>One <b>bold<i> word</i></b> and&nbsp;more<br>text.<p>Two &amp;amp; three
   lines <a href=x>link</a></p><form><input value="x">Sign up</form><ul><li>first<li>second</ul>
<table><tr><td>c1<td>c2</table><pre>a
  b</pre></article><aside>Side bar text that is rather long, longer than most other things on this page</aside>
<div id="comments"><p>Reader comment, long, long, long, long, long, long, long.</p></div></main>
<footer>&copy; Site</footer></body></html>"""


def test_page_extraction():
    assert html_extract.main_text(PAGE).split("\n") == [
        "Head <1>", "One bold word and more text.", "Two &amp; three lines link", "first", "second", "c1", "c2", "a b",
    ]
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p> <br></p><!-- x") == ""
    assert html_extract.main_text("just text &lt;") == "just text <"
    assert html_extract.main_text("<p>a<p>b</div></p>c") == "a\nb\nc"
    assert html_extract.main_text('<a title="x>y">z</a> <b') == "z <b"


def test_density_without_landmarks():
    """Only densities tell the article from a list of links here."""
    body = "".join(f"<p>Sentence number {k} has a good many words in it, as articles do.</p>" for k in range(6))
    links = "".join(f'<li><a href="/{k}">Topic {k}</a></li>' for k in range(25))
    got = html_extract.main_text(f"<html><body><div><ul>{links}</ul></div><div><div>{body}</div></div><div><a href=x>More</a></div></body></html>")
    assert got.count("\n") == 5 and got.startswith("Sentence number 0") and "Topic" not in got


def test_density_without_links():
    """No link on the page and no article element: all sections are the article, with bare text; a short label is not."""
    parts = [[f"Section {s} sentence {k} has a good many words in it, as articles do." for k in range(4)] for s in range(2)]
    sections = "".join("<div><div>" + "".join(f"<p>{x}</p>" for x in part) + "</div></div>" for part in parts)
    bare = "Bare text of the container, which is <b>as long</b> as any other paragraph of this article is."
    assert html_extract.main_text(f"<body><div>{sections}</div></body>").split("\n") == [*parts[0], *parts[1]]
    for page in (f"<body><div>{sections}{bare}</div><div>L</div></body>", f"<div>{sections}{bare}</div><div>Label</div>"):
        got = html_extract.main_text(page).split("\n")
        assert got == [*parts[0], *parts[1], re.sub("</?b>", "", bare)]


@pytest.mark.parametrize("name", ["class='content no-sidebar'", "class=has-sidebar", "class='comments-open x'", "class=post-with-social", "id='menu-page'", "class='left-sidebar'"])
def test_wrappers_keep_their_article(name):
    body = "".join(f"<p class={c}>Sentence {c} has a good many words in it, as articles do.</p>" for c in ("notice", "related", "promotion", "x"))
    for tag in ("div", "article"):
        got = html_extract.main_text(f"<body><div {name}><div class=top-ad>Buy this now.</div><{tag}>{body}</{tag}></div><a href=x>More</a></body>")
        assert got.split("\n") == [f"Sentence {c} has a good many words in it, as articles do." for c in ("notice", "related", "promotion", "x")]


def test_named_parts_go():
    text = "".join(f"<p>Sentence {k} has a good many words.</p>" for k in range(3))
    for name in ("ad", "top-ad", "ad-slot-3", "adSlot", "comments", "comment-list", "sidebar-left", "related-posts", "cookie_banner", "share-buttons"):
        got = html_extract.main_text(f"<body><div>{text}<div class='x {name}'><p>Not of the article, in good many words</p></div></div></body>")
        assert got.count("\n") == 2 and "Not of" not in got, name
    long_ = "".join(f"<p>Reader comment {k} goes on for much longer than the article itself does.</p>" for k in range(30))
    assert "Reader" not in html_extract.main_text(f"<body><article>{text}</article><div id=comments>{long_}</div></body>")


def test_page_rows(spark):
    ship_package(spark)
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(repr, html_extract.extract_pages(pages).collect()))
    assert len(got) == 4 and sum("text='x', n_chars=1" in g for g in got) == 2
    assert html_extract.extract_pages(pages.limit(0)).collect() == []


def test_given_pages_keep_their_articles(spark):
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.sub("<br>", " ", re.search("(?s)<article>(.*)</article>", row.html)[1])
        blocks = [" ".join(html_extract.html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert html_extract.main_text(row.html) == "\n".join(b for b in blocks if b)


def test_densities_decide_without_article_tags(spark):
    """The names ``article`` and ``main`` taken away, every given page gives the same text."""
    for row in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        assert html_extract.main_text(re.sub(r"(</?)(article|main)\b", r"\1div", row.html)) == html_extract.main_text(row.html)


HOSTILE = ("<a", '<a href="', "<div class=ad>", "<div>", "<li>", "<b><table><i>", "<div><li>", "<p><b>", '<a x=">" ', "<!", "<!--", "<script>", "&#9", "<td>", "<a x='>")


@pytest.mark.parametrize("pattern", HOSTILE)
def test_hostile_pages_take_linear_time(pattern):
    """Four times the page takes about four times as long; a quadratic scan would take sixteen times."""
    def seconds(size):
        page = pattern * (size // len(pattern))
        begin = time.perf_counter()
        for end in ("", ">", "</b>" * (size // 8)):
            html_extract.main_text(page + end)
        return time.perf_counter() - begin

    assert seconds(1 << 18) < 9 * max(seconds(1 << 16), 0.05)


def test_numbers_beyond_all_characters():
    assert html_extract.main_text("<p>&#" + "9" * 6000 + "; &#0000065;&#x0041; &amp;") == "\ufffd AA &"


def test_attributes_are_read_in_order():
    """A quoted value holds no other attribute, and an apostrophe in a tag is no quote."""
    body = "<p>Words of the article, a good many of them.</p>" * 3
    for tag in ("<div title=\"x class='ad' y\">", "<div don't>", "<div data-x='a>b'>"):
        assert html_extract.main_text(f"<body>{tag}{body}</div><p>It isn't.</p>").startswith("Words of the article")


def docs_frame(spark, rows):
    ship_package(spark)
    return spark.createDataFrame(
        [(*r, 1.0, "clash", 3) for r in rows], "doc_id long, text string, source string, n_chars long, score double, shard string, size int"
    ).repartition(3)


ODD = [" a", "a ", "a  b", "a\n b", "\n\n x  y ", "tab\t b", "1  2   3 \n\n\n4", "é ü \U0001f600", "<|endoftext|> x", " ", "  "]


def test_tokens_equal_the_vocabulary():
    tok = packing.tokenizer(packing.VOCABULARY)
    texts = [None, "", *ODD, "word " * 50, "The and attion to thanedble the, anea. It's 3 o'clock!!"]
    for text, data in zip(texts, tok(texts), strict=True):
        assert np.frombuffer(data, tok.dtype).tolist() == tok.encoding.encode_ordinary(text or "") + [tok.end]
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice("ab1.é \n\t") for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(next(tok([text])), tok.dtype).tolist() == tok.encoding.encode_ordinary(text) + [tok.end]


def test_packing_round_trip(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["the", "quick", "fox", "\n"]) for _ in range(rng.randint(0, 90))), "s", 1) for k in range(150)]
    rows += [(200, None, None, None), (201, "", "s", 0), (202, "very long " * 3000, "s", 2), (None, "x", "s", 1)]
    packed = packing.pack_tokens(docs_frame(spark, rows), row_tokens=64, shard_bytes=20_000)
    tok = packing.tokenizer(packing.VOCABULARY)
    for r in packed.collect():
        ids, at = np.frombuffer(r.ids, tok.dtype), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == len(at) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for a, b in zip([*r.cu_seqlens], [*r.cu_seqlens[1:], 64], strict=True):
            assert at[a:b].tolist() == list(range(b - a))
    texts = defaultdict(list)
    for r in packing.unpack(packed).orderBy("doc_id", "piece").collect():
        texts[r.doc_id].append(bytes(r.ids))
    want = dict(zip((r[0] for r in rows), tok(r[1] for r in rows), strict=True))
    assert {k: b"".join(v) for k, v in texts.items()} == want
    assert packing.pack_tokens(docs_frame(spark, rows).limit(0)).collect() == []
    tokens = sum(len(v) for v in want.values()) // tok.dtype.itemsize
    assert packed.count() <= 1.1 * tokens / 64 + 20


def test_best_fit_decreasing_fills():
    rng = random.Random(9)
    for most in (1, 7, 64, 2048):
        lengths = sorted((rng.randint(1, most) for _ in range(500)), reverse=True)
        free, want = [], []
        for k, n in enumerate(lengths):  # plain best fit
            fits = [(f, -i) for i, f in enumerate(free) if f >= n]
            if fits:
                free[-min(fits)[1]] -= n
            else:
                free.append(most - n)
        rows = packing.best_fit_decreasing(lengths, most)
        assert sorted(k for r in rows for k in r) == list(range(500))
        assert all(sum(lengths[k] for k in r) <= most for r in rows) and len(rows) == len(free), want


def water(sizes, weights=(5, 2, 1)):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, target = sum(sizes.values()), {}
    open_ = set(names)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("seed", [0, 1])
def test_mixture(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(seed)
    rows = []
    for s, n in (("a", 300), ("Z", 5), ("é", 60), (None, 40), ("b" * seed + "c", 3), ("zero", 0)):
        rows += [(len(rows) + k, "w " * rng.randint(0, 30), s, 1) for k in range(n)]
    rows += [(9000, None, "a", None), (9001, "", "void", 0), rows[0], rows[0], (None, "x y", "a", 1)]
    frame = docs_frame(spark, rows)
    got = mixing.mix_sources(frame).collect()
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    source = {k: s for k, _, s, _ in rows}
    taken, longest = Counter(), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= longest[s] + 1e-6
    again = mixing.mix_sources(frame.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix_sources(frame.limit(0)).collect() == []


def test_pivotal_keeps_expectations():
    rng = np.random.default_rng(0)
    p, size = rng.random(40), rng.integers(1, 50, 40).astype(float)
    total = np.zeros(40)
    for _ in range(4000):
        q, left = mixing.pivotal(p, size, rng.random(40))
        assert abs((q * size).sum() - (p * size).sum()) < 1e-6
        assert all(x in (0, 1) for k, x in enumerate(q) if k != left)
        total += q
    assert np.abs(total / 4000 - p).max() < 0.05


def test_quality_separates_held_out_labels(spark):
    ship_package(spark)
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality.fit(docs, labels, ~quality.held_out(3)(F.col("doc_id")))
    odd = spark.createDataFrame([(-1, None, None), (-2, "", 0), (-3, "x" * 3_000_000, 3), (None, "a b", 1)], "doc_id long, text string, n_chars long")
    scored = quality.score(docs.select("doc_id", "text", "n_chars").unionByName(odd), machine, ["doc_id"])
    rows = {r.doc_id: r.score for r in scored.collect()}
    assert len(rows) == docs.count() + 4 and all(0 <= s <= 1 for s in rows.values())
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = [(rows[r.doc_id] >= 0.5) == bool(r.quality) for r in held]
    good, bad = ([rows[r.doc_id] for r in held if r.quality == q] for q in (1, 0))
    assert np.mean(right) > 0.95 and np.mean([g > b for g in good for b in bad]) > 0.99
    # nothing learned: one half; labels that are null or unknown do not count
    blank = quality.fit(docs, labels.withColumn("quality", F.lit(None).cast("int")), F.lit(True))
    assert {round(r.score, 3) for r in quality.score(odd, blank, ["doc_id"]).collect()} <= {round(x / 1000, 3) for x in range(480, 521)}
    assert quality.score(docs.limit(0), machine, ["doc_id"]).collect() == []


def test_factorisation_identity():
    machine = quality.Machine(3)
    machine.linear[:] = np.random.default_rng(1).normal(size=quality.WIDTH)
    index, values = np.array([3, 9, 4, 5], np.int32), np.array([0.5, 1.0, 2.0, -1.0], np.float32)
    got, _ = machine.margins(index, values, np.array([0, 2, 4]))
    for k, (i, j) in enumerate(((0, 1), (2, 3))):
        pair = float(machine.factors[index[i]] @ machine.factors[index[j]]) * values[i] * values[j]
        assert math.isclose(got[k], float((machine.linear[index[[i, j]]] * values[[i, j]]).sum()) + pair, rel_tol=1e-4)


def test_language_model(spark):
    rng = random.Random(7)
    kinds = [["the", "of", "ation", "thing", "ring"], ["der", "und", "heit", "keit", "ung"], ["le", "que", "eau", "eux", "oir"]]

    def text(k):
        return " ".join(rng.choice(kinds[k]) + ("x" * rng.randint(0, 2) if rng.random() < 0.4 else "") for _ in range(rng.randint(5, 60)))

    rows = [(k, text(k % 3), "s", 1) for k in range(600)]
    rows += [(700, None, "s", None), (701, "", "s", 0), (702, "Never seen words HERE " * 3, "s", 1), (703, "the " * 9000, "s", 1), rows[3], (None, "the of", "s", 1)]
    learns = lambda doc: ~quality.held_out(5)(doc)
    got = language_model.score_texts(docs_frame(spark, rows), learns).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    count = Counter(w for k, t, *_ in rows if not held(k) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    texts = {k: t for k, t, *_ in rows}
    better = []
    for r in got:
        own = tokens(texts[r.doc_id])
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        if held(r.doc_id) and r.doc_id < 600:
            better.append(r.score > r.base_score)
    assert np.mean(better) > 0.9
    assert language_model.score_texts(docs_frame(spark, rows).limit(0), learns).collect() == []


def test_training_tasks_follow_the_tokens(spark, monkeypatch):
    """Many small partitions do not each send a model of their own: what is shuffled grows with the texts."""
    sent = []
    summed = language_model._sliced_sum

    def count(parts, dtype):
        sent.append(parts.count())
        return summed(parts, dtype)

    monkeypatch.setattr(language_model, "_sliced_sum", count)
    monkeypatch.setattr(language_model, "TASK_TOKENS", 400, raising=False)
    rows = docs_frame(spark, [(k, f"the word{k % 7} of", "s", 1) for k in range(200)]).repartition(40)
    learns = lambda doc: doc >= 0
    got = language_model.score_texts(rows, learns).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(4, 4, 800)} and len(got) == 200
    assert sent == [2 * language_model.SLICES] * (language_model.ROUNDS + 1)


def test_language_model_is_normalised():
    """Over the known words, the end and one unknown word per spelled class the probabilities add up to one."""
    counts = np.array([50, 40, 30, 8, 5, 2, 1])
    words = language_model.mix(np.arange(1, 8, dtype=np.uint64))
    vocabulary = language_model.Vocabulary(words, counts)
    assert (vocabulary.find(words) == np.arange(7)).all() and (vocabulary.find(words + np.uint64(1)) == -1).all()
    weights = np.random.default_rng(0).normal(size=(1 << language_model.FEATURE_BITS, language_model.CLASSES)).astype(np.float32)
    features = np.random.default_rng(1).integers(0, 1 << language_model.FEATURE_BITS, (20, language_model.FEATURES)).astype(np.int32)
    assert np.allclose(np.exp(language_model._log_softmax(weights, features)).sum(axis=1), 1, atol=1e-4)


def test_counting_words_takes_linear_time():
    """Words already counted are not sorted again for every piece: four times the pieces take about four times as long."""
    def seconds(pieces):
        batches = [pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{k}x{j}" for j in range(300)) + " The the"])], ["text"]) for k in range(pieces)]
        begin = time.process_time()
        parts = list(language_model._count_words(iter(batches)))
        spent = time.process_time() - begin
        rows = pa.Table.from_batches(parts).to_pandas()
        assert rows["word"].is_unique and Counter(rows["c"]) == {1: 300 * pieces, 2 * pieces: 1}
        return spent

    assert seconds(1200) < 9 * max(seconds(300), 0.1)


def test_counts_leave_in_parts(monkeypatch):
    monkeypatch.setattr(language_model, "FRESH_WORDS", 3, raising=False)
    texts = ["a b c d", "B c", None, "", "c d e f g h", "a"]
    batches = (pa.RecordBatch.from_arrays([pa.array([t], pa.string())], ["text"]) for t in texts)
    rows = [r for b in language_model._count_words(batches) for r in b.to_pylist()]
    assert sorted(r["c"] for r in rows) == [1, 1, 1, 1, 2, 2, 2, 3]
    assert list(language_model._count_words(iter([]))) == []


def test_stream_of_tokens_equals_its_definition():
    texts = ["the a of the b", None, "", "x", "of", "the", "a b c d e the the", " A\tB "]
    ((_, _, words, spelled, first),) = language_model.batch_words(pa.array(texts))
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    rank = np.array([{"the": 0, "of": 1}.get(w, -1) for t in tokens for w in t])
    class_of = language_model.END_CLASS + 1 + np.arange(1 << language_model.SPELLING_BITS) % 32
    classes, features, owner, is_end = language_model._stream(words, rank, spelled, first, class_of)

    def feature(key):
        return int(language_model.mix(np.array([key % 2**64], np.uint64))[0]) >> (64 - language_model.FEATURE_BITS)

    hashes, spellings, at = iter(words.tolist()), iter(spelled.tolist()), 0
    start, none = int(language_model._START), language_model.OWN_CLASSES + 1
    for d, t in enumerate(tokens):
        back, last = [start] * 3, none
        for w in [*t, None]:
            own = {"the": 0, "of": 1, None: language_model.END_CLASS}.get(w)
            spelling = None if w is None else next(spellings)
            if w is not None:
                padded = [*w.encode()[:2], *[0] * (2 - len(w))], [*w.encode()[::-1][:4], *[0] * (4 - len(w))]
                number = int.from_bytes(bytes(padded[0] + padded[1]), "big")
                assert spelling == int(language_model.mix(np.array([number + 1], np.uint64))[0]) >> (64 - language_model.SPELLING_BITS)
            keys = [
                back[0] * 0x9E3779B97F4A7C15 + 1, back[1] * 0xBF58476D1CE4E5B9 + 2, back[2] * 0x94D049BB133111EB + 3,
                back[0] * 0xD6E8FEB86659FD93 + back[1] * 0xA0761D6478BD642F + 4, last + (5 << 32), 6 << 32,
            ]
            assert (owner[at], is_end[at], classes[at]) == (d, w is None, class_of[spelling] if own is None else own)
            assert features[at].tolist() == [feature(k) for k in keys]
            if w is not None:
                back = [next(hashes), *back[:2]]
                last = last if own is None else own
            at += 1
    assert at == len(classes)


def test_parts_of_a_step_equal_their_definitions():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(1 << language_model.FEATURE_BITS, language_model.CLASSES)).astype(np.float32)
    features = rng.integers(0, 1 << language_model.FEATURE_BITS, (300, language_model.FEATURES)).astype(np.int32)
    features[:, 0] %= 150
    features[:, -1] = features[0, -1]
    classes = rng.integers(0, language_model.CLASSES, 300)
    logits = weights[features].astype(np.float64).sum(axis=1)
    logs = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(language_model._log_softmax(weights, features), logs, atol=1e-4)
    chance = language_model._log_chance(weights, features, classes)
    assert (chance == language_model._log_softmax(weights, features)[np.arange(300), classes]).all()
    slope = np.exp(logs).astype(np.float32)
    assert (language_model._highest(slope) == slope.max(axis=1, keepdims=True)).all()
    for k in range(language_model.FEATURES):
        keys, total = language_model._sums_by(features[:, k], slope)
        assert (keys == np.unique(features[:, k])).all()
        assert np.allclose(total, [slope[features[:, k] == x].astype(np.float64).sum(axis=0) for x in keys], rtol=1e-5)


def test_steps_count_by_sightings():
    """A task that saw a feature nine times as often moves it nine times as much, however often that is."""
    before = np.zeros((2, language_model.CLASSES), np.float32)
    parts = [language_model._weighted_steps(before, before + step, np.array([1, 1]) * seen) for step, seen in ((1.0, 900_000), (0.0, 100_000))]
    total = sum(x.astype(np.float64) for x in parts)
    assert np.allclose(total[:, :-1] / total[:, -1:], 0.9)
