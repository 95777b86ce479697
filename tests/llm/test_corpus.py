"""Quality, mixing, sharding, media, language model, pages and URLs on small tables with every odd case."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lanternlog.llm import lm, media, mixing, pages, quality, sharding, urls
from lanternlog.llm.queries import QUERIES


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts():
    text = "a b c a b c x\n\nsame line\nsame line\n # $$ end."
    n = dict(zip(quality.COUNTS, quality.text_counts(text), strict=True))
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    assert (n["n_words"], n["word_chars"], n["n_symbols"], n["n_dup_lines"], n["n_repeat_words"]) == (len(words), sum(map(len, words)), 3, 1, len(inside))
    assert quality.text_counts(None) == quality.text_counts(" \n") == (0,) * len(quality.COUNTS)


def test_quality_finds_rule_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.9])
    votes = np.where(rng.random((4000, 4)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random((4000, 4)) < 0.2] = 0
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, on_good, on_bad = quality.fit_votes(patterns, counts)
    q = quality.posterior(patterns, share, on_good, on_bad)[at.ravel()]
    assert ((q >= 0.5) == truth).mean() > 0.95 and abs(share - truth.mean()) < 0.05


def test_quality_on_odd_documents(docs, no_docs):
    rows = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert rows[0]._good and not rows[15]._good and rows[4]._counts.n_words == 0
    assert quality.judge(no_docs).count() == 0


def test_mixing(spark, docs, no_docs):
    rows, mixed = mixing.mix_sources(docs)
    got, taken = rows.collect(), Counter()
    for r in mixed.collect():
        taken[r.source] += r._size
    assert len(got) == docs.count()
    size = Counter()
    for r in got:
        size[r.source] += len(WORD.findall(r.text or ""))
        assert r._copies is None or len(r._copies) <= 2
    target = {r.source: r._target for r in got}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    left, rest = dict(weight), 1.5 * sum(size.values())
    expected = {}
    while True:  # fill by weight, stop full sources, share the excess again
        level = rest / sum(left.values())
        full = [s for s in left if level * left[s] > 2 * size[s] + 1e-9]
        if not full:
            expected |= {s: level * w for s, w in left.items()}
            break
        for s in full:
            expected[s] = 2.0 * size[s]
            rest -= expected[s]
            del left[s]
    assert target == pytest.approx(expected)
    again = Counter()
    for r in mixing.mix_sources(docs.repartition(5))[1].collect():
        again[r.source] += r._size
    assert again == taken
    assert mixing.mix_sources(no_docs)[1].count() == 0


def test_split_quotas_are_exact():
    counts = np.array([7, 0, 1000, 33, 1])
    q = mixing.split_quotas(counts, 16, np.random.default_rng(1))
    assert q.shape == (16, 5) and (q.sum(0) == counts).all() and (q >= 0).all() and q.sum(1).max() - q.sum(1).min() <= 1


def test_sharding(docs, no_docs):
    for n in (1, 2, 5, 64, 1000, 4097):
        p = sharding.permute(np.arange(n), n, 3)
        assert sorted(p) == list(range(n)) and (sharding.permute(p, n, 3, back=True) == np.arange(n)).all()
    rows = sharding.feistel_shards(docs.select("doc_id", "text"), ["doc_id", "text"], 4).collect()
    by = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in by.items())
    again = sharding.feistel_shards(docs.select("doc_id", "text").repartition(7), ["doc_id", "text"], 4).collect()
    assert Counter(tuple(r) for r in rows) == Counter(tuple(r) for r in again)
    assert sharding.feistel_shards(no_docs.select("doc_id"), ["doc_id"], 4).count() == 0


def test_media_round_trip_and_damage():
    for n in (0, 1, 64, 1021, 1022, 5000, 100_000):
        payload = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)) if n else b""
        data = media.encode(payload)
        got = media.parse(data)
        assert got["payload"] == payload and got["payload_intact"] and got["bad_checksums"] == got["skipped_bytes"] == 0
        assert got["table_frames"] == got["frames"] and got["samples"] == 1152 * got["frames"]
        assert all(media.header(data, at) for at in got["offsets"])
    data = bytearray(media.encode(b"\xff\xfa" * 3000))
    whole = media.parse(bytes(data))
    at = whole["offsets"][2]
    data[at] = 0  # a lost header: resumes at the next frame
    got = media.parse(bytes(data))
    assert got["frames"] == whole["frames"] - 1 and got["skipped_bytes"] > 0 and not got["payload_intact"]
    data[at] = 0xFF
    data[at + 8] ^= 1  # side information no longer fits its checksum
    assert media.parse(bytes(data))["bad_checksums"] == 1
    assert media.parse(None)["frames"] == media.parse(b"noise")["frames"] == 0


def test_media_tables_and_layers():
    import struct

    data = media.encode(b"x" * 9000)
    got = media.parse(data)
    frames = got["offsets"]
    assert got["table_kind"] == "xing" and got["table_frames"] == len(frames) and got["seconds"] == got["samples"] / got["sample_rate"]
    start = media.tags(data)[0]
    assert got["table_bytes"] == len(data) - start and len(got["table_seek"]) == 100
    assert all(abs(start + m - frames[min(len(frames) - 1, i * len(frames) // 100)]) <= got["table_bytes"] / 256 + 1 for i, m in enumerate(got["table_seek"]))
    # A table of the other kind, in the first frame's body: frames, bytes and sizes of the stretches between seek points.
    size = media.header(data, start)[4]
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 7777, 42, 3, 2, 2, 1) + struct.pack(">HHH", 100, 50, 25)
    vbri = data[: start + 6] + bytes(30) + table + bytes(size - 36 - len(table)) + data[start + size :]
    other = media.parse(vbri)
    assert (other["table_kind"], other["table_frames"], other["table_bytes"], other["table_seek"]) == ("vbri", 42, 7777, [0, 200, 300]) and other["frames"] == got["frames"]
    # Layer I, whose checksum covers the bit allocation: plain stereo, joint stereo and mono.
    for mode, covered in ((0x00, 32), (0x50, (32 + 8) // 2), (0xC0, 16)):
        head = bytes((0xFF, 0xFE, 0x40, mode))
        n = media.header(head + bytes(200), 0)[4]
        body = bytes(range(n - 6))
        frame = head + media.crc16(head[2:] + body[:covered]).to_bytes(2, "big") + body
        good = media.parse(frame * 3)
        assert (good["layer"], good["frames"], good["checked_frames"], good["bad_checksums"], good["samples"]) == (1, 3, 3, 0, 3 * 384)
        wrong = bytearray(frame * 3)
        wrong[6 + covered - 1] ^= 1
        wrong[n + 6 + covered] ^= 1  # beyond what is covered
        assert media.parse(bytes(wrong))["bad_checksums"] == 1


def test_language_model(docs, no_docs):
    rows = lm.score_documents(docs).collect()
    tokens = [([*WORD.findall((r.text or "").translate({c: c + 32 for c in range(65, 91)})), "\n"], zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7 == 2) for r in docs.collect()]
    counts = Counter(w for ws, held in tokens if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((len(ws), held, sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for ws, held in tokens)
    assert sorted((r.n_tokens, r.held_out, r.n_known, round(r.base_score, 4)) for r in rows) == expected
    assert all(r.train_tokens == n and r.score < 0 for r in rows)
    assert lm.score_documents(no_docs).count() == 0


def test_language_model_without_training_rows(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    rows = lm.score_documents(spark.createDataFrame([(i, "some words here") for i in held], "doc_id long, text string")).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    assert all(math.isfinite(r.score) for r in rows) and len({r.score for r in rows}) == 1


def test_language_model_ignores_the_layout_and_beats_counts(spark):
    rng = np.random.default_rng(5)
    nouns, verbs = [f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    texts = [" ".join(w for _ in range(40) for w in ("the", str(rng.choice(nouns)), str(rng.choice(verbs)))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    first = {r.doc_id: r for r in lm.score_documents(df.repartition(2)).collect()}
    again = {r.doc_id: r for r in lm.score_documents(df.repartition(5)).collect()}
    assert all(first[i].score == pytest.approx(again[i].score, rel=1e-4) for i in first)
    held = [r for r in first.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_frequent_words_keep_ties_together(spark):
    counts = spark.createDataFrame([(f"w{i}", c) for i, c in enumerate([5000, 4000, 9, 9, 9, 2, 2, 1])] + [(lm.END, 7)], "word string, c long")
    assert sorted(r.c for r in lm.frequent_words(counts, 6)) == [9, 9, 9, 4000, 5000]
    assert len(lm.frequent_words(counts, 4)) == 2 and lm.frequent_words(counts.limit(0), 4) == []


def test_words_come_in_columns_and_sums(spark, monkeypatch):
    """A whole column's words, cut and lowered as bytes are; a task's counts are added up before they are shuffled."""
    texts = [None, "", " ", " A\tb\x0bC\x0cd\re\nf ", "É É\xa0x\x85y\x1cz\u2003w", "one  two\n\n one", "ÀB İ ſ K"]
    words, sizes = lm.words_of(pa.array(texts))
    expected = [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]
    assert words.to_pylist() == [w for ws in expected for w in ws] and sizes.tolist() == [len(ws) for ws in expected]
    counts = Counter(w for ws in expected for w in ws) + Counter({lm.END: len(texts)})
    df = spark.createDataFrame([(t,) for t in texts * 50], "text string")
    for counted, summed in ((lm.COUNTED, lm.SUMMED), (4, 9), (4, 2)):
        monkeypatch.setattr(lm, "COUNTED", counted)
        monkeypatch.setattr(lm, "SUMMED", summed)
        assert {r.word: r.c for r in lm.count_words(df, "text").collect()} == {w: 50 * c for w, c in counts.items()}


def test_language_model_gradients_are_those_of_the_likelihood():
    """A step changes each weight by its gradient's sign at first, which small differences of the likelihood show; a lane ends early."""
    rng = np.random.default_rng(2)
    words, targets = rng.integers(0, lm.NET_WORDS + 1, (6, 4)), rng.integers(0, lm.NET_WORDS + 1, (6, 4))
    live = np.ones((6, 4), bool)
    live[4:, 2] = False
    h = rng.standard_normal((4, lm.HIDDEN)).astype(np.float32) * 0.3
    net = lm.Net.start(np.arange(lm.NET_WORDS, 0, -1.0), 10.0)
    for v in net.p.values():
        v += rng.standard_normal(v.shape).astype(np.float32) * 0.3
    likelihood = lambda p: lm.Net(p).log_probs(lm.Net(p).hidden(words, h)[live], targets[live])[0].astype(float).sum()
    flat, at = net.flat(), 0
    speed = {k: np.zeros_like(v) for k, v in net.p.items()}
    net.learn(words, targets, live, h, speed)
    for k, v in speed.items():
        size = np.sqrt(v.ravel()) * (lm.WINDOW * lm.LANES / lm.SCALE)  # the gradient's size, as nothing is clipped here
        for i in np.argsort(-size)[:3]:
            up, down = flat.copy(), flat.copy()
            up[at + i] += 0.01
            down[at + i] -= 0.01
            assert abs(likelihood(up) - likelihood(down)) / 0.02 == pytest.approx(float(size[i]), rel=0.05), (k, i)
        at += v.size


def test_language_model_gradients_and_sums():
    net = lm.Net.start(np.arange(lm.NET_WORDS, 0, -1.0), 10.0)
    rng = np.random.default_rng(1)
    words, targets = rng.integers(0, lm.NET_WORDS + 1, (5, 3)), rng.integers(0, lm.NET_WORDS + 1, (5, 3))
    h = net.hidden(words, np.zeros((3, lm.HIDDEN), np.float32)).reshape(-1, lm.HIDDEN)
    one = np.repeat(h[:1], lm.NET_WORDS + 1, axis=0)
    assert abs(np.exp(net.log_probs(one, np.arange(lm.NET_WORDS + 1))[0]).sum() - 1) < 1e-3  # all words together
    text = rng.integers(0, lm.NET_WORDS + 1, 100)
    whole = lm.score_texts(net, [text, text[:7]])
    steps = net.hidden(np.concatenate([[0], text[:-1]])[:, None], np.zeros((1, lm.HIDDEN), np.float32))[:, 0]
    assert whole[0] == pytest.approx(float(net.log_probs(steps, text)[0].sum()), rel=1e-4)  # windows carry the state
    before = net.log_probs(h, targets.ravel())[0].sum()
    speed = {k: np.zeros_like(v) for k, v in net.p.items()}
    for _ in range(20):
        net.learn(words, targets, np.ones((5, 3), bool), np.zeros((3, lm.HIDDEN), np.float32), speed)
    after = net.log_probs(net.hidden(words, np.zeros((3, lm.HIDDEN), np.float32)).reshape(-1, lm.HIDDEN), targets.ravel())[0].sum()
    assert after > before + 5


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One <b>two<br>three<p>Four &lt;</article><footer>&copy; x"


def test_page_lines():
    kept = [t for t, s in pages.page_lines(PAGE) if s == pages.CONTENT]
    assert kept == ["A & B", "One two three", "Four <"]
    assert pages.page_lines(None) == pages.page_lines("") == []
    a, b = [1, 2, 3, 4, 5, 3], [2, 9, 3, 5, 3, 8]
    assert [a[i] for i in pages.common_lines(a, b)] == [2, 3, 5, 3]


def test_broken_and_odd_markup():
    content = lambda html: [t for t, s in pages.page_lines(html) if s == pages.CONTENT]
    assert content("<article><p data-x=don't>One</p><p>Two</p></article>") == ["One", "Two"]
    assert content("<article><p title='a > b' class=x>One</p><p title=\"it's\">Two") == ["One", "Two"]
    assert content("<article><div class='related-work'>A</div><p id='comment-period'>B</p><b class='share-price'>C</b></article>") == ["A", "B", "C"]
    assert content("<article><p>A</p><div class='share-buttons'>x</div><section id=comments><p>y</p></section><ul class='related posts'><li>z</ul></article>") == ["A"]
    assert content("<article><p>A" + " b" * 200_000) == ["A" + " b" * 200_000]
    assert content("<article><p>1 < 2 <p>&amp;amp; &#x41;&nbsp;&nbsp;x</") == ["1 < 2", "&amp; A x"]


def test_common_lines_are_longest_and_bounded(monkeypatch):
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = np.random.default_rng(3)
    for most in (1 << 26, 40):
        monkeypatch.setattr(pages, "MOST_BITS", most)
        for _ in range(150):
            a, b = rng.integers(0, 6, rng.integers(0, 40)).tolist(), rng.integers(0, 6, rng.integers(0, 40)).tolist()
            got = pages.common_lines(a, b)
            places = iter(b)
            assert len(got) == longest(a, b) and got == sorted(set(got)) and all(any(y == a[i] for y in places) for i in got)


def test_copies_do_not_delete_each_other(spark):
    page = lambda own, extra="": f"<body><div>Welcome to the site</div><p>{own}</p><div>Contact us</div>{extra}</body>"
    long = "a long article that was published twice under neighbouring addresses of the same host and says the same each time " * 3
    rows = [(1, "http://h/a/1?x=1", page(long)), (2, "https://h/a/1?x=2", page(long)), (3, "http://h/a/2", page(long, "<i>again</i>")), (4, "http://h/a/9", page("other"))]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] and long.strip() in got[1] and long.strip() in got[3] and got[4] == "other"


def test_names_tell_by_what_a_thing_is():
    gone = "site-footer page-header post-comments entry-comments user-comments commentSection cookieConsent google-ad ad-300x250 ad-slot global-nav share-tools site-notice related-posts related-articles teaser comment-body SITE_FOOTER sidebar".split()
    kept = "related-work share-price has-sidebar no-comments entry-header article-header header ad-hoc commentary navy footerless menu-engineering content main-text author post-123 js-nav 300x250 a".split()
    text = lambda body: [t for t, s in pages.page_lines(f"<body><article><p>one</p>{body}<p>two</p></article></body>") if s == pages.CONTENT]
    for name in gone:
        assert text(f'<div class="x {name}"><p>in</p></div>') == ["one", "two"], name
    for name in kept:
        assert text(f'<div class="x {name}"><p>in</p></div>') == ["one", "in", "two"], name
    for attrs in ("hidden", "hidden=''", "HIDDEN=until-found", 'style="color:red; display : none"', "class=a hidden id=b", "style='visibility:hidden'"):
        assert text(f"<div {attrs}><p>in</p></div>") == ["one", "two"], attrs
    for attrs in ("data-hidden=1", 'title="hidden away"', 'style="display:block"', "class=hiddenly", "title='a > hidden'"):
        assert text(f"<div {attrs}><p>in</p></div>") == ["one", "in", "two"], attrs
    two = "<main><article><p>Story</p></article><article class='teaser'><p>Other story</p></article><article class='comment'><p>Nice</p></article></main>"
    assert [t for t, s in pages.page_lines(two) if s == pages.CONTENT] == ["Story"]


def test_pages_without_article_lose_shared_lines(spark):
    page = lambda own: f"<body><div>Welcome to the site</div><p>{own}</p><div>Contact us</div></body>"
    rows = [(1, "http://h/a/1", page("first"), "x"), (2, "http://h/a/2", page("second"), "x"), (3, "http://g/a/1", page("third"), "x"), (4, None, None, "x"), (5, "bad", "", "x"), (1, "http://h/a/1", page("first"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, lines string")
    got = sorted((r.page_id, r.text) for r in pages.extract_pages(df).collect())
    alone = "Welcome to the site\n\nthird\n\nContact us"
    assert got == [(1, "first"), (1, "first"), (2, "second"), (3, alone), (4, ""), (5, "")]
    assert pages.extract_pages(df.limit(0)).count() == 0


def test_urls(spark):
    cases = ["http://Sub.Example.NET/en/1", "http://example.net/fr/1", "http://x.example.com/de/9?a#b", "http://a.org/fr/2", "http://a.org/de/2", "http://a.org", None, "no scheme", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, template string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got[0] == ("sub.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/fr/1", "net/", "block")
    assert got[2] == ("x.example.com", "/de/9", "example.com/de/", "block")
    assert got[3] == ("a.org", "/fr/2", "org/fr/", "allow")
    assert got[5][:3] == ("a.org", "", None) and got[6] == got[7] == ("", "", None, "allow")
    assert got[8][:2] == ("b:", "//c/d")
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_url_templates_block_what_is_labelled_bad(spark):
    rows = [("h", f"/shop/{i}.html", "block" if i < 20 else None) for i in range(40)] + [("h", f"/news/{i}", "allow" if i < 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "host string, path string, label string")
    got = {r.path: (r.template, r.template_verdict) for r in urls.judge_templates(df).collect()}
    assert got["/shop/33.html"] == ("/shop/*.html", "block") and got["/news/33"] == ("/news/*", "allow")


def plain_tree(rows):
    """The template tree in plain Python: (host, path, label) -> {(host, path): (template, purity, verdict)}."""
    wild = lambda x: "*" + (re.search(r"\.[A-Za-z]{1,5}$", x) or [""])[0]
    paths = {}
    for h, p, label in rows:
        n = paths.setdefault((h, p), [0, 0, 0])
        n[0] += 1
        n[1] += label == "block"
        n[2] += label == "allow"
    made = {k: [] for k in paths}
    segs = {k: [x for x in k[1].split("/") if x] for k in paths}
    for d in range(max(map(len, segs.values()))):
        child, parent = Counter(), Counter()
        for k, s in segs.items():
            if len(s) > d:
                child[k[0], tuple(made[k]), s[d]] += paths[k][0]
                parent[k[0], tuple(made[k])] += paths[k][0]
        new = {}
        for k, s in segs.items():
            if len(s) > d:
                n, whole = child[k[0], tuple(made[k]), s[d]], parent[k[0], tuple(made[k])]
                new[k] = [*made[k], s[d] if n >= urls.LEAST_COUNT and n >= urls.LEAST_SHARE * whole else wild(s[d])]
        made |= new
    template = {k: "".join("/" + x for x in made[k]) + ("/" if k[1].endswith("/") else "") for k in paths}
    nodes = {}
    for k, t in template.items():
        at = nodes.setdefault((k[0], t), [0, 0, 0])
        for i in range(3):
            at[i] += paths[k][i]
    parts = {k: k[1].split("/") for k in nodes}
    changed = True
    while changed:
        changed = False
        for i in range(max(map(len, parts.values())) - 1, 0, -1):
            groups = {}
            for k, p in parts.items():
                if len(p) > i and p[i] and not p[i].startswith("*"):
                    shape = re.sub("[0-9]+", "0", re.sub(r"[^\W\d_]+", "a", p[i]))
                    groups.setdefault((k[0], tuple(p[:i]), shape), {}).setdefault(p[i], []).append((tuple(p[i + 1 :]), nodes[k]))
            for (h, up, shape), branches in groups.items():
                told = {}
                for seg, cells in branches.items():
                    own = Counter()
                    for r, n in cells:
                        own[r] += n[0]
                    told[seg] = (sum(n[1] + n[2] for _, n in cells), sum(own.values()), sum(n[1] for _, n in cells), own)
                lead = max(told, key=lambda s: (*told[s][:2], s))
                m0, n0, b0, own0 = told[lead]
                alike = [lead]
                for seg, (m, size, b, own) in told.items():
                    if seg == lead:
                        continue
                    pooled, whole = own + own0, size + n0
                    chi = sum((x[r] - k * pooled[r] / whole) ** 2 / (k * pooled[r] / whole) for x, k in ((own, size), (own0, n0)) for r in pooled)
                    free, share = len(pooled) - 1, (b + b0 + urls.PRIOR_LABELS * (1 - urls.PRIOR)) / (m + m0 + urls.PRIOR_LABELS)
                    fits = not free or chi <= free * (1 - 2 / (9 * free) + urls.ALIKE * math.sqrt(2 / (9 * free))) ** 3
                    if fits and (not m or abs(b - m * share) < urls.ALIKE * math.sqrt(m * share * (1 - share))):
                        alike.append(seg)
                if len(alike) > 1:
                    changed = True
                    for k, p in parts.items():
                        if k[0] == h and len(p) > i and tuple(p[:i]) == up and p[i] in alike:
                            p[i] = wild(p[i])
    sums = {}
    for k, p in parts.items():
        at = sums.setdefault((k[0], "/".join(p)), [0, 0, 0])
        for i in range(3):
            at[i] += nodes[k][i]
    out = {}
    for k, t in template.items():
        node = "/".join(parts[k[0], t])
        n, b, g = sums[k[0], node]
        purity = (g + urls.PRIOR * urls.PRIOR_LABELS) / (g + b + urls.PRIOR_LABELS)
        out[k] = (node, round(purity, 9), "block" if purity < urls.LEAST_PURITY and b >= urls.LEAST_BAD * n else "allow")
    return out


def test_url_tree_equals_plain_python_and_blocks_unlabelled_pages(spark):
    rng = np.random.default_rng(11)
    rows = []
    for h in ("a", "b", "c"):
        for _ in range(250):
            lang = str(rng.choice(["de", "en", "fr", "es"]))
            path = f"/{lang}/{rng.integers(1000)}" + str(rng.choice(["", ".html", "/"]))
            rows.append((h, path, "block" if lang == "de" and h != "c" else "allow" if lang == "fr" and h == "b" else None))
        rows += [(h, f"/x/{k}/y/{k}/z/{rng.integers(3)}/{rng.integers(99)}.php", "block" if k == "q" else None) for k in ("q", "r", "q2") for _ in range(30)]
        rows += [(h, "/one/" + "/".join(map(str, range(40))), None), (h, "", None), (h, "/", None), (h, "//p///q", "allow"), (h, "/p/q", None)]
    got = {(r.host, r.path): (r.template, round(r.purity, 9), r.template_verdict) for r in urls.judge_templates(spark.createDataFrame(rows, "host string, path string, label string")).collect()}
    assert got == plain_tree(rows)
    unlabelled = {(h, p) for h, p, x in rows if x is None} - {(h, p) for h, p, x in rows if x}
    assert sum(got[k][2] == "block" for k in unlabelled if k[0] == "a" and k[1].startswith("/en/")) > 20  # each template of /*/ by its own labels
    assert {got[k][2] for k in unlabelled if k[0] == "c" and k[1].startswith("/en/")} == {"allow"}


def test_url_tree_broadcasts_what_does_not_grow_with_the_paths(spark, monkeypatch):
    rows = [(i, f"http://h{i % 9}.org/{'de' if i % 3 else 'en'}/{i}{'/x' * (i % 7 == 0)}") for i in range(1000)] + [(1000, "http://one.com/a/b/c")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    settle, broadcast, plans, sent = urls.settle, urls.F.broadcast, [], []
    monkeypatch.setattr(urls, "settle", lambda df: plans.append(plan(df)) or settle(df))
    monkeypatch.setattr(urls.F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    fits = urls.filter_urls(df)
    assert 0 < max(sent) < 100  # templates, not paths
    plans.clear()
    monkeypatch.setattr(urls, "MOST_BROADCAST", -1)
    shuffled = urls.filter_urls(df)
    assert not [p for p in [*plans, plan(shuffled)] if "Broadcast" in p]
    got = sorted(map(str, shuffled.collect()))
    assert len(got) == 1001 and got == sorted(map(str, fits.collect()))


def test_queries_hold_their_contracts(spark, docs, tmp_path):
    docs.where("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    folder, text = str(tmp_path), {r.doc_id: r.text or "" for r in docs.collect()}
    for r in QUERIES["op8_mpeg_audio"](spark, folder).collect():
        raw = text[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    for r in QUERIES["op9_feistel_shards"](spark, folder).collect():
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    for r in QUERIES["op2_weak_supervision"](spark, folder).collect():
        n = len(WORD.findall(text[r.doc_id]))
        assert r.n_words == n and r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n) and not (r.base_failed and r.kept)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as cp

    docs.select(*cp.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path)).collect()
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    fit = {i for i, r in judged.items() if r._good and not (r._counts.n_words < 50 or 100 * r._counts.n_repeat_words > 50 * r._counts.n_words)}
    from .test_neardup import groups, plain_set
    from .test_tokens import library

    texts = {}
    for r in docs.collect():
        if r.doc_id in fit and r.doc_id is not None:
            texts[r.doc_id] = r
    sets = {i: plain_set(r.text) for i, r in texts.items()}
    root = groups([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], sets)
    left = [tuple(r[c] for c in cp.COLUMNS) for i, r in texts.items() if root[i] == i]
    lone = [tuple(r[c] for c in cp.COLUMNS) for r in docs.collect() if r.doc_id is None and None in fit and not any(100 * len(plain_set(r.text) & s) >= 75 * len(plain_set(r.text) | s) for s in sets.values())]
    mixed = mixing.mix_sources(spark.createDataFrame(left + lone, "doc_id long, text string, lang string, source string, n_chars long"))[1].collect()
    lib = library()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in mixed:
        ids = lib.encode_ordinary(r.text)
        want[r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r.text.encode())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want and want
