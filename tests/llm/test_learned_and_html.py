import itertools
import random

import numpy as np
import pytest

from meshlight.llm import decontaminate, html_extract, langid, toxicity


def sellers(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j - 1] + (a != b), row[j] + 1, now[j - 1] + 1))
        row = now
    return min(row)


def test_leaks_match_full_alignment():
    rng = random.Random(5)
    item = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    items = [(k, item(rng.randint(20, 120))) for k in range(8)]
    index = decontaminate.ItemIndex(items)
    for _ in range(60):
        k = rng.randrange(len(index.texts))
        t = bytearray(index.texts[k])
        for _ in range(rng.randint(0, int(index.edits[k]) + 4)):
            at = rng.randrange(len(t))
            kind = rng.random()
            if kind < 0.4:
                t[at] = ord(rng.choice("wxyz"))
            elif kind < 0.7:
                del t[at]
            else:
                t.insert(at, ord(rng.choice("wxyz")))
        text = decontaminate.folded(item(100)) + b" " + bytes(t) + b" " + decontaminate.folded(item(80))
        for j, own in enumerate(index.texts):
            want = sellers(own, text)
            got = [x for x in decontaminate.leaks_in(index, text, np.array([0])) if x[1] == j]
            assert bool(got) == (want <= index.edits[j])
            if got:
                assert got[0][4] == want and sellers(own, text[got[0][2] : got[0][2] + got[0][3]]) == want


def test_hits_in_parts_give_the_same_leaks(monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab" if rng.random() < 0.5 else "abc ") for _ in range(n))
    seen = 0
    for _ in range(40):
        items = [(i, word(rng.randint(1, 12)) * rng.randint(1, 8)) for i in range(6)]
        texts = ["", *(word(rng.randint(0, 20)) * rng.randint(1, 10) + rng.choice(items)[1] * rng.randint(1, 3) + word(9) for _ in range(4))]
        found = {}
        for most in (1 << 40, 0, 50, 700):
            monkeypatch.setattr(decontaminate, "MOST", most)
            found[most] = sorted(decontaminate.search(decontaminate.ItemIndex(items), list(range(len(texts))), texts))
        assert all(own == found[1 << 40] for own in found.values())
        seen += len(found[0])
    assert seen > 100


def test_one_pattern_throughout_a_long_text():
    text = "-=" * 200_000 + "=" * 300_000  # 22 million shared q-grams
    (leak,) = decontaminate.search(decontaminate.ItemIndex([(1, "=" * 80)]), [7], [text])
    assert leak[:2] == (7, 1) and leak[4] == 0 and text[leak[2] : leak[2] + leak[3]] == "=" * 80


def test_decontamination(spark, rows, docs, none):
    long_text = next(r[1] for r in rows if r[1] and len(r[1]) > 9000)
    passage = long_text[5000:5200]
    bench = spark.createDataFrame([(1, passage.upper()), (2, None), (3, ""), (4, "x"), (5, "nowhere in any of the texts at all, surely")], "item_id long, text string")
    want = {(r[0], i) for r in rows for i, t in ((1, passage), (4, "x")) if r[1] and (decontaminate.folded(t) in decontaminate.folded(r[1]) if i == 1 else decontaminate.folded(r[1]) == b"x")}
    for block_mb in (16, 0.0001):  # the second takes many blocks
        found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, block_mb=block_mb).collect()}
        assert found == want
        kept = decontaminate.decontaminate(docs, bench, block_mb=block_mb)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {i for i, _ in want}
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def stands_alone(item, text):
    """Whether the item stands in the text at word borders."""
    goes = lambda c: c >= 128 or chr(c).isalnum()
    for k in range(len(text) - len(item) + 1):
        end = k + len(item)
        if text[k:end] == item and not (k and goes(text[k - 1]) and goes(item[0])) and not (end < len(text) and goes(text[end]) and goes(item[-1])):
            return True
    return False


def test_items_of_any_length_keep_their_budget(spark):
    """The whole query against full alignment, items from one byte on, with edits up to one above the budget."""
    rng = random.Random(11)
    letters = "abcdefgh  \u00e9"
    items = [(k, "".join(rng.choice(letters) for _ in range(n))) for k, n in enumerate([*range(1, 13), 19, 20, 22, 29, 30, 31, 39, 40, 45, 60, 95])]
    items += [(90, "2+2=4?"), (91, "the quick brown fox ju"), (92, "   "), (93, None), (94, "ten")]
    docs = ["so 2+2=4? yes", "a the quack brown fix ju b", "a the quack brawn fix ju b", "often", "ten men", "", None]
    for _, item in items:
        t = list(item or "")
        for edits in range(len(t) // 10 + 2):
            docs.append(f"{''.join(rng.choice('xyz ') for _ in range(20))} {''.join(t)} {''.join(rng.choice('xyz') for _ in range(9))}")
            if t:
                t[rng.randrange(len(t))] = "w"
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    found = decontaminate.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for i, item in items:
        own = decontaminate.folded(item or "")
        k = len(own) // 10
        for d, text in enumerate(docs):
            whole = decontaminate.folded(text or "")
            if own and (sellers(own, whole) <= k if k else stands_alone(own, whole)):
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want) > 60
    for r in found:
        region = decontaminate.folded(docs[r.doc_id])[r.start_byte : r.start_byte + r.length_bytes]
        assert sellers(decontaminate.folded(dict(items)[r.item_id]), region) == r.edits


def test_segments_are_all_maximal():
    def brute(s, low, high):
        best = None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += s[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j + 1)
        return [] if best is None else brute(s, low, best[1]) + [best[1:]] + brute(s, best[2], high)

    rng = np.random.default_rng(0)
    for _ in range(200):
        s = np.round(rng.normal(-0.5, 2, rng.integers(0, 14)), 3) + rng.random() * 1e-4
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute(s, 0, len(s))


LANGS = {"en": ["th", "ing", "wh", "ed", "er"], "fr": ["eau", "oui", "que", "é", "on"], "de": ["sch", "ung", "ä", "keit", "en"]}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    out, marks = [], []
    for i in range(240):
        lang = rng.choice(list(LANGS))
        text, toxic = spoken(rng, lang, 60), rng.random() < 0.3
        if toxic:
            w = text.split()
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgle", "zorgling", "vexit"]))
            text = " ".join(w)
        out.append((i, text, lang))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame([*out, (1000, None, "en"), (1001, "", None), (1002, "123 !?", None), (1003, "½ ² Ⅷ", None)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([*marks, (5000, 1), (5001, None), (None, 1)], "doc_id long, toxic int")


def test_language(labelled, docs, none):
    own, _ = labelled
    found = langid.identify(own, langid.learn(own))
    rows = found.join(own.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.doc_id < 1000]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id >= 1000} == {("und", 0.0)}
    model = langid.learn(own)
    kept = langid.keep_identified(own.withColumn("score", own.doc_id), model, 0.4)
    assert {r.doc_id for r in kept.collect()} == set(range(240)) and kept.columns[-1] == "score"
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(none)).collect()} == {"und"}
    mixed = langid.Labeller(model).label([spoken(random.Random(1), "en", 30) + " " + spoken(random.Random(1), "fr", 12)])
    assert mixed[0][0] == "en" and mixed[0][3] >= 1 and mixed[0][1] < 0.9  # the switch shows


def test_forward_backward():
    rng = np.random.default_rng(0)
    for n in (1, 2, 4):
        e, t = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        marginal, pairs, z = np.zeros((n, 3)), np.zeros((3, 3)), 0.0
        for s in itertools.product(range(3), repeat=n):
            w = np.exp(sum(e[i, k] for i, k in enumerate(s)) + sum(t[i, j] for i, j in zip(s, s[1:])))
            z += w
            for i, k in enumerate(s):
                marginal[i, k] += w
            for i, j in zip(s, s[1:]):
                pairs[i, j] += w
        got, expected = langid.forward_backward(e, t, langid.packed(np.array([n])), pairs=True)
        assert np.allclose(got, marginal / z) and np.allclose(expected, pairs / z)


def test_toxicity(labelled, docs, none):
    own, labels = labelled
    found = toxicity.toxicity(own, labels).join(labels.filter("doc_id < 1000"), "doc_id", "left").collect()
    held = [r for r in found if r.held_out and r.toxic is not None]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in found)
    assert all((r.score >= 0.7) == bool(r.predicted) for r in found) and len(found) == 244
    unlearned = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(unlearned) == docs.count() and len({r.score for r in unlearned}) == 1
    assert toxicity.toxicity(none, labels).count() == 0


def test_common_lines():
    def length(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
        return d[-1, -1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in "xy")
        for got in (html_extract.common_lines(a, b), html_extract._common(a, b, most_bits=5)):
            rest = iter(b)
            assert len(got) == length(a, b) and got == sorted(set(got)) and all(x in rest for x in (a[i] for i in got))


def test_extract(spark):
    nav, foot = "<nav><a href=/>Home</a></nav>", "<footer>&copy; x</footer>"
    pages = [
        (1, "http://h.org/a/1", f"<html><head><title>T</title><style>p{{}}</style></head><body>{nav}<article><h1>One &amp;  two</h1><p>First<br>line<p>Second <b>bold</p><div class='comments'><p>hi</p></div></article>{foot}"),
        (2, "http://h.org/b/1", "<div>Shared line</div><div>Own words here</div><script>var a='</p>'</script><p class='ad'>Buy</p>"),
        (3, "http://h.org/b/2", "<div>Shared line</div><div>Other words here</div><!-- <p>no</p> -->"),
        (4, "http://solo.org/", "<p>Kept</p>&lt;tag&gt;"),
        (5, None, None),
        (6, "not a url", ""),
        (7, "http://[bad", "plain text"),
        (7, "http://[bad", "plain text"),
    ]
    frame = spark.createDataFrame([(*p, "h", b"k") for p in pages], "page_id long, url string, html string, host string, kinds binary").coalesce(1)
    found = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
    assert found == {1: "One & two\n\nFirst line\n\nSecond bold", 2: "Own words here", 3: "Other words here", 4: "Kept\n\n<tag>", 5: "", 6: "", 7: "plain text"}
    assert html_extract.extract(frame).count() == 8 and html_extract.extract(frame.limit(0)).count() == 0


def kept(page):
    return "|".join(t for k, t in html_extract.blocks(page) if k == html_extract.MAIN), "|".join(t for k, t in html_extract.blocks(page) if k == html_extract.OPEN)


@pytest.mark.parametrize(
    "page, main, open_",
    [
        ('<div class="page has-sidebar"><article>Text</article></div>', "Text", ""),
        ('<div class="sidebar-left"><article>Text</article></div>', "Text", ""),
        ('<div class="menu"><p>Home<article>Text</article>', "Text", ""),
        ('<nav>Home<article>Text</article>', "Text", ""),
        ('<article>Text<div class="comment-list"><article class="comment">Hi</article></div></article>', "Text", ""),
        ('<main>Text</main><aside><article>Teaser</article></aside>', "Text", ""),
        ('<article><p class="social-history">One<h2 class="share-prices">Two</h2><div class="share-buttons">Go</div></article>', "One|Two", ""),
        ('<article><header><h1>Head</h1></header><div class="article-header">Sub</div>Text</article>', "Head|Sub|Text", ""),
        ('<article>a <math><mi>x</mi></math> <canvas>c</canvas> <object>o</object></article>', "a x c o", ""),
        ('<div class="siteNav">Menu</div><div id="cookieBanner2">Yes</div><p>Open</p>', "", "Open"),
        ('<p style="display: none">No</p><p aria-hidden="true">No</p><p hidden>No</p><p>Open', "", "Open"),
    ],
)
def test_kinds_of_blocks(page, main, open_):
    assert kept(page) == (main, open_)


def brute_extract(pages):
    """Each page against its neighbours in the order of paths, with a plain table for the common lines."""
    def lcs(a, b):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                n[i][j] = n[i - 1][j - 1] + 1 if x == y else max(n[i - 1][j], n[i][j - 1])
        return n[-1][-1]

    found = {k: html_extract.blocks(h or "") for k, (_, _, h) in enumerate(pages)}
    places = {k: html_extract.place(u) for k, (_, u, _) in enumerate(pages)}
    out = []
    for k, (page_id, _, _) in enumerate(pages):
        own, (host, path) = found[k], places[k]
        paths = sorted({p for h, p in places.values() if h == host})
        at = paths.index(path)
        near = [p for p in (paths[at - 1] if at else None, paths[at + 1] if at + 1 < len(paths) else None) if p] if host else []
        near.sort(key=lambda p: -html_extract.prefix(p, path))  # stable: the one before stays first
        gone = []
        for other in near:
            first = min((j for j in places if places[j] == (host, other)), key=lambda j: pages[j][0])
            b = [t for _, t in found[first]]
            shared = html_extract.common_lines([t for _, t in own], b)
            assert len(shared) == lcs([t for _, t in own], b)
            gone = [i for i in shared if own[i][0] == html_extract.OPEN]
            if not gone or any(k == html_extract.MAIN or k == html_extract.OPEN and i not in gone for i, (k, _) in enumerate(own)):
                break
            gone = []
        out.append((page_id, "\n\n".join(t for i, (k, t) in enumerate(own) if k == html_extract.MAIN or k == html_extract.OPEN and i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_extract_against_brute_force(spark, partitions):
    rng = random.Random(4)
    shared = [f"Shared line {k}" for k in range(6)]
    pages = []
    for k in range(70):
        host = rng.choice(["a.org", "b.org", "hot.org", "hot.org"])
        path = "/hot/path" if k % 3 == 0 else f"/{rng.choice('xyz')}/{rng.randint(0, 30)}"
        lines = [rng.choice([rng.choice(shared), f"Own {rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 7))]
        body = "".join(f"<div>{t}</div>" for t in lines)
        if rng.random() < 0.3:
            body += f"<article>Article {k}</article>"
        pages.append((k, f"http://{host}{path}{rng.choice(['', '', '?page=2', '#top'])}", f"<nav>Menu</nav>{body}"))
    mirror = "<p>Same text</p><p>On two pages</p>"
    pages += [(100, "http://m.org/1", mirror), (101, "http://m.org/2", mirror), (102, None, mirror), (103, "http://m.org/9", None), (104, "http://k.org/1", mirror), (105, "http://k.org/2", mirror), (106, "http://k.org/3", mirror + "<p>More</p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(partitions)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for small_mb in (8, -1):  # broadcast, and joined
            got = html_extract.extract(frame, small_mb).collect()
            assert sorted((r.page_id, r.text) for r in got) == brute_extract(pages)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    text = {r.page_id: r.text for r in got}
    assert text[100] == text[101] == text[104] == "Same text\n\nOn two pages" and sum(r.n_removed for r in got) > 20
