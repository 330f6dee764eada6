"""op2 and op7: automata; op3: shards; op10: pages."""

import hashlib
import html as entities
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import decontam, html, license, shard
from tidewell.llm.queries import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(texts, items):
    windows = {}
    for i, t in items:
        w = low(t)
        for p in [w[j : j + 13] for j in range(len(w) - 12)] if len(w) >= 13 else [w] if w else []:
            windows.setdefault(tuple(p), set()).add(i)
    out = {}
    sizes = {len(p) for p in windows}
    for key, t in texts:
        w, hit, ids = low(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                found = windows.get(tuple(w[j : j + n]))
                if found:
                    hit |= set(range(j, j + n))
                    ids |= found
        out.setdefault(key, []).append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return {k: sorted(v) for k, v in out.items()}


def gathered(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
    return {k: sorted(v) for k, v in out.items()}


def test_decontamination(spark, docs, sf):
    items = table(spark, sf, "benchmark")
    expected = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert gathered(decontam.contract(docs, items).collect()) == expected
    assert sum(v[0][4] for v in expected.values()) > 0
    kept = {r.doc_id for r in decontam.decontaminate(docs, items).collect()}
    assert kept == {k for k, v in expected.items() if not v[0][4]}
    blocks = decontam.judged(decontam.scan(docs, items, block_bytes=2000)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), r.contaminated) for r in blocks} == {k: (v[0][0], v[0][1], v[0][2], v[0][4]) for k, v in expected.items()}
    assert {r.doc_id for r in decontam.decontaminate(docs, items, block_bytes=2000).collect()} == kept


def test_decontamination_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one TWO"), (2, "one two"), (3, None), (4, ""), (5, "all rights, reserved")], "item_id long, text string")
    expected = brute_hits([(r.doc_id, r.text) for r in odd_docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert gathered(decontam.contract(odd_docs, items).collect()) == expected
    assert decontam.contract(no_docs, items).count() == 0 and decontam.contract(odd_docs, items.where("false")).where("contaminated").count() == 0
    assert decontam.decontaminate(odd_docs, items).columns == odd_docs.columns


def test_rows_are_judged_one_by_one_in_any_number_of_blocks(spark):
    """Repeated and null ids, equal texts, and items without an id or a text."""
    bad, ok = " ".join(f"q{i}" for i in range(14)), " ".join(f"clean{i}" for i in range(30))
    rows = [(1, bad), (1, ok), (2, ok), (None, bad), (None, ok), (None, None), (3, bad + " " + ok), (3, bad + " " + ok), (4, "other item words"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = [(1, bad), (None, "Other item WORDS"), (7, "x" * 3000), (8, None), (None, None), (1, "other item words here not there")] + [(100 + i, f"filler {i} words") for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(((k, t) for k, t in rows if t not in (bad, bad + " " + ok, "other item words")), key=str)
    for block_bytes in (8_000_000, 900, 60):
        kept = sorted(((r.doc_id, r.text) for r in decontam.decontaminate(docs, benchmark, block_bytes=block_bytes).collect()), key=str)
        assert kept == expected, block_bytes
        got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), list(r.offsets)) for r in decontam.scan(docs, benchmark, block_bytes=block_bytes).collect()), key=str)
        one = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), list(r.offsets)) for r in decontam.scan(docs, benchmark).collect()), key=str)
        assert got == one and len(got) == len(rows)
    assert (4, 3, 3, [], []) in one  # an item without an id hits words but isn't named


def test_offsets_are_of_the_original(spark):
    docs = spark.createDataFrame([(1, "É! One,  two?")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two")], "item_id long, text string")
    r = decontam.scan(docs, items).first()
    first, after = map(int, r.offsets[0].split(":")[0].split("-"))
    assert "É! One,  two?".encode()[first:after] == b"One,  two" and r.offsets[0].endswith(":7")


def brute_labels(text):
    w, starts, labels = low(text), [], set()
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        for j in range(len(w) - len(p) + 1):
            if w[j : j + len(p)] == p:
                starts.append(j)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        expected = sorted([(r.doc_id, *brute_labels(r.text)) for r in df.collect()], key=repr)
        got = license.contract(df).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=repr) == expected
        for r in got:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license.contract(no_docs).count() == 0


def test_license_expressions():
    p = license.PERMISSION
    assert license.evaluate("MIT OR (Apache-2.0 AND GPL-2.0-only)")[0] == p["mit"]
    assert license.evaluate("MIT AND Apache-2.0 OR GPL-3.0+")[0] == p["apache"]
    assert license.evaluate("GPL-2.0-only WITH Classpath-exception-2.0 extra words")[0] == p["gpl"] + (1 - p["gpl"]) / 4
    assert license.evaluate("(MIT OR") == (None, []) and license.evaluate("") == (None, []) and license.evaluate("MIT) x")[1] == ["mit"]
    assert license.judge(b"// SPDX-License-Identifier: (mit or lgpl-2.1)\ncode")[3] == ["lgpl", "mit"]
    assert license.judge(b"lesser general public license")[3] == ["gpl", "lgpl"] and license.judge(b"")[4] == 0.5


def test_nested_notices_of_any_number():
    p = license.PERMISSION
    for n in (1, 99, 100, 1000):
        assert license.judge(b"lesser general public license. " * n)[4] == p["lgpl"]
    assert license.judge(b"lesser general public license. " * 150 + b"general public license")[4] == p["gpl"]
    spans = [((i * 37) % 50, (i * 37) % 50 + 1 + i * i % 7, "gpl") for i in range(300)]
    longer = [s for s in spans if not any(o[0] <= s[0] and s[1] <= o[1] and o[1] - o[0] > s[1] - s[0] for o in spans)]
    assert sorted(license.outermost(spans)) == sorted(longer)


def test_license_tags_in_any_case_and_place():
    for tag in ("SPDX-License-Identifier: MIT", "sPdX-LICENSE-identifier:MIT", "\ufeffSPDX-License-Identifier: MIT", "xSPDX-License-Identifier:\tMIT\r\n", "a license identifier. SPDX-License-Identifier: MIT"):
        assert license.judge(tag.encode())[3:] == (["mit"], 0.95), tag
    for other in ("license-identifier: MIT", "SPDX License Identifier: MIT", "SPDX-License-Identifier MIT", "SPDX-License-\nIdentifier: MIT"):
        assert license.judge(other.encode())[3:] == ([], 0.5), other
    assert license.judge(b"SPDX-License-Identifier: MIT // SPDX-License-Identifier: GPL-2.0-only")[3:] == (["gpl", "mit"], 0.5)


def brute_capacity(sizes, shards):
    def need(c):
        n, a = 1, 0
        for s in sizes:
            if a + s > c:
                n, a = n + 1, 0
            a += s
        return n

    low_, high = max(sizes) - 1, sum(sizes)
    while high - low_ > 1:
        m = (low_ + high) // 2
        low_, high = (low_, m) if need(m) <= shards else (m, high)
    return high


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards(docs, odd_docs, shards):
    for df in (docs, odd_docs):
        got = shard.assign(df, shards).collect()
        size, by, slots, shard_of = {}, {}, {}, {}
        for r in got:
            size[r.group] = size.get(r.group, 0) + r.size
            by[r.shard] = by.get(r.shard, 0) + r.size
            slots.setdefault(r.shard, []).append(r.slot)
            assert shard_of.setdefault(r.group, r.shard) == r.shard
        order = sorted(size)
        assert max(by.values()) == brute_capacity([size[g] for g in order], shards)
        assert [shard_of[g] for g in order] == sorted(shard_of.values()) and set(by) <= set(range(shards))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == df.count()
        text = {}
        for r in df.collect():
            raw = (r.text or "").encode()
            text.setdefault(r.doc_id, set()).add((len(raw) + 1, zlib.crc32(raw)))
        assert all((r["size"], r.text_crc32) in text[r.doc_id] for r in got)


def test_shards_of_nothing(no_docs):
    assert shard.contract(no_docs).count() == 0


@pytest.mark.parametrize("marks", [60, 200])
def test_few_marks_find_the_same_capacity(spark, marks):
    sizes = [1 + (i * 7919) % 997 for i in range(900)]
    groups = spark.createDataFrame(list(enumerate(sizes)), "i long, size long")
    sums = shard.running(groups, ["i"], ["size"]).cache()
    capacity, ends = shard.minimax(sums, "size_end", 5, max(sizes), marks=marks)
    assert capacity == brute_capacity(sizes, 5) and ends[-1] == sum(sizes)


def test_sharding_is_native(docs):
    plan = shard.assign(docs, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_main_text_of_the_pages(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r.page_id: r.text for r in html.contract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"<p>|</p>|</h1>|<h1>", inner)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)


LONG = "A sentence, with commas, that is long enough to count as main text on a page of the web. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain words", "plain words"), ("<body><p>a&nbsp;b &lt;c&gt; &eacute;</p>", "a b <c> é"),
        (f"<div id=page><header><h1>Site</h1></header><div class='sidebar'>{LONG}</div><div><h1>T</h1><p>{LONG}<p>{LONG}<p>Short.</div><div class=comments><p>{LONG}{LONG}</div></div>", f"T\n\n{LONG.strip()}\n\n{LONG.strip()}\n\nShort."),
        (f"<main><section><h2>A</h2><p>{LONG}</p></section><section><h2>B</h2><p>{LONG}</p></section></main><footer>{LONG}</footer>", f"A\n\n{LONG.strip()}\n\nB\n\n{LONG.strip()}"),
        (f"<article><ul><li>one<li>two</ul><p>{LONG}<form><p>{LONG}</form><script>x='<p>{LONG}'</script><!-- {LONG} --><p hidden>{LONG}</article>", f"one\n\ntwo\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><p>cut <b>sho", f"{LONG.strip()}\n\ncut sho"), (f"<article><p>{LONG}</p><a hre", LONG.strip()), ("<div>" * 5000 + LONG, LONG.strip()),
    ],
)
def test_main_text_rules(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("name", ["content no-sidebar", "post-content has-sidebar", "article-body ad-free", "entry share-enabled", "related-content", "main-widget", "post social promo", "newsletter"])
def test_names_alone_drop_no_article(name):
    for start, end in (("<div>", "</div>"), ("", ""), ("<div><div>", "</div></div>")):
        page = f"<body><div id=nav><a href=/>Home</a></div>{start}<div class='{name}'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>{end}<p>Copyright line here.</p></body>"
        assert html.extract(page).startswith(f"T\n\n{LONG.strip()}\n\n{LONG.strip()}"), name


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "ad", "promo box", "related", "share", "comments", "comment-list", "newsletterSignup"])
def test_noise_beside_and_inside_the_article_goes(name):
    noise = f"<div class='{name}'><p>{LONG}{LONG}</p></div>"
    body = f"<h1>T</h1><p>{LONG}</p>" + f"<p>{LONG}</p>" * 3
    text = "\n\n".join(["T", *[LONG.strip()] * 4])
    assert html.extract(f"<div id=x>{body}{noise}</div>") == html.extract(f"<div>{body}</div>{noise}") == html.extract(f"<article>{body}{noise}</article>") == text
    comments = "".join(f"<div class='comment'><p>{LONG}{LONG}</p></div>" for _ in range(40))
    assert html.extract(f"<div id=x>{body}<div id=comments>{comments}</div></div>") == text


@pytest.mark.parametrize("page", ["<span>" * 8000 + "</b>" * 8000, "<div>" * 8000, "<b><div>" + "<span>" * 8000 + "</b>" * 8000, "</i>" * 50_000, "<p>" * 50_000, "<table>" + "<tr><td>" * 8000, "<a>" * 20_000, "<h1>" * 8000 + "</h2>" * 8000, "<div><span>" * 8000 + "</p>" * 8000])
def test_many_tags_take_linear_time(page):
    import time

    began = time.process_time()
    assert html.extract(page + LONG) == LONG.strip() and time.process_time() - began < 1


def test_main_text_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x", 2), (1, "u", "<p>x", 2)], "page_id long, url string, html string, k int")
    assert sorted(r.n_chars for r in html.contract(df).collect()) == [0, 1, 1] and html.contract(df.where("false")).count() == 0


ARTICLE = "".join(f"<p>Paragraph {i} of this text, with some words in it, and a few more of them to read.</p>" for i in range(5))
PLAIN = "\n\n".join(f"Paragraph {i} of this text, with some words in it, and a few more of them to read." for i in range(5))


@pytest.mark.parametrize(
    "page",
    [
        '<head><script>var s="<!--";</script></head><body><article>%s</article></body>', '<body><div title="<!--"><div>%s</div></div></body>', "<body><style>a:after{content:'<!--'}</style><main>%s</main>",
        '<body><form id="aspnetForm"><input name="q"><label>Search</label><div>%s</div></form></body>', "<form><div>%s</div><select><option>one</select><button>Go</button></form>", "<body><form><article>%s</article></form><div>short</div>",
        "<body><div>%s</div><form><p>Your address will not be published. Required fields are marked with a star, always.</p><label>Name</label></form>", "<div>%s</div><!-- never ends <p>gone</p>", "<div>%s</div><b never ends",
        '<div>%s<section class="user-responses"><p>First! I liked this one very much, thank you for writing it.</p></section></div>', "<div><!-->%s<!---></div>", "<div><!-- a > b -- c --!>%s</div>", '<div data-x="a>b" title=\'<p>\'>%s</div>', "<DIV CLASS=x>%s</DIV>",
        "<div><?php echo 1 ?>%s<![CDATA[x]]></div>", "<div>%s<textarea><p>no</p></textarea><iframe><p>no</p></iframe></div>", "<title><!-- </title><div>%s</div>",
    ],
)
def test_pages_keep_their_article(page):
    assert html.extract(page % ARTICLE) == PLAIN


@pytest.mark.parametrize("piece", ["<a", "<a ", '<a x="', "<!--", "<!", "</", "</a", "<?", "&#", "&#1", "<div>", "<p>", "<b><i>", "<form>", "<form>x</form>", "<ul><li>x", "</p>", "<a>", "<table><tr><td>", "<a x='\">'", "<script>", "<a =", "<x/ y"])
def test_any_bytes_take_linear_time(piece):
    import time

    def took(n):
        began = time.process_time()
        html.extract(piece * n)
        return time.process_time() - began

    n = 400_000 // len(piece)
    once = max(took(n // 4), 0.05)
    assert took(n) < 10 * once


def test_character_references():
    assert html.extract("<p>&lt;b&gt; &amp;amp; &#65;&#x42;&#0000000000067;&#99999999999999;&#x0000000000044; &nosuch; a&b " + "&#" + "1" * 5000 + ";" + "&#" + "0" * 5000 + "69;</p>") == "<b> &amp; ABC�D &nosuch; a&b �E"


def brute_tokens(page):
    """Text, start and end tags by walking character by character."""
    out, i, n = [], 0, len(page)
    space = "\t\n\f\r "

    def tag(i):
        name = ""
        while i < n and page[i] not in space + "/>":
            name += page[i]
            i += 1
        attrs = []
        while True:
            while i < n and page[i] in space + "/":
                i += 1
            if i >= n:
                return None
            if page[i] == ">":
                return name.lower(), attrs, i + 1
            key = page[i]
            i += 1
            while i < n and page[i] not in space + "/>=":
                key += page[i]
                i += 1
            j = i
            while j < n and page[j] in space:
                j += 1
            value = ""
            if j < n and page[j] == "=":
                i = j + 1
                while i < n and page[i] in space:
                    i += 1
                if i < n and page[i] in "\"'":
                    end = page.find(page[i], i + 1)
                    if end < 0:
                        return None
                    value, i = page[i + 1 : end], end + 1
                else:
                    while i < n and page[i] not in space + ">":
                        value += page[i]
                        i += 1
            attrs.append((key.lower(), value))

    def letter(i):
        return i < n and page[i].isascii() and page[i].isalpha()

    text = ""
    while i < n:
        found = None
        if page[i] == "<" and (letter(i + 1) or page[i + 1 : i + 2] == "/" and letter(i + 2)):
            start = letter(i + 1)
            found = tag(i + 1 if start else i + 2)
            out.append(text)
            text = ""
            if found is None:
                return out
            out.append(("start", *found[:2]) if start else ("end", found[0]))
            i = found[2]
        elif page[i] == "<" and page[i + 1 : i + 2] and page[i + 1] in "/!?":
            out.append(text)
            text = ""
            if page.startswith("<!--", i) and not page.startswith(("<!-->", "<!--->"), i):
                ends = [e + len(m) for m in ("-->", "--!>") if (e := page.find(m, i + 4)) >= 0]
                if not ends:
                    return out
                i = min(ends)
            else:
                end = page.find(">", i)
                if end < 0:
                    return out
                i = end + 1
        else:
            text += page[i]
            i += 1
    return [*out, text]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "/", "!", "--", "-", "?", "a", "B1", "=", '"', "'", " ", "\n", "x y", "é", "<b>", "</b>", "<!--", "-->"]), max_size=14).map("".join))
def test_tokens_are_those_of_a_plain_walk(page):
    got, text = [], ""
    for kind, value, attrs in html.tokens(page):
        if kind == "text":
            text += value
        else:
            got += [text, ("start", value, attrs) if kind == "start" else ("end", value)]
            text = ""
    expected = brute_tokens(page)
    flat = lambda x: [t for t in x if t != ""]

    def joined(x):
        out = []
        for t in flat(x):
            if isinstance(t, str) and out and isinstance(out[-1], str):
                out[-1] += t
            else:
                out.append(t)
        return out

    assert joined([*got, text]) == joined(expected)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=16), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 7))
def test_runs_are_all_windows(items, text, window):
    """Hit words, items and places of windows are those of all windows one by one, in texts of few words that repeat."""
    rows = [(k, " ".join(w).encode()) for k, w in enumerate(items)]
    found = decontam.Items(rows, window).find([w.encode() for w in text])
    hit = {i for a, n, _ in found for i in range(a, a + n)}
    expected, places = set(), set()
    for k, w in enumerate(items):
        size = min(window, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            for i in range(len(text) - size + 1):
                if text[i : i + size] == w[j : j + size]:
                    expected |= set(range(i, i + size))
                    places.add((2 * i, 2 * (i + size) - 1, k))
    assert hit == expected
    assert decontam.spans(" ".join(text).encode(), found, window) == sorted(places)


def test_a_long_passage_is_walked_once():
    import time

    text = " ".join(f"w{i % 5000}" for i in range(60_000)).encode()
    m = decontam.Items([(1, text), (2, text[: len(text) // 2])], 13)
    began = time.process_time()
    found = m.find(text.split())
    assert (0, 60_000, 1) in found and time.process_time() - began < 5


NOTICES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": ("mit", 0.95), "Redistribution and use in source and binary forms, with or without modification, are permitted": ("bsd", 0.95),
    "Licensed under the GNU GPL v3": ("gpl", 0.5), "Licensed under the GNU LGPL, version 2.1": ("lgpl", 0.6), "GPLv2 or later": ("gpl", 0.5), "AGPL v3": ("agpl", 0.4), "Licensed under the Apache Licence, Version 2.0": ("apache", 0.9),
    "you can redistribute it and/or modify\n it under the terms of the GNU Lesser General Public License": ("gpl,lgpl", 0.6), "Creative Commons Attribution-ShareAlike 4.0": ("cc-by,cc-by-sa,creative-commons", 0.6),
    "This is free and unencumbered software released into the public domain.": ("public-domain,unlicense", 1.0), "SPDX-License-Identifier: MIT OR GPL-2.0-only": ("gpl,mit", 0.95), "a gpl, a mit and an apache": ("", 0.5),
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": ("boost", 0.95),
}


@pytest.mark.parametrize("text", NOTICES)
def test_notices_of_common_licences(text):
    assert (",".join(license.judge(text.encode())[3]), license.judge(text.encode())[4]) == NOTICES[text]


def brute_judgement(text):
    """(labels, score) by looking for each phrase at each word, and for tags line by line."""
    w, spans = low(text), []
    for phrase, label in {**license.BASE, **license.PHRASES}.items():
        p = low(phrase)
        spans += [(j, j + len(p), label) for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
    labels = {s[2] for s in spans}
    scores = [license.PERMISSION[s[2]] for s in spans if not any(o[0] <= s[0] and s[1] <= o[1] and o[:2] != s[:2] for o in spans)]
    for line in re.split(r"[\r\n]", text or ""):
        for at in re.finditer("spdx-license-identifier:", line, re.I):
            value, more = license.evaluate(line[at.end() :].split("\n")[0])
            if value is not None:
                labels |= set(more)
                scores.append(value)
    return ",".join(sorted(labels)), min(scores, default=0.5)


def test_labels_and_scores_are_those_of_brute_force(spark, docs, odd_docs):
    phrases = [*license.BASE, *license.PHRASES, "SPDX-License-Identifier: MIT OR GPL-3.0", "spdx-license-identifier: (Apache-2.0 AND MIT) WITH x", "\n", "gnu", "license", "public", "creative", "some words"]
    import random

    r = random.Random(8)
    made = spark.createDataFrame([(k, " ".join(r.choice(phrases) if r.random() < 0.7 else r.choice(r.choice(phrases).split() or ["x"]) for _ in range(r.randrange(9)))) for k in range(400)], "doc_id long, text string")
    for df in (docs, odd_docs, made):
        expected = sorted([(r.doc_id, *brute_judgement(r.text)) for r in df.collect()], key=repr)
        assert sorted([(r.doc_id, r.labels, r.score) for r in license.contract(df).collect()], key=repr) == expected
