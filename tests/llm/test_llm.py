"""The llm operators against brute force, on small hand-made tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import html
import math
import os
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from metaloom.llm import bpe, common, exact_dedup, fingerprints, html_text, jaccard_join, licenses, lm_score, packing, quality, warc
from pyspark.sql import functions as F

BASE = " ".join(f"w{i % 97}x{i}" for i in range(120))
EDIT = BASE.replace("w5x5 ", "other ")
TEXTS = [
    (1, BASE), (2, EDIT), (3, BASE.upper()), (4, BASE.replace(" ", "\t\n")), (5, None), (6, ""), (7, "one two"), (8, "One  two"), (9, "one two three"), (10, "ab " * 400), (11, "ab " * 400 + "end"),
    (12, "é" * 3000 + " ñandú 日本語 " * 20), (13, "".join(chr(97 + i % 26) for i in range(2500))), (14, " ".join(f"u{i}" for i in range(3000))), (15, " \t "), (16, "a<|endoftext|>b"), (17, BASE),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, -1.0, "x", "y", "z") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, digest string, part string, node string").repartition(3)


def empty(docs):
    return docs.where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_jaccard_join(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(docs, 4, 85, 100).collect()}
    sets = {}
    for i, t in TEXTS:
        w = words(t)
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i, _ in TEXTS}
    for _ in TEXTS:
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {i: (len(sets[i]), root[i]) for i, _ in TEXTS}
    assert jaccard_join.link(empty(docs), 4, 85, 100).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} >= {1, 5, 6, 7, 9, 12, 13, 14, 15, 16}


def linked_classes(texts, k, numerator, denominator):
    """Brute force: size of each document's set, and the smallest document that links lead to."""
    sets = {}
    for i, t in texts:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and denominator * len(x & y) >= numerator * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


def family_texts():
    """Five families of 60 edits of one text, a chain of 30 whose neighbours alone link, copies of one text, and texts with no relation."""
    random = np.random.default_rng(7)
    out = []
    for f in range(5):
        lead = [f"f{f}w{i}" for i in range(160)]
        for _ in range(60):
            own = list(lead)
            for at in random.integers(0, 160, random.integers(0, 9)):
                own[at] = f"e{random.integers(0, 40)}"
            out.append(" ".join(own))
    out += [" ".join(f"c{j}" for j in range(6 * i, 6 * i + 150)) for i in range(30)]
    out += ["the same text again and again " * 9] * 40 + [" ".join(f"n{random.integers(0, 500)}" for _ in range(50)) for _ in range(60)]
    return [(int(i) * 3 + 1, t) for i, t in zip(random.permutation(len(out)), out, strict=True)]


@pytest.mark.parametrize("k, numerator, denominator", [(4, 85, 100), (5, 80, 100)])
def test_jaccard_join_families_and_chains(spark, k, numerator, denominator):
    texts = family_texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(docs, k, numerator, denominator).collect()}
    assert len(texts) >= 300 and got == linked_classes(texts, k, numerator, denominator)


def test_jaccard_join_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, BASE), (None, BASE), (5, BASE), (5, "another text of this row"), (9, EDIT), (7, "another text of this row")], "doc_id long, text string")
    got = sorted(((r[0], r[2]) for r in jaccard_join.link(docs, 4, 85, 100).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 5), (9, 5), (None, None), (None, None)]


def test_components_keep_worlds_apart(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 3), (0, None, 4), (1, 3, 4), (1, 5, 4), (1, 4, 5)], "world int, a long, b long")
    got = {tuple(r) for r in common.components(edges, "world").collect()}
    assert got == {(0, 1, 1), (0, 2, 1), (0, 3, 1), (1, 3, 3), (1, 4, 3), (1, 5, 3)}
    chain = spark.range(40).selectExpr("id as a", "id + 1 as b")
    assert {tuple(r) for r in common.components(chain).collect()} == {(i, 0) for i in range(41)}
    assert common.components(chain.where("false")).count() == 0


def test_bpe(docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r["doc_id"]: (np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    assert got == {i: (encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS}
    assert bpe.round_trip(empty(docs), path, public_tokenizers.PATTERN, digests=True).count() == 0


def test_fingerprints(docs):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    ordered = [(i, t or "") for i, t in TEXTS]
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        assert (rows[i]["n_chars"], rows[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert rows[i]["fingerprint"] == fingerprint(t) and rows[i]["edited_fingerprint"] == fingerprint(edited)
    assert rows[1]["fingerprint"] == rows[17]["fingerprint"] and rows[14]["near_edited"] > rows[14]["near_next"]
    assert fingerprints.fingerprints(empty(docs)).count() == 0


def fingerprint(text):
    """The same by hand, with Spark's xxhash64 (seed 42, one column after the other)."""
    import xxhash

    def chain(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else int(p).to_bytes(8, "little", signed=True) if abs(p) >= 1 << 31 or not isinstance(p, Int) else int(p).to_bytes(4, "little", signed=True), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    tokens = [w[j : j + 16] for w in re.findall(r"[^\x20\x09-\x0D]+", text) for j in range(0, len(w), 16)]
    if not tokens:
        return ""
    seen, elements = Counter(), []
    for i in range(max(len(tokens) - 3, 0) + 1):
        h = chain(*tokens[i : i + 3]) >> 28
        elements.append((h if not seen[h] else chain(h, Int(seen[h])) >> 28, i))
        seen[h] += 1
    out, slots = "", {}
    for h, i in sorted(elements):
        slots.setdefault(h >> 30, []).append((h, i))
    for slot, own in sorted(slots.items()):
        values = []
        for h, _ in sorted(own[:2], key=lambda x: x[1]):
            x = (h & ((1 << 36) - 1)) << 28
            values.append(x - (1 << 64) if x >> 63 else x)
        out += f"{(slot + 32) * 65536 + (chain(*values) & 65535):06x}"
    return out


class Int(int):
    """A number that Spark hashes as four bytes."""


def test_packing(docs):
    from tokenizers import Tokenizer

    files = packing.tokenizer_files()
    tokenizer = Tokenizer.from_file(files[0])
    rows = packing.pack(docs, files, capacity=256).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    import zlib

    for i, t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[i])
        assert [p[0] for p in own] == list(range(len(own))) and [p[1] for p in own] == np.cumsum([0, *[p[2] for p in own]])[:-1].tolist() and sum(p[2] for p in own) == len(ids)
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for _, s, n, c in own) and all(n == 256 for _, _, n, _ in own[1:])
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 256
    assert len(by) <= 1.1 * math.ceil(sum(r["length"] for r in rows) / 256) + 2
    assert packing.pack(empty(docs), files).count() == 0
    demand = {3: 7, 500: 40, 524: 40, 700: 9, 1024: 2, 1: 13}
    used = Counter()
    for lengths, times in packing.plan(demand, 1024):
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += times
    assert used == demand


def test_html_text(spark):
    page = lambda n: f'<html><head><title>t</title></head><body><header>Site</header><nav>x</nav><div class="cookie-notice">c</div><article><h1>T{n} &amp; u</h1><p>One <b>bo</b>ld {n}<p>Two&nbsp;x<br>y<div>Always here</div><ul><li>a<li>b{n}</ul><form>f</form><aside>q</aside><section id="comments"><p>c1</section><script>if(a<b){{}}</script></article><div class="ad">ad</div><footer>f</footer>'
    rows = [(n, "http://a.example/x", page(n), "k") for n in range(8)] + [(20, None, None, "k"), (21, "odd", "", "k"), (22, "http://b.example/", "plain &lt;text&gt;", "k"), (22, "http://b.example/", "plain &lt;text&gt;", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in html_text.main_text(df).collect()}
    assert all(got[n]["text"] == f"T{n} & u One bold {n} Two x y Always here a b{n}" for n in range(8))
    assert (got[20]["text"], got[21]["text"], got[22]["text"], got[22]["n_chars"]) == ("", "", "plain <text>", 12)
    assert html_text.main_text(df).count() == len(rows) and html_text.main_text(df.where("false")).count() == 0
    copies = spark.createDataFrame([(n, "http://c.example/", page(1), "k") for n in range(9)], df.schema)
    assert {r["text"] for r in html_text.main_text(copies).collect()} == {"T1 & u One bold 1 Two x y Always here a b1"}
    assert html.unescape("&amp;") == "&"


def test_exact_dedup(spark, docs):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in TEXTS}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    for i, t in norm.items():
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest())
    twice = spark.createDataFrame([(None, "a"), (2, "a"), (2, "a"), (3, " a"), (4, "a  b"), (5, "a b")], "doc_id long, text string").repartition(4)
    assert sorted((r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(twice).collect() if r["kept"]) == [(2, 3), (3, 1), (4, 2)]
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(twice).collect()) == [2, 3, 4]
    assert exact_dedup.exact_dedup(empty(docs)).count() == 0 and exact_dedup.drop_copies(docs).columns == docs.columns


def _texts(spark, pages):
    rows = spark.createDataFrame([(n, "http://h.example/", p) for n, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return [r["text"] for r in html_text.main_text(rows).orderBy("page_id").collect()]


def test_html_text_keeps_the_end_of_copied_articles(spark):
    """Six copies of a long article, html not identical, among twelve short ones: no paragraph is template."""
    page = lambda ad, words: f'<body><div class="ad">{ad}</div><article>' + "".join(f"<p>{w}</p>" for w in words) + "</article>"
    long = [f"long{i}" for i in range(9)]
    near = [[f"near{n}", *long[1:]] for n in range(3)]
    pages = [page(n, long) for n in range(6)] + [page(0, w) for w in near] + [page(0, [f"a{n}", f"b{n}"]) for n in range(12)]
    assert _texts(spark, pages) == [" ".join(long)] * 6 + [" ".join(w) for w in near] + [f"a{n} b{n}" for n in range(12)]


def test_html_text_counts_do_not_depend_on_the_first_page(spark):
    """39 of 40 pages without article share an unmarked line; the page that lacks it may come first, and pages may be dealt in any way."""
    pages = [f"<div id=x1>{'odd' if n == 0 else 'Home Shop'}</div><div id=x2><h1>t{n}</h1><p>body {n}</p><p>always here</p></div><div id=x3>Made by us</div>" for n in range(40)]
    want = ["odd t0 body 0 always here", *(f"t{n} body {n} always here" for n in range(1, 40))]
    rows = [(n, "http://h.example/", p) for n, p in enumerate(pages)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows if parts == 1 else rows[::-1], "page_id long, url string, html string").repartition(parts)
        assert [r["text"] for r in html_text.main_text(df).orderBy("page_id").collect()] == want


def test_html_text_wrapper_of_pages_without_article(spark, monkeypatch):
    """Pages differ in how many paragraphs and menu entries they have; few pages, or pages that are all the same, have no template."""
    page = lambda n: "<table><tr><td>" + "<br>".join(["Start", "News"]) + "</td><td><div>" + "".join(f"<p>{n} line {i}</p>" for i in range(1 + n % 5)) + "</div></td></tr></table><div>Imprint</div>"
    pages = [page(n) for n in range(12)]
    want = [" ".join(f"{n} line {i}" for i in range(1 + n % 5)) for n in range(12)]
    assert _texts(spark, pages) == want
    monkeypatch.setattr(html_text, "BROADCAST", 0)
    assert _texts(spark, pages) == want
    assert _texts(spark, pages[:3]) == [f"Start News {w} Imprint" for w in want[:3]]
    assert _texts(spark, [pages[1]] * 9) == [f"Start News {want[1]} Imprint"] * 9
    assert _texts(spark, []) == []


def test_html_text_deep_and_broken_pages():
    text = lambda source: html_text.extract(html_text.parse(source))
    assert text("<div>" * 50_000 + "deep" + "</div>" * 50_000 + "after") == "deep after"
    assert text("<div class=a>" * 50_000 + "<article>deep</article>" * 1000) == " ".join(["deep"] * 1000)
    for broken in ("<a ", '<a b="', "<!", "<a b='x\" ", "</", "<div "):
        source = broken * (1_000_000 // len(broken))
        assert isinstance(text(f"<p>A</p>{source}"), str) and text(f"<p>A</p>{source}").startswith("A")
    a, b = (html_text.parse(f"<div>{'<div>' * 20_000}{x}") for x in ("<p>one", "<ul>two"))
    assert len(html_text.matches(a, b)) == 20_002


def test_html_text_alignment_by_brute_force():
    """Simple tree matching against its recursive definition, on random trees."""
    random = np.random.default_rng(3)

    def tree(depth):
        tag = ["div", "section", "p"][random.integers(0, 3)]
        return f"<{tag}>{''.join(tree(depth - 1) for _ in range(random.integers(0, 4))) if depth and tag != 'p' else 'x'}</{tag}>"

    def most(a, b):
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids):
            for j, y in enumerate(b.kids):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + most(x, y))
        return 1 + best[-1][-1]

    for _ in range(60):
        a, b = (html_text.parse("".join(tree(3) for _ in range(3))) for _ in range(2))
        pairs = html_text.matches(a, b)
        labels = [n.label for n in html_text.kept_below(a)]
        assert len(pairs) == most(a, b) and len({p for p, _ in pairs}) == len(pairs) == len({id(n) for _, n in pairs})
        assert all(labels[p] == n.label for p, n in pairs)


def test_html_text_marks():
    """Marks are whole tokens; nothing around an article is dropped for one, nor an article's headers, headings and inline elements."""
    text = lambda source: html_text.extract(html_text.parse(source), None)
    for name in ("layout has-sidebar", "no-sidebar", "widget", "sidebar"):
        assert text(f'<div class="{name}"><article><p>A</article></div>') == "A"
        assert text(f'<div class="{name}"><main><p>A</main></div>') == "A"
    assert text('<form id="form"><article>A</article></form><div class="comments"><article class="comment">c</article></div>') == "A"
    kept = '<div class="article-header"><h1>A</h1></div><header class="entry-header">B</header><header class="header">C</header><h2 id="related-work">D</h2><h2 class="related">E</h2><section id="notice-period">F</section><p>x<span class="search-term">G</span>y <b class="ad">H</b></p><div class="header">I</div>'
    assert text(f"<article>{kept}</article>") == "A B C D E F xGy H I"
    dropped = '<div class="ad">a</div><div class="big ad-banner">b</div><div id="cookie-notice">c</div><ul role="navigation"><li>d</ul><section class="comments">e</section>'
    assert text(f"<article>A{dropped}</article>") == "A" and text(f"A{dropped}<header>f</header><span class=ad>g</span>") == "A"


def test_html_text_of_large_pages_has_a_template(spark):
    """Pages of more than 4096 blocks each still share a template."""
    pages = [f"<div id=n>site name</div><table>{''.join(f'<tr><td>{n}-{i}</td></tr>' for i in range(2100))}</table>" for n in range(6)]
    assert _texts(spark, pages) == [" ".join(f"{n}-{i}" for i in range(2100)) for n in range(6)]


def test_html_text_wrapper_decides_among_articles(spark, monkeypatch):
    """The wrapper is induced on pages with articles too: a teaser in an article of its own, the same on all pages, is template; a constant paragraph of an article with content isn't."""
    page = lambda n, ad="": f"<div>{ad}</div><article><h2>Join us</h2><p>Subscribe today</p></article><article><h1>t{n}</h1><p>always here</p><p>body {n}</p></article>"
    want = [f"t{n} always here body {n}" for n in range(9)]
    assert _texts(spark, [page(n) for n in range(9)]) == want
    monkeypatch.setattr(html_text, "BROADCAST", 0)
    assert _texts(spark, [page(n) for n in range(9)]) == want
    whole = "Join us Subscribe today t1 always here body 1"
    assert _texts(spark, [page(n) for n in range(3)])[1] == whole and _texts(spark, [page(1, ad) for ad in range(9)]) == [whole] * 9
    stub = lambda n: "<html></html>" if n % 2 else page(n // 2)
    assert _texts(spark, [stub(n) for n in range(18)]) == [x for w in want for x in (w, "")]


def test_lm_score_lets_go_of_the_counts_shuffles(spark):
    """When the pairs are about to be shuffled, no shuffle of the counts is left."""
    known = lambda: set(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keySet().mkString(",").split(","))
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 97).cast("string")) for k in range(1, 30)]).alias("text")).repartition(4)
    before = known()
    scored = lm_score.score(texts)
    assert known() - before - {""} == set()
    assert scored.count() == 400


def test_licenses(spark):
    texts = [(1, "MIT Licence\n\nCopyright (c) 2020 Someone\n\n" + licenses._MIT.replace('"', "“").lower()), (2, licenses._MIT + " more"), (3, None), (4, "a\nReleased under the MIT licence\nb"), (4, "a\nReleased under the MIT licence\nb")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, license_id string")
    got = [(r["doc_id"], r["license_id"], r["notice_ids"], r["canonical_sha256"]) for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == [(i, "MIT" if i == 1 else None, "MIT" if i == 4 else "", hashlib.sha256(licenses.canonical(t or "").encode()).hexdigest()) for i, t in texts]
    assert licenses.scan(df.where("false")).count() == 0


def test_licenses_wrapped_and_long(spark):
    isc = f"ISC License\n\nCopyright Someone\nCopyright (c) 2020, Other\n\n{licenses._ISC_GRANT}, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n{licenses._ISC_DISCLAIMER}"
    bsd = f"{licenses._BSD_GRANT}\n\n{licenses._BSD_THIRD}\n\n{licenses._BSD_DISCLAIMER}".replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ").replace("BY THE COPYRIGHT", "BY THE\nCOPYRIGHT")
    texts = {"ISC": isc, "BSD-3-Clause": bsd}
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("GPL-2.0", "GPL-2"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(path := f"/usr/share/common-licenses/{file}"):
            with open(path, encoding="utf-8") as f:
                texts[name] = f.read()
    rows = [*enumerate(texts.values()), (99, "a\nSPDX-License-Identifier: MIT\nThis project is licensed under the GPLv3.")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license_id"] for i in range(len(texts))] == list(texts) and got[99]["notice_ids"] == "GPL-3.0,MIT"
    assert all(got[i]["canonical_sha256"] == hashlib.sha256(licenses.canonical(t).encode()).hexdigest() for i, t in rows)


def test_packing_program():
    """The dual bound holds against all configurations, the solution covers the demand, and all configurations rounded use it up."""
    random = np.random.default_rng(5)
    for capacity, demand in ((12, {2: 40, 3: 31, 5: 50, 7: 23, 11: 9}), (20, {int(x): int(n) for x, n in zip(range(3, 20, 2), random.integers(1, 90, 9), strict=True)})):
        lengths = sorted(demand)

        def configurations(room, most):
            yield ()
            for x in (x for x in lengths if x <= min(room, most)):
                for rest in configurations(room - x, x):
                    yield (x, *rest)

        uses, weights, bound = packing.fractional(demand, capacity)
        price = dict(zip(lengths, weights.tolist(), strict=True))
        best = max(sum(price[x] for x in c) for c in configurations(capacity, capacity))
        value = packing.knapsack(np.array(lengths), weights, capacity)[-1]
        assert abs(best - value) < 1e-9 and sum(price[x] * demand[x] for x in lengths) / best <= bound + 1e-9
        covered = Counter()
        for c, amount in uses.items():
            assert sum(c) <= capacity
            for x in c:
                covered[x] += amount
        assert all(covered[x] >= demand[x] - 1e-6 for x in lengths) and bound - 1e-6 <= sum(uses.values()) <= 1.1 * bound
    for demand in ({1: 3}, {600: 7}, {1024: 4, 3: 1}, {int(x): int(n) for x, n in zip(range(1, 1024, 7), random.integers(1, 50, 147), strict=True)}, {x: 10_000_000 for x in (100, 300, 501, 724)}):
        packed, used = packing.plan(demand, 1024), Counter()
        for c, n in packed:
            assert sum(c) <= 1024
            for x in c:
                used[x] += n
        assert used == Counter(demand) and sum(n for _, n in packed) <= packing.best_fit(demand, 1024).total() * 1.01 + 1


def test_quality_votes_by_hand(spark):
    """Every text's score from all labelled vectors, one by one: the most similar vote, ties go to the smallest id."""
    texts = [(n, f"A fine sentence number {n % 7}, with words." if n % 2 else f"BUY {n % 5} NOW!!! $$$ {n % 3}") for n in range(120)] + [(200, None), (201, ""), (202, "x" * 50_000), (None, "A fine sentence."), (3, "A fine sentence.")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in texts], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(90)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, 60)
    assert len(model["labels"]) <= 60
    got = {(r["doc_id"], r["score"]) for r in quality.score(docs, model).collect()}
    import pyarrow as pa

    own = quality._unit(quality.weighted(quality.counts(pa.array([t for _, t in texts])), model["weights"]) @ model["basis"])
    for (doc_id, _), v in zip(texts, own, strict=True):
        steps = [round(float(x) * 65536) for x in (v[None] @ model["vectors"].T)[0]]
        near = sorted(range(len(steps)), key=lambda k: (-steps[k], k))[: quality.NEIGHBOURS]
        weight = [max(steps[k] / 65536, 0.0) ** quality.POWER + 1e-9 for k in near]
        score = sum(w * model["labels"][k] for w, k in zip(weight, near, strict=True)) / sum(weight)
        assert any(i == doc_id and abs(x - score) < 1e-3 for i, x in got)


@pytest.mark.parametrize("limit", [lm_score.WORDS, 0])
def test_lm_score(docs, monkeypatch, limit):
    monkeypatch.setattr(lm_score, "WORDS", limit)
    own = {i: words(t) for i, t in TEXTS}
    ones, twos = Counter(), Counter()
    for w in own.values():
        ones.update(w)
        twos.update(zip(w, w[1:], strict=False))
    total = sum(ones.values())
    for r in lm_score.score(docs).collect():
        w = own[r["doc_id"]]
        u, b, s = Counter(w), Counter(zip(w, w[1:], strict=False)), 0.0
        for j, x in enumerate(w):
            others = twos[w[j - 1], x] - b[w[j - 1], x] if j else 0
            s += math.log(others / (ones[w[j - 1]] - u[w[j - 1]])) if others else math.log(0.4 * max(ones[x] - u[x], 0.5) / max(total - len(w), 1))
        assert r["n_words"] == len(w) and abs(r["score"] - (s / len(w) if w else 0)) < 1e-4
    assert lm_score.score(empty(docs)).count() == 0


def test_warc(spark, tmp_path):
    long = "<p>" + "é" * 200
    rows = [(3, "http://a/1 b", long), (1, None, long), (2, "u", "short"), (5, "u", "short"), (4, "u", None), (7, "u", long), (7, "u", long), (None, "u", "x" * 150)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write(df, str(tmp_path / "w"), roll_bytes=300)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(spark, str(tmp_path / "w"), manifest).collect())
    assert got == sorted([("1", 403, "response", None), ("3", 403, "revisit", 1), ("2", 5, "response", None), ("5", 5, "response", None), ("4", 0, "response", None), ("7", 403, "revisit", 1), ("7", 403, "revisit", 1), ("None", 150, "response", None)])
    assert (tmp_path / "w" / "MANIFEST").exists() and not (tmp_path / "w" / "_temporary").exists()
    again = warc.write(df, str(tmp_path / "v"), roll_bytes=300)
    assert sorted(r["sha256"] for r in again.collect()) == sorted(r["sha256"] for r in manifest.collect())
    assert warc.read(spark, str(tmp_path / "e"), warc.write(df.where("false"), str(tmp_path / "e"))).count() == 0


def test_release_gives_native_memory_back(spark):
    """Buffers that lie between ones in use are freed, but stay with C's allocator unless it is told to trim."""
    jvm = spark.sparkContext._jvm
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status").read())[1]) / 1024  # noqa: E731, SIM115
    common.release(spark, now=True)
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(96 << 10) for _ in range(2400)]
    full, buffers = held(), buffers[::8]
    for _ in range(2):  # memory is freed in the background, once a collection has found it unused
        common.release_all(spark)
    assert held() < full - 120 and len(buffers) == 300


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.query(spark, sf).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.95 and got[1] >= 0 and got[2] <= 1
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (2, "x" * 200000, 3.0)], "doc_id long, text string, score double")
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), labels, 200)
    assert quality.score(odd, model).count() == 3 and quality.score(odd, None).select("score").distinct().collect()[0][0] == 0.5
    assert quality.keep_good(odd, model).columns == odd.columns and quality.train(odd, labels.where("false")) is None


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.query(spark, sf).where("predicted = 1").collect()}
    first = {}
    for i in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(texts[i])) else set() for i in first.values()}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and root[a] != root[b] and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == {i for i in root if root[i] == i}
