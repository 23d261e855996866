"""Conversation repair, main text and centroid clustering: against brute force, by hand, and on odd rows."""

import hashlib
import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids, conversations, main_text, queries
from tests.oracle import connect, differences

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\f\r"
TURNS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        word = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        have = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            have += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Every edit string of at most five inserted rows, by enumeration: (cost, audit) of the least."""
    best = None

    def go(i, roles, cost, audit, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        expected = "a" if roles[-1:] == "u" else "u"
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if i < len(rows):
            initial, gone, cut = rows[i]
            go(i + 1, roles, cost + 3, audit + "D", inserts)
            if not gone:
                if initial == expected or initial == "s" and not roles:
                    go(i + 1, roles + initial, cost + cut, audit + "K", inserts)
                go(i + 1, roles + expected, cost + 2 + cut, audit + "R", inserts)
        if inserts:
            go(i, roles + expected, cost + 2, audit + "I", inserts - 1)

    go(0, "", 0, "", 5)
    return best


def by_strings(rows):
    """The same over whole strings by state, for long conversations."""
    at, following = {"": (0, "")}, {"": "u", "s": "u", "u": "a", "a": "u"}

    def put(d, k, v):
        d[k] = min(d.get(k, v), v)

    def close():
        for _ in range(4):
            for s, (c, p) in list(at.items()):
                put(at, following[s], (c + 2, p + "I"))

    for initial, gone, cut in rows:
        close()
        new = {}
        for s, (c, p) in at.items():
            put(new, s, (c + 3, p + "D"))
            if not gone:
                if initial == following[s] or initial == "s" and s == "":
                    put(new, initial, (c + cut, p + "K"))
                put(new, following[s], (c + 2 + cut, p + "R"))
        at = new
    close()
    return min(at[s] for s in ("", "a") if s in at)


def repaired(rows, search):
    rows, seen, faults = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), set(), []
    for _, role, text in rows:
        faults.append("blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = search([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
    out, last, at = [], "", iter(rows)
    for e in audit:
        _, role, text = (None, "", "") if e == "I" else next(at)
        if e in "RI":
            role = "assistant" if last == "u" else "user"
        if e != "D":
            out.append(f"{role}:{text}")
            last = role[0]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def check_conversations(df, search=by_strings, long=8192):
    got = [tuple(r) for r in conversations.repair_damaged(df, long).collect()]
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = {c: repaired(x, search) for c, x in damaged(rows).items()}
    assert len(got) == len(want)
    assert {r[0]: r[1:] for r in got} == want


def test_conversations_equal_brute_force(spark):
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, SF2).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF2}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == {c: repaired(x, cheapest) for c, x in damaged(rows).items()}


def test_cheapest_edits_equal_enumeration():
    """All ties: every sequence of up to five rows of three roles, deleted or truncated ones among them."""
    kinds = [("u", False, False), ("a", False, True), ("s", False, False), ("u", True, False), ("x", False, False)]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            cost, audit, _ = conversations.finished({s: (*v, []) for s, v in conversations.edits(list(rows), 0).items()})
            assert (cost, audit) == cheapest(list(rows)), rows


def test_prefixes_compare_as_strings_even_where_hashes_collide(monkeypatch):
    for modulus in (conversations.MODULUS, 2):
        monkeypatch.setattr(conversations, "MODULUS", modulus)
        rnd, paths, words = random.Random(3), conversations.Prefixes(), {0: ""}
        for _ in range(400):
            up = rnd.choice(list(words))
            letter = rnd.choice("DIKR")
            words[paths.add(up, letter)] = words[up] + letter
        for _ in range(4000):
            a, b = rnd.choice(list(words)), rnd.choice(list(words))
            assert paths.less(a, b) == (words[a] < words[b]) and paths.spell(a) == words[a]


def test_long_conversations_are_split_over_tasks(spark):
    """One conversation holds most rows; blocks of 40 rows give the same as one program over all."""
    rnd = random.Random(5)
    rows = [(1, t, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["again.", "cut", "", f"{t}.", f"{t}?", f"{t} cut"])) for t in range(3000)]
    rows += [(c, t, rnd.choice(["user", "assistant"]), f"{t}.") for c in range(2, 12) for t in range(c)]
    check_conversations(spark.createDataFrame(rows, TURNS), long=40)
    ties = spark.createDataFrame([(12, None, "user", f"{i}.") for i in range(200)] * 2, TURNS)
    a, b = (conversations.repair_damaged(x, 40).collect() for x in (ties, ties.orderBy(F.desc("text"))))
    assert a == b and tuple(a[0])[:6] == (12, 0, 0, 200, 0, 399)


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 2, "user", "x."), (1, None, "user", "a."), (1, 1, None, "b."), (1, 2, "user", None), (2, 5, "assistant", " \t\n"), (3, 9, "user", "x" * 300_000), (3, 9, "user", "x" * 300_000), (4, 2, "", "é."), (4, 40, "s", "😀!")]
    df = spark.createDataFrame(rows, TURNS)
    check_conversations(df.withColumns({c: F.lit(1) for c in ("conv", "copy", "kind", "gone", "part", "pos", "key", "at", "block", "audit", "mix")}))
    assert conversations.repair_damaged(df.limit(0)).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    only = conversations.repair_damaged(spark.createDataFrame([(dropped, 0, "user", "x.")], TURNS)).collect()
    assert [tuple(r) for r in only] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def article(page):
    """The text of the only article, by splitting at its block tags."""
    found = re.search("<article>(.*?)</article>", page or "", re.S)
    parts = re.split("</?(?:p|h1)>", found.group(1)) if found else []
    lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n".join(line for line in lines if line)


@pytest.mark.parametrize("folder", [SF, SF2])
def test_main_text_equals_the_article(spark, folder):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op12_main_text(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert got == {r.page_id: (r.url, article(r.html), len(article(r.html))) for r in rows}


def page_of(n, body, site="news"):
    """A page whose article has no element of its own name, among all that is no article."""
    return f"""<html><head><title>T {n}</title><style>p > b {{}}</style></head><body class="single comments-open has-sidebar">
<div id=top><a href=/>Home of {site}</a></div><div class="site-menu"><ul>{''.join(f'<li><a href=/{i}>Topic {i}</a></li>' for i in range(4))}</ul></div>
<div class=wrap><div id="post-{n}" class="story-body">{body}<div class="share">Share it</div><ul class=more>{''.join(f'<li><a href=/{i}>Story {n} {i}</a></li>' for i in range(3))}</ul><div class=about>All of {site} is written by hand</div></div>
<div class="sidebar">Popular {n}</div></div><div id="comments"><article><p>I liked number {n}</p></article></div>
<form><p>Send a letter</p><textarea>x</textarea></form><script>if (a < b) document.write("<p>no</p>")</script><footer><p>&copy; {site}</p></footer></body></html>"""


def test_templates_find_the_slot_of_the_article(spark):
    """Twelve pages of a host teach what is fixed (the note on the site) and what only links; no article element is needed."""
    rnd = random.Random(1)
    words = lambda n: " ".join(rnd.choice(["tide", "mark", "wave", "salt", "foam", "&amp;", "sea"]) for _ in range(n))
    bodies = [(words(6), words(40 + i), words(30)) for i in range(12)]
    rows = [(i, f"https://news.example/{i}", page_of(i, f"<h2>{a}</h2><p>{b}</p>loose  text<br>goes on<p>{c}<br><br>new")) for i, (a, b, c) in enumerate(bodies)]
    rows.append((99, "https://other.example/", page_of(99, "<h2>Alone</h2><p>One page of its host &lt;only&gt; with&nbsp;text enough to be seen.</p>", "other")))
    got = {r.page_id: r for r in main_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (a, b, c) in enumerate(bodies):
        assert got[i].text == html.unescape("\n".join([a, b, "loose text goes on", c, "new"])), i
        assert got[i].n_classes > 2
    lines = got[99].text.split("\n")
    assert lines[:2] == ["Alone", "One page of its host <only> with text enough to be seen."]
    assert not {"Share it", "Popular 99", "I liked number 99", "Send a letter", "Home of other"} & set(lines)


def test_copies_of_one_page_keep_their_text(spark):
    one = page_of(1, "<h2>Same</h2><p>On every page of this host stands the same text.</p>")
    df = spark.createDataFrame([(i, "http://same.example/", one) for i in range(20)], "page_id long, url string, html string")
    assert all("On every page of this host stands the same text." in r.text for r in main_text.extracted(df).collect())


def test_hot_hosts_without_broadcast(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = {(r.page_id, r.text) for r in main_text.extracted(df).collect()}
    assert {(r.page_id, r.text) for r in main_text.extracted(df, broadcast_bytes=-1).collect()} == want


def test_odd_pages(spark):
    long = "<p>" + "word " * 100_000 + "</p>"
    rows = [(1, None, None), (2, "u", ""), (3, "http://a/x", "plain & simple"), (4, "http://a/x", "<p>a<p>b</i></div>&#x1F600;&bogus;"), (5, "http://b/", long), (5, "http://b/", long), (None, "http://b/", "<!-- <p>x</p>"),
            (6, "http://c/", "<div>" * 20_000 + "deep"), (7, "http://c/", '<p title="a>b">q</p><p class="x'), (8, "http://d/", "<nav>only a menu</nav><div class=ad>buy</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "token", "pages", "tokens", "all_pages", "key", "text", "n")})
    got = {(r.page_id, r.text) for r in main_text.extracted(df).collect()}
    assert got == {(1, ""), (2, ""), (3, "plain & simple"), (4, "a\nb\n😀&bogus;"), (5, ("word " * 100_000).strip()), (None, ""), (6, "deep"), (7, "q"), (8, "")}
    assert main_text.extracted(df).count() == len(rows) and main_text.extracted(df.limit(0)).collect() == []


def brute_clusters(rows, k=16, rounds=3):
    rows = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows]
    x = np.array([v for _, v in rows])
    c = np.array([v for _, v in sorted(rows, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:k]])
    for n in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if n < rounds:
            c = np.array([[int(s) // int((own == j).sum()) for s in x[own == j].sum(axis=0)] if (own == j).any() else c[j] for j in range(len(c))])
    near = d[np.arange(len(x)), own]
    return {rows[i][0]: (int(own[i]), int(near[i]), int(near[own == own[i]].sum()), int(near.sum()), hashlib.sha256(",".join(map(str, c[own[i]])).encode()).hexdigest()) for i in range(len(x))}


def test_clusters_equal_sql_and_brute_force(spark):
    got = queries.op13_centroid_clustering(spark, SF2)
    assert differences(got.toPandas(), connect(SF2).sql(queries.oracle_sql()["op13_centroid_clustering"]).df()) == ""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF2}/embeddings.parquet").collect()]
    assert {r.vec_id: tuple(r)[1:] for r in got.collect()} == brute_clusters(rows)


def test_bounds_leave_vectors_of_clear_clusters_unseen(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 64)) * 4
    rows = [(i, [float(v) for v in centres[i % 16] + rng.normal(size=64) * 0.05]) for i in range(1600)]
    got = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r.vec_id: tuple(r)[1:6] for r in got.collect()} == brute_clusters([(i, np.array(v, np.float32)) for i, v in rows])
    assert got.where("scanned").count() < 800


def test_loosening_bounds_every_point_of_a_sphere():
    rng = np.random.default_rng(0)
    tighter = 0
    for _ in range(3000):
        d = rng.integers(2, 5)
        a, b, c = rng.normal(size=(3, d)) * rng.choice([0.1, 1, 5], size=(3, 1))
        r = abs(rng.normal()) * rng.choice([0.1, 1, 3])
        u = rng.normal(size=(200, d))
        x = c + u / np.linalg.norm(u, axis=1)[:, None] * r * rng.choice([1.0, 0.5], size=(200, 1))
        bound = centroids.loosening(c, r, a, b)
        assert bound >= (np.linalg.norm(x - a, axis=1) - np.linalg.norm(x - b, axis=1)).max()
        tighter += bound < 0.9 * np.linalg.norm(a - b)
    assert tighter > 1000


def test_odd_vectors(spark):
    v = [0.5] * 64
    rows = [(1, v), (1, v), (2, None), (3, v[:63]), (4, v[:63] + [None]), (5, v[:63] + [float("nan")]), (6, v[:63] + [float("inf")]), (None, [-0.01] * 64), (7, [3e30] * 64), (8, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("vec", "cluster", "upper", "mark", "n", "distance")})
    got = sorted(((r.vec_id or 0), r.distance) for r in centroids.clustered(df).collect())
    assert [i for i, _ in got] == [0, 1, 1, 7, 8] and {d for _, d in got} == {0}
    assert centroids.clustered(df.limit(0)).collect() == []
    ties = spark.createDataFrame([(i, [float(i % 2)] * 64) for i in range(40)], "vec_id long, embedding array<double>")
    assert {r.vec_id: tuple(r)[1:6] for r in centroids.clustered(ties).collect()} == brute_clusters([(i, [float(i % 2)] * 64) for i in range(40)])


def test_licenses_by_reduction_equal_all_templates_on_all_blocks(spark):
    """No ranking, no threshold: every template against every block gives the same rows."""
    import zstandard

    from tidemark.llm import license_scan as LS

    known, plain = [LS.Template(n, *t) for n, t in LS.TEMPLATES.items()], zstandard.ZstdCompressor(level=6)
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    got = [tuple(r)[:4] for r in LS.license_blocks(docs).collect()]
    around, want = max(len(t.words) for t in known), []
    for r in docs.where(F.col("text").rlike(LS.CUES)).collect():
        for block in LS.blocks(r.text, re.compile(LS.CUES), around):
            want += [(r.doc_id, *row[:3]) for row in LS.found_in(r.text, block, known, plain, 0.8, -1e9)]
    assert sorted(got) == sorted(want) and len(got) > 10


def test_licenses_are_ranked_by_what_their_dictionary_takes_off():
    import zstandard

    from tidemark.llm import license_scan as LS

    known, plain = [LS.Template(n, *t) for n, t in LS.TEMPLATES.items()], zstandard.ZstdCompressor(level=6)
    filler = [f"w{i}" for i in range(150)]
    for name in ("MIT", "GPL-3.0", "BSD-3-Clause", "MPL-2.0", "ISC", "MIT-line", "Apache-2.0-line", "GPL-3.0-or-later-spdx"):
        words = filler + next(t for t in known if t.name == name).words + filler
        order = LS.ranked(words, known, plain, 0.25)
        sizes = [s for s, _ in order]
        assert sizes == sorted(sizes, reverse=True) and name in [t.name for s, t in order if s >= sizes[0] - 12], name
    twins = [LS.Template(n, "Released under the Acme License.", "acme") for n in ("B", "A")]
    text = "Released under the Acme License."
    block = next(LS.blocks(text, re.compile(LS.CUES), 10))
    assert [t.name for _, t in LS.ranked([w for _, _, w in block], twins, plain, 0.25)] == ["A", "B"]
    assert [r[2] for r in LS.found_in(text, block, twins, plain, 0.8, 0.25)] == ["A"]  # a tie goes to the name


def test_statements_identifiers_and_very_long_texts(spark):
    import time

    from tidemark.llm import license_scan as LS

    notice = LS.TEMPLATES["MIT"][0]
    long = " ".join(f"license {i} warranty copyright" for i in range(30_000)) + " " + notice + " end " * 1000
    rows = [(1, "// SPDX-License-Identifier: MIT"), (2, "# SPDX-License-Identifier: GPL-3.0-or-later"), (3, "Distributed under GPL-3.0."), (4, "This project is MIT licensed."), (5, "We like gpl-3 and the mit"), (6, long)]
    start = time.time()
    got = {r.doc_id: r.license for r in LS.license_blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()}
    assert got == {1: "MIT-spdx", 2: "GPL-3.0-or-later-spdx", 3: "GPL-3.0-statement", 4: "MIT-licensed", 6: "MIT"} and len(long) > 900_000
    assert time.time() - start < 30


def test_lines_are_removed_in_linear_time(spark):
    import time

    from tidemark.llm import line_dedup

    text = "\n".join(f"line {i % 30_000} of the text" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: (r.text.count("\n") + 1 if r.text else 0, r.n_removed) for r in line_dedup.without_repeats(df).collect()}
    assert got == {1: (30_000, 30_000), 2: (0, 60_000)} and time.time() - start < 20
