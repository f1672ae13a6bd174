"""HTML, Matroska, licenses and top-k: against pages, files and scores made by hand or by brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from gneiss.llm import html_extract, licenses, media, topk
from gneiss.llm.queries import op2_licenses

LONG = "This is a paragraph of the article that says quite a lot, and goes on for a while so that it counts."

# HTML


PAGES = {
    "article": f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><a href=1>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>Second &amp;&#233; &lt;b&gt;<b>bo</b>ld<br>line</article><footer>&copy; me</footer><script>var x='</p>';</script></body></html>",
    "divs": f"<body><div class='top-nav'><a href=1>A</a></div><div id=content><h2>Title</h2><p>{LONG}</p><ul><li>one<li>two</ul><div class=ad>Buy</div><form><label>Mail</label></form></div><div class='sidebar-left'><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div><p class=cookie-notice>We use cookies</p></body>",
    "cut": f"<body><nav>menu</nav><article><p>{LONG}</p><p>Second half &am",
    "cut tag": f"<body><article><p>{LONG}</p><p>End <a href='x",
    "plain": "no  mark-up &amp;\n text",
    "comment": f"<body><main><!-- <p>no</p> --><p>{LONG}</p><![CDATA[x & y]]></main></body>",
    "nested comments": f"<body><article><p>{LONG}</p><section class='comments'><article class=comment><p>{LONG}</p></article></section></article></body>",
}
TEXTS = {
    "article": f"Title {LONG} Second &é <b>bold line",
    "divs": f"Title {LONG} one two",
    "cut": f"{LONG} Second half &am",
    "cut tag": f"{LONG} End",
    "plain": "no mark-up & text",
    "comment": f"{LONG} x & y",
    "nested comments": LONG,
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert html_extract.main_text(PAGES[name]) == TEXTS[name]


def test_densest_part_wins_without_any_names():
    html = f"<body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><div>Small print</div></body>"
    assert html_extract.main_text(html) == f"Head {LONG} {LONG}"


def test_class_words_count_as_a_whole():
    html = f"<body><article><p class='ad-hoc share-price'>{LONG}</p><div class=social-history><p>{LONG}</p></div><h2 id=comments>Head</h2><p class=ad-slot-3>Buy</p><div class='adBox'>Now</div><div class='social-share'>Tell</div></article></body>"
    assert html_extract.main_text(html) == f"{LONG} {LONG} Head"


def naive(node, share=None):
    """(characters, tags, those in links, own density and density sum of each node in order): by the definition, nothing shared."""
    import math

    def texts(n):
        return [html_extract.SPACE.sub(" ", c).strip() for c in n.children if isinstance(c, str)]

    def count(n, linked=False):
        linked = linked or n.name == "a"
        c, t = sum(map(len, texts(n))), 1
        lc, lt = (c, t) if linked else (0, 0)
        for k in n.children:
            if isinstance(k, html_extract.Node):
                got = count(k, linked)
                c, t, lc, lt = c + got[0], t + got[1], lc + got[2], lt + got[3]
        return c, t, lc, lt

    c, t, lc, lt = count(node)
    share = lc / max(1, c) if share is None else share
    if not c:
        own = 0.0
    else:
        base = math.log(max(math.log(c / max(1, c - lc) * lc + share * c + math.e), 1.0001))
        own = c / t * max(0.0, math.log(max(1e-9, c / max(1, lc) * t / max(1, lt))) / base)
    below = [naive(k, share) for k in node.children if isinstance(k, html_extract.Node)]
    return [(c, t, lc, own, sum(b[0][3] for b in below)), *[x for b in below for x in b]]


def test_densities_match_the_definition():
    r = random.Random(8)

    def tree(depth):
        bits = []
        for _ in range(r.randint(0, 4)):
            kind = r.random()
            if kind < 0.4:
                bits.append(" ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 12))))
            elif depth:
                name = r.choice(["div", "span", "a", "section"])
                bits.append(f"<{name}>{tree(depth - 1)}</{name}>")
        return "".join(bits)

    def preorder(n):
        yield n
        for c in n.children:
            if isinstance(c, html_extract.Node):
                yield from preorder(c)

    for _ in range(60):
        root = html_extract.parse(f"<body>{tree(5)}</body>")
        (body,) = root.children
        html_extract.measure(root, body)
        got = [(n.chars, n.tags, n.link_chars, n.density, n.sum) for n in preorder(body)]
        want = naive(body)
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert np.allclose([x[3:] for x in got], [x[3:] for x in want])
        assert body.top.sum == max(x[4] for x in got)


def test_density_decides_without_article_elements():
    r = random.Random(9)

    def words(n):
        return " ".join("x" * r.randint(2, 9) for _ in range(n))

    for _ in range(40):
        parts = [words(r.randint(12, 60)) for _ in range(r.randint(3, 9))]
        menu = "".join(f"<li><a href=x>{words(1)}</a></li>" for _ in range(r.randint(4, 12)))
        beside = "".join(f"<p><a href=x>{words(3)}</a></p>" for _ in range(5))
        body = "".join(f"<p>{p}</p>" for p in parts)
        html = f"<body><div><ul>{menu}</ul></div><div><div><h1>Head of it</h1>{body}</div></div><div>{beside}</div><div><a href=x>{words(2)}</a> {words(3)}</div></body>"
        assert html_extract.main_text(html) == " ".join(["Head of it", *parts])


def test_broken_deep_pages_take_linear_time():
    import time

    def took(html):
        began = time.process_time()
        html_extract.main_text(html)
        return time.process_time() - began

    for make in (lambda n: "<form>" * n + "x", lambda n: "<div>" * n + "</span>" * n, lambda n: "<div class=ad>" * n + "<main>x</main>", lambda n: "<li><ul>" * n + "<b>" * n + "<li></li>" * n, lambda n: "<p><b>" * n):
        assert took(make(40_000)) < 8 * max(took(make(10_000)), 0.05)


BIG = [2**53 + 1, 2**53 + 3, -(2**63), 2**63 - 1]


def test_ids_of_any_size_beside_nulls(spark):
    from gneiss.llm import simhash, substrings, toxicity

    rows = [(i, f"<p>{n} words of a text of its own</p>", "u") for n, i in enumerate([*BIG, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string").coalesce(1)
    want = sorted(map(str, [*BIG, None]))
    pages = df.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {
        "html": html_extract.extract(pages).select("page_id"),
        "licenses": licenses.scan_licenses(df).select("doc_id"),
        "media": media.sound_columns(df).select("doc_id"),
        "prints": simhash.group_near(df).select("doc_id"),
        "alike": simhash.group_alike(df).select("doc_id"),
        "repeats": substrings.remove_repeats(df).select("doc_id"),
        "scores": toxicity.score(df, toxicity.train(df, none)).select("doc_id"),
    }
    for name, ids in got.items():
        assert sorted(str(r[0]) for r in ids.collect()) == want, name
    own = {r["doc_id"]: r["component_id"] for r in simhash.group_near(df).collect()}
    assert all(own[i] in (*BIG, None) for i in own)
    named = df.withColumn("doc_id", df.doc_id.cast("string"))
    assert sorted(str(r["doc_id"]) for r in simhash.group_near(named).collect()) == want


def test_pages_of_any_kind(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (None, None, "<p>a</p>", "x"), (3, "u", "<p>a</p>", "x"), (3, "u", "<p>a</p>", "x"), (4, "u", "<div>" * 20_000 + "deep" + "<p>x" * 3000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in html_extract.extract(df).collect())
    assert got[:3] == [("1", 0), ("2", 0), ("3", 1)] and len(got) == 6 and got[4][1] > 6000
    assert html_extract.extract(df.limit(0)).collect() == []


def test_broken_pages_never_fail():
    r = random.Random(1)
    bits = ["<p>", "</p>", "<div class='nav", "'>", "<a href=\"", "\">", "<!--", "-->", "<script>", "</script>", "&", "text ", "<li>", "</ul>", "<table><td>", "<", ">", "<svg/>", "<![CDATA[", "]]>", "</x", "<b", "<article>"]
    for _ in range(500):
        html_extract.main_text("".join(r.choice(bits) for _ in range(r.randint(0, 60))))


# Matroska


@pytest.mark.parametrize("n", [0, 1, 63, 64, 4096, 4097, 32_768, 32_769, 600_001])
def test_payloads_come_back(n):
    payload = media.padded(bytes(i * 7 % 251 for i in range(n)))
    file = media.store(payload)
    table, cues, tracks = media.packets(file)
    assert b"".join(file[a:b] for _, _, a, b, _ in table) == payload and len(payload) % 64 == 0 and len(payload) >= 64
    assert tracks[1]["codec"] == "A_PCM/INT/LIT" and tracks[1]["rate"] == 8000 and tracks[1]["bits"] == 8
    assert [t for _, t, *_ in table] == [i * 512_000_000 for i in range(len(table))]
    for ns, track, at in cues:
        assert track == 1 and file[at : at + 4] == media.CLUSTER.to_bytes(4, "big") and ns % 512_000_000 == 0


@pytest.mark.parametrize("kind", [media.NO_LACE, media.XIPH, media.FIXED, media.EBML_LACE])
@pytest.mark.parametrize("simple", [True, False])
def test_every_lacing_in_clusters_of_unknown_size(kind, simple):
    frames = [b"f" * 300] * 4 if kind == media.FIXED else [bytes([i]) * n for i, n in enumerate((300, 255, 510, 0, 20, 70_000, 1))]
    frames = frames[:1] if kind == media.NO_LACE else frames
    body = media.unsigned(media.TIMESTAMP, 10) + media.element(media.VOID, b"..") + (media.block(1, -3, frames, kind) if simple else media.element(media.BLOCK_GROUP, media.block(1, -3, frames, kind, simple=False) + media.unsigned(media.REFERENCE, 1)))
    unknown = media.CLUSTER.to_bytes(4, "big") + b"\xff" + body
    file = media.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + unknown + media.element(media.CLUSTER, body) + media.element(0x4DBB, b"??")
    table, _, _ = media.packets(file)
    assert [file[a:b] for _, _, a, b, _ in table] == frames * 2
    assert all(t == 7_000_000 and key == simple for _, t, _, _, key in table)


def test_damage_never_fails():
    r = random.Random(2)
    file = media.store(bytes(20_000))
    for _ in range(300):
        bad = bytearray(file[: r.randint(0, len(file))])
        for _ in range(5):
            if bad:
                bad[r.randrange(len(bad))] = r.randrange(256)
        for _, _, a, b, _ in media.packets(bytes(bad))[0]:
            assert 0 <= a <= b <= len(bad)


def test_sound_columns_and_packet_tables(spark):
    df = spark.createDataFrame([(1, "é" * 50, "x"), (2, None, "x"), (3, "", "x"), (None, "é" * 50, "x"), (4, "a" * 100_000, "x")], "doc_id long, text string, media string")
    rows = {r["doc_id"]: r for r in media.sound_columns(df, with_media=True).collect()}
    want = "é".encode() * 50 + bytes(28)
    assert (rows[1]["n_bytes"], rows[1]["payload_bytes"], rows[1]["payload_sha256"], rows[1]["tail_crc32"]) == (100, 128, hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert rows[1]["media_sha256"] == rows[None]["media_sha256"] == hashlib.sha256(rows[1]["media"]).hexdigest() and rows[1]["media_bytes"] == len(rows[1]["media"])
    assert rows[2]["payload_sha256"] == rows[3]["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest() and rows[2]["n_bytes"] == 0
    files = spark.createDataFrame([(4, bytes(rows[4]["media"])), (5, None)], "doc_id long, media binary")
    packets = media.packet_tables(files).collect()
    assert len(packets) == 25 and sum(p["end"] - p["begin"] for p in packets) == 100_032
    assert media.sound_columns(df.limit(0)).collect() == []


def test_rows_match_a_second_writing_of_the_contract(spark):
    """Row by row from the text alone, and the payload from the stored file by a search for its frames."""
    r = random.Random(3)
    texts = {i: "".join(r.choice("aé😀 \n") for _ in range(r.choice([0, 1, 63, 64, 65, 5000, 40_000]))) for i in range(30)} | {99: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for row in media.sound_columns(df, with_media=True).collect():
        raw = (texts[row["doc_id"]] or "").encode()
        payload = raw + bytes((-len(raw) % 64) or (0 if raw else 64))
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert row["tail_crc32"] == zlib.crc32(payload[-64:])
        file = bytes(row["media"])
        assert (row["media_bytes"], row["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        at = 0
        for i in range(0, len(payload), 4096):  # packets lie in the file in order
            at = file.index(payload[i : i + 4096], at) + len(payload[i : i + 4096])
        x = np.frombuffer(payload, np.uint8).astype(float)
        said = dict(p.rsplit(" ", 1) for p in row["feature"].split("; ")[1:])
        assert abs(float(said["mean"]) - x.mean()) < 1e-5 and abs(float(said["rms"]) - np.sqrt(((x - 128) ** 2).mean())) < 1e-3
        assert int(said["crossings"]) == int(((x[1:] < 128) != (x[:-1] < 128)).sum()) and abs(float(said["seconds"]) - len(payload) / 8000) < 1e-6


# Licenses


KNOWN = {k: licenses.Template(v) for k, v in licenses.TEMPLATES.items()}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_every_template_is_found_in_a_long_text():
    r = random.Random(3)
    for name, text in licenses.TEMPLATES.items():
        around = " ".join(r.choice("thing of the and in software license a to".split()) for _ in range(400))
        body = f"{around}\n{text.upper()}\n{around}"
        found = licenses.scan(body, KNOWN, 0.8)
        assert name in [f[0] for f in found], name
        _, coverage, begin, end = next(f for f in found if f[0] == name)
        assert coverage >= 0.95 and body[begin:end].upper()[:8] == text.upper()[:8]


def test_alignment_ascends_and_stays_under_the_best():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 30))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= lcs(a, b)
    mit = KNOWN["MIT"].words
    assert len(licenses.align(mit, mit)) == len(mit)


def test_changed_words_lower_coverage_and_strangers_have_none():
    words = licenses.TEMPLATES["ISC"].split()
    for i in range(0, len(words), 10):
        words[i] = "changed"
    (got,) = [f for f in licenses.scan(" ".join(words), KNOWN, 0.8) if f[0] == "ISC"]
    assert 0.85 <= got[1] < 0.93
    assert licenses.scan("permission to use the software is hereby granted " * 5, KNOWN, 0.8) == []


def test_scans_find_what_is_planted_and_nothing_else():
    """Texts with known templates in known places; what else is found has its coverage by the best alignment there is."""
    r = random.Random(11)
    names = sorted(licenses.TEMPLATES)
    filler = "thing maker of house to run over green and tree a".split()
    for _ in range(25):
        chosen = r.sample(names, r.randint(0, 2))
        text, places = " ".join(r.choice(filler) for _ in range(r.randint(1, 60))), {}
        for n in chosen:
            places[n] = len(text) + 1
            text += " " + licenses.TEMPLATES[n] + " " + " ".join(r.choice(filler) for _ in range(r.randint(30, 60)))
        found = {f[0]: f for f in licenses.scan(text, KNOWN, 0.8)}
        words = licenses.words_of(text)
        for n, (_, coverage, begin, end) in found.items():
            assert 0.8 <= coverage <= lcs(KNOWN[n].words, words) / len(KNOWN[n].words) and 0 <= begin < end <= len(text)
        for n in chosen:
            inside = [f for f in found.values() if f[2] <= places[n] + 40 and f[3] >= places[n] + len(licenses.TEMPLATES[n]) - 40]
            assert n in found and found[n][1] == 1.0 or inside, (n, found)
        for n in names:
            if n not in found and lcs(KNOWN[n].words, words) < 0.8 * len(KNOWN[n].words):
                assert n not in chosen


def test_license_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hi. Released under the MIT License. Bye.", "x"), (3, "İ Released under the MIT License.", "x"), (None, "Licensed under CC BY-NC 4.0. " * 2000, "x")], "doc_id long, text string, licenses string")
    rows = licenses.scan_licenses(df).collect()
    assert sorted(len(r["licenses"]) for r in rows) == [0, 0, 1, 1, 1]
    assert {x["license"] for r in rows for x in r["licenses"]} == {"MIT-notice", "CC-BY-NC-4.0-notice"}
    assert next(r["licenses"][0]["begin"] for r in rows if r["licenses"] and r["doc_id"] == 3 and r["licenses"][0]["begin"] == 2)
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_op2_returns_every_license(spark, tmp_path):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0-notice"]
    texts = {1: f"{gpl} and then {mit}", 2: "no license here", 3: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in op2_licenses(spark, str(tmp_path)).collect()), key=str)
    at = len(gpl) + len(" and then ")
    assert got == [(1, 2, "GPL-3.0-notice", 1.0, 0, len(gpl) - 1), (1, 2, "MIT", 1.0, at, at + len(mit) - 1), (2, 0, *[None] * 4), (3, 0, *[None] * 4)]


# Top-k


def brute(rows, k):
    rows = list(dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)))
    out = []
    for q, a in rows:
        if q % 50 == 0:
            scored = []
            for i, b in rows:
                if i != q:
                    scored.append((-sum(int(np.floor(256.0 * float(np.float32(x)))) * int(np.floor(256.0 * float(np.float32(y)))) for x, y in zip(a, b, strict=False)), i))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_top_k_matches_brute_force(spark, block):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 0.3, 12)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(2000, rows[5][1]), (2000, rows[5][1]), (2001, None), (2050, [None] * 12), (2100, [float("nan")] * 12), (2150, [float("inf")] + [0.0] * 11), (2200, [0.25]), (2250, []), (None, [1.0])]
    df = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<float>, rank string")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block=block, query_block=3).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == brute(rows, 5)


def test_top_k_of_few_none_and_huge(spark):
    kind = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], kind)
    assert [(r["vec_id"], r["rank"], r["score"]) for r in topk.top_k(few, few.where("vec_id = 0"), 5).collect()] == [(1, 1, 256 * 512)]
    assert topk.top_k(few.limit(0), few.limit(0), 5).collect() == []
    huge = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 0.0]), (2, [1e300, 0.0])], kind)
    got = topk.top_k(huge, huge.where("vec_id = 0"), 5).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (2, 2**63 - 1)]


def test_walk_stops_early_on_proof():
    r = np.random.default_rng(6)
    x = np.floor(r.normal(0, 3, (2000, 16)))
    x[7] = 1000
    index = topk.Index(topk.Index.build(np.arange(2000), x))
    read = []
    (hit,) = topk.search(np.array([-1]), np.full((1, 16), 50.0), index, 1, read)
    assert hit[1].tolist() == [7] and hit[2].tolist() == [50 * 16_000] and len(read) < len(index.segments)


def test_later_segments_are_read_for_fewer_vectors():
    """Vectors of many lengths: those that can't be among the best leave, and results stay exact."""
    r = np.random.default_rng(7)
    x = np.floor(r.normal(0, 40, (3000, 24)) * r.lognormal(0, 1, (3000, 1)))
    queries = np.floor(r.normal(0, 40, (9, 24)))
    index = topk.Index(topk.Index.build(np.arange(3000), x))
    assert np.array_equal(index.vectors(24), x)
    read = []
    for q, ids, scores in topk.search(np.arange(-9, 0), queries, index, 5, read):
        every = x @ queries[q]
        best = np.lexsort((np.arange(3000), -every))[:5]
        assert ids.tolist() == best.tolist() and scores.tolist() == every[best].tolist()
    assert sum(read) < 0.8 * 9 * np.count_nonzero(x)
