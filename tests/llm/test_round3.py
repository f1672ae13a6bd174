"""Personal data, periodic runs and centroid clustering, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gneiss.llm import centroids, html_extract, periodic, pii, queries

# -- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The contract's patterns as they are, with checks that are written anew."""
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_rules_against_the_patterns():
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choice("1234567890..@@ab-+ (") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_rules_are_linear_in_long_runs():
    for unit in ("a", "1", "1.", "+1 ", "a@", "a.", "0"):
        pii.base_spans(unit * 200_000)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(pii.seed_labels(spark))


def test_field_finds_other_forms_and_leaves_numbers_alone(model):
    def kinds(text):
        return [(s["kind"], text[s["start"] : s["end"]], s["base"]) for s in pii.spans_of([text], model)[0]]

    assert kinds("call me at (555) 123-4567 tomorrow") == [("phone", "(555) 123-4567", False)]
    assert kinds("jane [at] corp [dot] org") == [("email", "jane [at] corp [dot] org", False)]
    assert kinds("card 4111.1111.1111.1111 ok") == [("card", "4111.1111.1111.1111", False)]
    assert kinds("+1 (843) 555-7672 170.106.47.218") == [("phone", "+1 (843) 555-7672", False), ("ip", "170.106.47.218", True)]
    for clean in ("version 1.2.3 of 12.05.2021, page 17", 'token = "463a598be7e762208ac6a4730a37634729cbd1d2"', "he is at home; dot com", "1234567890123456 units", "in 2021, 2023 the", ""):
        assert kinds(clean) == [], clean


def test_field_on_held_out_rows():
    rows = pii.seed_rows()
    random.Random(2).shuffle(rows)
    n = len(rows) * 3 // 4
    model = pii.train(rows[:n])
    hit = false = missed = 0
    for (text, spans), found in zip(rows[n:], pii.spans_of([t for t, _ in rows[n:]], model), strict=True):
        got, want = {(s["kind"], s["start"], s["end"]) for s in found}, set(spans)
        hit, false, missed = hit + len(got & want), false + len(got - want), missed + len(want - got)
    assert hit / (hit + missed) >= 0.9 and hit / (hit + false) >= 0.9


def test_viterbi_against_all_labellings(model):
    """Over all label sequences of short token lists, none scores more than the decoded one."""
    from itertools import product

    rnd = np.random.default_rng(3)
    small = pii.Model({}, np.zeros((0, 9)), rnd.normal(size=(10, 9)))
    scores = [rnd.normal(size=(n, 9)) for n in (1, 2, 3, 4)]
    for own, best in zip(scores, pii.viterbi(small, scores), strict=True):

        def worth(labels):
            if not pii.FOLLOWS[0, labels[0]] or not all(pii.FOLLOWS[a, b] for a, b in zip(labels, labels[1:], strict=False)):
                return -np.inf
            return small.pairs[-1, labels[0]] + sum(own[t, x] for t, x in enumerate(labels)) + sum(small.pairs[a, b] for a, b in zip(labels, labels[1:], strict=False))

        assert worth(tuple(best)) == pytest.approx(max(map(worth, product(range(9), repeat=len(own)))))


def test_stretches_decode_like_whole_texts(model):
    """Cut at tokens that may not be in a span, a chain decodes the same: no label is taken beyond the reach of a number."""
    text = " ".join(["word"] * 40 + ["call", "(555) 123-4567", "now"] + ["word"] * 40)
    parts = pii.stretches(text)
    assert len(parts) == 1 and len(parts[0]) < 30
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in pii.spans_of([text], model)[0]] == [("phone", "(555) 123-4567")]


def test_pii_rows(spark, model):
    rows = [(1, "a@b.cd 1.2.3.4", "x"), (1, "a@b.cd 1.2.3.4", "x"), (None, None, None), (2, "", "é"), (3, "é é a@b.cd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.digest_pii(pii.find_pii(docs, model, ["doc_id"])).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["spans"]) for r in got) == [(0, 0, 0, ""), (1, 1, 1, "email:0:6,ip:7:14"), (1, 1, 1, "email:0:6,ip:7:14"), (2, 0, 0, ""), (3, 1, 0, "email:4:10")]
    assert {r["base_sha256"] for r in got if r["doc_id"] == 1} == {hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()}
    masks = pii.find_pii(docs, model, ["doc_id"], mask=True).where("doc_id = 3").first()
    assert masks["masked"] == "é é <EMAIL>"
    assert pii.find_pii(docs.limit(0), model, ["doc_id"]).count() == 0
    none = pii.fit(pii.seed_labels(spark).limit(0))
    assert [s["kind"] for s in pii.spans_of(["a@b.cd (555) 123-4567"], none)[0]] == ["email"]


# -- runs


def plain_runs(words, power=4, least=6):
    """All stretches of each period, without those that have a smaller one."""
    found = []
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    whole = lambda s, n, p: all(words[s + k] == words[s + k + p] for k in range(n - p))
    return sorted(((s, n, q) for s, n, q in found if not any(whole(s, n, p) for p in range(1, q))), key=lambda r: (r[0], r[2]))


def repeating(rnd):
    k, words = rnd.choice([1, 2, 3, 8]), []
    while len(words) < 70 and rnd.random() < 0.9:
        unit = [chr(97 + rnd.randrange(k)) for _ in range(rnd.randint(1, 6))]
        words += (unit * rnd.randint(1, 9))[: rnd.randint(1, 45)]
    return words


def test_runs_against_brute_force():
    rnd = random.Random(5)
    for _ in range(400):
        texts = [" ".join(repeating(rnd)) if rnd.random() < 0.95 else None for _ in range(rnd.randint(1, 6))]
        power, least = rnd.choice([(2, 2), (3, 6), (4, 6), (4, 6)])
        told, kept = periodic.texts_runs(texts, power, least)
        for text, runs, left in zip(texts, told, kept, strict=True):
            words = (text or "").split()
            want = plain_runs(words, power, least)
            assert [(r["start"], r["length"], r["period"]) for r in runs] == want
            dropped = {i for s, n, q in want for i in range(s + q, s + n)}
            assert left == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_runs_without_cuts_are_the_same():
    rnd = random.Random(6)
    for _ in range(200):
        words = repeating(rnd)
        codes = np.array([ord(w) for w in words], np.int64)
        bare = periodic.runs_in(codes, np.zeros(len(codes), np.int64), 4, 6)
        assert [(r["start"], r["length"], r["period"]) for r in periodic.texts_runs([" ".join(words)])[0][0]] == list(zip(*(x.tolist() for x in bare), strict=True))


def test_suffixes_against_sorting():
    rnd = np.random.default_rng(7)
    for n in (1, 2, 3, 17, 64, 200):
        s = np.append(rnd.integers(1, 4, n), 0)
        own = periodic.Suffixes(s)
        assert own.order.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
        a, b = np.array([(i, j) for i in range(n + 1) for j in range(n + 1) if i != j][:2000]).T
        common = [next((k for k, (x, y) in enumerate(zip(s[i:], s[j:], strict=False)) if x != y), n + 1 - max(i, j)) for i, j in zip(a, b, strict=True)]
        assert own.common(a, b).tolist() == common


def test_runs_of_a_long_text():
    words = [f"w{i}" for i in range(30_000)] + ["x", "y", "z"] * 40_000
    (runs,), (kept,) = periodic.texts_runs([" ".join(words)])
    assert runs == [{"start": 30_000, "length": 120_000, "period": 3}] and kept.split() == words[:30_003]


def test_run_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, " ".join(repeating(rnd)) if i % 3 else " ".join(str(rnd.randrange(9)) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(None, "a a a a a a a"), (700, None), (701, ""), (702, " \t\n"), (1, "b b b b b b"), (1, "b b b b b b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_runs(spark, str(tmp_path)).collect()

    def want(doc_id, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        if doc_id is not None and n:
            h = zlib.crc32(str(doc_id).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        said = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        return (doc_id, len(runs), s, m, q, None if s is None else 1000 * m // q, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())

    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted((want(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows[:300] if t)


def test_runs_with_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a a a a a a", "r", "k", "b")], "doc_id long, text string, `runs.x` string, given string, `a``b` string")
    assert periodic.find_runs(docs, ["doc_id", "runs.x", "given", "a`b"]).first()["kept"] == "a"
    assert periodic.find_runs(docs.limit(0), ["doc_id"]).count() == 0


# -- clustering


def lloyd(ids, vectors, k, rounds, salt="2"):
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"{salt}:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), vectors[i].tolist()))
    own = vectors[order[:k]].copy()
    for r in range(rounds + 1):
        far = ((vectors[:, None, :] - own[None]) ** 2).sum(2)
        at = far.argmin(1)
        if r == rounds:
            break
        for c in range(len(own)):
            if (at == c).any():
                own[c] = vectors[at == c].sum(0) // (at == c).sum()
    distance = far[np.arange(len(ids)), at]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in own.tolist()]
    return [(i, int(c), int(d), int(distance[at == c].sum()), int(distance.sum()), digests[c]) for i, c, d in zip(ids, at, distance, strict=True)]


def clustered(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size,n,k,scale", [(3, 240, 30, 4), (8, 500, 40, 60), (5, 17, 40, 10), (4, 300, 7, 1_000_000)])
def test_clusters_against_lloyd(spark, size, n, k, scale):
    rng = np.random.default_rng(size)
    vectors = (rng.normal(size=(n, size)) * scale).round().astype(np.int64)
    vectors[n // 2 :] = vectors[rng.integers(0, n // 2, n - n // 2)]  # repeats and ties
    vectors += (rng.integers(0, 4, n) * 5 * scale)[:, None]
    ids = list(range(n))
    frame = spark.createDataFrame([(i, (v / 256).tolist(), 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, cluster int").repartition(3)
    seen = []
    got = centroids.cluster_vectors(frame, k, size, 5, seen=seen)
    assert clustered(got) == sorted(lloyd(ids, vectors, k, 5), key=repr)
    assert seen[0] == n * min(k, n) and (n < 100 or sum(seen[1:]) < 5 * n * k)


def test_bounds_save_most_distances_of_settled_clusters(spark):
    rng = np.random.default_rng(4)
    vectors = rng.integers(0, 40, 2000)[:, None] * 1000 + rng.integers(-30, 30, (2000, 16))
    frame = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    seen = []
    got = centroids.cluster_vectors(frame, 40, 16, 5, seen=seen)
    assert clustered(got) == sorted(lloyd(list(range(2000)), vectors, 40, 5), key=repr)
    assert sum(seen[1:]) < 0.25 * 5 * 2000 * 40


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [3.0, 4.0]), (1, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = clustered(centroids.cluster_vectors(frame, 40, 2, 5))
    assert got == sorted(lloyd([1, None, 1], np.array([[256, 512], [768, 1024], [256, 512]]), 40, 5), key=repr)
    assert centroids.cluster_vectors(frame.limit(0), 40, 2, 5).count() == 0
    huge = spark.createDataFrame([("a", [1e300, -1e300]), ("b", [0.0, 0.0])], "vec_id string, embedding array<double>")
    assert {r["distance"] for r in centroids.cluster_vectors(huge, 2, 2, 3).collect()} == {0}


# -- main text where names mislead

STORY = "<p>" + "A story sentence goes here and tells of things. " * 3 + "</p>"
TALK = "<p>" + "I think that this comment is rather long and says a lot. " * 20 + "</p>"


@pytest.mark.parametrize(
    "html,stories",
    [
        (f'<div class="post"><h1>T</h1>{STORY}</div><div class="comments">{TALK}{TALK}</div>', 3),
        (f'<div class="post"><h1>T</h1>{STORY}{STORY}</div><div class="ad">{TALK * 4}</div>', 6),
        (f'<div class="cookie-notice">{TALK * 3}</div><div id="x"><h1>T</h1>{STORY}</div>', 3),
        (f'<main><h1>T</h1>{STORY}{STORY}</main><section class="comments"><article>{TALK}</article><article>{TALK}</article></section>', 6),
        (f'<article><h1>T</h1>{STORY}{STORY}<section class="comments"><article>{TALK}</article></section></article>', 6),
        (f'<article><h1>T</h1>{STORY}{STORY}<section class="related"><ul><li><a href="1">I think so</a></li><li><a href="2">I think not</a></li></ul></section>{STORY}</article>', 9),
        (f'<div class="comments"><article>{TALK}</article></div>', 0),
        (f"<form><div>{STORY}{STORY}</div></form>", 6),
        (f'<form><main><h1>T</h1>{STORY}</main></form><p>Made by us.</p>', 3),
        (f'<div class="content sidebar-right"><article><h1>T</h1>{STORY}{STORY}</article></div><p>Made by us.</p>', 6),
    ],
)
def test_what_names_itself_comment_or_advert_never_wins_by_size(html, stories):
    text = html_extract.main_text(f"<html><body>{html}</body></html>")
    assert text.count("A story sentence") == stories and "I think" not in text


def test_related_section_of_an_article_stays_where_it_is_text():
    text = html_extract.main_text(f'<body><article><h1>T</h1>{STORY}<section class="related">{TALK}</section>{STORY}</article></body>')
    assert text.count("A story sentence") == 6 and text.count("I think") == 20
