"""Near copies, repeats, tokens and toxicity against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from tokenizers import Tokenizer

from gneiss.llm import bpe, simhash, substrings, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_words string, kept string, block string, fp string"


def frame(spark, texts):
    rows = texts.items() if isinstance(texts, dict) else texts
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def corpus(n, seed=1):
    """Texts that share passages, with copies, near copies, runs of one word, and empty ones."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "the an of in re on ed st".split() for b in ("", "er", "ing", "Ly", "é")]
    passages = [[r.choice(words) for _ in range(r.randint(10, 60))] for _ in range(6)]
    out = {}
    for i in range(n):
        kind = r.random()
        ws = [r.choice(words) for _ in range(r.randint(0, 120))]
        if kind < 0.3 and out:
            ws = (out[r.choice(list(out))] or "").split()
            if kind < 0.15 and ws:
                ws[r.randrange(len(ws))] = "changed"
        elif kind < 0.6:
            at = r.randint(0, len(ws))
            ws[at:at] = r.choice(passages)[r.randint(0, 5) :]
        elif kind < 0.7:
            ws = ["same"] * r.randint(1, 60)
        out[i * 7 % (n * 7 + 1)] = r.choice([" ", "\n", " \t "]).join(ws) if kind < 0.97 else None
    return out


# Repeats


def repeats(texts, window=13):
    words = [(i if i is not None else 1 << 62, (t or "").encode().split()) for i, t in texts]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), sha(kept)))
    return sorted(out)


@pytest.mark.parametrize("rounds", [0, 3, 14])
def test_repeats_match_brute_force(spark, rounds):
    texts = list(corpus(150).items()) + [(None, "same " * 40), (5000, "x " * 30), (5000, "x " * 30), (5001, "x " * 13), (5002, " ".join("abcdefghijklmno")), (5003, "long " * 20_000 + "end")]
    got = substrings.remove_repeats(frame(spark, texts).repartition(5), rounds=rounds).collect()
    assert sorted((1 << 62 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == repeats(texts)


def test_repeats_keep_other_columns_and_take_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    (r,) = substrings.remove_repeats(df, keep=["lang", "text", "doc_id"]).collect()
    assert (r["lang"], r["text"], r["doc_id"], r["kept"]) == ("en", "a b", 1, "a b")
    assert substrings.remove_repeats(df.limit(0)).collect() == []


def parsed(texts):
    import pyarrow as pa

    return substrings.parse(pa.table({"doc_id": list(texts), "text": list(texts.values())}), "doc_id", "text")[0]


def test_equal_parts_have_equal_phrases():
    r = random.Random(3)
    long = [str(r.randrange(50)) for _ in range(3000)]
    p = parsed({1: "x y " + " ".join(long), 2: " ".join(long) + " z"})
    _, (names, at, _) = p.recompress(8, 13, 3)
    a, b = (set(names[p.doc[at] == d].tolist()) for d in (0, 1))
    assert len(a & b) > 0.8 * max(len(a), len(b))


def test_a_symbol_stands_wherever_its_context_does():
    """The ground for leaving windows out: what holds a symbol's context again holds the symbol again, in its place."""
    texts = corpus(200, 8) | {5000 + k: " ".join("ab"[i * k % 7 % 2] for i in range(60)) for k in range(20)}
    p = parsed(texts)
    (names, at, low, high), _ = p.recompress(14, 13, 2)
    said = [p.words[i] for i in p.local.tolist()]
    places, made = {}, {}
    for name, a, lo, hi in zip(names.tolist(), at.tolist(), low.tolist(), high.tolist(), strict=True):
        assert 0 <= lo <= a < hi <= len(said) and hi - lo <= 13 and p.doc[lo] == p.doc[hi - 1]
        made.setdefault(lo, set()).add((name, a - lo, hi - lo))
    for width in {hi - lo for lo, hi in zip(low.tolist(), high.tolist(), strict=True)}:
        for lo in range(len(said) - width + 1):
            if p.doc[lo] == p.doc[lo + width - 1]:
                places.setdefault(tuple(said[lo : lo + width]), []).append(lo)
    again = 0
    for lo, symbols in made.items():
        for name, offset, width in symbols:
            same = places[tuple(said[lo : lo + width])]
            again += len(same) > 1
            assert all((name, offset, width) in made.get(x, ()) for x in same)
    assert again > 1000


def test_few_windows_are_asked_for_themselves():
    """A text of its own asks for few windows, one that repeats another for those around its ends."""
    r = random.Random(5)
    own = {i: " ".join(str(r.randrange(4000)) for _ in range(4000)) for i in range(4)}
    p = parsed(own)
    symbols, phrases = p.recompress(14, 13, 3)
    s, f = substrings.Asked(p, *symbols[:2]), substrings.Asked(p, *phrases[:2], p.check_of(*phrases[1:]))
    import pyarrow as pa

    block = substrings.Block([memoryview(x) for x in substrings.Block.parts(pa.table({"doc_id": list(own)}), p, symbols, s, phrases, f, 5)], 13)
    repeated, is_open = block.settle([])
    assert not repeated.any() and is_open.sum() < 0.2 * len(p.local)


def test_names_that_collide_are_told_apart_by_their_checks(spark, monkeypatch):
    """All words of one name: all windows of one name, and all phrases that have one shape. Checks decide."""
    real = substrings.word_names
    texts = corpus(40, 6)
    for lost in (lambda n: np.zeros_like(n), lambda n: n % np.uint64(3)):
        monkeypatch.setattr(substrings, "word_names", lambda words, lost=lost: (lost(real(words)[0]), real(words)[1]))
        rows = parsed(texts)
        (_, at, low, high), phrases = rows.recompress(14, 13, 3)
        names, checks = rows.windows(rows.inside(13), 13)
        said = [rows.words[i] for i in rows.local.tolist()]
        by = {}
        for i, n, c in zip(rows.inside(13).tolist(), names.tolist(), checks.tolist(), strict=True):
            by.setdefault((n, c), set()).add(tuple(said[i : i + 13]))
        assert len(set(names.tolist())) < len(by) and all(len(x) == 1 for x in by.values())
        by = {}
        for n, c, i, k in zip(phrases[0].tolist(), rows.check_of(*phrases[1:]).tolist(), phrases[1].tolist(), phrases[2].tolist(), strict=True):
            by.setdefault((n, c), set()).add(tuple(said[i : i + k]))
        assert all(len(x) == 1 for x in by.values())
        asked = substrings.Asked(rows, names, rows.inside(13), checks)
        assert len(asked.names) == len({tuple(said[i : i + 13]) for i in rows.inside(13).tolist()})


def test_buckets_tell_colliding_names_apart():
    from gneiss.llm import blocks

    def ask(block, checks, ids):
        names = np.zeros(len(checks), np.uint64)
        return blocks.ask(blocks.SPAN, block, names, np.array(ids, np.int64), np.arange(len(ids)), 1, checks=np.array(checks, np.uint64))["payload"].to_pylist()

    answers = blocks.held_elsewhere(blocks.SPAN, [*ask(1, [1, 2, 3], [10, 10, 10]), *ask(2, [2, 4], [5, 5])])
    assert [np.unpackbits(np.frombuffer(a, np.uint8))[:3].tolist() for a in answers] == [[0, 1, 0], [0, 0, 0]]


def test_repeats_in_many_small_blocks_and_buckets(spark):
    texts = list(corpus(120, 12).items()) + [(10_001, None), (10_002, ""), ((1 << 60) + 1, "same " * 40), ((1 << 60) + 2, "same " * 40)]
    got = substrings.remove_repeats(frame(spark, texts).repartition(3), block_bytes=2_000, bucket_bytes=1_500).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == repeats(texts)


# Near copies


def fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    group = list(range(len(prints)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                group[find(a)] = find(b)
    return [find(x) for x in range(len(prints))]


def test_fingerprints_and_groups_match_brute_force(spark):
    texts = [*corpus(120, 5).items(), (9000, "A"), (9001, "a"), (9002, "one Two three four"), (9003, ""), (9003, ""), (None, "a"), (None, "lonely words of no id at all")]
    got = simhash.group_near(frame(spark, texts)).collect()
    prints = [fingerprint(t) for _, t in texts]
    least = {}
    groups = grouped(prints)
    for (i, _), g in zip(texts, groups, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    want = sorted(str((i, f, least[g])) for (i, _), f, g in zip(texts, prints, groups, strict=True))
    assert sorted(str((r["doc_id"], r["fp"] % (1 << 64), r["component_id"])) for r in got) == want


def test_no_link_is_lost(spark):
    r = np.random.default_rng(7)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64) * 2
    near = np.concatenate([base] + [base ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (k, 300), dtype=np.uint64), axis=0) for k in (1, 2, 3, 4)])
    prints = np.unique(near)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    roots = {x["node"]: x["root"] for x in simhash.components(simhash.near_pairs(df)).collect()}
    want = grouped([int(x) for x in prints])
    names = [roots.get(int(x), int(x)) for x in prints.view(np.int64)]
    assert len(set(zip(want, names, strict=True))) == len(set(want)) == len(set(names))


def test_dense_groups_give_a_forest():
    fp = np.unique(np.uint64(0b1111) << np.arange(0, 50, dtype=np.uint64) % 50)
    fp = np.unique(np.concatenate([fp ^ np.uint64(k) for k in range(16)]))
    assert len(fp) > simhash.DENSE
    found = [(int(fp[x]), int(fp[y])) for a, b in simhash.links(np.zeros(len(fp), np.int64), [fp]) for x, y in zip(a, b, strict=True)]
    assert len(found) < len(fp) and all((x ^ y).bit_count() <= 4 for x, y in found)
    want, names = grouped([int(x) for x in fp]), grouped_by(found, [int(x) for x in fp])
    assert len(set(zip(want, names, strict=True))) == len(set(want)) == len(set(names))


def grouped_by(pairs, nodes):
    group = {x: x for x in nodes}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in pairs:
        group[find(a)] = find(b)
    return [find(x) for x in nodes]


def test_forests_reach_what_only_a_few_link():
    """A ball of near fingerprints, and a chain that leaves it: the fewer are compared with the more."""
    r = np.random.default_rng(3)
    ball = np.uint64(0) ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 40, (2, 700), dtype=np.uint64), axis=0)
    chain = np.array([(1 << k) - 1 for k in range(3, 64, 3)], np.uint64)
    far = r.integers(0, 1 << 63, 50, dtype=np.uint64)
    fp = r.permutation(np.unique(np.concatenate([ball, chain, far])))
    found = [(int(fp[x]), int(fp[y])) for a, b in simhash.links(np.zeros(len(fp), np.int64), [fp]) for x, y in zip(a, b, strict=True)]
    want, names = grouped([int(x) for x in fp]), grouped_by(found, [int(x) for x in fp])
    assert len(set(zip(want, names, strict=True))) == len(set(want)) == len(set(names))


def test_anchors_cover():
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 21, 500)
    y = x ^ (1 << r.integers(0, 21, 500))
    wx, ax = simhash.anchors(x, 21)
    wy, ay = simhash.anchors(y, 21)
    assert all(len(simhash.anchors(z, 21, 0)[1]) == 500 for z in (x, y))
    for i in range(500):
        assert set(ax[wx == i]) & set(ay[wy == i])


def edited(words, n, r):
    """``words`` with ``n`` of them, far from each other, changed."""
    out = list(words)
    for i in range(n):
        out[10 + i * (len(out) // (n + 1))] = f"new{r.random()}"
    return " ".join(out)


def test_alike_texts_are_linked_and_others_not(spark):
    r = random.Random(4)
    texts = {}
    for i in range(120):
        base = [f"w{r.randrange(5000)}" for _ in range(200)]
        texts[3 * i], texts[3 * i + 1], texts[3 * i + 2] = " ".join(base), edited(base, 2, r), edited(base, 8, r)
    texts |= {9000: "Short", 9001: "short", 9002: "", 9003: None, 9004: "a b c d e f", 9005: "a b c d e g"}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in texts.items()}
    like = {(a, b) for a in texts for b in texts if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))}
    assert (0, 1) in like and (0, 2) not in like and (9000, 9001) in like and (9002, 9003) in like and (9004, 9005) not in like
    got = {x["doc_id"]: x["component_id"] for x in simhash.group_alike(frame(spark, texts)).collect()}
    near = {x["doc_id"]: x["component_id"] for x in simhash.group_near(frame(spark, texts)).collect()}
    assert sum(near[a] == near[b] for a, b in like) < 0.5 * len(like)
    assert sum(got[a] == got[b] for a, b in like) >= 0.95 * len(like)
    assert {(a, b) for a in got for b in got if a < b and got[a] == got[b]} <= like


def test_tiles_compare_every_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    r = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = {i: edited(base, 1, r) for i in range(60)}
    assert {x["component_id"] for x in simhash.group_alike(frame(spark, texts)).collect()} == {0}
    assert simhash.group_alike(frame(spark, {})).collect() == []


def test_near_takes_empty_tables(spark):
    assert simhash.group_near(frame(spark, {})).collect() == []


# Tokens


AWKWARD = ["", None, "<|endoftext|>", "a<|endoftext|>b <|endoftext|", "  two  spaces \n\n x", "don't we'll I'VE 'tis", "naïve 日本語 😀‍👩", "  x\u0085y​", "١٢٣ ½ Ⅷ", "\x00\x01", "tab\tend ", "x" * 3000, "é" * 500 + " 12345"]


def test_tokens_match_the_library(spark):
    t = Tokenizer.from_file(PATH)
    texts = [*corpus(60, 9).items(), *((10_000 + i, x) for i, x in enumerate(AWKWARD)), (None, "no id"), (10_000, "twice")]
    rows = bpe.encode_docs(frame(spark, texts).repartition(3), PATH, keep=["doc_id", "text"], most=2000).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False) == (r["text"] or "")
    digests = {str(r["doc_id"]): r for r in bpe.digest_docs(frame(spark, {1: "hello there"}), PATH).collect()}
    ids = t.encode("hello there", add_special_tokens=False).ids
    assert digests["1"]["ids_sha256"] == sha(np.array(ids, "<u4").tobytes()) and digests["1"]["decoded_sha256"] == sha(b"hello there")
    assert bpe.digest_docs(frame(spark, {}), PATH).collect() == []


def test_words_split_as_the_library_does_for_every_character():
    v = bpe.vocabulary(open(PATH, encoding="utf-8").read())
    split = v.tokenizer.pre_tokenizer.pre_tokenize_str
    letters = bpe.byte_letters()
    unsettled = bpe.unsettled()
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    settled = [c for c in every if not unsettled.match(c)]
    assert len(settled) > 200_000
    for i in range(0, len(settled), 400):
        text = "".join(f"a{c}1{c}{c} {c}!" for c in settled[i : i + 400])
        assert [w.encode() for w in v.word.findall(text)] == [bytes(letters[x] for x in w) for w, _ in split(text)], hex(ord(settled[i]))
    # The others are left to the library.
    assert [w.encode() for w in v.words("a\u0558 \u0558b")] == [bytes(letters[x] for x in w) for w, _ in split("a\u0558 \u0558b")]


# Toxicity


def test_classifier_learns_and_scores(spark):
    r = random.Random(4)
    words = [f"{a}{b}" for a in "tion ed the re st ing an er".split() for b in "an er the st ou le".split()]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        ws = [r.choice(words) for _ in range(40)]
        if toxic:
            for _ in range(3):
                ws[r.randrange(40)] = r.choice(["grobnik", "vlasquat", "Grobniks"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    docs = frame(spark, rows)
    lab = spark.createDataFrame([*labels, (3, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).select("doc_id", "score").collect()}
    out = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert out and all((got[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in out)
    # Held-out labels are never read: turned round, they change nothing.
    turned = spark.createDataFrame([(i, 1 - y if i in set(out) else y) for i, y in labels], "doc_id long, toxic int")
    again = toxicity.train(docs, turned)
    assert np.array_equal(again[0], model[0]) and np.allclose(again[1], model[1])
    assert {x["doc_id"] for x in docs.where(toxicity.held_out(docs.doc_id)).collect()} == set(out)


def test_scores_match_a_naive_writing(spark):
    """Features, log-count ratios and the best weights, written down again plainly; the fit has to be the optimum."""
    import math
    import re

    r = random.Random(6)
    words = [f"{a}{b}" for a in "tion ed re st ing".split() for b in "an er st".split()]
    rows = [(i, " ".join(r.choice([*words, *(["grob", "vlas"] if i % 4 == 0 else [])]) for _ in range(20))) for i in range(400)] + [(900, None)]
    labels = {i: int(i % 4 == 0) for i, _ in rows if i < 380}

    def grams(text):
        out = set()
        for w in set(re.findall(r"\w+", (text or "").lower())):
            w = f" {w} "
            out |= {zlib.crc32(w[k : k + n].encode()) % (1 << 22) for n in (3, 4, 5, 6) for k in range(len(w) - n + 1)}
        return out

    own = [(grams(t), labels[i]) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    pos, neg = sum(y for _, y in own), sum(1 - y for _, y in own)
    ratio = {}
    for g in set().union(*(x for x, _ in own)):
        p, q = sum(g in x for x, y in own if y), sum(g in x for x, y in own if not y)
        a = math.log((p + 1) / (pos + 2)) - math.log((q + 1) / (neg + 2))
        error = math.sqrt(1 / (p + 1) - 1 / (pos + 2) + 1 / (q + 1) - 1 / (neg + 2))
        if p + q >= 4 and abs(a) / error >= 4:
            ratio[g] = a
    docs = frame(spark, rows)
    which, weights, bias = toxicity.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    assert set(which.tolist()) == set(ratio) and len(ratio) > 5
    w = dict(zip(which.tolist(), weights.tolist(), strict=True))
    slope = {g: 0.3 * w[g] / ratio[g] for g in ratio}
    for x, y in own:
        p = 1 / (1 + math.exp(-bias - sum(w.get(g, 0) for g in x)))
        for g in x & set(ratio):
            slope[g] += ratio[g] * (p - y)
    assert max(map(abs, slope.values())) < 0.05
    texts = dict(rows)
    for got in toxicity.score(docs, (which, weights, bias)).collect():
        assert got["score"] == pytest.approx(1 / (1 + math.exp(-bias - sum(w.get(g, 0) for g in grams(texts[got["doc_id"]])))))


def test_classifier_without_labels_and_empty_texts(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = frame(spark, [(1, None), (2, ""), (None, "x"), (3, "y" * 100_000)])
    scores = [r["score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()]
    assert scores == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert all(0.5 < r["score"] <= 1 for r in toxicity.score(docs, toxicity.train(docs, one)).collect())
    assert toxicity.score(docs.limit(0), toxicity.train(docs, none)).collect() == []


def test_word_pattern_is_the_six_ascii_spaces():
    assert regex.findall(r"[^\x20\x09-\x0D]+", "a b c\x1cd") == [w.decode() for w in "a b c\x1cd".encode().split()]
