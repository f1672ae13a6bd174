"""Personal data: spans by rule, and spans that a linear-chain conditional random field adds.

Rules give e-mail addresses, IPv4 addresses, payment cards and phone numbers in their plain forms. The field reads tokens
(digits, letters, single signs) by their word shapes and those of their neighbours, and finds other forms of the same kinds: phone
numbers without a plus, addresses spelled "name (at) host (dot) org", cards and numbers cut by dots. It is trained on a
small labelled table (text and spans), by default rows that ``seed_labels`` makes from some sentences, and decoded by
Viterbi, many stretches at a time in numpy.

Labels other than "outside" are allowed only within REACH tokens of a digit, an @ or a spelled-out sign, so tokens
further away are outside whatever the weights, the chain falls apart there exactly, and only stretches near such tokens are decoded.
What the field finds is kept if it holds what its kind needs (digits, Luhn's sum, parts up to 255, a sign and a host) and meets no span of the rules.

Training runs in one task on at most MOST_LABELLED rows (those with the smallest hash of their text); all else is by row.

Defined results: null text counts as empty and has no spans; offsets are code points, ends exclusive; spans are ordered by start,
then kind as listed; repeated rows and null ids have their own rows; an empty table gives an empty table; without labelled
rows there are the rules' spans alone; other columns, whatever their names, come back if named in ``keep``.
"""

from __future__ import annotations

import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import derived

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean>"
LABELLED = "text string, spans array<struct<kind:string,start:bigint,end:bigint>>"
#: Tokens between a token of a span and the next digit, @ or spelled-out sign.
REACH = 8
MOST_LABELLED = 5_000
#: Steps of training, their size, and the weight of the squared norm.
STEPS, RATE, NORM = 120, 0.15, 0.02

# -- rules

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is looked at once, from its beginning: from inside, it would fail or match no further.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the address pattern, from the left; every sign is looked at from the @ outwards, so time is linear."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        host = HOST.match(text, at + 1) if begin < at else None
        if host:
            end = host.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# -- tokens and features

TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|[^\w\s]|_")
#: Texts without any of these have no span.
NEAR = re.compile(r"[0-9@]|\bdot\b|\bat\b(?=\s*[\])}>])", re.IGNORECASE)
SIGNS = ("at", "dot")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
#: May a label follow another? Inside follows only begin or inside of its kind.
FOLLOWS = np.array([[not b.startswith("I") or a[1:] == b[1:] for b in LABELS] for a in LABELS])


def shape(token: str) -> str:
    first = token[0]
    if "0" <= first <= "9":
        return f"d{min(len(token), 20)}"
    if not first.isalpha():
        return token
    if token.lower() in SIGNS:
        return token.lower()
    kind = "x" if token.islower() else "X" if token.isupper() else "Xx" if token.istitle() else "xX"
    return kind + ("1" if len(token) == 1 else "s" if len(token) < 5 else "l")


def features(text: str, tokens: list[re.Match]) -> list[list[str]]:
    """Per token the names of its features: shapes of it and its neighbours, what is glued to what, the run of digits it is in."""
    shapes = [shape(t[0]) for t in tokens]
    glued = [i > 0 and tokens[i - 1].end() == t.start() for i, t in enumerate(tokens)]
    runs, tight = number_runs(tokens, 1), number_runs(tokens, 0)
    spelled = ["" if t[0][0] in "0123456789" else t[0].lower() for t in tokens]
    padded = ["<<", "<<", *shapes, ">>", ">>"]
    out = []
    for i, own in enumerate(shapes):
        near = padded[i : i + 5]
        left, right = glued[i], i + 1 < len(glued) and glued[i + 1]
        names = [
            f"s={own}", f"l={left}{right}", f"p={near[1]}", f"n={near[3]}", f"pp={near[0]}", f"nn={near[4]}",
            f"ps={near[1]}|{own}|{left}", f"sn={own}|{near[3]}|{right}", f"r={runs[i]}", f"t={tight[i]}",
        ]
        if runs[i]:
            names += [f"rs={runs[i]}|{own}", f"ts={tight[i]}|{own}"] + (["small"] if shapes[i][0] == "d" and len(tokens[i][0]) < 4 and int(tokens[i][0]) <= 255 else [])
        names += [f"w={spelled[i]}"] if spelled[i] else []
        names += [f"w{d}={spelled[i + d]}" for d in (-3, -2, -1, 1) if 0 <= i + d < len(spelled) and spelled[i + d].isalpha()]
        out.append(names)
    return out


def number_runs(tokens: list[re.Match], gap: int) -> list[str]:
    """For tokens in a stretch of digits and the signs of numbers, at most ``gap`` apart: its groups, its digits, Luhn's sum, and whether it reads as an address."""
    out, i = [""] * len(tokens), 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and (tokens[j][0][0] in "+()-./" or "0" <= tokens[j][0][0] <= "9") and (j == i or tokens[j].start() - tokens[j - 1].end() <= gap):
            j += 1
        groups = [t[0] for t in tokens[i:j] if "0" <= t[0][0] <= "9"]
        if groups:
            digits = "".join(groups)
            dotted = [t[0] for t in tokens[i:j] if t[0] == "."]
            quad = "quad" if len(groups) == 4 and len(dotted) == 3 and all(len(g) < 4 and int(g) <= 255 for g in groups) else ""
            name = f"{min(len(groups), 7)}/{min(len(digits), 20)}{'+' if tokens[i][0] == '+' else ''}{'L' if 12 <= len(digits) <= 19 and luhn(digits) else ''}{quad}"
            out[i:j] = [name] * (j - i)
        i = max(j, i + 1)
    return out


def stretches(text: str) -> list[list[re.Match]]:
    """Tokens that may be part of a span, in stretches."""
    tokens = list(TOKEN.finditer(text))
    near = [i for i, t in enumerate(tokens) if t[0][0] in "0123456789@" or t[0].lower() == "dot" or (t[0].lower() == "at" and i + 1 < len(tokens) and tokens[i + 1][0] in "])}>")]
    out: list[tuple[int, int]] = []
    for i in near:
        a, b = max(0, i - REACH), min(len(tokens), i + REACH + 1)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [tokens[a:b] for a, b in out]


# -- the field


@dataclass
class Model:
    """Features by name, their weights a label, and weights of label pairs (the last row: of first labels)."""

    known: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray


def packed(sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all tokens one after the other, and where each token's begin."""
    flat = [f for s in sequences for token in s for f in token]
    sizes = [len(token) for s in sequences for token in s]
    return np.array(flat, np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if sizes else np.empty(0, np.int64)


def emissions(model: Model, sequences: list[list[list[str]]]) -> list[np.ndarray]:
    """Per sequence a row a token: the score of each label by the token's own features. Unknown features weigh nothing."""
    known, none = model.known, len(model.known)  # the row behind the last feature holds zeros
    flat, first = packed([[[known.get(f, none) for f in token] for token in s] for s in sequences])
    scores = np.add.reduceat(np.vstack([model.weights, np.zeros(len(LABELS))])[flat], first, axis=0) if len(first) else np.empty((0, len(LABELS)))
    return np.split(scores, np.cumsum([len(s) for s in sequences])[:-1]) if sequences else []


def viterbi(model: Model, scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best labelling of each sequence; all are decoded together, the longest first, so those that have ended drop out at the end."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    allowed = np.where(FOLLOWS, model.pairs[:-1], -np.inf)
    start = np.where(FOLLOWS[0], model.pairs[-1], -np.inf)
    for begin in range(0, len(order), 512):
        some = [i for i in order[begin : begin + 512] if len(scores[i])]
        if not some:
            continue
        sizes = np.array([len(scores[i]) for i in some])
        padded = np.zeros((sizes[0], len(some), len(LABELS)))
        for b, i in enumerate(some):
            padded[: sizes[b], b] = scores[i]
        back = np.zeros((sizes[0], len(some), len(LABELS)), np.int8)
        best = start + padded[0]
        for t in range(1, sizes[0]):
            on = int(np.searchsorted(-sizes, -t, side="left"))  # sequences longer than t
            paths = best[:on, :, None] + allowed
            back[t, :on] = paths.argmax(1)
            best[:on] = paths.max(1) + padded[t, :on]
        for b, i in enumerate(some):
            at = int(best[b].argmax())
            labels = [at]
            for t in range(sizes[b] - 1, 0, -1):
                at = int(back[t, b, at])
                labels.append(at)
            out[i] = np.array(labels[::-1])
    return out


def train(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> Model:
    """Weights that make the labelled rows likely: full gradients by forward and backward sums, Adam's steps, a squared norm."""
    sequences, golds = [], []
    for text, spans in rows:
        for tokens in stretches(text):
            gold = []
            for t in tokens:
                inside = next(((k, a) for k, a, b in spans if a <= t.start() < b), None)
                gold.append(LABELS.index(("B-" if inside[1] == t.start() else "I-") + inside[0]) if inside else 0)
            sequences.append(features(text, tokens))
            golds.append(gold)
    often = Counter(f for s in sequences for token in s for f in token)
    known = {f: i for i, f in enumerate(sorted(f for f, n in often.items() if n > 2))}
    n_labels = len(LABELS)
    model = Model(known, np.zeros((len(known), n_labels)), np.zeros((n_labels + 1, n_labels)))
    if not sequences:
        return model
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sequences, golds = [sequences[i] for i in order], [golds[i] for i in order]
    sizes = np.array([len(s) for s in sequences])
    longest, many = int(sizes[0]), len(sizes)
    token_of = np.full((longest, many), -1)
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for b in range(many):
        token_of[: sizes[b], b] = firsts[b] + np.arange(sizes[b])
    on = [int((sizes > t).sum()) for t in range(longest + 1)]
    gold = np.concatenate(golds)
    flat, first = packed([[[known.get(f, len(known)) for f in token] for token in s] for s in sequences])
    owner = np.repeat(np.arange(len(gold)), np.diff(np.append(first, len(flat))))
    used = flat < len(known)
    flat, owner = flat[used], owner[used]
    pair_gold = np.zeros((n_labels + 1, n_labels))
    for g in golds:
        np.add.at(pair_gold, (np.array([n_labels, *g[:-1]]), np.array(g)), 1)
    block = np.where(FOLLOWS, 0.0, -1e9)
    theta = [model.weights, model.pairs]
    means, squares = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, STEPS + 1):
        weights, pairs = theta
        scores = np.zeros((len(gold), n_labels))
        for label in range(n_labels):
            scores[:, label] = np.bincount(owner, weights[flat, label], len(gold))
        moves = pairs[:-1] + block
        ahead = np.zeros((longest, many, n_labels))
        ahead[0] = pairs[-1] + block[0] + scores[token_of[0]]
        for t in range(1, longest):
            ahead[t, : on[t]] = total(ahead[t - 1, : on[t], :, None] + moves, 1) + scores[token_of[t, : on[t]]]
        behind = np.zeros((longest, many, n_labels))
        for t in range(longest - 2, -1, -1):
            behind[t, : on[t + 1]] = total(moves + (scores[token_of[t + 1, : on[t + 1]]] + behind[t + 1, : on[t + 1]])[:, None, :], 2)
        whole = total(ahead[0] + behind[0], 1)
        chance = np.zeros((len(gold), n_labels))
        expected = np.zeros_like(pairs)
        for t in range(longest):
            here = np.exp(ahead[t, : on[t]] + behind[t, : on[t]] - whole[: on[t], None])
            chance[token_of[t, : on[t]]] = here
            if t == 0:
                expected[-1] = here.sum(0)
            else:
                later = scores[token_of[t, : on[t]]] + behind[t, : on[t]]
                expected[:-1] += np.exp(ahead[t - 1, : on[t], :, None] + moves + later[:, None, :] - whole[: on[t], None, None]).sum(0)
        chance[np.arange(len(gold)), gold] -= 1
        slope = np.stack([np.bincount(flat, chance[owner, label], len(known)) for label in range(n_labels)], 1)
        for x, g, m, v in zip(theta, (slope + NORM * weights, expected - pair_gold + NORM * pairs), means, squares, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


# -- what the field adds


def holds(kind: str, text: str) -> bool:
    """Does a span of the field hold what its kind needs?"""
    digits = digits_of(text)
    if kind == "email":
        return bool(re.search(r"[^\W_].*(@|\bat\b).*[^\W_].*(\.|\bdot\b).*[^\W_]", text, re.IGNORECASE | re.DOTALL)) and len(text) <= 120
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not re.search(r"[^\W0-9_]", text)


def spans_of(texts: list[str | None], model: Model) -> list[list[dict]]:
    """All spans of some texts: the rules', and the field's that hold and meet none of them."""
    found = [base_spans(t) if t else [] for t in texts]
    parts = [(i, tokens) for i, t in enumerate(texts) if t and model.known and NEAR.search(t) for tokens in stretches(t)]
    named = [features(texts[i], tokens) for i, tokens in parts]
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, tokens), labels in zip(parts, viterbi(model, emissions(model, named)), strict=True):
        text, k = texts[i], 0
        while k < len(labels):
            label, begin = LABELS[labels[k]], k
            k += 1
            if label == "O":
                continue
            while k < len(labels) and LABELS[labels[k]] == "I" + label[1:]:
                k += 1
            a, b = tokens[begin].start(), tokens[k - 1].end()
            if holds(label[2:], text[a:b]) and not any(a < e and s < b for _, s, e in found[i]):
                added[i].append((label[2:], a, b))
    out = []
    for base, more in zip(found, added, strict=True):
        spans = sorted([(a, KINDS.index(k), b, True) for k, a, b in base] + [(a, KINDS.index(k), b, False) for k, a, b in more])
        out.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in spans])
    return out


def masked(text: str | None, spans: list[dict]) -> str:
    """The text with each span, or overlapping spans together, replaced by the kind of the first in angle brackets."""
    out, end = [], 0
    for s in spans:
        if s["start"] >= end:
            out += [text[end : s["start"]], f"<{s['kind'].upper()}>"]
        end = max(end, s["end"])
    return "".join(out) + (text or "")[end:]


# -- on Spark


def fit(labelled: DataFrame) -> Model:
    """A model of the labelled rows: at most MOST_LABELLED of them, by the smallest hash of their text. Null texts and spans count as empty."""
    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), "spans").orderBy(F.xxhash64("text"), "text").limit(MOST_LABELLED)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        told = sorted((t, sorted((s["kind"], int(s["start"]), int(s["end"])) for s in (spans if spans is not None else []))) for t, spans in zip(group["text"], group["spans"], strict=True))
        return pd.DataFrame({"model": [pickle.dumps(train(told))]})

    made = rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([])


def find_pii(docs: DataFrame, model: Model, keep: list[str], text: str | Column = "text", mask: bool = False) -> DataFrame:
    """Columns ``keep``, then ``spans`` and, if asked for, ``masked``, the text with spans replaced by their kinds."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as the labelled table's features, not as the documents

    def make():
        own = sent.value

        def run(texts: list) -> list[list]:
            spans = spans_of(texts, own)
            return [spans, [masked(t, s) for t, s in zip(texts, spans, strict=True)]] if mask else [spans]

        return run

    return derived(docs, keep, text, {"spans": f"array<{SPAN}>"} | ({"masked": "string"} if mask else {}), make)


def digest_pii(found: DataFrame) -> DataFrame:
    """Per row doc_id, the rules' spans of each kind, their digest, all spans as text, and how many the field has added."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


# -- the labelled table

#: Sentences around personal data and around numbers that are none. {…} names what is put there; ~ is an invented word.
SENTENCES = (
    "~ ~ {email} ~ ~", "Write to {email} or call {phone}.", "contact: {email}", "mail {email}, ~ ~", "~ <{email}> ~", "e-mail: {email}; tel. {phone}", "~ ~ {phone} ~ ~",
    "Call {phone} before noon.", "tel: {phone}", "Phone {phone} ~", "Telefon: {phone}", "Tel. {phone}, ~", "my number is {phone}", "fax {phone}", "llame al {phone} ~", "appelez le {phone} ~", "ruf {phone} an",
    "~ ~ {ip} ~ ~", "host {ip} is down", "from {ip} port {small}", "login at {ip}:{small} ~", "~ {ip}, {ip} ~", "~ ~ {card} ~ ~", "card {card} expires {date}", "Visa: {card}", "paid with {card} on {date}", "Karte {card} ~",
    "~ ~ ~ {number} ~ ~", "order {number} of {date}", "~ in {year} ~ {small} ~", "version {version} ~", "~ {date}, ~", "the {small} ~ of {year}", "{money} ~ ~", "token = \"{hex}\" ~", "id {number} ~ ~", "see pages {small}-{small}",
    "at {time} on {date} ~", "~ is at the dot ~", "ISBN {isbn}", "~ {small} + {small} = {small}", "~ ~. ~ {small}. ~", "chapter {small}.{small}.{small} ~", "~ scored {small}-{small} at ~", "{year}-{year}", "row {small} of {number}", "~ {bad_ip} ~", "~ {bad_card} ~ ~",
    "~ | {small} | {number} | ~", "~ ~ {phone} ~ {number} ~", "~ {card} ~ {bad_card} ~", "~ {email} ~ {hex} ~", "sha {hex}", "~ {money} and {money} ~", "~ {phone} {ip} ~", "{phone} {card} ~", "~ {card} {phone}", "~ {ip} {phone} ~", "~ {ip} {card} ~", "{phone} or {phone}", "~ {phone} {number} ~", "~ {number} {card} ~",
)
COPIES = 14


def invented(rnd: random.Random) -> str:
    word = "".join(rnd.choice("bcdfghlmnprstvwz") + rnd.choice("aeiouäéíó") + rnd.choice(["", "n", "r", "st", "ch"]) for _ in range(rnd.randint(1, 4)))
    return word.capitalize() if rnd.random() < 0.15 else word


def number(rnd: random.Random, n: int) -> str:
    return str(rnd.randint(1, 9)) + "".join(str(rnd.randint(0, 9)) for _ in range(n - 1))


def value(rnd: random.Random, kind: str) -> str:
    """Something of a kind, in one of its forms."""
    n = lambda k: number(rnd, k)
    if kind == "email":
        name, host = invented(rnd).lower(), invented(rnd).lower()
        name = rnd.choice([name, f"{name}.{invented(rnd).lower()}", f"{name}.{n(2)}", f"{name}_{n(1)}", f"{name}{n(2)}"])
        at = rnd.choice(["@", "@", "@", " (at) ", "[at]", " [at] ", " @ "])
        dot = "." if "@" in at else rnd.choice([".", " (dot) ", "[dot]", " [dot] "])
        return f"{name}{at}{host}{rnd.choice(['', n(1)])}{dot}{rnd.choice(['com', 'org', 'net', 'de', 'example' + dot + 'com'])}"
    if kind == "phone":
        a, b, c = n(3), n(3), n(4)
        return rnd.choice([f"+1 ({a}) {b}-{c}", f"+{n(2)} {n(3)} {n(7)}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{n(2)} {n(4)} {n(4)}", f"0{n(3)}/{n(6)}", f"00{n(2)} {n(3)} {n(3)} {n(3)}"])
    if kind == "ip":
        parts = [str(rnd.randint(0, 255)) for _ in range(4)]
        return rnd.choice([".".join(parts)] * 3 + ["[.]".join(parts)])
    if kind == "bad_ip":
        return ".".join(str(rnd.randint(256, 999)) for _ in range(4))
    if kind in ("card", "bad_card"):
        body = n(15)
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        whole = body + (last if kind == "card" else str((int(last) + rnd.randint(1, 9)) % 10))
        groups = [whole[i : i + 4] for i in range(0, 16, 4)]
        return rnd.choice([whole, whole, " ".join(groups), "-".join(groups), ".".join(groups)])
    plain = {
        "small": n(rnd.randint(1, 3)), "number": n(rnd.randint(4, 11)), "year": f"{rnd.choice([19, 20])}{rnd.randint(10, 99)}", "time": f"{rnd.randint(0, 23)}:{rnd.randint(10, 59)}",
        "date": rnd.choice([f"{rnd.randint(1, 28)}.{rnd.randint(1, 12)}.{rnd.randint(1990, 2030)}", f"20{rnd.randint(10, 30)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", f"{rnd.randint(1, 12)}/{rnd.randint(1, 28)}/{rnd.randint(1990, 2030)}"]),
        "version": f"{n(1)}.{n(2)}.{n(rnd.randint(1, 3))}", "money": rnd.choice([f"${n(3)}.{n(2)}", f"{n(2)},{n(3)}.{n(2)} EUR", f"€ {n(4)}"]), "isbn": f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}",
        "hex": "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice([32, 40, 48]))),
    }
    return plain[kind]


def seed_rows() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """COPIES rows a sentence, the same in every run."""
    rnd, out = random.Random(11), []
    for sentence in SENTENCES * COPIES:
        text, spans = "", []
        for piece in re.split(r"(~|\{\w+\})", sentence):
            if piece == "~":
                piece = " ".join(invented(rnd) for _ in range(rnd.randint(1, 4)))
            elif piece[:1] == "{":
                kind = piece[1:-1]
                piece = value(rnd, kind)
                if kind in KINDS:
                    spans.append((kind, len(text), len(text) + len(piece)))
            text += piece
        out.append((text, spans))
    return out


def seed_labels(spark: SparkSession) -> DataFrame:
    """The labelled table that this module makes: text and spans."""
    return spark.createDataFrame([(t, [{"kind": k, "start": a, "end": b} for k, a, b in s]) for t, s in seed_rows()], LABELLED)
