"""SimHash near-duplicates by anchor points.

Fingerprints. Texts are lower-cased (A to Z), cut into words at ASCII white space, and into shingles of
``shingle`` words, repeats included; a text with fewer words is one shingle, one without words has the
fingerprint 0. A bit of the fingerprint is set if it is set in over half of the shingles' XXH64.

Pairs. The 64 bits are cut into parts so that fingerprints within ``near`` bits agree on some part
but for one spare bit. In each part the words of a covering code are the anchors: the perfect Hamming
code [15, 11] on the part's first 15 bits (every pattern is within 1 bit of a code word) and every
pattern of its other bits. A fingerprint is replicated to each anchor within covering radius + spare
bits. Of two fingerprints within the spare bits, one lies within the radius of some anchor, and the
other within radius + spare of it, so they meet there; what meets is compared on all 64 bits.

Copies share a fingerprint, which is replicated once for all of them. An anchor's distinct fingerprints
meet in one task, 16 bytes each, and are compared on arrays; where many meet, each found component is
taken out of the rest as it grows, so a group of near copies costs about its size. A task's links leave
it as stars, one link a fingerprint at the most, however many were found. Links are told in terms of the smallest doc_id of each fingerprint,
and components are found by rounds of large and small stars, cut by checkpoints, never on the driver.

Defined results: null text is empty; a null doc_id is linked but is no component's id (null if a
component has none other); repeated rows have a row each; an empty table gives no row; doc_id may be of
any type that has an order and comes back as it is; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import cut, derived, forget, release, shared_folder

SHINGLE, NEAR, SEED = 4, 4, 42
#: First bit and width of each part. Two fingerprints within 4 bits are within 1 on one of three parts.
PARTS = ((0, 22), (22, 21), (43, 21))
CODE_BITS = 15
DENSE = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    last = (ends[shingle - 1 :] - 1).tolist()
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, last, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, text) -> doc_id, fp (the fingerprint as a signed long)."""

    def make() -> Callable[[list], list[list]]:
        return lambda texts: [np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)]

    return derived(docs, [id_column], F.col(text), {"fp": "long"}, make).withColumnRenamed(id_column, "doc_id")


def _syndrome_flip() -> np.ndarray:
    """For each 15-bit pattern, the bit to flip for its code word (0: it is one). Bit i has the syndrome i + 1."""
    x = np.arange(1 << CODE_BITS)
    s = np.zeros(len(x), np.int64)
    for i in range(CODE_BITS):
        s ^= np.where(x >> i & 1, i + 1, 0)
    return np.where(s > 0, 1 << (s - 1).clip(0), 0)


FLIP = _syndrome_flip()


def anchors(values: np.ndarray, width: int, spare: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Each value of a part with every anchor it is replicated to: indexes of the values, and the anchors.

    An anchor within radius + spare bits is the code word of a pattern that is ``spare`` bits off; without a
    spare bit it is the value's own code word alone, as the code is perfect.
    """
    low = (1 << CODE_BITS) - 1
    offsets = np.array([0, *(1 << i for i in range(width))], np.int64)[: 1 + spare * width]
    near = values[:, None] ^ offsets[None, :]
    own = near & low
    words = (near & ~low) | (own ^ FLIP[own])
    if not spare:
        return np.arange(len(values)), words[:, 0]
    words.sort(axis=1)
    new = np.concatenate((np.ones((len(words), 1), bool), words[:, 1:] != words[:, :-1]), axis=1)
    which, _ = np.nonzero(new)
    return which, words[new]


def _apart(words: list[np.ndarray], a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Differing bits of fingerprints, whose words are arrays of their own."""
    return sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int32) for w in words)


def links(anchor: np.ndarray, words: list[np.ndarray], near: int = NEAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links, as places, among fingerprints that share an anchor; where over DENSE do, a spanning forest of them. Sorted by anchor."""
    begin = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.empty(0, np.int64)
    sizes = np.diff(np.append(begin, len(anchor)))
    end = np.repeat(begin + sizes, sizes)
    at = np.flatnonzero(np.repeat(sizes <= DENSE, sizes))
    for step in range(1, DENSE):
        at = at[at + step < end[at]]
        if not len(at):
            break
        hit = at[_apart(words, at, at + step) <= near]
        if len(hit):
            yield hit, hit + step
    for lo, n in zip(begin[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist(), strict=True):
        yield from forest(np.arange(lo, lo + n), words, near)


def forest(rest: np.ndarray, words: list[np.ndarray], near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links in ``rest``: what is reached is compared with what isn't yet, the fewer one by one with all the others."""
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = [rest[:0]]
            if len(front) <= len(rest):
                for f in front.tolist():
                    hit = _apart(words, rest, f) <= near
                    if hit.any():
                        reached.append(rest[hit])
                        yield np.full(len(reached[-1]), f), reached[-1]
                        rest = rest[~hit]
            else:
                got = np.zeros(len(rest), bool)
                for i, r in enumerate(rest.tolist()):
                    hit = np.flatnonzero(_apart(words, front, r) <= near)
                    if len(hit):
                        got[i] = True
                        yield front[hit[:1]], rest[i : i + 1]
                reached.append(rest[got])
                rest = rest[~got]
            front = np.concatenate(reached)


#: How many linked fingerprints a task remembers before it tells of their links.
MOST_LINKED = 500_000


class Stars:
    """The components of a task's links as they come: in the end each node has one link, to its component's smallest."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (over := up.setdefault(x, x)) != x:
            up[x] = over = up[over]
            x = over
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack((a, b), axis=1), axis=0)
        for x, y in pairs.tolist():
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def told(self) -> pd.DataFrame:
        nodes = list(self.up)
        return pd.DataFrame({"a": np.array([self.root(x) for x in nodes], np.int64), "b": np.array(nodes, np.int64)})


def folded(pairs: DataFrame) -> DataFrame:
    """Links (a, b), a < b -> the same components by fewer links.

    Links of one larger end meet in a task and leave as stars of what they join: a node then has one link a task, not one for
    each task that knew it. Centers are smallest nodes, so it is leaves that are dealt, evenly however large a star is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Stars()
        for rows in batches:
            known.add(rows["a"].to_numpy(), rows["b"].to_numpy())
            if len(known.up) > MOST_LINKED:
                yield known.told()
                known = Stars()
        yield known.told()
        release()

    return pairs.repartition("b").mapInPandas(run, "a long, b long").where("a <> b")


def _met(replicas: DataFrame, columns: list[str], near: int) -> DataFrame:
    """(anchor, fingerprint words ``columns``) -> links (a, b) in terms of the first word, a < b: of each task's, what joins its components."""
    parts = int(replicas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["anchor", *columns]

    def linked(pieces: list[list[np.ndarray]], known: Stars) -> None:
        anchor, *words = (np.concatenate(x) for x in zip(*pieces, strict=True))
        words = [w.view(np.uint64) for w in words]
        for a, b in links(anchor, words, near):
            known.add(words[0][a].view(np.int64), words[0][b].view(np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[np.ndarray]] = []
        known = Stars()
        for rows in batches:
            now = [rows[c].to_numpy() for c in names]
            full = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # whole anchors only
            if full or (held and len(now[0]) and held[-1][0][-1] != now[0][0]):
                linked([*held, [x[:full] for x in now]], known)
                held = []
            if len(now[0]):
                held.append([x[full:] for x in now])
            if len(known.up) > MOST_LINKED:
                yield known.told()
                known = Stars()
        if held:
            linked(held, known)
        yield known.told()
        release()

    met = replicas.repartition(parts, "anchor").sortWithinPartitions("anchor")
    # once for the leaves that several tasks know, once for the centers these leaves join
    return folded(folded(met.mapInPandas(run, "a long, b long").where("a <> b")))


def near_pairs(prints: DataFrame, near: int = NEAR) -> DataFrame:
    """(fp), distinct -> links (a, b), a < b, enough of them to give every component of links within ``near`` bits."""
    if near // len(PARTS) > 1:
        raise ValueError(f"{len(PARTS)} parts with a spare bit find links of up to {len(PARTS) * 2 - 1} bits")

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 20_000):
                fp = b["fp"].to_numpy()[i : i + 20_000]
                for part, (first, width) in enumerate(PARTS):
                    which, anchor = anchors((fp.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1), width)
                    yield pd.DataFrame({"anchor": anchor << 2 | part, "fp": fp[which]})

    return _met(prints.select("fp").mapInPandas(replicate, "anchor long, fp long"), ["fp"], near)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a, b) -> node, root: the smallest node of each component.

    Alternating large and small stars (Kiveris and others, 2014): every round moves links to smaller
    nodes; the links form stars, and are done, when a round leaves them as they were.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (now["n"], now["h"]) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (now["n"], now["h"])
    raise RuntimeError(f"links aren't stars after {rounds} rounds")


def _node(name: str, *more: Column) -> Column:
    """Of some rows with a doc_id: the smallest, nulls last, and what else it has; a fingerprint's or text's place among all."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *more)).alias(name)


def _classes(known: DataFrame, name: str, pairs: DataFrame) -> DataFrame:
    """known(name, node), links (a, b) between names -> name, root, component_id: the smallest node of the component, and its doc_id.

    A node begins with its smallest doc_id, so the smallest node of a component is its id: no join by component.
    """
    ends = known.select(F.col(name).alias("is"), "node")
    edges = pairs.join(ends.select(F.col("is").alias("a"), F.col("node").alias("x")), "a").join(ends.select(F.col("is").alias("b"), F.col("node").alias("y")), "b")
    roots = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    met = known.join(roots, known["node"] == roots["node"], "left")
    return met.select(name, F.coalesce(roots["root"], known["node"]).alias("root")).withColumn("component_id", F.col("root")["id"])


def group_near(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, near: int = NEAR, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, text) -> doc_id, fp, component_id."""
    prints = cut(fingerprints(docs, text, shingle, id_column))
    known = cut(prints.groupBy("fp").agg(_node("node")).select("fp", F.struct("node.none", "node.id", "fp").alias("node")))
    classes = _classes(known, "fp", near_pairs(known, near))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


# Near copies by similarity: anchors find candidates, shingles decide.

#: Words of a shingle and the least Jaccard similarity of two texts' shingles.
WIDE_SHINGLE, ALIKE = 5, 0.8
#: A wide fingerprint has eight words of 64 bits. What meets is compared on the first two of them.
#: Texts with a similarity of 0.8 differ in about 15 % of the bits, so in 19 of 128.
WIDE_WORDS, WIDE_NEAR = 8, 34
#: Each part is some 22 of the bits, 15 of them coded, without a spare bit: an anchor is its whole cell of the perfect code. Two
#: texts with a similarity of 0.8 meet in a part with a chance of 4.7 %, in one of all parts with 99 %; others with 1 in 262,144.
WIDE_PARTS, WIDE_BITS = 96, 22
#: A tile of a large component has about so many texts, or shingles, at most.
TILE, TILE_SHINGLES = 1024, 2_000_000


def shingles(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """XXH64 of a text's distinct shingles, sorted. A text with fewer words is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    last = (ends[-n:] - 1).tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, last, strict=True)), np.uint64, n))


def _mixed(h: np.ndarray) -> np.ndarray:
    """The words of each hash (the finalizer of splitmix64)."""
    out = h[:, None] + np.arange(1, WIDE_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = (out ^ out >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ out >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return out ^ out >> np.uint64(31)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """A bit is set if most distinct shingles set it; where as many do as don't, the smallest shingle decides."""
    if not len(h):
        return np.zeros(WIDE_WORDS, np.uint64)
    ones = np.zeros(64 * WIDE_WORDS, np.int64)
    for i in range(0, len(h), 8_192):
        ones += np.unpackbits(_mixed(h[i : i + 8_192]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    first = np.unpackbits(_mixed(h[:1]).view(np.uint8), axis=1, bitorder="little")[0]
    return np.packbits(ones * 2 + first > len(h), bitorder="little").view(np.uint64)


def _chosen() -> np.ndarray:
    """The bits of each part: 22 of all, drawn once for all."""
    draw = np.random.default_rng(SEED)
    return np.array([draw.permutation(64 * WIDE_WORDS)[:WIDE_BITS] for _ in range(WIDE_PARTS)])


def _cells(words: np.ndarray) -> np.ndarray:
    """Wide fingerprints -> for each part, a row, the anchor of each fingerprint with the part's number."""
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    out = np.empty((WIDE_PARTS, len(words)), np.int64)
    for k, of in enumerate(_chosen()):
        value = bits[:, of].astype(np.int64) @ (1 << np.arange(WIDE_BITS))
        out[k] = anchors(value, WIDE_BITS, 0)[1] << 7 | k
    return out


def _sketches(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """(doc_id, text) -> doc_id, said (a hash of the text), own (one of its set of shingles), n (their number), print (its words) and the first of them."""

    def make() -> Callable[[list], list[list]]:
        def sketched(texts: list) -> list[list]:
            sets = [shingles(t) for t in texts]
            own = np.fromiter((xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets), np.uint64, len(sets)).view(np.int64)
            prints = [wide_fingerprint(h) for h in sets]
            return [own, [len(h) for h in sets], [int(p.view(np.int64)[0]) for p in prints], [p.tobytes() for p in prints]]

        return sketched

    given = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("said"))
    return derived(given, ["doc_id", "said"], F.col("t"), {"own": "long", "n": "long", "first": "long", "print": "binary"}, make)


def _candidates(known: DataFrame) -> DataFrame:
    """(print), distinct -> links (a, b) between first words: a spanning forest of what meets at an anchor and is near."""

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2_000):
                words = np.frombuffer(b"".join(b["print"].iloc[i : i + 2_000]), np.uint64).reshape(-1, WIDE_WORDS)
                cells = _cells(words)
                x, y = (np.tile(words[:, k].view(np.int64), WIDE_PARTS) for k in (0, 1))
                yield pd.DataFrame({"anchor": cells.ravel().astype(np.int32), "x": x, "y": y})

    return _met(known.mapInPandas(replicate, "anchor int, x long, y long"), ["x", "y"], WIDE_NEAR)


def alike(sets: list[np.ndarray], least: float = ALIKE) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is ``least`` or more, exactly."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    rest = np.arange(len(sets))
    marked = np.zeros(len(names), bool)
    while len(rest):
        front, rest = rest[:1].tolist(), rest[1:]
        while front and len(rest):
            f = front.pop()
            own = flat[ends[f] - sizes[f] : ends[f]]
            marked[own] = True
            # neither set may be smaller than ``least`` of the other
            able = rest[np.minimum(sizes[rest], sizes[f]) >= least * np.maximum(sizes[rest], sizes[f])]
            both = np.fromiter((np.count_nonzero(marked[flat[ends[i] - sizes[i] : ends[i]]]) for i in able), np.int64, len(able))
            marked[own] = False
            hit = able[both >= least * (sizes[able] + sizes[f] - both)]
            if len(hit):
                yield from ((f, i) for i in hit.tolist())
                front += hit.tolist()
                rest = rest[~np.isin(rest, hit)]


def _verified(docs: DataFrame, members: DataFrame, text: str, id_column: str) -> DataFrame:
    """members(id, said, own, root, tiles) -> links (a, b) between sets of shingles that are alike.

    A component of candidates is cut into tiles, and every two of them meet in a group of their own. A set's
    text is read from the row of its smallest doc_id, so copies aren't gathered.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                yield pd.DataFrame({"own": part["own"], "root": part["root"], "tiles": part["tiles"], "h": [shingles(t).tobytes() for t in part["t"]]})

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["own"].to_numpy()
        found = [*alike([np.frombuffer(h, np.uint64) for h in rows["h"]])]
        return pd.DataFrame({"a": [own[i] for i, _ in found], "b": [own[j] for _, j in found]}, dtype="int64")

    given = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("said"), F.col(text).alias("t"))
    same = given["id"].eqNullSafe(members["id"]) & (given["said"] == members["said"])
    texts = given.join(members, same).select("own", "root", "tiles", "t").dropDuplicates(["own"])
    sets = texts.mapInPandas(read, "own long, root long, tiles long, h binary")
    mine = F.pmod("own", "tiles")
    dealt = sets.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "own", "h")
    found = dealt.groupBy("root", "i", "j").applyInPandas(compared, "a long, b long")
    return folded(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def group_alike(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, text) -> doc_id, said (its text's XXH64 by Spark), root (the component's name), component_id: texts whose five-word shingles have a Jaccard similarity of 0.8 or more are linked.

    Only what anchors bring together is compared; what is linked is so exactly. Nulls, repeats, empty tables,
    types of doc_id and other columns are as in ``group_near``.
    """
    spark = docs.sparkSession
    prints = cut(_sketches(docs, text, id_column))
    known = prints.groupBy("own").agg(_node("node", F.col("said")), F.min("n").alias("n"), F.min("first").alias("first"), F.min("print").alias("print"))
    known = cut(known.select("own", "n", "first", "print", F.struct("node.none", "node.id", "own").alias("node"), F.col("node.said").alias("said")))
    roots = components(_candidates(known.select("print").distinct()))
    rooted = known.join(roots, known["first"] == roots["node"], "left").select("own", known["node"]["id"].alias("id"), "said", "n", F.coalesce("root", "first").alias("root"))
    sizes = rooted.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles")).where("texts > 1")
    tiles = F.ceil(F.greatest(F.col("texts") / TILE, F.col("shingles") / TILE_SHINGLES)).alias("tiles")
    at = f"{shared_folder(spark)}/members-{uuid.uuid4().hex}"  # as files, so the optimizer knows their size
    rooted.join(sizes, "root").select("id", "said", "own", "root", tiles).write.parquet(at)
    classes = _classes(known.select("own", "node"), "own", _verified(docs, spark.read.parquet(at), text, id_column))
    forget(spark, at)
    return prints.select("doc_id", "said", "own").join(classes, "own").select("doc_id", "said", "root", "component_id")
