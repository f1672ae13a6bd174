"""Substring dedup by recompression.

Words get names, and each round names maximal runs of one symbol, then pairs of a left and a right symbol
(the round's coin on a symbol's name says which it is). A name is a hash of its round and its parts, so
equal parts have equal names in every task of every machine, and the naming of a round is global by itself.
Every symbol knows its context: the words that its making depends on. Where a text holds these words again,
it holds the symbol again; so the symbols whose context lies inside a repeat are symbols of both its places.

1. Symbols. Blocks tell buckets the symbols, of all rounds, that have ``least`` words or more and whose context
   fits into a window, and the phrases: what stands after the last round and has a window's length. Buckets
   tell which symbols are in several documents, and which phrases in one with a smaller id.
2. Windows. All windows in a phrase of a smaller document are repeats. A window that holds the context of a
   symbol which no other document has is none. What is left, around the ends of shared symbols, is named and
   asked for itself. The smallest holder of a phrase asks for its windows too, so nothing that a phrase
   settles is missing here.
3. Words under a repeated window go.

Names of phrases and windows are held together with a check, 64 bits of the words themselves by another hash:
two that agree in their names and not in their checks are different. With 10^13 distinct windows a false match
has a probability of 10^-12.

Blocks are numbered by the order in which rows meet a task, so ``docs`` has to read the same each time, as a
table does; cut lineage first where it may not. Names are dealt into buckets by their value, so many that
a bucket answers for about ``most`` bytes of text.

Defined results: ids are whole numbers, or cast to them; null text has no words; a null doc_id counts as larger
than any other; rows that share a doc_id are one document's in comparisons (never "smaller"), but each has its
own row and result; an empty table gives no row; extra columns, whatever their names, are left out or passed on
by ``keep``.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gneiss.llm import blocks as B
from gneiss.llm.common import release

WINDOW, ROUNDS, LEAST = 13, 14, 3
#: Rounds after which hardly a symbol's context fits into a window.
CERTAIN = 7
NO_ID = np.iinfo(np.int64).max
#: Fixed value: the odd number next to 2**64 over the golden ratio.
GOLDEN = 0x9E3779B97F4A7C15
#: Beyond any word; differences of two such places fit 32 bits.
FAR = np.int32(1 << 28)



def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix((a + np.uint64(salt * GOLDEN % 2**64)) * np.uint64(0xD6E8FEB86659FD93) ^ (b >> np.uint64(32)) ^ (b << np.uint64(32)))


def word_names(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A name and a check of each word: the halves of its XXH3 of 128 bits."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class Parsed:
    """The documents of a block in the order of their ids: distinct words, the places of their words among these, and where documents begin."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, words: list[bytes], local: np.ndarray):
        self.ids, self.sizes, self.words, self.local = ids, sizes, words, local
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        names, checks = word_names(words)
        self.names, self.checks = names[local], checks[local]

    def recompress(self, rounds: int, window: int, least: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Symbols (name, first word, first and past the last word of the context) and phrases (name, first word, length)."""
        sym, doc, begins, ends = self.names, self.doc, self.local, self.local
        at = np.arange(len(sym), dtype=np.int32)
        end, low, high = at + np.int32(1), at, at + np.int32(1)
        found: list[tuple[np.ndarray, ...]] = []
        for r in range(1, rounds + 1):
            if len(sym) < 2:
                break
            tracked = r <= CERTAIN
            beside = doc[1:] == doc[:-1]
            again = (sym[1:] == sym[:-1]) & beside
            made = np.zeros(len(sym), bool)
            if again.any():
                first = np.flatnonzero(np.concatenate(([True], ~again)))
                last = np.append(first[1:], len(sym)) - 1
                run = last - first + 1
                if tracked:
                    low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
                    begins, ends = begins[first], ends[last]
                sym, at, end, doc = sym[first], at[first], end[last], doc[first]
                made = run > 1
                sym[made] = pair_name(sym[made], run[made].astype(np.uint64), 2 * r)
                beside = doc[1:] == doc[:-1]
            apart = np.flatnonzero(~beside)
            if tracked:
                # No run goes on to a symbol that begins, or comes from one that ends, with another word. Else nothing is certain.
                low = np.minimum(low, at - np.int32(1))
                high = np.maximum(high, end + np.int32(1))
                low[1:][(ends[1:] == ends[:-1]) | ~beside] = -FAR
                high[:-1][(begins[1:] == begins[:-1]) | ~beside] = FAR
                low[0], high[-1] = -FAR, FAR
            coin = (sym >> np.uint64(r) & np.uint64(1)).astype(bool)
            left = np.append(~coin[:-1] & coin[1:] & beside, False)
            stays = np.flatnonzero(np.concatenate(([True], ~left[:-1])))
            i = np.flatnonzero(left)
            if tracked:
                # A left symbol depends on what is to its right, a right one that stays on what is to its left: they pair, or could have.
                near_low, near_high = np.empty_like(low), np.empty_like(high)
                near_low[:-1], near_low[-1], near_high[:-1], near_high[-1] = low[1:], -FAR, high[1:], FAR
                near_low[apart], near_high[apart] = -FAR, FAR
                alone = np.flatnonzero(coin)
                near_low[alone], near_high[alone] = low[alone - 1], high[alone - 1]
                edge = alone[np.concatenate(([True], ~beside))[alone]]
                near_low[edge], near_high[edge] = -FAR, FAR
                low, high = np.minimum(low, near_low)[stays], np.maximum(high, near_high)[stays]
                ends = ends.copy()
                ends[i] = ends[i + 1]
                begins, ends = begins[stays], ends[stays]
            named, end = sym.copy(), end.copy()
            named[i] = pair_name(sym[i], sym[i + 1], 2 * r + 1)
            end[i] = end[i + 1]
            made |= left
            sym, at, end, doc = named[stays], at[stays], end[stays], doc[stays]
            if tracked:
                use = np.flatnonzero(made[stays] & (high - low <= window) & (end - at >= least))
                found.append((sym[use], at[use], low[use], high[use]))
        length = end - at
        long = length >= window
        symbols = tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), *[np.empty(0, np.int32)] * 3)
        return symbols, (sym[long], at[long], length[long])

    def check_of(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of stretches of words: a polynomial of their checks."""
        power = np.cumprod(np.full(len(self.checks), GOLDEN, np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.checks * power, dtype=np.uint64)))
        back = np.cumprod(np.full(len(self.checks) + 1, pow(GOLDEN, -1, 2**64), np.uint64))
        return mix((sums[at + length] - sums[at]) * back[at])

    def windows(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Names and checks of the windows that begin at ``at``."""
        name, check = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for j in range(window):
            name = name * np.uint64(GOLDEN) + self.names[at + j]
            check = check * np.uint64(0xD6E8FEB86659FD93) + self.checks[at + j]
        return mix(name), mix(check)

    def inside(self, window: int) -> np.ndarray:
        """Where windows begin that lie in one document."""
        n = len(self.names) - window + 1
        return np.flatnonzero(self.doc[:n] == self.doc[window - 1 :]) if n > 0 else np.empty(0, np.int64)


class Asked:
    """Distinct names in order, with their checks, if any; the smallest holder of each, and whether it has several; and each occurrence's place among them."""

    def __init__(self, p: Parsed, names: np.ndarray, at: np.ndarray, checks: np.ndarray | None = None):
        doc = p.doc[at]
        order = np.lexsort((doc, names)) if checks is None else np.lexsort((doc, checks, names))
        names, doc = names[order], doc[order]
        new = np.concatenate(([True], names[1:] != names[:-1])) if len(names) else np.empty(0, bool)
        if checks is not None:
            checks = checks[order]
            new[1:] |= checks[1:] != checks[:-1]
        first = np.flatnonzero(new)
        self.names, self.checks = names[first], None if checks is None else checks[first]
        self.holder = doc[first]
        self.several = p.ids[doc[np.append(first[1:], len(names)) - 1]] != p.ids[self.holder] if len(first) else np.empty(0, bool)
        self.place = np.empty(len(names), np.int64)
        self.place[order] = np.cumsum(new) - 1

    def later(self, p: Parsed, at: np.ndarray, smaller: np.ndarray) -> np.ndarray:
        """Whether each occurrence stands in a document with a larger id than the name's smallest holder."""
        return smaller[self.place] | (p.ids[p.doc[at]] > p.ids[self.holder][self.place])


def parse(rows: pa.Table, id_column: str, text: str) -> tuple[Parsed, np.ndarray]:
    """The block's words, frequent ones first, and the order of its rows by id."""
    ids = rows[id_column].combine_chunks().cast(pa.int64())
    ids = np.where(ids.is_null().to_numpy(zero_copy_only=False), NO_ID, ids.fill_null(0).to_numpy(zero_copy_only=False))
    order = np.argsort(ids, kind="stable")
    texts = rows[text].combine_chunks().to_pylist()
    seen: dict[bytes, int] = {}
    place = seen.setdefault
    local, sizes = array("i"), []
    for i in order.tolist():
        words = (texts[i] or "").encode().split()
        sizes.append(len(words))
        local.extend([place(w, len(seen)) for w in words])
    words, local = B.frequent_first(list(seen), np.frombuffer(local, np.int32) if local else np.empty(0, np.int32))
    return Parsed(ids[order], np.array(sizes, np.int64), words, local.astype(np.int32)), order


def stretches(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places some stretch from begin to before end covers."""
    return np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0


class Block:
    """A block as it is shuffled: its rows, its words, and what it takes to read the answers about its symbols and phrases."""

    def __init__(self, parts: list[memoryview], window: int):
        self.window = window
        self.rows, words, *arrays, self.several = parts
        ids, sizes, local, self.symbol_bounds, self.symbol_place, low, span, self.phrase_bounds, self.phrase_place, self.at, self.length, self.holder = (B.expand_array(x, k) for x, k in zip(arrays, (np.int64, np.uint32, np.uint32, np.int64, np.uint32, np.uint32, np.uint8, np.int64, np.uint32, np.uint32, np.uint32, np.uint32), strict=True))
        self.p = Parsed(ids, sizes.astype(np.int64), zstandard.decompress(words).split(), local)
        self.low = np.cumsum(low, dtype=np.int64)
        self.high = self.low + span

    @staticmethod
    def parts(rows: pa.Table, p: Parsed, symbols: tuple[np.ndarray, ...], s: Asked, phrases: tuple[np.ndarray, ...], f: Asked, buckets: int) -> list[bytes]:
        _, _, low, high = symbols
        order = np.argsort(low, kind="stable")
        arrays = (
            *(p.ids, p.sizes.astype(np.uint32), p.local.astype(np.uint32)),
            *(B.bucket_bounds(s.names, buckets), s.place[order].astype(np.uint32), np.diff(low[order], prepend=np.int32(0)).astype(np.uint32), (high - low)[order].astype(np.uint8)),
            *(B.bucket_bounds(f.names, buckets), f.place.astype(np.uint32), phrases[1].astype(np.uint32), phrases[2].astype(np.uint32), f.holder.astype(np.uint32)),
        )
        return [B.squeeze(rows), zstandard.compress(b" ".join(p.words), 3), *map(B.squeeze_array, arrays), np.packbits(s.several).tobytes()]

    def settle(self, told: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """By the answers on symbols and phrases: which windows are repeats, and which are to be asked for (both by their first words)."""
        p, n = self.p, len(self.p.names)
        smaller = B.bits_of(told, B.PHRASE, self.phrase_bounds)[self.phrase_place] | (p.ids[p.doc[self.at]] > p.ids[self.holder][self.phrase_place])
        begin = self.at[smaller].astype(np.int64)
        repeated = stretches(begin, begin + self.length[smaller] - self.window + 1, n)
        names = int(self.symbol_bounds[-1])
        shared = B.bits_of(told, B.SYMBOL, self.symbol_bounds) | np.unpackbits(np.frombuffer(self.several, np.uint8), count=names).astype(bool)
        single = ~shared[self.symbol_place]
        unique = stretches(np.maximum(self.high[single] - self.window, 0), self.low[single] + 1, n)
        is_open = np.zeros(n, bool)
        is_open[p.inside(self.window)] = True
        return repeated, is_open & ~repeated & ~unique

    def ask_windows(self, is_open: np.ndarray) -> tuple[Asked, np.ndarray]:
        at = np.flatnonzero(is_open)
        names, checks = self.p.windows(at, self.window)
        return Asked(self.p, names, at, checks), at

    def kept(self, told: list[tuple[int, int, bytes]], buckets: int) -> list[np.ndarray]:
        """For each document in order: which words stay."""
        repeated, is_open = B.remembered(told, len(self.p.names), 2)
        asked, at = self.ask_windows(is_open)
        repeated[at] |= asked.later(self.p, at, B.bits_of(told, B.SPAN, B.bucket_bounds(asked.names, buckets)))
        step = np.concatenate(([0], np.cumsum(repeated)))
        covered = step[1:] - step[np.maximum(np.arange(1, len(step)) - self.window, 0)] > 0
        return np.split(~covered, self.p.starts[1:-1])


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS, least: int = LEAST, prefix: str = "", block_bytes: int = B.BLOCK_BYTES, bucket_bytes: int = B.BUCKET_BYTES) -> DataFrame:
    """Columns ``keep`` (the id alone), n_words, n_removed, kept_sha256 and kept (the words that stay, joined by a space).

    ``prefix`` stands before the last four names, for tables that have such columns themselves. The text column
    comes as it was, if ``keep`` names it. A task holds some blocks of ``block_bytes`` of text, or a bucket's
    questions; ``bucket_bytes`` of text make a bucket.
    """
    keep = [id_column] if keep is None else keep
    used = list(dict.fromkeys([id_column, text, *keep]))
    buckets = B.buckets_for(docs, text, bucket_bytes)
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField(prefix + c, k) for c, k in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.StringType()))])

    def recompress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in B.in_blocks(batches, text, block_bytes):
            p, order = parse(rows, id_column, text)
            symbols, phrases = p.recompress(rounds, window, least)
            s, f = Asked(p, *symbols[:2]), Asked(p, *phrases[:2], p.check_of(*phrases[1:]))
            yield from B.block_row(block, buckets, *Block.parts(rows.select(keep).take(pa.array(order)).combine_chunks(), p, symbols, s, phrases, f, buckets)).to_batches()
            yield from B.ask(B.SYMBOL, block, s.names, p.ids, s.holder, buckets, several=s.several).to_batches()
            yield from B.ask(B.PHRASE, block, f.names, p.ids, f.holder, buckets, checks=f.checks).to_batches()
        release()

    def answer(rows: pa.Table) -> pa.Table:
        return B.answers(rows, (B.SYMBOL, B.PHRASE, B.SPAN), buckets, B.held_elsewhere)

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = [B.rows_of(B.ASKED, bucket=[], block=[], kind=[], payload=[])]
        for number, parts, told in B.blocks_of(left, right):
            block = Block(parts, window)
            repeated, is_open = block.settle(told)
            a, _ = block.ask_windows(is_open)
            asked += [B.ask(B.SPAN, number, a.names, block.p.ids, a.holder, buckets, checks=a.checks), B.memo(number, [repeated, is_open], buckets)]
        release()
        return pa.concat_tables(asked)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        done = [pa.table({f"c{i}": pa.array([], to_arrow_type(f.dataType)) for i, f in enumerate(out)})]
        for _, parts, told in B.blocks_of(left, right):
            block = Block(parts, window)
            p = block.p
            stays = block.kept(told, buckets)
            words = np.array(p.words, object)
            said = [b" ".join(words[p.local[a:b][k]].tolist()) for a, b, k in zip(p.starts[:-1].tolist(), p.starts[1:].tolist(), stays, strict=True)]
            columns = [*B.expand(block.rows).columns, pa.array(p.sizes, pa.int64()), pa.array([int(len(k) - k.sum()) for k in stays], pa.int64())]
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in said], pa.string()), pa.array(said, pa.binary()).cast(pa.string())]
            done.append(pa.table({f"c{i}": c.cast(to_arrow_type(f.dataType)) for i, (c, f) in enumerate(zip(columns, out, strict=True))}))
        release()
        return pa.concat_tables(done).rename_columns([f.name for f in out])

    # Blocks and questions are dealt in one shuffle, planned three times and run once.
    first = B.dealt(docs.select(*(F.col(f"`{c}`") for c in used)).mapInArrow(recompress, B.ASKED), buckets)
    told = B.dealt(first.groupBy("bucket").applyInArrow(answer, B.TOLD), buckets, "home")
    second = B.dealt(first.groupBy("bucket").cogroup(told.groupBy("home")).applyInArrow(ask_windows, B.ASKED), buckets)
    told = B.dealt(second.groupBy("bucket").applyInArrow(answer, B.TOLD), buckets, "home")
    return first.groupBy("bucket").cogroup(told.groupBy("home")).applyInArrow(finish, out)
