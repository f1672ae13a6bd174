"""BPE encoding and decoding by a table of distinct words.

Blocks split their texts into words as the tokenizer's byte-level pattern does and keep, for each text,
the places of its words in the block's list of distinct words. The lists are dealt by word into buckets;
a bucket meets a word once however often texts hold it, encodes it once, and tells each block the
word's ids. Ids are then joined back by position. Decoding joins ids to pieces, each distinct word of a
block once, and puts the pieces' bytes together by position; bytes that aren't UTF-8 become U+FFFD.

The vocabulary, of fixed size, is the only thing broadcast. Texts aren't shuffled: what moves is a
number a word.

Blocks are numbered by the order in which rows meet a task, so ``docs`` has to read the same each time, as a
table does; cut lineage first where it may not.

Defined results: null text is empty and has no ids; the special tokens' own strings in a text become
their ids, as the library does by default; repeated rows have a row each; an empty table gives no row.
"""

from __future__ import annotations

import functools
import hashlib
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gneiss.llm import blocks as B
from gneiss.llm.common import release

#: The kind of question that a block asks about its words.
WORDS = 0
#: Fixed value: the byte-level pattern of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(1)
def unsettled() -> regex.Pattern:
    """Characters that Unicode has assigned or moved since its version 3.2, or not yet: libraries may class them differently."""
    old = unicodedata.ucd_3_2_0.category
    moved = [c for c in range(0x80, 0x110000) if (k := unicodedata.category(x := chr(c))) != old(x) or k == "Cn"]
    starts = [c for c, before in zip(moved, [0, *moved], strict=False) if c != before + 1]
    ends = [c for c, after in zip(moved, [*moved[1:], 0], strict=True) if after != c + 1]
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]")


class Vocabulary:
    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = byte_letters()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.letters = letters
        self.settled: set[str] = set()
        self.pieces: dict[int, bytes] = {}
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = piece.encode() if i in added else bytes(letters[c] for c in piece)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word = regex.compile(PATTERN)

    def words(self, text: str) -> list[str]:
        if not self.split_special or not any(s in text for s in self.special):
            return self.plain_words(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self.plain_words(part)
        return out

    def plain_words(self, text: str) -> list[str]:
        """By the pattern; texts with characters that not all versions of Unicode class alike are split by the library itself."""
        if text.isascii() or self.is_settled(text):
            return self.word.findall(text)
        letters = self.letters
        return [bytes(letters[c] for c in w).decode() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def is_settled(self, text: str) -> bool:
        """Looks each character up once: those found settled are remembered."""
        new = set(text).difference(self.settled)
        if new and unsettled().search("".join(new)):
            return False
        self.settled |= new
        return True

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


@functools.lru_cache(2)
def vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(spec)


def encode_docs(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text", most: int = 8 << 20, results: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Columns ``keep`` (doc_id alone) and ``results`` among n_tokens, ids (little-endian unsigned 32-bit), decoded (the text that the ids give) and their digests.

    ``path``: the tokenizer's file, read on the driver. ``most``: bytes of text in a block. Words are dealt
    into as many buckets as the bytes of all texts need.
    """
    return _encoded(docs, path, keep, text, most, results)


def digest_docs(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text", most: int = 8 << 20) -> DataFrame:
    """As ``encode_docs``, with digests of ids and of the decoded text in their place."""
    return _encoded(docs, path, keep, text, most, ("n_tokens", "ids_sha256", "decoded_sha256"))


RESULTS = {"n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def _encoded(docs: DataFrame, path: str, keep: list[str] | None, text: str, most: int, results: tuple[str, ...]) -> DataFrame:
    keep = ["doc_id"] if keep is None else keep
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    out = T.StructType([docs.select(*keep).schema[c] for c in keep] + [T.StructField(c, RESULTS[c]) for c in results])

    buckets = B.buckets_for(docs, text)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(spec.value)
        for block, rows in B.in_blocks(batches, text, most):
            seen: dict[str, int] = {}
            place = seen.setdefault
            at, sizes = array("i"), []
            for t in rows[text].to_pylist():
                words = v.words(t) if t else []
                at.extend([place(w, len(seen)) for w in words])
                sizes.append(len(words))
            words, local = B.frequent_first(list(seen), np.frombuffer(at, np.int32) if at else np.empty(0, np.int32))
            places = np.concatenate(([len(sizes)], sizes, local)).astype(np.uint32)
            table = pa.array(words, pa.string())
            yield from B.block_row(block, buckets, B.squeeze(rows.select(keep).combine_chunks()), B.squeeze_array(places), B.squeeze(pa.table({"w": table}))).to_batches()
            to = _bucket_of(table, buckets)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(buckets + 1)).tolist()
            asked: dict[str, list] = {"bucket": [], "block": [], "kind": [], "payload": []}
            for b, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if lo < hi:
                    for k, x in zip(asked, (b, block, WORDS, B.squeeze(pa.table({"w": table.take(pa.array(order[lo:hi]))}))), strict=True):
                        asked[k].append(x)
            yield from B.rows_of(B.ASKED, **asked).to_batches()
        release()

    def encode(_kind: int, payloads: list[bytes]) -> list[bytes]:
        v = vocabulary(spec.value)
        lists = [B.expand(p)["w"].combine_chunks() for p in payloads]
        coded = pa.chunked_array(lists, pa.string()).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        words = coded.dictionary.to_pylist()
        ids = [np.array(x, np.uint32) for i in range(0, len(words), 10_000) for x in v.encode(words[i : i + 10_000])]
        flat, starts, sizes = _ragged(ids)
        which = coded.indices.to_numpy(zero_copy_only=False)
        out, begin = [], 0
        for words_of in lists:
            own = which[begin : begin + len(words_of)]
            begin += len(words_of)
            out.append(zstandard.compress(np.concatenate(([len(own)], sizes[own], _gather(flat, starts, sizes, own))).astype(np.uint32).tobytes(), 1))
        return out

    def answer(rows: pa.Table) -> pa.Table:
        return B.answers(rows, (WORDS,), buckets, encode)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        done = [pa.table({f"c{i}": pa.array([], to_arrow_type(f.dataType)) for i, f in enumerate(out)})]
        v = vocabulary(spec.value)
        for _, (rows, places, words), told in B.blocks_of(left, right):
            columns = [*B.expand(rows).columns, *_joined(v, B.expand_array(places, np.uint32), B.expand(words)["w"].combine_chunks(), told, buckets, results)]
            done.append(pa.table({f"c{i}": pa.chunked_array(c.chunks if isinstance(c, pa.ChunkedArray) else [c], to_arrow_type(f.dataType)) for i, (c, f) in enumerate(zip(columns, out, strict=True))}))
        release()
        return pa.concat_tables(done).rename_columns([f.name for f in out])

    # Blocks and their words are dealt in one shuffle, planned twice and run once.
    first = B.dealt(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([text, *keep]))).mapInArrow(split, B.ASKED), buckets)
    told = B.dealt(first.groupBy("bucket").applyInArrow(answer, B.TOLD), buckets, "home")
    return first.groupBy("bucket").cogroup(told.groupBy("home")).applyInArrow(join, out)


def _joined(v: Vocabulary, places: np.ndarray, words: pa.Array, told: list[tuple[int, int, bytes]], buckets: int, results: tuple[str, ...]) -> list[pa.Array]:
    """A block's results: ids joined back by position, pieces by id."""
    n = int(places[0])
    lengths, at = places[1 : n + 1].astype(np.int64), places[n + 1 :]
    to = _bucket_of(words, buckets)
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(buckets + 1))
    ids: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
    for _, b, payload in told:
        got = np.frombuffer(zstandard.decompress(payload), np.uint32)
        k = int(got[0])
        for i, x in zip(order[ends[b] : ends[b + 1]].tolist(), np.split(got[k + 1 :], np.cumsum(got[1:k])), strict=True):
            ids[i] = x
    flat, starts, sizes = _ragged(ids)
    piece = v.pieces
    text_of = [b"".join([piece[i] for i in x.tolist()]) for x in ids]
    tokens = _gather(flat, starts, sizes, at)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    token_ends = np.concatenate(([0], np.cumsum(sizes[at])))[ends].tolist()
    cols: dict[str, list] = {c: [] for c in results}
    for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        own = tokens[token_ends[i] : token_ends[i + 1]].astype("<u4").tobytes()
        decoded = b"".join([text_of[j] for j in at[lo:hi].tolist()])
        for c in results:
            cols[c].append(_result(c, own, decoded))
    return [pa.array(cols[c], to_arrow_type(RESULTS[c])) for c in results]


def _result(name: str, ids: bytes, decoded: bytes):
    if name == "n_tokens":
        return len(ids) // 4
    if name.startswith("ids"):
        return ids if name == "ids" else hashlib.sha256(ids).hexdigest()
    try:
        text = decoded.decode()
    except UnicodeDecodeError:
        text = decoded.decode("utf-8", "replace")
        decoded = text.encode()
    return text if name == "decoded" else hashlib.sha256(decoded).hexdigest()


def _bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words)) * np.uint64(buckets) >> np.uint64(32)


def _ragged(lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.concatenate([np.asarray(x, np.uint32) for x in lists]) if len(lists) else np.empty(0, np.uint32)
    return flat, np.cumsum(sizes) - sizes, sizes


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The lists ``which``, one after another."""
    n = sizes[which]
    return flat[np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
