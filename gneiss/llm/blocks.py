"""Blocks: some MB of rows packed into one, so that work on words runs on arrays and shuffles move few, dense rows.

A block holds what a task has made of some rows. What blocks ask about their distinct words or names is dealt
by value into buckets, answered there, and sent back to the block. There are as many buckets as the bytes of
all texts need, so what a bucket holds doesn't grow with the table; bucket b is partition b of a shuffle:

    rows --> blocks and their questions --by bucket--> answers --by the block's home--> blocks with answers

A block lies in a bucket too, its home, whatever it asks. Blocks and questions are dealt in one shuffle, which
is planned wherever it is read and run once. A bucket gets a name from each block once, however often the
block's texts hold it, so frequent words and passages load no bucket more than the number of blocks. Everything
is keyed by bucket and recomputable, as long as the table reads the same again: blocks are numbered by the
order in which rows meet a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import release

ASKED = "bucket int, block long, kind int, payload binary"
TOLD = "home int, block long, kind int, bucket int, payload binary"
#: Kinds of rows: is a name in several documents (SYMBOL), or in one with a smaller id (the next two)? A memo comes back as it is; a block stays.
SYMBOL, PHRASE, SPAN, MEMO, BLOCK = range(5)
#: Bytes of text that a bucket answers for.
BUCKET_BYTES = 24 << 20
#: Bytes of text in a block.
BLOCK_BYTES = 6 << 20


def squeeze(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def expand(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def squeeze_array(a: np.ndarray) -> bytes:
    """Bytes of equal rank are stored together: high bytes of small numbers then cost next to nothing."""
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def expand_array(payload: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(payload), np.uint8).reshape(width, -1).T).view(kind).ravel()


def in_blocks(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[int, pa.Table]]:
    """Cut a task's rows into blocks of about ``most`` bytes of text. A longer text has a block to itself."""
    first, n = TaskContext.get().partitionId() << 24, 0
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for i, length in enumerate(lengths.tolist()):
            if size and size + length > most:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield first + n, pa.Table.from_batches(held).combine_chunks()
                held, size, begin, n = [], 0, i, n + 1
            size += length + 64
        if begin < len(lengths):
            held.append(batch.slice(begin))
    if held:
        yield first + n, pa.Table.from_batches(held).combine_chunks()


def home(block: int, buckets: int) -> int:
    """The bucket that holds a block: a task's blocks lie side by side, as do the tasks'."""
    return ((block >> 24) * 5 + (block & 0xFFFFFF)) % buckets


def joined(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def parted(payload: bytes) -> list[memoryview]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    ends = np.cumsum([8 + 8 * n, *np.frombuffer(payload, np.int64, n, 8)]).tolist()
    return [memoryview(payload)[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def block_row(block: int, buckets: int, *parts: bytes) -> pa.Table:
    return rows_of(ASKED, bucket=[home(block, buckets)], block=[block], kind=[BLOCK], payload=[joined(*parts)])


def blocks_of(rows: pa.Table, told: pa.Table | None = None) -> Iterator[tuple[int, list[memoryview], list[tuple[int, int, bytes]]]]:
    """The blocks of a bucket: number, parts, and the answers (kind, bucket, payload) for each."""
    answers: dict[int, list] = {}
    if told is not None:
        for block, *what in zip(*(told[c].to_pylist() for c in ("block", "kind", "bucket", "payload")), strict=True):
            answers.setdefault(block, []).append(tuple(what))
    some = rows.filter(pc.equal(rows["kind"], BLOCK)) if rows.num_rows else rows
    for i in range(some.num_rows):
        block = some["block"][i].as_py()
        yield block, parted(some["payload"][i].as_py()), answers.get(block, [])


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def rows_of(ddl: str, **columns: list) -> pa.Table:
    return pa.Table.from_pydict(columns, schema=_schema(ddl))


def buckets_for(docs: DataFrame, text: str, most: int = BUCKET_BYTES) -> int:
    """As many buckets as a shuffle has partitions, or more if one would answer for more than ``most`` bytes of text; measured."""
    told = docs.agg(F.sum(F.octet_length(text) + F.lit(64)).alias("n")).first()["n"]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(told or 0) // most))


def dealt(rows: DataFrame, buckets: int, by: str = "bucket") -> DataFrame:
    """Bucket b's rows in partition b: grouping by bucket needs no other shuffle."""
    return rows.repartitionById(buckets, by)


def bucket_bounds(names: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins and ends in sorted 64-bit names: buckets are equal stretches of their range."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(names, edges), len(names))


def ask(kind: int, block: int, names: np.ndarray, ids: np.ndarray, holder: np.ndarray, buckets: int, checks: np.ndarray | None = None, several: np.ndarray | None = None) -> pa.Table:
    """A block's distinct names, sorted, the smallest id that holds each (ids[holder]), their checks, and whether several ids hold them."""
    bounds = bucket_bounds(names, buckets)
    out: dict[str, list] = {"bucket": [], "block": [], "kind": [], "payload": []}
    short = holder.astype(np.uint16 if len(ids) <= 65_536 else np.uint32)
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        lo, hi = bounds[b], bounds[b + 1]
        used, local = np.unique(short[lo:hi], return_inverse=True)
        parts = joined(
            squeeze_array(np.diff(names[lo:hi], prepend=np.uint64(0))),
            squeeze_array(local.astype(short.dtype)),
            squeeze_array(ids[used]),
            b"" if checks is None else checks[lo:hi].tobytes(),
            b"" if several is None else np.packbits(several[lo:hi]).tobytes(),
            bytes([short.itemsize]),
        )
        for k, v in zip(out, (b, block, kind, parts), strict=True):
            out[k].append(v)
    return rows_of(ASKED, **out)


def asked(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, ids, checks (0 if there are none) and whether several ids hold the name."""
    names, local, ids, checks, several, width = parted(payload)
    names = np.cumsum(expand_array(names, np.uint64), dtype=np.uint64)
    held = expand_array(ids, np.int64)[expand_array(local, np.uint16 if width[0] == 2 else np.uint32)]
    none = np.zeros(len(names), np.uint64)
    return names, held, np.frombuffer(checks, np.uint64) if len(checks) else none, np.unpackbits(np.frombuffer(several, np.uint8), count=len(names)).astype(bool) if len(several) else none.astype(bool)


def answers(rows: pa.Table, kinds: tuple[int, ...], buckets: int, found: Callable[[int, list[bytes]], list[bytes]]) -> pa.Table:
    """A bucket's answers, by ``found`` for the questions of each kind. Memos come back as they are, blocks stay."""
    out = []
    for kind in (*kinds, MEMO):
        some = rows.filter(pc.equal(rows["kind"], kind))
        if some.num_rows:
            block, payloads = some["block"].to_pylist(), some["payload"].to_pylist()
            out.append(rows_of(TOLD, home=[home(b, buckets) for b in block], block=block, kind=some["kind"].to_pylist(), bucket=some["bucket"].to_pylist(), payload=payloads if kind == MEMO else found(kind, payloads)))
    release()
    return pa.concat_tables(out) if out else rows_of(TOLD, home=[], block=[], kind=[], bucket=[], payload=[])


def held_elsewhere(kind: int, payloads: list[bytes]) -> list[bytes]:
    """One bit a name, in the order of each question: whether several documents hold the name, or one with a smaller id does."""
    lists = [asked(p) for p in payloads]
    sizes = [len(x[0]) for x in lists]
    names, ids, checks, several = (np.concatenate(x) for x in zip(*lists, strict=True))
    del lists
    order = np.argsort(names, kind="stable") if kind == SYMBOL else np.lexsort((checks, names))
    names = names[order]
    new = np.concatenate(([True], names[1:] != names[:-1]))
    if kind != SYMBOL:
        checks = checks[order]
        new[1:] |= checks[1:] != checks[:-1]
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    held = ids[order]
    least = np.minimum.reduceat(held, first)
    bits = np.empty(len(names), bool)
    if kind == SYMBOL:
        bits[order] = ((least != np.maximum.reduceat(held, first)) | np.logical_or.reduceat(several[order], first))[group]
    else:
        bits[order] = least[group] < held
    ends = np.cumsum(sizes)
    return [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes, strict=True)]


def memo(block: int, flags: list[np.ndarray], buckets: int) -> pa.Table:
    """Flags that a block will want again, as a question that comes back as it is."""
    return rows_of(ASKED, bucket=[home(block, buckets)], block=[block], kind=[MEMO], payload=[zstandard.compress(b"".join(np.packbits(f).tobytes() for f in flags), 1)])


def remembered(told: list[tuple[int, int, bytes]], n: int, flags: int) -> list[np.ndarray]:
    """The memo's flags, n each."""
    (payload,) = (p for kind, _, p in told if kind == MEMO)
    bits = np.frombuffer(zstandard.decompress(payload), np.uint8).reshape(flags, -1) if n else np.empty((flags, 0), np.uint8)
    return [np.unpackbits(b, count=n).astype(bool) for b in bits]


def bits_of(told: list[tuple[int, int, bytes]], kind: int, bounds: np.ndarray) -> np.ndarray:
    """The answers of ``kind`` for a block's sorted distinct names; ``bounds``: where each bucket's begin."""
    out = np.zeros(int(bounds[-1]), bool)
    for k, b, bits in told:
        if k == kind:
            lo, hi = int(bounds[b]), int(bounds[b + 1])
            out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


def frequent_first(words: list, at: np.ndarray) -> tuple[list, np.ndarray]:
    """Words by falling count, and the places of the same words in that order: small numbers are common and pack well."""
    order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return [words[i] for i in order.tolist()], rank[at]
