"""Byte-level BPE by two tiers: a minimal perfect hash finds whole pre-tokens that are in the
vocabulary, a heap over linked bytes merges the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, tidied

#: Pre-tokens in each of the two generations that a worker remembers; speed only, never the result.
MEMO = 300_000
#: Characters of a pre-token that is remembered, and bytes of a generation (the table's own part of an
#: entry is MEMO_ENTRY); speed only too.
MEMO_LETTERS, MEMO_BYTES, MEMO_ENTRY = 128, 24 << 20, 48
_MASK, _STEP, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


_TRIES = 128


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    x = h[:, None] + d[None, :] * np.uint64(_STEP)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """n keys in n slots by hash and displace: a key's bucket holds a displacement that sends all
    its keys to free slots, or, for a bucket of one key, the slot itself as ``-slot - 1``."""

    def __init__(self, ids: dict[bytes, int]):
        n = len(ids)
        self.n, self.n_buckets = n, max(1, n // 4)
        self.keys: list[bytes | None] = [None] * n
        self.ids = [-1] * n
        self.displace = [0] * self.n_buckets
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for key in ids:
            h = xxhash.xxh3_64_intdigest(key)
            buckets.setdefault(h % self.n_buckets, []).append((h, key))
        taken = np.zeros(n, bool)
        ordered = sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0]))
        for g, members in ordered:
            if len(members) == 1:
                break
            h, first = np.array([h for h, _ in members], np.uint64), 1
            while True:
                slots = _slots(h, np.arange(first, first + _TRIES, dtype=np.uint64), n)
                good = ~taken[slots].any(0)
                for k in np.flatnonzero(good):
                    if len(set(column := slots[:, k].tolist())) == len(members):
                        break
                else:
                    first += _TRIES
                    continue
                break
            self._put(g, first + int(k), column, members, ids)
            taken[column] = True
        free = iter(np.flatnonzero(~taken).tolist())
        for g, members in ordered:
            if len(members) == 1:
                slot = next(free)
                self._put(g, -slot - 1, [slot], members, ids)

    def _put(self, g: int, d: int, slots: list[int], members: list[tuple[int, bytes]], ids: dict[bytes, int]) -> None:
        self.displace[g] = d
        for slot, (_, key) in zip(slots, members):
            self.keys[slot], self.ids[slot] = key, ids[key]

    def get(self, key: bytes) -> int:
        """The key's id, or -1 if the key is not among those hashed."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.n_buckets]
        if d < 0:
            slot = -d - 1
        else:
            x = (h + d * _STEP) & _MASK
            slot = ((((x ^ (x >> 31)) * _MIX) & _MASK) >> 32) * self.n >> 32
        return self.ids[slot] if self.keys[slot] == key else -1


class Pairs:
    """What two neighbours merge into. Bytes that are no token are named by ids beyond the vocabulary;
    -1, beyond either end of a piece, merges with nothing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.top = max(ranks.values(), default=-1) + 1
        self.gaps = any(bytes((a,)) not in ranks for a in range(256))
        name = {bytes((a,)): self.top + a for a in range(256)} | ranks
        self.first = [name[bytes((a,))] for a in range(256)]
        nothing: dict[int, int] = {}
        #: for an id, the ids that may follow it and the token of both; the last one is that of -1
        self.then = [nothing] * (self.top + 257)
        for token, i in ranks.items():
            for k in range(1, len(token)):
                if (left := name.get(token[:k])) is not None and (right := name.get(token[k:])) is not None:
                    if self.then[left] is nothing:
                        self.then[left] = {}
                    self.then[left][right] = i
        self.bytes = [[self.then[a].get(b, -1) for b in self.first] for a in self.first]


def merge_bytes(piece: bytes, pairs: Pairs) -> list[int]:
    """Ids of a piece that is no token itself: the pair of lowest rank merges first, the leftmost
    of equals; a heap holds the candidate pairs of a linked list, so a long piece costs n log n."""
    n, then, pop, push = len(piece), pairs.then, heapq.heappop, heapq.heappush
    shift = n.bit_length()
    mask = (1 << shift) - 1
    end, before = list(range(1, n + 1)), list(range(-1, n))
    first, two = pairs.first, pairs.bytes
    # id that starts at a byte, -1 where none does and after the last one
    ids = [first[a] for a in piece]
    ids.append(-1)
    # rank of the pair that starts at a byte, -1 where none does; a heap entry that differs is stale
    pair = [two[a][b] for a, b in zip(piece, piece[1:])]
    pair += (-1, -1)
    heap = [rank << shift | i for i, rank in enumerate(pair) if rank >= 0]
    heapq.heapify(heap)
    while heap:
        entry = pop(heap)
        left = entry & mask
        merged = pair[left]
        if merged != entry >> shift:
            continue
        right = end[left]
        stop = end[left] = end[right]
        ids[left] = merged
        ids[right] = pair[right] = -1
        rank = pair[left] = then[merged].get(ids[stop], -1)
        if rank >= 0:
            push(heap, rank << shift | left)
        before[stop] = left
        back = before[left]
        rank = pair[back] = then[ids[back]].get(merged, -1)
        if rank >= 0:
            push(heap, rank << shift | back)
    out = [i for i in ids if i >= 0]
    if pairs.gaps and max(out, default=-1) >= pairs.top:
        raise KeyError("a byte is no token")
    return out


class Memo(dict):
    """Ids of pre-tokens, packed, the younger generation; the older one is asked before anything is
    worked out anew. It does not refer to its tokenizer, so that both go as soon as a worker's stage is
    over and not when Python next looks for cycles."""

    def __init__(self, table: PerfectHash, pairs: Pairs, kind: np.dtype):
        self.table, self.pairs, self.code = table, pairs, kind.char
        self.older: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, token: str) -> bytes:
        if len(self) >= MEMO or self.held >= MEMO_BYTES:
            self.older, self.held = dict(self), 0
            self.clear()
        found = self.older.get(token) or self._piece(token.encode())
        if len(token) <= MEMO_LETTERS:
            self[token] = found
            self.held += sys.getsizeof(token) + sys.getsizeof(found) + MEMO_ENTRY
        return found

    def _piece(self, piece: bytes) -> bytes:
        found = self.table.get(piece)
        return array(self.code, (found,) if found >= 0 else merge_bytes(piece, self.pairs)).tobytes()


#: What a pattern for ASCII texts may consist of, and how ``re`` writes the parts of it that differ.
_PART = re.compile(r"\[\^?(?:\\s|\\p\{[LN]\}|[A-Za-z0-9' ])+\]|\\[sS]|\\p\{[LN]\}|[A-Za-z0-9' |?+*)]|\((?:\?[!=:]|(?!\?))")
_ASCII = {r"\s": r"\t-\r ", r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}


def ascii_splitter(pattern: str) -> Callable[[str], list[str]] | None:
    """``findall`` of a pattern by ``re``, which is faster, for texts of ASCII characters only; None if
    the pattern has parts of which it is not known that they mean the same there."""
    parts, at = [], 0
    while at < len(pattern):
        if not (found := _PART.match(pattern, at)):
            return None
        part, at = found[0], found.end()
        if part == r"\S":
            part = r"[^\s]"
        elif part in _ASCII:
            part = f"[{part}]"
        for name, letters in _ASCII.items():
            part = part.replace(name, letters)
        parts.append(part)
    return re.compile("".join(parts)).findall


class Tokenizer:
    """Encoder and decoder of one vocabulary. ``pattern`` splits a text before merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None):
        import regex

        self.ranks, self.table = ranks, table or PerfectHash(ranks)
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.split_ascii = ascii_splitter(pattern) or self.split
        self.bytes_of = {i: b for b, i in ranks.items()}
        pairs = Pairs(ranks)
        self.names = np.array([b"%d " % i for i in range(pairs.top)], "S")
        self.kind = np.dtype(np.uint16 if pairs.top <= 1 << 16 else np.uint32)
        self.memo = Memo(self.table, pairs, self.kind)

    def array(self, text: str | None) -> np.ndarray:
        """Ids of a text as ordinary text, without special tokens; null and empty have none."""
        if not text:
            return np.empty(0, self.kind)
        split = self.split_ascii if text.isascii() else self.split
        return np.frombuffer(b"".join(map(self.memo.__getitem__, split(text))), self.kind)

    def encode(self, text: str | None) -> list[int]:
        """``array`` as a list."""
        return self.array(text).tolist()

    def written(self, ids: np.ndarray) -> bytes:
        """The ids in decimal digits, joined by one space."""
        return self.names[ids].tobytes().translate(None, b"\0")[:-1]

    def decode(self, ids) -> bytes:
        """The bytes of the ids; an id outside the vocabulary is a KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _broadcast(spark, path: str):
    """Vocabulary and its perfect hash, built once; its size is the vocabulary file's, not the data's."""
    ranks = load_ranks(path)
    return spark.sparkContext.broadcast({"ranks": ranks, "table": PerfectHash(ranks)})


def _tokenizer(shared, pattern: str) -> Tokenizer:
    """The worker's tokenizer, kept beside the broadcast value so that later tasks find its memo."""
    kept = shared.value
    if pattern not in kept:
        kept[pattern] = Tokenizer(kept["ranks"], pattern, kept["table"])
    return kept[pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the array column ``out`` of token ids; null texts give empty arrays, an
    existing column of that name is replaced, all others pass through."""
    bounded_batches(docs.sparkSession)
    shared = _broadcast(docs.sparkSession, path)
    kept = [c for c in docs.columns if c.lower() != out.lower() or c == text]
    docs = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared, pattern)
        for batch in batches:
            ids = pa.array([tokenizer.array(t).astype(np.int32) for t in batch.column(kept.index(text)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*kept, out])

    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the binary column ``out``: the bytes of the ids (null ids: null)."""
    shared = _broadcast(docs.sparkSession, path)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    docs = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared, pattern)
        for batch in batches:
            raw = [None if x is None else tokenizer.decode(x) for x in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*kept, out])

    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``doc_id``, number of tokens and digests of the ids and of the bytes they decode to, for every
    row of ``docs`` (``doc_id, text``), and the ids themselves if asked for; otherwise they stay
    inside the worker. A null text is empty: no ids, digests of nothing. Repeated rows are coded alike;
    an empty table stays empty."""
    bounded_batches(docs.sparkSession)
    shared = _broadcast(docs.sparkSession, path)
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared, pattern)
        for batch in batches:
            counts, coded, decoded, kept = [], [], [], []
            for text in batch.column(1):
                ids = tokenizer.array(text.as_py())
                counts.append(len(ids))
                if with_ids:
                    kept.append(pa.array(ids.astype(np.int32)))
                coded.append(hashlib.sha256(tokenizer.written(ids)).hexdigest())
                decoded.append(hashlib.sha256(tokenizer.decode(ids.tolist())).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = pa.array([0, *accumulate(counts)], pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(kept) if kept else pa.array([], pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidied(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op10(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded under the 50k vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
