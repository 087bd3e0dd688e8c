"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Encoding runs merges through a queue of buckets, one per merge rank. A bucket holds places in the linked list
of parts. Two levels of bitmaps tell which buckets have entries; find-first-set on each level yields the lowest
rank in constant time, whatever the length of the pre-token. Entries whose place was merged away or has another
rank by now are skipped when they surface. Within a rank the leftmost place goes first, as the usual encoder has
it; a merge that makes a pair of lower rank interrupts the bucket. All distinct pre-tokens of a slice share one
list and one queue, as they cannot touch each other: a full bucket is one step of array arithmetic.
"""

from __future__ import annotations

import base64
import functools
import sys
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import arrays, common, pretokens

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Entries that a worker's memo of pre-tokens holds at most; a bound on memory, not on results.
MEMO_ENTRIES = 300_000
MEMO_LENGTH = 64
#: Bits of a rank that pick the bit in a word of the lower bitmap.
WORD = 8
WORD_MASK = (1 << WORD) - 1
ID_BITS = 32
#: Bucket size from which a bucket is merged by array arithmetic.
FULL = 24
#: Bytes of text that share a queue: a worker holds about 40 times as many for their code points and keys.
SLICE_BYTES = 1 << 20
#: Part at the ends of each pre-token: no pair has it.
WALL = (1 << 30) - 1
#: Ids decoded at a time.
DECODE_IDS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(read_ranks(path))


@functools.cache
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


class Decoder:
    """The bytes of each token, end to end: all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_size = np.array([len(t) for t in tokens])
        self.token_first = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, end to end."""
        return self.token_bytes[arrays.ragged(self.token_first[ids], self.token_size[ids])]


class RankQueue:
    """Places by rank; ``take`` gives the lowest rank and its places, each once, leftmost first."""

    __slots__ = ("top", "low", "sorted", "edges", "pushed")

    def __init__(self, ranks: np.ndarray):
        """Each place with its rank in ``ranks``, if that is not -1."""
        place = np.flatnonzero(ranks >= 0)
        rank = ranks[place]
        order = np.argsort(rank, kind="stable")
        self.sorted, rank = place[order], rank[order]
        edge = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
        self.edges = dict(zip(rank[edge].tolist(), zip(edge.tolist(), [*edge[1:].tolist(), len(rank)])))
        self.pushed: dict[int, list[int]] = {}
        self.top, self.low = 0, {}
        for r in self.edges:
            self._mark(r)

    def _mark(self, rank: int) -> None:
        a = rank >> WORD
        self.top |= 1 << a
        self.low[a] = self.low.get(a, 0) | 1 << (rank & WORD_MASK)

    def push(self, rank: int, place: int) -> None:
        bucket = self.pushed.get(rank)
        if bucket is not None:
            bucket.append(place)
            return
        self.pushed[rank] = [place]
        a = rank >> WORD
        word = self.low.get(a)
        if word is None:
            self.top |= 1 << a
            self.low[a] = 1 << (rank & WORD_MASK)
        else:
            self.low[a] = word | 1 << (rank & WORD_MASK)

    def take(self) -> tuple[int, np.ndarray | list[int]]:
        """(rank, places); (-1, []) if there is none. Full buckets are arrays, others lists."""
        top = self.top
        if not top:
            return -1, []
        a = (top & -top).bit_length() - 1
        word = self.low[a]
        bit = word & -word
        rank = (a << WORD) + bit.bit_length() - 1
        word ^= bit
        if word:
            self.low[a] = word
        else:
            del self.low[a]
            self.top = top & (top - 1)
        more = self.pushed.pop(rank, None)
        edge = self.edges.pop(rank, None)
        if edge is None:
            if len(more) >= FULL:
                return rank, np.unique(more)
            return rank, sorted(set(more)) if len(more) > 1 else more
        first = self.sorted[edge[0] : edge[1]]
        if more:
            first = np.union1d(first, more)
        return rank, first if len(first) >= FULL else first.tolist()


class Encoder(Decoder):
    """Encodes and decodes under one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.ranks = ranks
        self.of_byte = [ranks[bytes([i])] for i in range(256)]
        # rank of the token that two tokens make, for every way to cut a token in two
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << ID_BITS | right] = rank
        key = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(key)
        self.pair_keys = key[order]
        self.pair_ranks = np.fromiter(self.pairs.values(), np.int32, len(self.pairs))[order]
        self.byte_ids = np.array(self.of_byte, np.int32)
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.of_bytes = self.pair_rank(self.byte_ids[a], self.byte_ids[b])
        self.memo: dict[str, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two parts each, -1 if there is none."""
        key = left.astype(np.int64) << ID_BITS | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int32(-1))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, four bytes an id. A merged part's id is the rank of its merge."""
        out: list[bytes | None] = [None if whole is None else whole.to_bytes(4, sys.byteorder) for whole in map(self.ranks.get, pieces)]
        todo = [i for i, ids in enumerate(out) if ids is None]
        if not todo:
            return out
        size = np.array([len(pieces[i]) for i in todo])
        raw = np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)
        n = len(raw)
        first = np.cumsum(size) - size
        # place n stands for what is beyond either end of any pre-token
        parts = np.append(self.byte_ids[raw], np.int32(WALL))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[first + size - 1] = before[first] = after[n] = before[n] = n
        current = np.full(n + 1, -1, np.int32)
        current[: n - 1] = self.of_bytes[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        current[first + size - 1] = -1
        queue = RankQueue(current)
        views = [memoryview(x) for x in (parts, after, before, current)]
        while True:
            rank, places = queue.take()
            if rank < 0:
                break
            if isinstance(places, list):
                self._merge_places(rank, places, queue, *views)
            else:
                self._merge_bucket(rank, places, queue, first, parts, after, before, current, views)
        left = np.flatnonzero(parts[:n] >= 0)
        edge = np.searchsorted(left, np.append(first, n)).tolist()
        ids = parts[left].tobytes()
        for i, a, b in zip(todo, edge, edge[1:]):
            out[i] = ids[4 * a : 4 * b]
        return out

    def _merge_places(self, rank: int, places: list[int], queue: RankQueue, parts, after, before, current) -> None:
        get, push = self.pairs.get, queue.push
        for at, i in enumerate(places):
            if current[i] != rank:
                continue  # stale
            j = after[i]
            k, h = after[j], before[i]
            parts[i] = rank
            parts[j] = current[j] = -1
            after[i] = k
            before[k] = i
            current[i] = right = get(rank << ID_BITS | parts[k], -1)
            lower = False
            if right >= 0:
                push(right, i)
                lower = right < rank
            left = get(parts[h] << ID_BITS | rank, -1)
            current[h] = left
            if left >= 0:
                push(left, h)
                lower |= left < rank
            if lower:  # a lower rank goes before the other places of this one
                for other in places[at + 1 :]:
                    push(rank, other)
                break

    def _merge_bucket(self, rank: int, places: np.ndarray, queue: RankQueue, first, parts, after, before, current, views) -> None:
        """The same for all places at once. In a chain of overlapping pairs every other one is merged, from the left."""
        i = places[current[places] == rank]
        if not len(i):
            return
        j = after[i]
        number = np.arange(len(i))
        chained = np.append(False, j[:-1] == i[1:])
        i = i[(number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0]
        j = after[i]
        k = after[j]
        after[i], before[k] = k, i
        h = before[i]
        # what each merge makes with the part behind it while that is not merged itself
        lower = self.pair_rank(np.full(len(i), rank), parts[k])
        lower = (lower >= 0) & (lower < rank)
        was = parts[i]
        parts[i] = rank
        left = self.pair_rank(parts[h], np.full(len(i), rank))
        lower |= (left >= 0) & (left < rank)
        right = self.pair_rank(np.full(len(i), rank), parts[k])
        lower |= (right >= 0) & (right < rank)
        if lower.any():
            # a pair of lower rank goes before other places of its pre-token: those pre-tokens go place by place
            piece = np.searchsorted(first, i, "right")
            slow = np.isin(piece, piece[lower])
            parts[i], after[i], before[k] = was, j, j
            self._merge_bucket(rank, i[~slow], queue, first, parts, after, before, current, views)
            own = places[np.isin(np.searchsorted(first, places, "right"), piece[lower])]
            self._merge_places(rank, own.tolist(), queue, *views)
            return
        parts[j] = current[j] = -1
        current[i] = right
        current[h] = left
        push = queue.push
        for at, new in ((i, right), (h, left)):
            some = new >= 0
            for r, p in zip(new[some].tolist(), at[some].tolist()):
                push(r, p)

    def pieces_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens, from the memo or by one merge of all others."""
        memo = self.memo
        out = [memo.get(p) for p in pieces]
        new = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(new, self.merge([pieces[i].encode() for i in new])):
            out[i] = ids
            if len(pieces[i]) <= MEMO_LENGTH:
                memo[pieces[i]] = ids
        if len(memo) > MEMO_ENTRIES:
            for old in [x for x, _ in zip(memo, range(len(memo) - MEMO_ENTRIES // 2))]:
                del memo[old]
        return out

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin. Each distinct pre-token is merged once."""
        points, off = pretokens.code_points(texts)
        start = pretokens.spans(points, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        _, example, place = pretokens.distinct(pretokens.span_keys(points, start))
        joined, end = "".join(texts), np.append(start[1:], len(points))
        ids = self.pieces_ids([joined[a:b] for a, b in zip(start[example].tolist(), end[example].tolist())])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        first = np.cumsum(size) - size
        count = size[place]
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        return flat[arrays.ragged(first[place], count)], total[np.searchsorted(start, off)]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row, over its whole text.

    A null or empty text has no ids. Rows may repeat, in id or text; each gives its row. Null ids stay null.
    No shuffle: rows stay in their partition.
    """
    path = path or public_tokenizers.path(RANK_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        try:
            for batch in batches:
                text = batch.column(1).fill_null("")
                for lo, hi, _, _ in arrays.slices(text, SLICE_BYTES):
                    ids, off = own.encode_texts(text.slice(lo, hi - lo).to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), arrays.list_array(pa.array(ids, pa.int32()), off)], ["doc_id", "ids"])
        finally:  # the memo is the task's: workers go on to other stages
            own.memo.clear()
            arrays.release()

    return common.documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes that the ids stand for. Null ids give null."""
    path = path or public_tokenizers.path(RANK_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = part.column(1)
                count = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
                flat, at, data = ids.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(count)), []
                for null, i, j in zip(ids.is_null().to_pylist(), at[:-1], at[1:]):
                    data.append(None if null else b"".join(own.decode(flat[x : min(j, x + DECODE_IDS)]).tobytes() for x in range(i, j, DECODE_IDS)))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(data, pa.binary())], ["doc_id", "ids", "decoded"])
            arrays.release()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; digests of the ids and of the decoded bytes. A null text is empty."""
    both = decode(encode(common.table(spark, sf_dir, "documents")))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.octet_length("decoded").cast("long").alias("n_bytes"))
