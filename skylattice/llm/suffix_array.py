"""Suffix-array dedup of bytes: text that a 400-byte string covers which also starts elsewhere.

A task builds one suffix array over its shard of contexts (see ``repeats``) by Larsson-Sadakane refinement, and
the common prefixes of neighbours by Kasai's rule; suffixes that share a whole window form its class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import arrays, common, repeats

WINDOW = 400
ANCHOR = 120


def suffix_array(text: np.ndarray, room: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(order, ranks) of the suffixes of non-negative integers by Larsson-Sadakane refinement.

    Groups of suffixes with a common prefix are sorted by the rank ``h`` places on, only as long as they have more
    than one member; ``h`` doubles. ``ranks`` has (h, rank) of each step: equal ranks are h equal symbols.

    With ``room``, the symbols of each suffix up to the end of its block, and ``most`` the order is that of the first ``most``
    symbols, of suffixes with as many: shorter ones fall out as soon as ``h`` outgrows them, and equal nothing from then on.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), []
    limit = n if most is None else min(n, most)
    wide = n.bit_length()
    mask = np.int64((1 << wide) - 1)
    # the first ranks are those of as many symbols as fit a word beside the place
    bits = int(text.max() + 1).bit_length()
    h = max(1, min(limit, (63 - wide) // bits))
    word, padded = np.zeros(n, np.int64), np.append(text + 1, np.zeros(h, np.int64))
    for i in range(h):
        word = (word << bits) + padded[i : n + i]
    word = np.sort((word << wide) + np.arange(n))
    s, key = word & mask, word >> wide
    # ranks count from 1 and leave room for the members of a group; beyond the text they are 0
    rank, ranks, first = np.zeros(n + 1, np.int32), [], True
    while True:
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(new, append=len(s))
        # what a group was split into follows on its rank
        group = np.ones(len(new), np.int64) if first else key[new] >> wide
        outer = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        rank[s] = np.repeat((group + new - np.repeat(new[outer], np.diff(outer, append=len(new)))).astype(np.int32), size)
        if room is not None and first:
            short = np.flatnonzero(room < h)
            rank[short] = -1 - short
        before = rank.copy()
        ranks.append((h, before[:n]))
        if h >= limit:
            break
        longer = min(2 * h, limit)
        # those in groups of several, in the order of the text
        live = np.zeros(n, bool)
        live[s] = np.repeat(size > 1, size)
        if room is not None:
            long = room >= longer
            short = np.flatnonzero(live & ~long)
            rank[short] = -1 - short
            live &= long
        s = np.flatnonzero(live)
        if not len(s):
            break
        key = (before.take(s).astype(np.int64) << wide) + before.take(np.minimum(s + longer - h, n))
        if 3 * wide <= 63:  # the place fits beside both ranks: plain sorting does
            key = np.sort((key << wide) + s)
            s, key = key & mask, key >> wide
        else:
            by = np.argsort(key)
            s, key = s[by], key[by]
        h, first = longer, False
    s = np.arange(n) if room is None else np.flatnonzero(room >= limit)
    return s[np.argsort(rank[s])], ranks


def common_prefixes(text: np.ndarray, order: np.ndarray, ranks: list[tuple[int, np.ndarray]], starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Kasai: length (up to ``most``) that each suffix shares with the one before it in ``order``, by suffix.

    A suffix shares at least one less than the suffix one place to its left does. The blocks ``starts:ends`` of the
    text are walked side by side, each from left to right; separators between them are all different. What is to be
    compared anew is compared by the ranks of the refinement, the longest prefixes first.
    """
    n = len(text)
    prev = np.full(n, -1, np.int32)
    prev[order[1:]] = order[:-1]
    out = np.zeros(n, np.int32)
    steps = [(d, r) for d, r in ranks if 1 < d <= most][::-1][::2] + [(1, text.astype(np.int32))]
    # past the text every place differs from every other
    past = -1 - np.arange(most + max(d for d, _ in steps) + 1, dtype=np.int32)
    strides = [(d, np.append(r, past)) for d, r in steps]
    length = np.zeros(len(starts), np.int32)
    by_size = np.argsort(starts - ends, kind="stable")
    starts, size = starts[by_size].astype(np.int32), (ends - starts)[by_size]
    for step in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -step, "left"))  # blocks longer than step
        i = starts[:live] + np.int32(step)
        j = prev[i]
        h = np.maximum(length[:live] - 1, 0)
        h[j < 0] = 0
        live_pairs = np.flatnonzero(j >= 0)
        for depth, rank in strides:
            run = live_pairs
            while len(run):
                own = h[run]
                run = run[rank[i[run] + own] == rank[j[run] + own]]
                h[run] += depth
                run = run[h[run] < most]
            live_pairs = live_pairs[h[live_pairs] < most]
        np.minimum(h, most, out=h)
        length[:live] = h
        out[i] = h
    return out


def recurring(groups: list[list[tuple[bytes, int, int]]], window: int = WINDOW) -> list[list[list[tuple[int, int]]]]:
    """For each context (content, before, copies) the spans that its recurring windows cover."""
    contexts = [c for g in groups for c in g]
    size = np.array([len(c[0]) for c in contexts])
    starts = np.cumsum(size + 1) - (size + 1)
    raw = np.frombuffer(b"\0".join([*(c[0] for c in contexts), b""]), np.uint8)
    # the fewer symbols there are, the more of them fit the first rank; no window holds the one between contexts
    used = np.bincount(raw, minlength=256) > 0
    text = (np.cumsum(used) - 1)[raw]
    text[starts + size] = used.sum()
    room = (np.repeat(starts + size, size + 1) - np.arange(len(text))).astype(np.int32)
    order, ranks = suffix_array(text, room, window)
    # only the starts of windows are in order: no other place shares a window with them; nor do those of different last ranks
    deepest = ranks[-1][1][order]
    near = np.sort(order[1:][deepest[1:] == deepest[:-1]])
    shared = common_prefixes(text, order, ranks, near, near + 1, window)
    # neighbours that share the whole window are of one class; a window recurs if its class has another context's
    # window of the same anchor at the same distance
    kind = np.empty(len(text), np.int64)
    kind[order] = np.cumsum(shared[order] < window)
    count = np.maximum(0, size - window + 1)
    at = arrays.ragged(starts, count)
    context = np.repeat(np.arange(len(size)), count)
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])[context]
    distance = np.array([c[1] for c in contexts])[context] - (at - starts[context])
    place = group * (int(size.max(initial=0)) + 1) + distance
    key = arrays.mix(kind[at].astype(np.uint64) * arrays.BASE + place.astype(np.uint64))
    _, same = np.unique(key, return_inverse=True)
    recurs = np.bincount(same, np.array([c[2] for c in contexts])[context])[same] > 1
    first = np.cumsum(count) - count
    out: list[list[tuple[int, int]]] = []
    for a, n in zip(first.tolist(), count.tolist()):
        hit = np.flatnonzero(recurs[a : a + n])
        # all windows of a context hold its anchor: they cover one span
        out.append([(int(hit[0]), int(hit[-1]) + window)] if len(hit) else [])
    it = iter(out)
    return [[next(it) for _ in g] for g in groups]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, extra: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """(doc_id, *extra, n_bytes, n_removed, spans, kept binary) of each row: UTF-8 bytes covered by a recurring window go.

    All occurrences go, the first too, judged on the input. Matches end at document borders. Null texts are empty; texts
    shorter than a window stay whole. A row given twice repeats itself, and so loses all its windows. ``spans`` are the
    maximal removed runs (from, to) in bytes; cuts may fall inside a character. With ``as_text``, ``kept`` is a string, and
    the other bytes of a character that a cut falls into go too (``n_removed`` does not count them).
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), *[docs[c] for c in extra or []], docs[text_col].cast("string").alias("text")).withColumn("k", common.row_key("doc_id", "text"))
    found = repeats.find_spans(rows.select("k", "text"), repeats.Plan(repeats.ByteUnits, window, min(ANCHOR, window)), lambda g: recurring(g, window))
    names = ["doc_id", *(extra or [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo, hi, data, off in arrays.slices(batch.column(at)):
                runs, kept, size = [], [], []
                for d in range(hi - lo):
                    raw, spans = data[off[d] : off[d + 1]], batch.column(at + 1)[lo + d].as_py()
                    own = repeats.merged([(s["a"], s["b"]) for s in spans or ()], len(raw))
                    runs.append([{"a": a, "b": b} for a, b in own])
                    edge = [0, *[x for r in own for x in r], len(raw)]
                    left = [raw[a:b].tobytes() for a, b in zip(edge[::2], edge[1::2])]
                    size.append(sum(map(len, left)))
                    # piece by piece: bytes from both sides of a cut must not meet as a character of neither
                    kept.append("".join(x.decode("utf-8", "ignore") for x in left) if as_text else b"".join(left))
                n = np.diff(off)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(at)], pa.array(n), pa.array(n - np.array(size, np.int64)), pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.string() if as_text else pa.binary())], [*names, "n_bytes", "n_removed", "spans", "kept"])

    wide = rows.join(found, "k", "left").select(*names, "text", "spans")
    own = wide.drop("text", "spans").schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own] + ["n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept " + ("string" if as_text else "binary")])
    return wide.mapInArrow(cut, schema)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(common.table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
