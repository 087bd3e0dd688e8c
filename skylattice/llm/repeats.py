"""Windows of a fixed number of units (bytes or words) that start at two places or more: candidates and routing.

Every window holds an *anchor*: the k-gram of units with the smallest hash in it, so equal windows have equal
anchors at the same distance. Anchors that occur twice are cut out with the units on both sides that a window around them may reach.
Such *contexts* meet by anchor, equal ones as one with a count. A window recurs if another context of its anchor, or a
copy of its own, has it at the same distance from the anchor: those are different places, whereas contexts of one text
overlap. The operators find the recurring windows of the contexts; the spans they cover go back to the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm import arrays, common

#: Distinct contexts of one anchor that go to one task; the windows of larger groups are counted by fingerprint.
GROUP = 2000
#: Context bytes that a task handles at once, besides whole groups.
CHUNK_BYTES = 700_000
#: Parts that the windows of a context are told apart in by their distance to the anchor.
PARTS = 8


class ByteUnits:
    """Bytes as units."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.hashes = arrays.BYTE_VALUE[data]

    def content(self, a: int, b: int) -> bytes:
        return self.data[a:b].tobytes()


class WordUnits:
    """Words ``[^\\x20\\x09-\\x0D]+`` as units, unchanged."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.words = arrays.Words(data, off)
        self.off = self.words.off
        self.data = data
        self.hashes = self.words.hashes(lower=False)

    def content(self, a: int, b: int) -> bytes:
        raw = self.data[self.words.start[a] : self.words.end[b - 1]].tobytes()
        return b" ".join(raw.split())


class Plan:
    """Kind of units, window length and anchor length."""

    def __init__(self, units: type, window: int, anchor: int):
        self.units, self.window, self.anchor = units, window, anchor
        # a window has ``left`` units or more before its anchor, or ``right`` or more behind it
        self.left = (window - anchor + 1) // 2
        self.right = window - anchor - self.left + 1

    def anchors(self, u) -> tuple[np.ndarray, np.ndarray]:
        """(unit place, hash) of the anchors of a slice; of equal hashes in a window the first counts."""
        g = arrays.kgrams(u.hashes, self.anchor)
        if not len(g):
            return np.zeros(0, np.int64), g
        # where the last anchor of each place's document may start; documents shorter than a window have none
        size = np.diff(u.off)
        last = np.repeat(np.where(size >= self.window, u.off[1:] - self.anchor, -1), size)[: len(g)]
        here = np.arange(len(g))
        key = (g >> np.uint64(32) << np.uint64(32)) + here.astype(np.uint64)
        key[here > last] = ~np.uint64(0)
        w = self.window - self.anchor + 1
        at = arrays.sliding_min(key, min(w, len(key))) & np.uint64(0xFFFFFFFF)
        at = at[at < len(g)].astype(np.int64)
        # the smallest of a window never lies before that of an earlier one
        at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
        return at, g[at]


def contexts(docs: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(seats, whole, open, cuts) of ``docs``, which has (k, text).

    ``seats`` are all anchors with their place and the hash ``x`` of their context; ``whole`` the spans of contexts with
    copies, whose windows all recur; ``open`` the contexts that must be compared, because the anchor has several and one
    of them has no copy; ``cuts`` these with their content, and with hashes of the anchor and what is on its left or right.
    """

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy()
            for lo, hi, data, off in arrays.slices(batch.column(1)):
                u = plan.units(data, off)
                at, h = plan.anchors(u)
                doc = np.searchsorted(u.off, at, "right") - 1
                a = np.maximum(u.off[doc], at - (plan.window - plan.anchor))
                b = np.minimum(u.off[doc + 1], at + plan.window)
                x = arrays.mix(arrays.span_hashes(u.hashes, a, b) + (at - a).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(k[lo:hi][doc]), pa.array((at - u.off[doc]).astype(np.int64)), pa.array(h.view(np.int64)), pa.array(x.view(np.int64)), pa.array((at - a).astype(np.int32)), pa.array((b - a).astype(np.int32))], ["k", "at", "anchor", "x", "before", "units"])

    # every anchor, and a hash of its context; texts stay where they are
    seats = common.stored(docs.select("k", "text").mapInArrow(anchor, "k long, at long, anchor long, x long, before int, units int"))
    # contexts of one hash are equal: the place of any of them serves
    kinds = seats.groupBy("anchor", "x").agg(F.count("*").alias("copies"), F.min(F.struct("k", "at", "before", "units")).alias("y")).select("anchor", "x", "copies", "y.*")
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("size"), F.min("copies").alias("fewest")).filter("size > 1 or fewest > 1")
    kinds = common.stored(kinds.join(sizes, "anchor").select("anchor", "x", "copies", "k", "at", "before", "units", "size", "fewest"))
    # all windows of a context with copies recur; the bytes are needed where another context is of one place only
    whole = kinds.filter("copies > 1").select("anchor", "x", F.lit(0).alias("a"), F.col("units").alias("b"))
    open_ = kinds.filter("size > 1 and fewest = 1")
    fields = ["at", "anchor", "x", "before", "units", "copies", "size"]
    places = open_.groupBy("k").agg(F.collect_list(F.struct(*fields)).alias("p"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in arrays.slices(batch.column(1)):
                u = plan.units(data, off)
                rows = []
                for d in range(hi - lo):
                    first = int(u.off[d])
                    for p in batch.column(2)[lo + d].as_py():
                        a = first + p["at"] - p["before"]
                        rows.append((p["anchor"], p["x"], p["before"], u.content(a, a + p["units"]), p["copies"], p["size"], first + p["at"], p["units"]))
                if rows:
                    c = list(zip(*rows))
                    at, before, units = np.array(c[6]), np.array(c[2]), np.array(c[7])
                    short = before < plan.left, units - before < plan.anchor + plan.right
                    l = arrays.span_hashes(u.hashes, np.where(short[0], at, at - plan.left), at + plan.anchor)
                    r = arrays.span_hashes(u.hashes, at, np.where(short[1], at, at + plan.anchor + plan.right))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.int64()), pa.array(l.view(np.int64), mask=short[0]), pa.array(r.view(np.int64), mask=short[1])], ["anchor", "x", "before", "content", "copies", "size", "l", "r"])

    cuts = docs.select("k", "text").join(places, "k").select("k", "text", "p").mapInArrow(cut, "anchor long, x long, before int, content binary, copies long, size long, l long, r long")
    return seats, whole, open_, cuts


def spread(seats: DataFrame, hit: DataFrame) -> DataFrame:
    """(k, spans array<struct<a, b>>): the spans ``hit`` (anchor, x, a, b) of contexts, told to all rows that have them."""
    spans = seats.join(hit, ["anchor", "x"]).select("k", (F.col("at") - F.col("before") + F.col("a")).alias("a"), (F.col("at") - F.col("before") + F.col("b")).alias("b"))
    return spans.groupBy("k").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def candidates(groups: list[list[tuple[bytes, int]]], plan: Plan) -> tuple[list[list[tuple[int, int]]], object]:
    """For each context (content, before) of each anchor the units (first, last + 1) that may hold recurring windows, and all units.

    The windows of a part, those of a range of distances to the anchor, all hold the units between its outermost windows. Where no
    other context of the anchor has these none of them recurs; equal hashes only keep more. Without such a part it is (0, 0).
    """
    flat = [c for g in groups for c in g]
    u = plan.units(np.frombuffer(b"".join(c[0] for c in flat), np.uint8), np.cumsum([0, *[len(c[0]) for c in flat]]))
    size, before = np.diff(u.off), np.array([c[1] for c in flat])
    own = arrays.mix(np.repeat(np.arange(len(groups), dtype=np.uint64), [len(g) for g in groups]))
    first, last = size.copy(), np.zeros(len(flat), np.int64)
    edges = np.linspace(0, plan.window - plan.anchor + 1, PARTS + 1).astype(np.int64)
    for near, far in zip(edges[:-1], edges[1:] - 1):
        # the distances of this part that windows inside the context have
        low, high = np.maximum(near, before + plan.window - size), np.minimum(far, before)
        some = np.flatnonzero(low <= high)
        at = u.off[:-1][some] + before[some]
        h = arrays.mix(arrays.span_hashes(u.hashes, at - near, at - far + plan.window) + own[some])
        _, same, n = np.unique(h, return_inverse=True, return_counts=True)
        some = some[n[same] > 1]
        first[some] = np.minimum(first[some], before[some] - high[some])
        last[some] = np.maximum(last[some], before[some] - low[some] + plan.window)
    first[last == 0] = 0
    it = zip(first.tolist(), last.tolist())
    return [[next(it) for _ in g] for g in groups], u


def find_spans(docs: DataFrame, plan: Plan, detect: Callable) -> DataFrame:
    """(k, spans array<struct<a, b>>): unit spans of the row with key k that recurring windows cover; they may overlap.

    ``docs`` has (k, text). ``detect(groups)`` takes lists of (content, units before the anchor, copies) that share an
    anchor and gives for each context the covered spans (first, last + 1) in units. It gets what ``candidates`` leaves.
    """
    seats, whole, open_, cuts = contexts(docs, plan)

    def recur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple]] = []
        held, now = 0, None

        def out():
            rows = []
            told, u = candidates([[g[2:4] for g in group] for group in groups], plan)
            start, kept, cut = iter(u.off.tolist()), [], []
            for group, own in zip(groups, told):
                left = [(g, a, u.content(i + a, i + b)) for g, (a, b), i in zip(group, own, start) if b]
                if left:
                    kept.append([(g, a) for g, a, _ in left])
                    cut.append([(content, g[3] - a, g[4]) for g, a, content in left])
            for group, spans in zip(kept, detect(cut) if cut else []):
                rows += [(g[0], g[1], first + a, last + a) for (g, a), own in zip(group, spans) if g[4] == 1 for first, last in own]
            c = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())], ["anchor", "x", "a", "b"])

        for batch in batches:
            for h, x, before, content, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if h != now:
                    if held > CHUNK_BYTES:
                        yield out()
                        groups, held = [], 0
                    groups.append([])
                    now = h
                groups[-1].append((h, x, content, before, copies))
                held += len(content)
        if groups:
            yield out()
        arrays.release()

    result = "anchor long, x long, a int, b int"
    crowded = open_.filter(f"size > {GROUP}").limit(1).count() > 0
    if crowded:
        cuts = common.stored(cuts)
    near = cuts.filter(f"size <= {GROUP}").select("anchor", "x", "before", "content", "copies").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(recur, result)
    hit = whole.union(near)
    if crowded:
        hit = hit.union(_crowded(cuts.filter(f"size > {GROUP}"), open_.filter(f"size > {GROUP}"), plan))
    hit = common.stored(hit.select("anchor", "x", "a", "b"))
    for done in (cuts, open_) if crowded else (open_,):
        common.drop_stored(done)
    return spread(seats, hit)


def _crowded(cuts: DataFrame, contexts: DataFrame, plan: Plan) -> DataFrame:
    """The same for anchors with too many contexts for one task: windows are counted by a fingerprint over all tasks.

    Only windows of one place are told to their context, which keeps the others; windows that recur are summed and gone.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, x, before, content, copies in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer(content, np.uint8)
                f = arrays.kgrams(plan.units(raw, np.array([0, len(raw)])).hashes, plan.window)
                s = np.arange(len(f), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), anchor)), pa.array(np.full(len(f), x)), pa.array(np.full(len(f), copies)), pa.array(s), pa.array(before - s), pa.array(f.view(np.int64))], ["anchor", "x", "copies", "s", "d", "f"])

    every = cuts.select("anchor", "x", "before", "content", "copies").mapInArrow(windows, "anchor long, x long, copies long, s int, d int, f long")
    alone = every.groupBy("anchor", "d", "f").agg(F.sum("copies").alias("n"), F.min("x").alias("x"), F.min("s").alias("s")).filter("n = 1")
    alone = alone.groupBy("anchor", "x").agg(F.collect_list("s").alias("alone"))
    left = F.array_except(F.sequence(F.lit(0), F.col("units") - plan.window), F.coalesce("alone", F.array().cast("array<int>")))
    single = contexts.filter(f"copies = 1 and units >= {plan.window}").select("anchor", "x", "units")
    held = single.join(alone, ["anchor", "x"], "left").withColumn("left", left).filter("size(left) > 0")
    return held.select("anchor", "x", F.array_min("left").alias("a"), (F.array_max("left") + plan.window).alias("b"))


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans, cut at n."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        a, b = max(0, a), min(b, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]
