"""Substring dedup of words: passages of 35 words or more that recur, found by sharded Aho-Corasick automata.

The windows of contexts of recurring anchors (see ``repeats``) are counted over all tasks, which confirms those that
recur. The contexts are dealt into shards. A shard joins its confirmed windows into passages, compiles one automaton
of them and streams its texts through it to locate them.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import arrays, common, repeats

WINDOW = 35
ANCHOR = 14


def recurring(cuts: DataFrame, plan: repeats.Plan) -> DataFrame:
    """(anchor, x, before, content, left, right, alone) of the contexts without a copy that may hold recurring windows.

    What recurs is counted over all tasks, the same way for every number of contexts. First the anchor with half of what
    a window adds to it, on either side; then the windows of the sides (``left``, ``right``) that recur. Only what is of
    one place is told to its context: ``alone`` are the windows of these sides that do not recur.
    """
    sides = cuts.select("anchor", "x", "copies", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("h")), F.struct(F.lit(1).alias("side"), F.col("r").alias("h")))).alias("s")).select("anchor", "x", "copies", "s.*").filter("h is not null")
    single = sides.groupBy("anchor", "side", "h").agg(F.sum("copies").alias("n"), F.min("x").alias("x")).filter("n = 1")
    single = single.groupBy("anchor", "x").agg(F.max(F.col("side") == 0).alias("no_l"), F.max(F.col("side") == 1).alias("no_r"))
    ok = lambda side: (F.col(side).isNotNull() & ~F.coalesce(f"no_{side}", F.lit(False)))
    live = cuts.join(single, ["anchor", "x"], "left").select("anchor", "x", "before", "content", "copies", ok("l").alias("left"), ok("r").alias("right")).filter("left or right")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, x, before, copies, left, right = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "x", "before", "copies", "left", "right"))
            for lo, hi, data, off in arrays.slices(batch.column("content")):
                words = arrays.Words(data, off)
                f = arrays.kgrams(words.hashes(lower=False), plan.window)
                at = np.arange(len(f))
                doc = np.searchsorted(words.off, at, "right") - 1
                inside = words.off[doc + 1] >= at + plan.window
                at, doc = at[inside], doc[inside]
                s = at - words.off[doc]
                doc = doc + lo
                distance = before[doc] - s
                use = np.where(distance >= plan.left, left[doc], right[doc]).astype(bool)
                doc, s, f = doc[use], s[use], arrays.mix(f[at[use]] + arrays.mix(distance[use].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[doc]), pa.array(x[doc]), pa.array(copies[doc]), pa.array(s.astype(np.int32)), pa.array(f.view(np.int64))], ["anchor", "x", "copies", "s", "f"])

    every = live.mapInArrow(windows, "anchor long, x long, copies long, s int, f long")
    alone = every.groupBy("anchor", "f").agg(F.sum("copies").alias("n"), F.min("x").alias("x"), F.min("s").alias("s")).filter("n = 1")
    alone = alone.groupBy("anchor", "x").agg(F.collect_list("s").alias("alone"))
    return live.join(alone, ["anchor", "x"], "left").filter("copies = 1").select("anchor", "x", "before", "content", "left", "right", "alone")


def located(contexts: list[tuple[bytes, int, bool, bool, list[int] | None]], plan: repeats.Plan) -> list[list[tuple[int, int]]]:
    """For each context (content, before, left, right, alone) of a shard the spans of words that the shard's passages cover.

    A passage is what the recurring windows of a context cover: they all hold its anchor, so that is one run of words.
    """
    known: set[bytes] = set()
    for content, before, left, right, alone in contexts:
        words, gone = content.split(b" "), set(alone or ())
        own = [s for s in range(len(words) - plan.window + 1) if (left if before - s >= plan.left else right) and s not in gone]
        if own:
            known.add(b" ".join(words[own[0] : own[-1] + plan.window]))
    if not known:
        return [[] for _ in contexts]
    # words are set off by one space at both ends, so that no match begins or ends inside a word
    machine = ahocorasick.Automaton()
    for p in known:
        text = f" {p.decode('utf-8', 'surrogateescape')} "
        machine.add_word(text, len(text))
    machine.make_automaton()
    out = []
    for content, *_ in contexts:
        text = f" {content.decode('utf-8', 'surrogateescape')} "
        out.append([])
        for first, last in repeats.merged([(end - n + 1, end) for end, n in machine.iter(text)], len(text)):
            a = text.count(" ", 0, first)
            out[-1].append((a, a + text.count(" ", first, last)))
    return out


def passage_spans(docs: DataFrame, plan: repeats.Plan) -> DataFrame:
    """(k, spans array<struct<a, b>>) of the rows of ``docs`` (k, text) that hold recurring windows, in words."""
    seats, whole, open_, cuts = repeats.contexts(docs, plan)
    cuts = common.stored(cuts.select("anchor", "x", "before", "content", "copies", "l", "r"))
    told = recurring(cuts, plan)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["anchor", "x", "content", "before", "left", "right", "alone"]
            rows = list(zip(*(batch.column(c).to_pylist() for c in names)))
            found = [(r[0], r[1], *s) for r, own in zip(rows, located([r[2:] for r in rows], plan)) for s in own]
            c = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["anchor", "x", "a", "b"])

    # a shard is a batch of contexts of one anchor or several, each automaton as large as a batch
    hit = common.stored(whole.union(told.mapInArrow(locate, "anchor long, x long, a int, b int")))
    for done in (cuts, open_):
        common.drop_stored(done)
    return repeats.spread(seats, hit)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, extra: list[str] | None = None) -> DataFrame:
    """(doc_id, *extra, n_words, n_removed, spans, kept string) of each row: words covered by a recurring window go.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; ``kept`` has the others joined by one space; ``spans`` are the maximal
    removed runs (from, to) in words. All occurrences go, judged on the input; matches end at document borders. Null
    texts have no words; texts shorter than a window stay whole. A row given twice repeats itself.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), *[docs[c] for c in extra or []], docs[text_col].cast("string").alias("text")).withColumn("k", common.row_key("doc_id", "text"))
    found = passage_spans(rows.select("k", "text"), repeats.Plan(repeats.WordUnits, window, min(ANCHOR, window)))
    names = ["doc_id", *(extra or [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo, hi, data, off in arrays.slices(batch.column(at)):
                n, gone, runs, kept = [], [], [], []
                for d in range(hi - lo):
                    words, spans = data[off[d] : off[d + 1]].tobytes().split(), batch.column(at + 1)[lo + d].as_py()
                    own = repeats.merged([(s["a"], s["b"]) for s in spans or ()], len(words))
                    edge = [0, *[x for r in own for x in r], len(words)]
                    left = [w for a, b in zip(edge[::2], edge[1::2]) for w in words[a:b]]
                    n.append(len(words))
                    gone.append(len(words) - len(left))
                    runs.append([{"a": a, "b": b} for a, b in own])
                    kept.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(at)], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "spans", "kept"])

    wide = rows.join(found, "k", "left").select(*names, "text", "spans")
    own = wide.drop("text", "spans").schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own] + ["n_words long, n_removed long, spans array<struct<a:long,b:long>>, kept string"])
    return wide.mapInArrow(cut, schema)


def op1_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_passages(common.table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))
