"""Token counts without token ids: pieces per distinct pre-token, times its frequency in each document.

Every distinct pre-token of the corpus is tokenized once. Per-document frequencies meet those counts in two
ways: a bounded table of the most widespread pre-tokens is broadcast and summed while a document is read; the
rest leaves the task as (pre-token key, frequency) and is joined.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import arrays, common, pretokens

TOKENIZER_FILE = "byte_bpe_50k.json"
#: Entries of the broadcast table at most: 12 bytes each.
WIDESPREAD = 1 << 18
#: Distinct pre-tokens that a task gathers before it passes them on.
GATHERED = 200_000


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


@functools.cache
def special(path: str) -> list[str]:
    """Strings that the library takes out of a text before it splits the rest."""
    return [x.content for x in tokenizer(path).get_added_tokens_decoder().values()]


def without_special(texts: list[str], strings: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces of the texts between special strings, the text that each is of, and how many special strings each text holds."""
    found = np.zeros(len(texts), np.int64)
    hit = [i for i, t in enumerate(texts) if any(s in t for s in strings)]
    if not hit:
        return texts, np.arange(len(texts)), found
    import regex

    split, pieces, owner = regex.compile("|".join(map(regex.escape, sorted(strings, key=len, reverse=True)))).split, [], []
    hits = set(hit)
    for i, t in enumerate(texts):
        own = split(t) if i in hits else [t]
        found[i] = len(own) - 1
        pieces += own
        owner += [i] * len(own)
    return pieces, np.array(owner), found


def _frequencies(texts: list[str], path: str):
    """(joined text, span starts, span ends, example spans of distinct keys, keys, text and distinct index of each (text, pre-token) pair, its frequency, special strings)."""
    pieces, owner, found = without_special(texts, special(path))
    points, off = pretokens.code_points(pieces)
    start = pretokens.spans(points, off)
    keys, example, place = pretokens.distinct(pretokens.span_keys(points, start))
    of = owner[np.searchsorted(off, start, "right") - 1] if len(start) else np.zeros(0, np.int64)
    pair, freq = np.unique(of * max(1, len(keys)) + place, return_counts=True)
    return pieces, start, np.append(start[1:], len(points)), example, keys, pair // max(1, len(keys)), pair % max(1, len(keys)), freq, found


def distinct_pretokens(docs: DataFrame, path: str) -> DataFrame:
    """(key, piece, n_tokens, spread): each distinct pre-token once, its token count by the library, and in how many task buffers it was seen."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, str] = {}
        count: dict[int, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.array(list(seen), np.uint64).view(np.int64)), pa.array(list(seen.values()), pa.string()), pa.array(list(count.values()), pa.int64())], ["key", "piece", "spread"])

        for batch in batches:
            text = batch.column(0).fill_null("")
            for lo, hi, _, _ in arrays.slices(text):
                pieces, start, end, example, keys, _, _, _, _ = _frequencies(text.slice(lo, hi - lo).to_pylist(), path)
                joined = "".join(pieces)
                for k, a, b in zip(keys.tolist(), start[example].tolist(), end[example].tolist()):
                    if k in seen:
                        count[k] += 1
                    else:
                        seen[k], count[k] = joined[a:b], 1
                if len(seen) > GATHERED:
                    yield out()
                    seen.clear()
                    count.clear()
        if seen:
            yield out()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                n = [len(x) for x in own.encode_batch_fast(part.column(1).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], ["key", "piece", "spread", "n_tokens"])

    found = docs.select("text").mapInArrow(gather, "key long, piece string, spread long")
    return found.groupBy("key", "piece").agg(F.sum("spread").alias("spread")).mapInArrow(tokens, "key long, piece string, spread long, n_tokens long")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row, over its whole text, as the tokenizers library counts, without begin or end tokens.

    A null or empty text has no bytes and no tokens. Repeated rows count each for itself; null ids stay null.
    A special string inside a text is one token, as the library's default has it.
    """
    path = path or public_tokenizers.path(TOKENIZER_FILE)
    spark = docs.sparkSession
    docs = common.documents(docs, id_col, text_col)
    pieces = common.stored(distinct_pretokens(docs, path).select("key", "n_tokens", "spread"))
    # bounded: WIDESPREAD entries of 16 bytes
    top = common.most_frequent(pieces, "spread", WIDESPREAD).select("key", "n_tokens").toArrow()
    keys = top["key"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[order], top["n_tokens"].to_numpy().astype(np.int32)[order]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_of = table.value
        for batch in batches:
            text = batch.column(1).fill_null("")
            for lo, hi, _, off in arrays.slices(text):
                texts = text.slice(lo, hi - lo).to_pylist()
                _, _, _, _, key, doc, kind, freq, found = _frequencies(texts, path)
                key = key.view(np.int64)
                at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
                is_known = known[at] == key if len(known) else np.zeros(len(key), bool)
                value = np.where(is_known, n_of[at], 0) if len(known) else np.zeros(len(key), np.int64)
                total = np.bincount(doc, freq * value[kind], hi - lo).astype(np.int64) + found
                rare = ~is_known[kind]
                count = np.bincount(doc[rare], minlength=hi - lo)
                at = np.zeros(hi - lo + 1, np.int64)
                np.cumsum(count, out=at[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(total), arrays.list_array(pa.array(key[kind[rare]]), at), arrays.list_array(pa.array(freq[rare].astype(np.int32)), at)], ["doc_id", "n_bytes", "known", "keys", "freqs"])

    # one row per document; its number ties the rare part back to it
    rows = docs.select(common.row_key("doc_id", "text").alias("k"), "doc_id", "text")
    rows = rows.select("doc_id", "text", "k")

    def read_keyed(batches):
        for batch in batches:
            at = 0
            for out in read(iter([batch.select(["doc_id", "text"])])):
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(at, out.num_rows), *out.columns], ["k", *out.schema.names])
                at += out.num_rows

    rows = common.stored(rows.mapInArrow(read_keyed, "k long, doc_id long, n_bytes long, known long, keys array<long>, freqs array<int>"))
    # rows alike in id and text have the same rare part: it is joined once
    rare = rows.filter(F.size("keys") > 0).dropDuplicates(["k", "doc_id"]).select("k", "doc_id", F.explode(F.arrays_zip("keys", "freqs")).alias("x")).select("k", "doc_id", F.col("x.keys").alias("key"), F.col("x.freqs").alias("freq"))
    rest = rare.join(pieces.select("key", "n_tokens"), "key").groupBy("k", "doc_id").agg(F.sum(F.col("freq") * F.col("n_tokens")).alias("rest"))
    rest = rest.select(F.col("k").alias("rk"), F.col("doc_id").alias("rid"), "rest")
    return rows.join(rest, (rows.k == rest.rk) & rows.doc_id.eqNullSafe(rest.rid), "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; null texts count 0, repeated rows each for itself."""
    counted = count_tokens(common.table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
