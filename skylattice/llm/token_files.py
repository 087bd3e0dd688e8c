"""Token ids in Parquet files: one row per document, in the order of ids, for reading by document, by place, or without tokens.

A folder has two tables. ``tokens`` holds a document's ids as a list (dictionary encoded: an id then takes as many bits as the
part's distinct ids need) beside narrow columns that rise (delta encoded). Row groups and pages are small enough that the
column and page indexes, which cover the narrow columns, spare a reader the pages of other documents. A file is a *part*: a
range of documents; ``at`` counts the ids before a document in its part. ``parts`` says where each part begins in the whole.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import arrays, common

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1_000
#: Pieces of words that a worker's memo holds at most, and the longest of them; bounds on memory, not on results.
MEMO_WORDS = 500_000
MEMO_LENGTH = 64
#: Bytes of text encoded at a time.
SLICE_BYTES = 8 << 20
TOKENS = "doc_id long, part int, at long, n_tokens long, ids array<int>"
PARTS = "part int, start long, n_tokens long, n_docs long, first_doc long, last_doc long"


#: A word that ends in such marks after a letter or digit is two pieces, as the tokenizer's pattern has it.
MARKS = ".,!?;:%$&#"
MARKED = "^[^<]*[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][" + MARKS + "]+$"


class WordEncoder:
    """Ids of texts by the pieces of their words, each encoded once.

    The tokenizer never looks past ASCII white space, which it drops; it parts closing marks from the letters before them; and
    it puts texts in small letters, but for its special strings, which are looked for first. So a text's ids are those of its
    pieces, small letters first unless a piece may hold a special string.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.off, self.held = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    def learn(self, pieces: list[str]) -> None:
        """Encodes ``pieces``, new and distinct, after those held."""
        n, found = self.held, [e.ids for e in self.own.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        end = self.off[n] + np.cumsum(size)
        while n + len(found) + 1 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        while len(found) and end[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.off[n + 1 : n + 1 + len(found)] = end
        self.ids[self.off[n] : self.off[n + len(found)]] = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum()))
        self.memo.update(zip(pieces, range(n, n + len(found))))
        self.held += len(found)

    def joined(self, place: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each begins) of runs of ``count`` pieces, the pieces at ``place``."""
        size = self.off[place + 1] - self.off[place]
        begin = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        return self.ids[arrays.ragged(self.off[place], size)], begin

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each begins); every text ends in ``end_id``."""
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten().dictionary_encode()
        kinds = pc.if_else(pc.match_substring(flat.dictionary, "<|"), flat.dictionary, pc.ascii_lower(flat.dictionary))
        marked = pc.match_substring_regex(kinds, MARKED).to_numpy(zero_copy_only=False)
        cores = pc.utf8_rtrim(kinds.filter(pa.array(marked)), characters=MARKS)
        listed = lambda x: x.to_numpy(zero_copy_only=False).tolist()
        first, second, at = listed(kinds), [], np.flatnonzero(marked)
        for i, core in zip(at.tolist(), listed(cores)):
            second.append(first[i][len(core) :])
            first[i] = core
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        new = {*first, *second} - self.memo.keys()
        self.learn(list(new))
        count = 1 + marked.astype(np.int64)
        place = np.empty(int(count.sum()), np.int64)
        begin = np.cumsum(count) - count
        place[begin] = np.fromiter(map(self.memo.__getitem__, first), np.int64, len(first))
        place[begin[at] + 1] = np.fromiter(map(self.memo.__getitem__, second), np.int64, len(second))
        ids, off = self.joined(place, count)
        # occurrences of words, then texts; the end id goes after the words of its text
        index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = off[index + 1] - off[index]
        before = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)]
        for w in [w for w in new if len(w) > MEMO_LENGTH]:
            del self.memo[w]
        return np.insert(ids[arrays.ragged(off[index], size)], before[1:], end_id), before + np.arange(len(texts) + 1)


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Writes the ids of every row's whole text to ``path``, each followed by ``end_id``, by rising id.

    Rows with one id stand by the hash of their text; null ids come last. A null or empty text has the end id alone. Repeated
    rows stand one after the other. An empty table makes an empty folder of both tables. The ids are those of the tokenizers
    library without special tokens added; special strings inside a text are its tokens.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or public_tokenizers.path(TOKENIZER_FILE)
    rows = common.documents(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, _, _ in arrays.slices(batch.column(1), SLICE_BYTES):
                ids, off = own.encode(batch.column(1).slice(lo, hi - lo), end_id)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(at + off[:-1]), pa.array(np.diff(off)), arrays.list_array(pa.array(ids), off)], ["doc_id", "part", "at", "n_tokens", "ids"])
                at += len(ids)

    told = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, TOKENS)
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": 1 << 20}
    told.write.options(**options).parquet(f"{path}/tokens")
    counted = tokens_table(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    rows, start = [], 0
    for r in sorted(counted.collect()):  # a row per file
        rows.append((r.part, start, r.n_tokens, r.n_docs, r.first_doc, r.last_doc))
        start += r.n_tokens
    spark.createDataFrame(rows, PARTS).coalesce(1).write.parquet(f"{path}/parts")


def tokens_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).parquet(f"{path}/tokens")


def parts_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(f"{path}/parts")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every document; no token is read."""
    return with_start(tokens_table(spark, path).select("doc_id", "part", "at", "n_tokens"), spark, path)


def with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``rows`` with ``start``, the ids of all documents before, in place of ``part`` and ``at``."""
    return rows.join(parts_table(spark, path).select("part", F.col("start").alias("_base")), "part").withColumn("start", F.col("_base") + F.col("at")).drop("part", "at", "_base")


def documents_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents with ids from ``first`` to ``last``: other files, row groups and pages stay unread."""
    files = [r.part for r in parts_table(spark, path).filter((F.col("first_doc") <= last) & (F.col("last_doc") >= first)).collect()]
    return tokens_table(spark, path).filter(F.col("part").isin(files) & F.col("doc_id").between(first, last)).select("doc_id", "n_tokens", "ids")


def tokens_between(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(doc_id, start, ids) of the stream's ids from place ``start`` to before ``stop``, cut at the ends, by document."""
    rows = tokens_table(spark, path)
    out = rows.filter(F.lit(False)).select("doc_id", F.col("at").alias("start"), "ids")
    for p in parts_table(spark, path).filter((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start)).collect():
        a, b = max(0, start - p.start), min(p.n_tokens, stop - p.start)
        hit = rows.filter((F.col("part") == p.part) & (F.col("at") < b) & (F.col("at") + F.col("n_tokens") > a))
        left = F.greatest(F.lit(a) - F.col("at"), F.lit(0))
        size = F.least(F.lit(b) - F.col("at"), F.col("n_tokens")) - left
        out = out.unionByName(hit.select("doc_id", (F.lit(p.start) + F.col("at") + left).alias("start"), F.slice("ids", (left + 1).cast("int"), size.cast("int")).alias("ids")))
    return out


def checksums(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``n_tokens`` and ``ids_crc32`` counted from the ids: unsigned crc32 of them as little-endian 32-bit integers."""
    kept = [c for c in tokens.columns if c not in ("ids", "n_tokens")]

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.names.index("ids"))
            off = ids.offsets.to_numpy().astype(np.int64)
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8))
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in kept], pa.array(np.diff(off)), pa.array(crc, pa.int64())], [*kept, "n_tokens", "ids_crc32"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema if f.name in kept)
    return tokens.select(*kept, "ids").mapInArrow(run, f"{kind}, n_tokens long, ids_crc32 long")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of ``documents``, read back from the files that ``write`` makes of it."""
    path = common.shared_dir(spark)
    write(common.table(spark, sf_dir, "documents"), path)
    read = checksums(tokens_table(spark, path).select("doc_id", "part", "at", "ids"))
    return with_start(read, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
