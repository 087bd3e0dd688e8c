"""Language identification in two steps: the family first, then one-versus-one linear SVMs among its languages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import arrays, common

#: Families of ISO 639-1 codes. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
}
#: Different labelled texts fitted per language, about: all of a language that has no more, else those with a hash below a share.
ROWS_PER_LANGUAGE = 1500
#: Texts of other families that a family's SVM learns from, about.
OTHERS_PER_FAMILY = 6000
BUCKETS = 4096
#: Documents whose dense features are held together, however short they are.
ROWS_AT_ONCE = 256
EPOCHS = 60
DECAY = 1e-3


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, matrix): per document the square roots of its byte 2- and 3-gram shares, hashed, at unit length."""
    low = np.arange(256, dtype=np.uint32)
    low[65:91] += 32
    for lo, hi, data, off in arrays.slices(column, max_rows=ROWS_AT_ONCE):
        n = hi - lo
        b = low[data]
        doc = np.repeat(np.arange(n), np.diff(off))
        total = np.zeros(n * BUCKETS, np.float32)
        for width in (2, 3):
            if len(b) < width:
                continue
            g = b[: len(b) - width + 1].copy()
            for i in range(1, width):
                g = g * np.uint32(257) + b[i : len(b) - width + 1 + i]
            same = doc[: len(g)] == doc[width - 1 :]
            g = (g * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
            total += np.bincount(doc[: len(g)][same] * BUCKETS + g[same], minlength=n * BUCKETS).astype(np.float32)
        x = np.sqrt(total.reshape(n, BUCKETS))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        yield lo, hi, x


class LinearSVM:
    """A hyperplane."""

    def __init__(self, w: np.ndarray, bias: float):
        self.w, self.bias = w, bias


class Sparse:
    """Rows of features as places and values end to end; ``x[rows]`` are some rows, dense. So a task holds no dense matrix."""

    def __init__(self, at: np.ndarray, value: np.ndarray, size: np.ndarray, order: np.ndarray):
        """Row i is the one that lies at place ``order[i]``."""
        self.at, self.value, self.count = at, value, size[order]
        self.first = (np.cumsum(size) - size)[order]
        self.shape = (len(order), BUCKETS)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        first, count = self.first[rows], self.count[rows]
        x, some = np.zeros((len(rows), BUCKETS), np.float32), arrays.ragged(first, count)
        x[np.repeat(np.arange(len(rows)), count), self.at[some]] = self.value[some]
        return x


def train(x: np.ndarray | Sparse, positive: np.ndarray, seed: int) -> LinearSVM:
    """Hinge loss with weight decay, by subgradient steps over shuffled blocks; classes weigh alike."""
    rng = np.random.default_rng(seed)
    y = np.where(positive, 1.0, -1.0)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())) * len(y)
    w, bias, step = np.zeros(x.shape[1]), 0.0, 0
    total_w, total_b, n = np.zeros(x.shape[1]), 0.0, 0
    for epoch in range(EPOCHS):
        for block in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            step += 1
            rate = min(1 / (DECAY * (step + 100)), 5.0)
            own = x[block]
            active = (y[block] * (own @ w + bias) < 1) * weight[block] * y[block] / len(block)
            w = (1 - rate * DECAY) * w + rate * (active @ own)
            bias += 0.1 * rate * active.sum()
            if epoch >= EPOCHS // 2:
                total_w, total_b, n = total_w + w, total_b + bias, n + 1
    return LinearSVM(total_w / max(1, n), total_b / max(1, n))


class Model:
    """``families``: one SVM per family against the rest; ``pairs``: one SVM for each two languages of a family."""

    def __init__(self, langs: list[str], svms: dict[str, LinearSVM] | None = None):
        self.langs = sorted(set(langs))
        self.members: dict[str, list[str]] = {}
        for a in self.langs:
            self.members.setdefault(family(a), []).append(a)
        self.names = sorted(self.members)
        self.pairs = [(a, b) for m in self.members.values() for i, a in enumerate(m) for b in m[i + 1 :]]
        self.svms = svms or {}

    def tasks(self, lang: str) -> list[tuple[str, bool, bool]]:
        """(SVM, on its positive side, may be thinned out) of each SVM that learns from texts in ``lang``."""
        own = family(lang)
        told = [(f"family {f}", f == own, f != own) for f in self.names] if len(self.names) > 1 else []
        return told + [(f"{a} or {b}", a == lang, False) for a, b in self.pairs if lang in (a, b)]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score: the family's sigmoid margin times the language's mean over its pairs."""
        n = len(x)
        sure = lambda svm: 1 / (1 + np.exp(-np.clip(2 * (x @ svm.w + svm.bias), -60, 60)))
        share = np.stack([sure(self.svms[f"family {f}"]) for f in self.names], 1) if len(self.names) > 1 else np.ones((n, 1))
        best = share.argmax(1)
        lang, score = np.empty(n, object), np.zeros(n)
        for f, name in enumerate(self.names):
            rows = np.flatnonzero(best == f)
            members = self.members[name]
            votes, mean = np.zeros((n, len(members))), np.zeros((n, len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    p = sure(self.svms[f"{a} or {members[j]}"])
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    mean[:, i] += p
                    mean[:, j] += 1 - p
            if len(members) == 1:
                mean[:] = 1.0
            else:
                mean /= len(members) - 1
            pick = (votes + mean / 2).argmax(1)
            lang[rows] = np.array(members, object)[pick[rows]]
            score[rows] = share[rows, f] * mean[rows, pick[rows]]
        return lang, np.clip(score, 0.0, 1.0)


def sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(lang, h, text): about ``rows`` different whole texts of each language, all of it if it has no more.

    Texts are taken by their hash: below the share rows / different texts of the language. No text is sorted or gathered,
    copies count once, and a language with many rows costs no more than another. Null texts and labels play no part.
    """
    plain = labelled.select(labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang")).filter("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    # one row a language
    share = plain.groupBy("lang").agg((F.lit(float(rows)) / F.approx_count_distinct("h", 0.02)).alias("share"))
    taken = plain.join(F.broadcast(share), "lang").filter((F.col("share") >= 1) | (F.col("h") / 2.0**64 + 0.5 < F.col("share")))
    return taken.groupBy("lang", "h").agg(F.first("text").alias("text"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model of the languages of ``labelled``; None without labelled text. Rows with a null text or label play no part.

    Fitted on ``sample``. Texts become sparse features on the executors; each SVM is trained by one task, which holds its
    own texts' features only: about ``rows`` per language and ``OTHERS_PER_FAMILY``. The driver gets the hyperplanes.
    """
    taken = sample(labelled, text_col, lang_col, rows)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in features(batch.column(2)):
                doc, at = np.nonzero(x)
                off = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in (0, 1)], arrays.list_array(pa.array(at.astype(np.int16)), off), arrays.list_array(pa.array(x[doc, at].astype(np.float32)), off)], ["lang", "h", "at", "x"])

    rows_of = common.stored(taken.select("lang", "h", "text").mapInArrow(sparse, "lang string, h long, at array<short>, x array<float>"))
    sizes = {r[0]: r[1] for r in rows_of.groupBy("lang").agg(F.count("*")).orderBy("lang").collect()}
    if not sizes:
        return None
    model = Model(list(sizes))
    few = min(1.0, OTHERS_PER_FAMILY / sum(sizes.values()))
    deal = [(lang, *t) for lang in sizes for t in model.tasks(lang)]
    if not deal:
        return model
    dealt = rows_of.sparkSession.createDataFrame(deal, "lang string, svm string, positive boolean, thinned boolean")
    # the first bits of a hash picked the text: others thin it out
    own = rows_of.join(F.broadcast(dealt), "lang").filter(~F.col("thinned") | (F.xxhash64("h") / 2.0**64 + 0.5 < few))

    def learn(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("h", "ascending")]).to_numpy()  # rows in one order whatever the shuffle's
        size = np.concatenate([pc.list_value_length(c).to_numpy() for c in table.column("at").chunks]).astype(np.int64)
        at, value = (np.concatenate([c.flatten().to_numpy() for c in table.column(n).chunks]) for n in ("at", "x"))
        positive = table.column("positive").to_numpy()
        name, table = table.column("svm").slice(0, 1), None
        svm = train(Sparse(at, value, size, order), positive[order], 1)
        return pa.table({"svm": name, "w": pa.array([svm.w.astype(np.float32)], pa.list_(pa.float32())), "bias": pa.array([svm.bias])})

    told = own.select("svm", "h", "positive", "at", "x").groupBy("svm").applyInArrow(learn, "svm string, w array<float>, bias double").collect()
    model.svms = {r[0]: LinearSVM(np.array(r[1], np.float32), r[2]) for r in told}
    common.drop_stored(rows_of)
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """(doc_id, *extra, lang_pred, score) of each row. ``und`` with score 0 for null, for texts without a letter, and without a model.

    Repeated rows give a row each; ties go to the language first in alphabetical order. An ``extra`` column named like a
    result gives way to it. An empty table gives no rows. No shuffle.
    """
    extra = [c for c in extra or [] if c not in ("doc_id", "lang_pred", "score")]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    letters = F.coalesce(F.regexp_like(docs[text_col], F.lit(r"\p{L}")), F.lit(False))
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), *[docs[c] for c in extra], docs[text_col].cast("string").alias("_text"), letters.alias("_letters"))
    kept = docs.drop("_text", "_letters").schema
    names = [f.name for f in kept]

    def run(batches):
        own = shared.value
        for batch in batches:
            text = batch.column(len(names)).fill_null("")
            ok = batch.column(len(names) + 1).to_numpy(zero_copy_only=False)
            for lo, hi, x in features(text):
                if own is None:
                    lang, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                else:
                    lang, score = own.predict(x)
                    lang[~ok[lo:hi]], score[~ok[lo:hi]] = "und", 0.0
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(len(names))], pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])
    return docs.mapInArrow(run, schema)


def held_out():
    """Whether the remainder of the id's checksum holds a document out; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by a model of those that are not held out; one row per row."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
