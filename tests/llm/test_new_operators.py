"""Whitening, resampling and token files against plain restatements."""

import hashlib
import math
import zlib
from collections import Counter
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from brute import LOWER
from pyspark.sql import functions as F
from test_llm import ODD, SF, key, odd, real

from skylattice.llm import radix, registry, resample, token_files, whitening


def whitened_brute(rows, most=4):
    x = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for size in {len(v) for _, v in x} - {0}:
        own = [(i, v) for i, v in x if len(v) == size]
        fit = sorted({tuple(v) for _, v in own})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        y = [[n * c - t for c, t in zip(v, s)] for v in fit]
        cov = np.array([[sum(r[a] * r[b] for r in y) / n**3 for a in range(size)] for b in range(size)])
        e, u = np.linalg.eigh(cov)
        e, u = e[::-1][:most], u[:, ::-1][:, :most]
        for i, v in own:
            c = [n * a - t for a, t in zip(v, s)]
            for k in range(len(e)):
                out.append((i, k + 1, n, sum(a * a for a in c), abs(float(np.dot(np.array(c) / n, u[:, k]))) / math.sqrt(e[k]) if e[k] > 1e-12 * cov.trace() else None, e[k] / cov.trace() if cov.trace() > 0 else None))
    return out


def same_whitening(got, want):
    got, want = sorted(got, key=lambda r: key(r[:4])), sorted(want, key=lambda r: key(r[:4]))
    assert [tuple(r[:4]) for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        for a, b in ((g["whitened"], w[4]), (g["explained"], w[5])):
            assert (a is None) == (b is None)
            assert a is None or abs(abs(a) - b) < 1e-7


def test_whitening_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    got = registry.QUERIES["op11_whitening"](spark, SF)
    assert got.schema.simpleString() == "struct<vec_id:bigint,component:int,n:bigint,deviation:bigint,whitened:double,explained:double,identity_error:double>"
    got = got.collect()
    same_whitening(got, whitened_brute(rows))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    # signs are the same for all rows: components do not correlate
    w = np.array([[r["whitened"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["component"] == c] for c in (1, 2)])
    assert abs(np.corrcoef(w)[0, 1]) < 0.1


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (2, [0.5, -0.25, 1.0]), (3, [-0.0, 3e2, 0.1]), (None, [7.0, -1e-9, 0.2]), (4, None), (5, []), (6, [nan, 1.0, 1.0]), (7, [1.0, None, 1.0]), (8, [inf, 0.0, 0.0]), (9, [1.0, 2.0]), (10, [0.0, 0.0, 9e2])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, x string, v int, n int")
    same_whitening(whitening.whiten(df).collect(), whitened_brute(rows))
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.filter("vec_id in (4, 5, 6)")).collect() == []


def test_square_sums_are_exact():
    rng = np.random.default_rng(1)
    for bits in (10, 30, 47, 61):
        w = rng.integers(-(1 << bits), 1 << bits, (50, 7))
        limbs = -(-(bits + 1) // whitening.LIMB)
        for axis in (0, 1):
            assert whitening.square_sums(w, axis, limbs).tolist() == (w.astype(object) ** 2).sum(axis).tolist()


def resampled(rows, target, percent=10, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = Counter(bucket(w) for _, x in rows for w in words(x)), Counter(bucket(w) for x in target for w in words(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, x in rows:
        w = words(x)
        weight = sum(gain(bucket(v)) for v in w) // len(w) if w else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(long[: percent * len(long) // 100])}
    return [(*r, drawn.get(id(r))) for r in out]


def test_resampling(spark):
    target = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    got = registry.QUERIES["op12_resample"](spark, SF).collect()
    want = resampled(real(), target)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    told = db.execute(registry.ORACLES["op12_resample"])
    at = [[d[0] for d in told.description].index(c) for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted((tuple(r[i] for i in at) for r in told.fetchall()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("percent", [10, 100])
def test_resampling_of_odd_texts(spark, percent):
    aim = spark.createDataFrame([(1, "ab one é two words"), (2, None)], "item_id long, text string")
    rows = [*ODD, (11, "tie " * 40), (11, "tie " * 40), (-5, "w1 " * 30)]
    df = spark.createDataFrame([(d, t, 0, "s", 1) for d, t in rows], "doc_id long, text string, rank int, score string, _pos int")
    got = resample.resample(df, aim, percent=percent).collect()
    assert sorted(map(tuple, got), key=key) == sorted(resampled(rows, ["ab one é two words", None], percent), key=key)
    assert resample.resample(df.limit(0), aim).collect() == []
    assert len(resample.resample(df, aim.limit(0)).collect()) == len(rows)


def test_radix_ranks(spark, monkeypatch):
    monkeypatch.setattr(radix, "BLOCK_BITS", 5)
    rng = np.random.default_rng(2)
    big = (1 << 63) - 1
    for keys in ([(int(a), int(b)) for a, b in zip(rng.integers(-3, 3, 400), rng.integers(-(10**6), 10**6, 400))], [(7, big), (7, -big - 1), (6, 0), (7, 0)], [(1, 1)] * 50):
        df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(keys)], "a long, b long, i long").repartition(5)
        got = sorted(radix.ranked(df, ["a", "b"]).collect(), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, len(keys) + 1))
        assert [(r["a"], r["b"]) for r in got] == sorted(keys)
        assert {r["i"] for r in got} == set(range(len(keys)))


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def streamed(rows):
    own, out, start = library(), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark):
    got = registry.QUERIES["op13_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=key) == sorted(streamed(real()), key=key)


HARD = ["á b́̂", "e ̈x", "ΑΣ ΣΑΣ Σ", "x<|endoftext|>y <|startoftext|>", "it's we'LL I'D", "١٢ 3½ ²", "   ok　", "İstanbul ﬁ", "a\x0bb\x0cc\x1cd\x85e", "̀ ́"]


def test_words_encode_like_whole_texts():
    own, lib = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), library()
    import pyarrow as pa

    for texts in (HARD, [t or "" for _, t in ODD], [], [" ".join(HARD)]):
        ids, off = own.encode(pa.array(texts, pa.string()), 1)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [[*lib.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_token_files_of_odd_texts(spark, tmp_path):
    rows = [*ODD, *[(100 + i, t) for i, t in enumerate(HARD)]]
    df = spark.createDataFrame([(d, t, 1, [2], 3) for d, t in rows], "doc_id long, text string, part int, ids array<int>, at int")
    path = str(tmp_path / "t")
    token_files.write(df, path, page_rows=2, row_group_bytes=4096)
    want = streamed(rows)
    got = token_files.metadata(spark, path).select("doc_id", "start", "n_tokens").collect()
    assert sorted(map(tuple, got), key=key) == sorted((r[:3] for r in want), key=key)
    some = token_files.documents_between(spark, path, 4, 9)
    assert sorted(map(tuple, token_files.checksums(some).collect())) == [(d, n, c) for d, _, n, c in want if d is not None and 4 <= d <= 9]
    own = library()
    stream = [i for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0])) for i in [*own.encode(t or "", add_special_tokens=False).ids, 1]]
    for a, b in ((0, len(stream)), (3, 9), (5000, 9000), (len(stream) - 1, len(stream) + 5), (4, 4)):
        cut = [i for r in sorted(token_files.tokens_between(spark, path, a, b).collect(), key=lambda r: r["start"]) for i in r["ids"]]
        assert cut == stream[a:b]
    none = str(tmp_path / "none")
    token_files.write(df.limit(0), none)
    assert token_files.metadata(spark, none).collect() == [] and token_files.tokens_between(spark, none, 0, 5).collect() == []
    # repeated rows have the same ids, one after the other
    twice = str(tmp_path / "twice")
    token_files.write(df.unionByName(df), twice)
    assert sorted(map(tuple, token_files.metadata(spark, twice).select("doc_id", "start", "n_tokens").collect()), key=key) == sorted((r[:3] for r in streamed(rows * 2)), key=key)


def test_token_file_layout(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 60), i -> concat('w', (i * id) % 300)))").alias("text"))
    token_files.write(docs, path, row_group_bytes=64 << 10, page_rows=100)
    files = [f for f in (tmp_path / "t/tokens").glob("*.parquet")]
    seen = set()
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and (column.has_column_index or column.path_in_schema.startswith("ids"))
                seen |= {(column.path_in_schema, e) for e in column.encodings}
    assert any(pq.ParquetFile(f).metadata.num_row_groups > 1 for f in files)
    assert {("ids.list.element", "RLE_DICTIONARY"), ("at", "DELTA_BINARY_PACKED"), ("doc_id", "DELTA_BINARY_PACKED")} <= seen
    plan = token_files.metadata(spark, path)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,part:int,at:bigint,n_tokens:bigint>" in plan
    plan = token_files.documents_between(spark, path, 10, 20)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan
