"""Bounds on what one Python worker holds."""

from unittest import mock

import numpy as np
import public_tokenizers
import pyarrow as pa

from skylattice.llm import arrays, bloom_lm, byte_bpe, language


def test_features_of_many_short_texts_are_not_dense_together():
    column = pa.array(["ab cd"] * 3000)
    sizes = [x.shape[0] for _, _, x in language.features(column)]
    assert sum(sizes) == 3000 and max(sizes) <= language.ROWS_AT_ONCE


def test_an_svm_learns_alike_from_sparse_rows():
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((200, language.BUCKETS)) < 0.05, rng.random((200, language.BUCKETS)), 0).astype(np.float32)
    positive = rng.random(200) < 0.5
    lies = rng.permutation(200)  # the row that lies at each place
    row, at = np.nonzero(dense[lies])
    sparse = language.Sparse(at.astype(np.int16), dense[lies][row, at], np.bincount(row, minlength=200), np.argsort(lies))
    a, b = language.train(dense, positive, 1), language.train(sparse, positive, 1)
    assert np.array_equal(a.w, b.w) and a.bias == b.bias


def test_decoding_holds_no_merges():
    path = public_tokenizers.path(byte_bpe.RANK_FILE)
    own = byte_bpe.decoder(path)
    assert not hasattr(own, "pairs") and byte_bpe.SLICE_BYTES <= 1 << 20
    ids, _ = byte_bpe.encoder(path).encode_texts(["Grüße aus  Köln"])
    assert own.decode(ids).tobytes().decode() == "Grüße aus  Köln"


def test_ngrams_are_added_up_from_small_slices(monkeypatch):
    seen = []
    monkeypatch.setattr(bloom_lm, "tokens", lambda data, off, of=bloom_lm.tokens: seen.append(len(data)) or of(data, off))
    texts = [f"word{i % 7} the {i}\n" * 3000 for i in range(300)] + [None, ""]
    column = pa.array(texts)
    got = list(bloom_lm.tallies(column, bloom_lm.bigrams))
    assert max(seen) <= arrays.SLICE_BYTES and 1 < len(got) < len(seen)
    whole = arrays.slices(column, 1 << 30)
    _, _, data, off = next(whole)
    want, n = np.unique(bloom_lm.bigrams(*bloom_lm.tokens(data, off)), return_counts=True)
    sums = {}
    for g, c in got:
        assert (g[1:] > g[:-1]).all()
        for x, y in zip(g.tolist(), c.tolist()):
            sums[x] = sums.get(x, 0) + y
    assert sums == dict(zip(want.tolist(), n.tolist()))
    assert list(bloom_lm.tallies(pa.array([], pa.string()), bloom_lm.bigrams)) == []


def test_a_filter_goes_with_its_broadcast(spark):
    """It is broadcast as laid out: no second copy in a worker, and none that stays."""
    rng = np.random.default_rng(5)
    grams = rng.integers(1, 1 << 63, 2000, dtype=np.uint64)
    block = bloom_lm.block_of(grams, 3)
    rows = [(b, bytearray(bloom_lm.build_block(grams[block == b], np.ones((block == b).sum(), np.int64)).tobytes())) for b in range(3)]
    shared = bloom_lm._broadcast(spark.createDataFrame(rows, "block long, bits binary"), 3)
    assert isinstance(shared.value, bloom_lm.Filter)
    assert (shared.value.levels(grams) >= 1).all() and len(shared.value.data) == sum(len(x) for _, x in rows)


def test_the_memo_of_pre_tokens_goes_with_its_task():
    docs = mock.Mock()
    with mock.patch.object(byte_bpe.common, "documents", return_value=docs):
        byte_bpe.encode(docs)
    run = docs.mapInArrow.call_args[0][0]
    own = byte_bpe.encoder(public_tokenizers.path(byte_bpe.RANK_FILE))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["Grüße aus  Köln zzqxv", None, "it's 12345"])], ["doc_id", "text"])
    rows = run(iter([batch]))
    first = next(rows)
    assert own.memo and all(isinstance(x, bytes) for x in own.memo.values())
    assert [own.decode(np.array(x, np.int32)).tobytes().decode() for x in first.column(1).to_pylist()] == ["Grüße aus  Köln zzqxv", "", "it's 12345"]
    assert list(rows) == [] and not own.memo
