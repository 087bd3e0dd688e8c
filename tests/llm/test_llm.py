import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import groups, near, phrases, substrings, words
from pyspark.sql import functions as F

from skylattice.llm import bloom_lm, byte_bpe, common, decontaminate, language, minhash, phrases as P, pivots, registry, repeats, suffix_array, token_counts, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, k string, spans string, component_id long"
LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(6000))
ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "Two words"), (6, LONG), (7, LONG + " end"), (8, "ab " * 300), (9, "é" * 900), (10, "it's <|endoftext|> ok"), (None, "no id at all"), (11, "x" * 5000), (12, "1234 5 %%")]


def odd(spark):
    """Nulls, empty and long texts, ties, and columns whose names clash with those the operators use."""
    return spark.createDataFrame([(d, t, "k", "s", 0) for d, t in ODD], SCHEMA)


def real():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def key(r):
    return tuple((x is not None, x) if not isinstance(x, bool) else (True, x) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_phrases(spark):
    same(registry.QUERIES["op1_phrases"](spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), phrases(real()))
    cut = P.remove_passages(odd(spark)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    same(cut.collect(), phrases(ODD))


def test_phrases_around_a_common_passage(spark):
    rng = np.random.default_rng(5)
    word = lambda n, of=9: [f"v{i}" for i in rng.integers(0, of, n)]
    common_ = word(60, 500)
    rows = [(i, " ".join(word(25, 2 + i % 2) + common_[i % 20 : 25 + i % 30] + word(25, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (35, 20, 14, 5):
        got = P.remove_passages(df, window=window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
        same(got.collect(), phrases(rows, window))


@pytest.mark.parametrize("group", [2000, 1])
def test_suffix_array(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    same(registry.QUERIES["op6_suffix_array"](spark, SF).collect(), substrings(real()))
    cut = suffix_array.remove_repeats(odd(spark)).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    same(cut.collect(), substrings(ODD))


def test_suffix_array_kernel():
    rng = np.random.default_rng(3)
    for _ in range(50):
        text = rng.integers(0, 3, rng.integers(1, 60))
        order, ranks = suffix_array.suffix_array(text)
        want = sorted(range(len(text)), key=lambda i: tuple(text[i:]))
        assert order.tolist() == want
        shared = suffix_array.common_prefixes(text, order, ranks, np.array([0]), np.array([len(text)]), 1000)
        for a, b in zip(want, want[1:]):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert shared[b] == n


def test_repeated_rows_repeat_themselves(spark):
    rows = [(1, LONG), (1, LONG), (2, LONG[:3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in P.remove_passages(df).filter("doc_id = 1").collect()} == {6000}
    assert {r.n_removed for r in suffix_array.remove_repeats(df).filter("doc_id = 1").collect()} == {len(LONG)}


def test_token_counts(spark):
    own = token_counts.tokenizer(token_counts.public_tokenizers.path(token_counts.TOKENIZER_FILE))
    want = lambda rows: [(d, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False))) for d, t in rows]
    same(registry.QUERIES["op2_token_counts"](spark, SF).select("doc_id", "n_bytes", "n_tokens").collect(), want(real()))
    same(token_counts.count_tokens(odd(spark)).collect(), want(ODD))


def test_token_counts_with_rare_pretokens(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "WIDESPREAD", 50)
    own = token_counts.tokenizer(token_counts.public_tokenizers.path(token_counts.TOKENIZER_FILE))
    same(token_counts.count_tokens(documents(spark)).select("doc_id", "n_tokens").collect(), [(d, len(own.encode(t or "", add_special_tokens=False))) for d, t in real()])


def test_byte_bpe(spark):
    import tiktoken

    ranks = byte_bpe.read_ranks(byte_bpe.public_tokenizers.path(byte_bpe.RANK_FILE))
    own = tiktoken.Encoding("own", pat_str=byte_bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def want(rows):
        for d, t in rows:
            ids = own.encode_ordinary(t or "")
            yield d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    same(registry.QUERIES["op8_byte_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), list(want(real())))
    got = byte_bpe.decode(byte_bpe.encode(odd(spark))).collect()
    assert {r.doc_id: (r.ids, bytes(r.decoded)) for r in got} == {d: (own.encode_ordinary(t or ""), (t or "").encode()) for d, t in ODD}


def test_warc(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = registry.QUERIES["op3_warc"](spark, SF)
    want = db.execute(warc.OP3_SQL)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    same(got.select(*names).collect(), want.fetchall())
    urls = [(i, u, "") for i, u in enumerate(["HTTP://u:p@WWW.a.com:80/X?y#z", "https://b.org", "c.net?q", "ftp://", "#", "://x.y/z", " d.e/F#", None, "www.a.b.c#x?y"])]
    db.execute("CREATE OR REPLACE VIEW pages AS SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if u is None else repr(u)}, '')" for i, u, _ in urls) + ") t(page_id, url, html)")
    told = {r[0]: r[names.index("urlkey")] for r in db.execute(warc.OP3_SQL).fetchall()}
    assert told == {i: warc.url_key(u) for i, u, _ in urls}
    order = [(r.urlkey, r.captured, r.page_id) for r in got.collect()]
    assert order == sorted(order)
    odd_pages = [(1, None, None, 5), (2, "HTTP://WWW.a.com/X?y", "<p>" * 50, 5), (3, "http://a.com", "<p>" * 50, 5), (3, "http://a.com", "<p>" * 50, 5), (None, "a", "é\r\n\r\n", 5), (4, "", "short", 5), (5, "x", "short", 5)]
    back = warc.read_archives(warc.write_archives(spark.createDataFrame(odd_pages, "page_id long, url string, html string, archive int"))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in back) == [(0, "response", 0), (1, "response", 0), (2, "response", 0), (3, "revisit", 2), (3, "revisit", 2), (4, "response", 0), (5, "response", 0)]
    assert {bytes(r.payload) for r in back if r.page_id is None} == {"é\r\n\r\n".encode()}


def test_capture_index_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    # one very common URL, one repeated page, nulls
    pages = [(i, f"http://a.com/{i % 7 if i % 3 else 0}", f"<p>{i}" + "x" * 200) for i in range(300)] + [(5, "http://z", "y")] * 60 + [(None, None, None)] * 5
    records = warc.read_archives(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string")), payloads=False)
    index = warc.capture_index(records)
    assert index.rdd.getNumPartitions() > 5
    got = [(r.urlkey, r.captured, r.page_id is not None, r.page_id or 0, r.archive, r.offset) for r in index.collect()]
    assert got == sorted(got) and len(set(got)) == len(pages)
    assert Counter(g[0] for g in got) == Counter(warc.url_key(u) for _, u, _ in pages)


def test_loser_tree():
    rng = np.random.default_rng(1)
    for k in range(9):
        runs = [sorted(rng.integers(0, 9, rng.integers(0, 7)).tolist()) for _ in range(k)]
        assert (list(warc.LoserTree(runs)) if k else []) == sorted(sum(runs, []))


def _vectors():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 4)):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])).tolist(), int(rng.integers(0, 2))))
    return rows + [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [None] + [1.0] * 15, 1), (9004, [float("nan")] + [1.0] * 15, 1), (9005, rows[0][1], None), (9006, rows[0][1], rows[0][2]), (9007, [1.0, 2.0], 0), (9008, [], 0)]


def test_pivots_recall_and_results(spark):
    rows = _vectors()
    got = {r.vec_id: r for r in pivots.near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, c int")).collect()}
    good = [(i, np.array(v, float), a) for i, v, a in rows if v and a is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for n, (i, v, a) in enumerate(good) for j, w, b in good[n + 1 :] if a == b and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.98]
    degree = Counter(x for link in links for x in link)
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.9 * len(links) <= found <= len(links) and all(got[i].n_links <= degree[i] for i in got)
    part = groups([r[0] for r in rows], links)
    assert np.mean([got[i].component_id == part[i] for i in got]) >= 0.9
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("dense", [False, True])
def test_pivots_recall_at_64_dimensions(spark, dense):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(20, 64))
    rows = []
    for i in range(1200):
        base = centre[i % 20] + rng.normal(size=64) * 0.35 if dense else rng.normal(size=64)
        for j in range(1 + i % 2):  # the second at about the limit
            rows.append((len(rows), (base + j * rng.normal(size=64) * 0.19 * np.linalg.norm(base) / 8).tolist(), i % 3))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    met = np.triu(x @ x.T >= 0.98, 1) & (label[:, None] == label[None, :])
    got = pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert met.sum() > 200 and met.sum() * 0.9 <= sum(r.n_links for r in got) / 2 <= met.sum()


def test_pivots_query_and_ties(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    met = np.triu(v @ v.T >= 0.98, 1) & (label[:, None] == label[None, :]) & (label >= 0)
    got = {r.vec_id: r for r in registry.QUERIES["op4_pivots"](spark, SF).collect()}
    assert len(got) == len(rows) and sum(r.n_links for r in got.values()) / 2 <= met.sum()
    part = groups([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(met))])
    assert np.mean([got[i].component_id == part[i] for i in part]) >= 0.9
    # one vector for all ids, one row twice, the id of another vector once more
    same_ = [(i, [1.0, 2.0, 3.0], 1) for i in range(50)] + [(7, [1.0, 2.0, 3.0], 1), (7, [-3.0, 1.0, 0.5], 1)]
    out = pivots.near_vectors(spark.createDataFrame(same_, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter((r.n_links, r.component_id) for r in out) == {(50, 0): 51, (0, 7): 1}


def test_minhash(spark):
    same(registry.QUERIES["op9_minhash"](spark, SF).collect(), near(real()))
    odd_rows = [r for r in ODD if r[0] is not None]
    same([tuple(r)[:4] for r in minhash.near_duplicates(odd(spark)).collect() if r.doc_id is not None], near(odd_rows))


def test_minhash_clusters_without_a_common_link(spark):
    rng, rows = np.random.default_rng(8), []
    for n in (40, 150):
        base = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        for i in range(220):  # from equal to far apart; every third is a copy of another copy with its changes
            own = list(base if i % 3 else rows[-1][1].split()) if rows and i else list(base)
            for at in rng.integers(0, len(own), rng.integers(0, n // 12)):
                own[at] = f"x{rng.integers(0, 10**6)}" if rng.random() < 0.7 else base[(at + 1) % n]
            rows.append((len(rows), " ".join(own)))
    want = near(rows)
    assert 20 < len({c for _, _, c, _ in want}) < len(rows) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(r)[:4] for r in minhash.near_duplicates(df).collect()], want)


def test_minhash_departures_lose_no_pair(spark):
    rng, rows = np.random.default_rng(9), []
    base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
    for i in range(60):
        own = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 6)):
            own[at] = f"x{rng.integers(0, 4)}"
        rows.append((i, " ".join(own)))
    sets = {d: {tuple(w[i : i + 3]) for i in range(58)} for d, t in rows for w in [t.split()]}
    want = {(a, b) for a in sets for b in sets if 0 < a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    with_zero = {a for a in sets if 100 * len(sets[a] & sets[0]) >= 85 * len(sets[a] | sets[0])}
    texts = spark.createDataFrame(rows, "c long, text string")
    apart = texts.filter("c > 0").select(F.lit(0).cast("long").alias("z"), F.col("c").alias("k"), F.col("c").alias("g"))
    got = {(r.a, r.b) for r in minhash.departures(apart, texts, 3, 85).collect()}
    missed = want - got
    assert want and all(a in with_zero and b in with_zero for a, b in missed)
    assert any(not (a in with_zero and b in with_zero) for a, b in want)


def _weighted(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def _leaks(rows, items, n=5):
    shingle = lambda w: Counter(tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1))
    out = set()
    for d, t in rows:
        w = words(t, lower=True)
        for i, x in items:
            item = words(x, lower=True)
            if not item or len(w) < len(item):
                continue
            own = shingle(item)
            first = set(own)
            starts = {s for s in range(len(w) - len(item) + 1) if first & set(shingle(w[s : s + len(item)]))} if any(tuple(w[s : s + min(n, len(item))]) in first for s in range(len(w))) else ()
            if any(_weighted(own, shingle(w[s : s + len(item)])) >= 0.8 for s in starts):
                out.add((d, i))
    return out


def test_decontaminate(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    rows = real()
    edited = items[0][1].split()
    edited[len(edited) // 2] = "changed"
    rows += [(7001, "before " + items[0][1].upper() + " after"), (7002, "x " * 9 + " ".join(edited)), (7003, None), (7004, "")]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == _leaks(rows, items)


def test_language(spark):
    got = registry.QUERIES["op7_language"](spark, SF).join(documents(spark).select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    model = language.fit(documents(spark))
    told = {r.doc_id: r for r in language.predict(odd(spark), model).collect()}
    assert all(told[d].lang_pred == "und" for d in (1, 2, 3, 12)) and all(0 <= r.score <= 1 for r in told.values())
    assert language.predict(odd(spark), language.fit(documents(spark).limit(0))).filter("lang_pred <> 'und'").count() == 0


def _base(rows, train):
    count = Counter(w for _, t in train for w in [*words(t, lower=True), None])
    n, v = sum(count.values()), len(count)
    for d, t in rows:
        w = [*words(t, lower=True), None]
        yield d, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)


def _model(rows, train):
    """The score with exact counts in place of the filter's levels."""
    pair, word = Counter(), Counter()
    for _, t in train:
        w = [None, *words(t, lower=True), 0]
        word.update(w)
        pair.update(zip(w, w[1:]))
    n, v = sum(c for w, c in word.items() if w is not None), len([w for w in word if w is not None])
    steps = bloom_lm.THRESHOLDS.tolist()
    low = lambda c: max([s for s in steps if s <= c], default=0)
    high = lambda c: min(s for s in steps if s > c) - 1
    p = lambda u, w: bloom_lm.WEIGHT * (min(1, low(pair[u, w]) / max(1, high(word[u]))) if word[u] else 0) + (1 - bloom_lm.WEIGHT) * (low(word[w]) + 0.5) / (n + 0.5 * (v + 1))
    score = {d: sum(math.log10(p(u, w)) for u, w in zip(x, x[1:])) for d, t in rows for x in [[None, *words(t, lower=True), 0]]}
    sums = [sum(p(u, w) for w in {*word, "unseen"} - {None}) for u in [*list(word)[:40], "unseen"]]
    return score, sums


def test_bloom_lm(spark, monkeypatch):
    train = [r for r in real() if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    want, sums = _model(real(), train)
    assert max(sums) <= 1 + 1e-9
    scores = []
    for top, part in ((1 << 18, 1 << 27), (100, 1 << 14)):
        monkeypatch.setattr(bloom_lm, "WIDESPREAD", top)
        monkeypatch.setattr(bloom_lm, "BROADCAST_BYTES", part)
        monkeypatch.setattr(bloom_lm, "BYTES_PER_BLOCK", 1 << 17)
        got = registry.QUERIES["op10_bloom_lm"](spark, SF).collect()
        same([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], list(_base(real(), train)))
        scores.append({r.doc_id: r.score for r in got})
        # the filter's false positives raise a few levels
        assert np.mean([abs(scores[-1][d] - x) <= 0.03 * abs(x) for d, x in want.items()]) > 0.95
        more = bloom_lm.score(odd(spark), odd(spark)).collect()
        same([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in more], list(_base(ODD, ODD)))
    assert all(abs(scores[0][d] - scores[1][d]) < 1e-6 for d in scores[0])
    held = [r for r in got if r.held_out]
    assert all(r.score <= 0 for r in got) and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert bloom_lm.score(odd(spark), odd(spark).limit(0)).filter("n_known > 0 or train_tokens > 0").count() == 0


def test_bloom_levels_never_fall_short():
    rng = np.random.default_rng(5)
    grams, counts = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(1, 5000, 5000)
    counts[0] = 1 << 55
    blocks = bloom_lm.block_of(grams, 4)
    own = bloom_lm.Filter(4, [(b, bloom_lm.build_block(grams[blocks == b], counts[blocks == b]).tobytes()) for b in range(4)])
    level = own.levels(grams)
    want = bloom_lm.level_of(counts)
    assert (bloom_lm.least(want) <= counts).all() and (bloom_lm.most(want) >= counts).all() and (bloom_lm.least(want) * 1.42 + 1 >= counts).all()
    assert (level >= want).all() and (level == want).mean() > 0.95
    assert (own.levels(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) > 0).mean() < 0.05


def test_most_frequent(spark):
    rows = [(i, 1 + i % 100) for i in range(1000)]
    df = spark.createDataFrame(rows, "w long, c long")
    got = [r.c for r in common.most_frequent(df, "c", 200).collect()]
    assert 100 <= len(got) <= 200 and Counter(got) == Counter(c for _, c in rows if c >= min(got))
    assert common.most_frequent(df, "c", 3).count() == 0 and common.most_frequent(df, "c", 5000).count() == 1000


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (501, 501), (502, 500)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == groups([*range(1, 201), 500, 501, 502], chain)


def test_empty_tables(spark):
    none = odd(spark).limit(0)
    for df in (P.remove_passages(none), suffix_array.remove_repeats(none), token_counts.count_tokens(none), byte_bpe.decode(byte_bpe.encode(none)), minhash.near_duplicates(none), decontaminate.contaminated(none, spark.createDataFrame([], "item_id long, text string")), bloom_lm.score(none, none), pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")), warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string")))):
        assert df.count() == 0


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs, n = documents(spark), []
    for _, stage in pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF))
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[-1] > 0
    assert docs.filter("not exact").count() == 0
    kept = pipeline.near_duplicates(spark, documents(spark), SF).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, _, _, k in near(real(), 5, 80) if k)
