"""Stages of the pipeline on rows that the test tables do not hold."""

from collections import Counter

from brute import covered

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"w{i * 7919 % 1000}" for i in range(120))


def kept_texts(rows, window=400):
    """The texts without recurring windows; of a character that a cut falls into nothing stays."""
    count = Counter(b[i : i + window] for _, t in rows for b in [t.encode()] for i in range(len(b) - window + 1))
    out = {}
    for d, t in rows:
        mask, at, left = covered(t.encode(), window, count, bytes), 0, []
        for c in t:
            n = len(c.encode())
            left += [] if any(mask[at : at + n]) else [c]
            at += n
        out[d] = "".join(left)
    return out


def test_substrings_cut_inside_characters(spark):
    # two-byte characters that share their first byte after the passage, and their last byte before it; a genuine U+FFFD
    texts = [(1, f"front é{PASSAGE}é one \ufffd end"), (2, f"other ĩ{PASSAGE}è two"), (3, "short \ufffd"), (4, PASSAGE)]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in texts], SCHEMA)
    got = pipeline.remove_substrings(spark, docs, "").collect()
    want = {d: t for d, t in kept_texts(texts).items() if t}
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert want[1] == "front  one \ufffd end"


def test_null_and_repeated_ids_and_no_labels(spark):
    text = lambda seed: " ".join(f"{'abcdefg'[(i * seed) % 7]}{i * seed % 997}" for i in range(60))
    one, two, three, four = text(3), text(11), text(101), text(211)
    # texts one and two share an id; text one is also that of a smaller id; nulls: a copy, and texts that no other row has
    rows = [(5, one), (5, two), (3, one), (9, two + " end"), (None, one), (None, three), (None, four), (12, four), (7, "123 456"), (8, None)]
    docs = spark.createDataFrame([(d, t, None, "web", len(t or "")) for d, t in rows], SCHEMA)
    clean = pipeline.identify_language(spark, docs, "")
    assert {(r.doc_id, r.text) for r in clean.collect()} == {r for r in rows if r[0] not in (7, 8)}
    kept = pipeline.near_duplicates(spark, clean, "")
    want = {(3, one), (5, two), (None, three), (12, four)}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert set(got) == want and len(got) == len(want)
    at = f"{spark.conf.get('spark.sql.warehouse.dir')}/items"
    spark.createDataFrame([(1, two), (2, three)], "item_id long, text string").write.mode("overwrite").parquet(f"{at}/benchmark.parquet")
    mixed = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in ((5, one), (5, two), (None, three), (None, four))], SCHEMA)
    left = pipeline.remove_benchmark(spark, mixed, at)
    assert {(r.doc_id, r.text) for r in left.collect()} == {(5, one), (None, four)}
    told = pipeline.encode(spark, mixed.union(mixed.filter("doc_id is null")), "").collect()
    assert sorted(str(r.doc_id) for r in told) == ["5", "5", "None", "None", "None", "None"] and all(r.exact for r in told)


def test_documents_shorter_than_the_item(spark):
    from skylattice.llm import decontaminate

    item = [f"w{i}" for i in range(38)]
    shingle = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rows = [(n, item[:n]) for n in range(1, 39)] + [(100 + n, item[n:]) for n in range(1, 38)] + [(200, item[:20] + ["new"] + item[20:36])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    own = shingle(item)
    alike = {d: sum((own & shingle(w)).values()) / sum((own | shingle(w)).values()) for d, w in rows}
    assert {r.doc_id: (round(r.similarity, 9), r.n_words) for r in got} == {d: (round(alike[d], 9), len(w)) for d, w in rows if alike[d] >= 0.8}
    assert 36 in {r.doc_id for r in got}


def test_language_fits_different_texts(spark):
    from skylattice.llm import language

    texts = [f"text number {i} of a language" for i in range(400)]
    rows = [(t, "en") for t in texts for _ in range(20)] + [(None, "en"), (texts[0], None), ("ein anderer Satz", "de")]
    taken = [(r.lang, r.text) for r in language.sample(spark.createDataFrame(rows, "text string, lang string"), rows=200).collect()]
    count = Counter(a for a, _ in taken)
    assert len(set(taken)) == len(taken) and 140 <= count["en"] <= 260 and count["de"] == 1
    assert {t for a, t in taken if a == "en"} <= set(texts)


def test_language_model_is_the_same_each_time(spark):
    from skylattice.llm import language

    rows = [(f"the {w} of the house {i}", "en") for i in range(20) for w in ("wall", "roof")] + [(f"die {w} des hauses {i}", "de") for i in range(20) for w in ("wand", "decke")] + [(f"le {w} de la maison {i}", "fr") for i in range(20) for w in ("mur", "toit")]
    models = [language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(n)) for n in (1, 5)]
    assert sorted(models[0].svms) == ["de or en", "family germanic", "family romance"]
    assert all((models[0].svms[k].w == models[1].svms[k].w).all() for k in models[0].svms)
    one = language.fit(spark.createDataFrame(rows[:5], "text string, lang string"))
    told = language.predict(spark.createDataFrame([(1, "x", "a"), (2, "1", "b")], "doc_id long, text string, score string"), one, extra=["score"]).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in told} == {(1, "en", 1.0), (2, "und", 0.0)}


def test_copies_of_an_item_take_no_place_of_others(spark, monkeypatch):
    from skylattice.llm import decontaminate

    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 5)
    texts = {i: " ".join(f"i{i}w{j}" for j in range(12)) for i in range(4)}
    items = spark.createDataFrame([(0, texts[0])] * 40 + [(i, texts[i]) for i in (1, 2, 3)], "item_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect())
    assert got == {(0, 0): 40, (1, 1): 1, (2, 2): 1, (3, 3): 1}
    monkeypatch.setattr(decontaminate, "BYTES_PER_PASS", 100)
    many = items.union(spark.createDataFrame([(9, None), (8, "")], "item_id long, text string"))
    assert Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, many).collect()) == got


def test_decontamination_equals_brute_force_at_the_limit(spark):
    import random

    from skylattice.llm import decontaminate

    rng = random.Random(4)
    item = [f"w{i}" for i in range(60)]
    shingle = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    best = {}
    rows = []
    for d in range(400):
        own = list(item)
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(60)
            own[at : at + rng.randrange(0, 2)] = [f"n{rng.randrange(99)}"] * rng.randrange(0, 3)
        w = [f"a{rng.randrange(99)}" for _ in range(rng.randrange(30))] + own + [f"b{rng.randrange(99)}" for _ in range(rng.randrange(30))]
        rows += [(d, " ".join(w), "x", 0.0)] * (1 + (d % 50 == 0))
        n = min(60, len(w))
        scores = [sum((shingle(item) & shingle(w[s : s + n])).values()) / sum((shingle(item) | shingle(w[s : s + n])).values()) for s in range(len(w) - n + 1)]
        best[d] = max(scores), scores.index(max(scores))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, similarity double")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    close = [d for d, (s, _) in best.items() if 0.8 <= s < 0.85]
    assert len(close) > 20
    want = Counter({(d, round(s, 9), at): 1 + (d % 50 == 0) for d, (s, at) in best.items() if s >= 0.8 - 1e-12})
    assert Counter((r.doc_id, round(r.similarity, 9), r.first_word) for r in got) == want
