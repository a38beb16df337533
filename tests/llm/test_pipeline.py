import brute
import corpus_pipeline
import numpy as np


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs, rows = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert len(after) == out.count()
        if name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            good, bad = ([d for d, q in labels.items() if q == k] for k in (1, 0))
            assert np.mean([d in after for d in good]) > 0.95 and np.mean([d in after for d in bad]) < 1  # few labels here
        elif name == "exact_dedup":
            best = {}
            for d, t in sorted(before.items()):
                key = "".join(brute.words(t))
                if key not in best or len(t) > len(before[best[key]]):
                    best[key] = d
            assert set(after) == set(best.values())
        elif name == "simhash_dedup":
            ids = sorted(before)
            sets = {d: brute.shingles(before[d], 5) for d in ids}
            similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if similar(a, b)]
            gone = set(ids) - set(after)
            assert gone <= {b for _, b in pairs}  # none without a similar one before it
            assert len({b for _, b in pairs} - gone) <= 0.05 * len(pairs)
        elif name == "suffix_dedup":
            want = brute.repeats(before.items())
            assert after == {d: want[d][3].decode("utf-8", "ignore") for d in before}
        else:
            rows = out.collect()
        docs = out
    from test_operators import check_packing

    check_packing(rows, list(after.items()))


def nasty(spark, first=10**6):
    texts = [*brute.ODD, *brute.ODD, "the same words again and again " * 30, "the same words again and again " * 30, "long " * 60_000]
    rows = [(first + i if i % 9 else None, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else "src0", None if i % 3 == 0 else 7, "x", 1, None) for i, t in enumerate(texts)]
    rows += rows[5:9]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, kept int, runs string")


def test_stages_on_nasty_rows(spark, sf_dir):
    """Nulls anywhere, empty and long texts, repeated rows, clashing columns."""
    for frame in (nasty(spark), nasty(spark).limit(0)):
        docs = frame.cache()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "packing":
                assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() > 0) == (frame.count() > 0)


def test_operators_on_nasty_rows(spark, sf_dir):
    from tessera.llm import bpe, exact_dedup, packing, quality_model, quality_rules, queries as q, simhash, suffix_dedup, token_rollup, tokenfile, url_filter

    import public_tokenizers

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ranks = q.vocabulary(q.BYTE_RANKS), public_tokenizers.PATTERN
    for frame in (nasty(spark), nasty(spark).limit(0)):
        n = frame.count()
        one_each = [
            exact_dedup.exact_groups(frame),
            simhash.near_groups(frame),
            quality_model.classify(frame, labels),
            quality_model.classify(frame, labels.limit(0)),
            tokenfile.token_files_round_trip(frame, q.vocabulary(q.BYTE_TOKENIZER)),
            bpe.encode_texts(frame, *ranks),
            suffix_dedup.cut_repeats(frame),
            quality_rules.judge(frame, labels),
            url_filter.filter_urls(frame.withColumnRenamed("text", "url").withColumnRenamed("source", "host"), spark.createDataFrame([(None, 1), ("http://a/", None)], "url string, label int"), id_col="doc_id"),
        ]
        assert [x.count() for x in one_each] == [n] * len(one_each)
        assert packing.pack_documents(frame, q.vocabulary(q.WORD_TOKENIZER)).count() >= n
        import tempfile

        totals = token_rollup.maintained_totals(frame, f"file://{tempfile.mkdtemp()}/s", q.PATTERNS).agg({"n_docs": "sum"}).first()[0] or 0
        assert totals == frame.select("doc_id").distinct().where("doc_id is not null").count()


def test_scores_hold_little_memory():
    """Features of many texts are made for a few at a time; the scores don't depend on how many."""
    import tracemalloc

    from tessera.llm import quality_model as qm

    rng = np.random.default_rng(1)
    texts = [b" ".join(b"%d" % x for x in rng.integers(0, 9999, 400)) for _ in range(1000)]
    x, first = qm.passage_features(texts[:40])
    model = qm.train(x, first, np.arange(40, dtype=np.float32) % 2, 0.5)
    tracemalloc.start()
    got = model.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert np.allclose(got, [model.scores([t])[0] for t in texts], atol=1e-5)


def test_workers_give_memory_back():
    """The tables of a codec are empty while documents are scored, and what ends tidies up."""
    from tessera.llm import wordcodec

    ended = []
    kept = wordcodec.tidy
    wordcodec.tidy = lambda: ended.append(1)
    try:
        assert list(wordcodec.tidied(lambda batches: (2 * x for x in batches))(iter([1, 2]))) == [2, 4] and ended == [1]
    finally:
        wordcodec.tidy = kept
    wordcodec.tidy()
