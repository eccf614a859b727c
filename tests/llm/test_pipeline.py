"""The pipeline against its stages applied one by one, with a brute-force version of what each stage decides."""

import re

import corpus_pipeline
from recallspark.llm import pii
from tests.llm.test_ngram_join import brute_components

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(corpus_pipeline.saved(stage(spark, frames[-1], SF), "t"))
        assert frames[-1].columns == columns
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(a >= b for a, b in zip(ids[:-1], ids[1:], strict=True))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d in ids[0] if labels.get(d) == 1]
    bad = [d for d in ids[0] if labels.get(d) == 0]
    assert sum(d in ids[1] for d in good) >= 0.97 * len(good)
    assert sum(d in ids[1] for d in bad) <= 0.1 * len(bad)
    assert len(ids[2]) >= 0.99 * len(ids[1])
    classes = brute_components({r.doc_id: r.text for r in frames[2].select("doc_id", "text").collect()})
    assert ids[3] == {d for d, (_, c) in classes.items() if d == c}
    before = {r.doc_id: r.text for r in frames[3].select("doc_id", "text").collect()}
    for r in frames[4].collect():
        assert not pii.base_spans(r.text) or pii.base_spans(before[r.doc_id])
        assert r.n_chars == len(r.text)
        if not pii.base_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id]
        else:
            assert not re.search(r"@mail\d\.example\.com", r.text)
    packed = corpus_pipeline.pack_sequences(spark, frames[4], SF).collect()
    assert {r.doc_id for r in packed} == ids[4]
    run = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.length) for r in run.collect()) == sorted((r.doc_id, r.start, r.length) for r in packed)


def test_null_and_repeated_ids(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(None, "null id with mail a@b.com and other words here", "x"), (None, "another null id with mail c@d.org and more words", "x"), (1, long, "x"), (1, long, "x"), (None, long, "x"), (2, "same id first text mail e@f.net stands here", "x"), (2, "a second text mail at its end g@h.net", "x"), (3, None, "x"), (3, None, "x"), (None, "", "x"), (4, " ", "x")]
    df = corpus_pipeline.saved(spark.createDataFrame(rows, "doc_id long, text string, other string"), "made")
    kept = corpus_pipeline.drop_near_copies(spark, df, SF)
    assert kept.columns == df.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, set(rows) - {(None, long, "x")}))
    twice = corpus_pipeline.saved(df.union(df), "made")
    clean = corpus_pipeline.remove_personal_data(spark, twice, SF).collect()
    wanted = [(i, t and re.sub(r"[a-z]@[a-z]\.[a-z]+", "[EMAIL]", t), o) for i, t, o in rows * 2]
    assert sorted(str((r.doc_id, r.text, r.other)) for r in clean) == sorted(map(str, wanted))


def test_columns_with_clashing_names(spark):
    rows = [(1, "one two three four five six mail a@b.com", 7, "n", "s"), (1, "one two three four five six mail a@b.com", 7, "n", "s"), (2, "other words stand here", None, "m", "t")]
    df = corpus_pipeline.saved(spark.createDataFrame(rows, "doc_id long, text string, _row_key int, _n string, _spans string"), "clash")
    kept = corpus_pipeline.drop_near_copies(spark, df, SF)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, set(rows)))
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    assert sorted(map(str, map(tuple, clean.collect()))) == sorted(str((i, t.replace("a@b.com", "[EMAIL]"), *x)) for i, t, *x in rows)
    found = pii.find(df.withColumnRenamed("doc_id", "key"), "key")
    assert found.columns == ["key", "spans"] and found.count() == 3
