import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from recallspark.llm import packing


def whole(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def fuzz(seed, n):
    r = random.Random(seed)
    letters = "abcXYZ éÉ'sİßſ́̀   \x1c\x85\x0b\x0c\n\t\r  12٣½漢字각ᄀ​<|endoftext|>.,!?ſΣς’'t're𝒜😀"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", None, " ", "a" * 5000, "it's DON'T x", "é ́x", "<|endoftext|> a<|startoftext|>b"]


def test_word_by_word_ids_are_those_of_the_whole_text():
    texts = fuzz(1, 3000)
    texts += ["<|ENDOFTEXT|> x", "A<|b", "Hello, World.", "word;:! (word)", "ÀÉ!? İ. ẞ;", "e.\u0300 x,\u0301", "a.b,c'd.", "it's. IT'S.", "x'. y.'"]
    ids, at = packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x[:-1] for x in whole(texts)]


def test_runs_keep_every_row(monkeypatch):
    monkeypatch.setattr(packing, "RUN_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([None if k % 7 == 0 else "x" * (k * 11 % 130) for k in range(50)])], names=["id", "text"])
    assert sum((p.column(0).to_pylist() for p in packing.runs(batch)), []) == list(range(50))
    assert not list(packing.runs(batch.slice(0, 0)))


def covered(rows, texts, window=4096):
    """Pieces cover every document once, sequences are gapless and as long as a power of two; returns padding."""
    ids = dict(texts)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_query_covers_every_token_once(spark):
    rows = packing.op1_hierarchical_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert covered(rows, zip([d.doc_id for d in docs], whole([d.text for d in docs]), strict=True)) == 0


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    texts = [None, "", "x " * 30000, "same text", "same text", *fuzz(3, 200)[:200], *(f"word{k} " * (k % 700) for k in range(1500))]
    df = spark.createDataFrame([(k, x, 1, 2) for k, x in enumerate(texts)], "doc_id long, text string, start int, tier int").repartition(3)
    from pyspark.sql import functions as F

    rows = packing.pack(df.sortWithinPartitions("doc_id"), hold=20000).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert covered(rows, enumerate(whole(texts))) == 0
    by = defaultdict(set)
    for r in rows:
        by[r.step_group].add(r.tier)
    assert all(len(x) == 1 for x in by.values())
    assert sum(r.tier == 4096 for r in rows)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
