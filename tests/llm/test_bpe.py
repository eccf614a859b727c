import hashlib
import random

import numpy as np
import public_tokenizers

from recallspark.llm import bpe


def whole(texts):
    enc, _ = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return [enc.encode_ordinary(t or "") for t in texts]


def fuzz(seed, n, size):
    r = random.Random(seed)
    letters = "abcXYZ  \n\n\t\r'sé漢😀12٣.,!?-\x1c\x85 \xa0<|endoftext|>"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, size))) for _ in range(n)]


def test_long_texts_are_cut_safely(monkeypatch):
    enc, pieces = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for limit in (1, 2, 5, 17):
        monkeypatch.setattr(bpe, "LONG", limit)
        monkeypatch.setattr(bpe.safe_parts, "__defaults__", (limit,))
        for text in fuzz(limit, 400, 60) + ["a" * 300, " " * 300, "x" + " " * 200 + "y" * 100, "1a2b" * 50]:
            assert bpe.encode_text(text, enc, pieces) == enc.encode_ordinary(text), (limit, text)
            assert b"".join(enc.decode_bytes(x) for x in bpe.id_parts(text, enc, pieces)).decode() == text


def test_very_long_runs():
    enc, pieces = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ("a" * 150_000, " " * 150_000, "ab " * 60_000, "é" * 120_000 + " x"):
        ids = bpe.encode_text(text, enc, pieces)
        assert enc.decode(ids) == text


def test_query_round_trip_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], whole([d.text for d in docs]), strict=True))
    for r in bpe.op9_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
    sent = {d.doc_id: hashlib.sha256(d.text.encode()).hexdigest() for d in docs}
    assert {r.doc_id: r.decoded_sha256 for r in bpe.op9_byte_bpe(spark, "/root/testdata/sf0.001").collect()} == sent
    texts = [None, "", "a", "a", *fuzz(9, 50, 100)]
    df = spark.createDataFrame([(k, t, b"x") for k, t in enumerate(texts)], "doc_id long, text string, ids binary")
    for r in bpe.encode_decode(df).collect():
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    assert bpe.encode_decode(df.limit(0)).collect() == []
