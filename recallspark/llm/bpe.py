"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallspark.llm._common import map_batches, require, slices, table

#: A text of more characters is cut at safe boundaries before it is encoded.
LONG = 50_000
#: White space that both Python's and tiktoken's patterns see as such, after anything that neither does.
BOUNDARY = re.compile(r"(?<=\S)(?=[ \n\t\r])")
_encoders: dict[tuple[str, str], tuple[tiktoken.Encoding, regex.Pattern]] = {}


def encoder(rank_file: str, pattern: str) -> tuple[tiktoken.Encoding, regex.Pattern]:
    """The encoding of a rank file, built once in each Python worker, and the pattern for the regex module."""
    if (rank_file, pattern) not in _encoders:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        own = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        _encoders[rank_file, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(own)
    return _encoders[rank_file, pattern]


def safe_parts(text: str, limit: int = LONG) -> Iterator[tuple[str, bool]]:
    """Cut a long text where a match of the pattern surely starts: before white space that follows something else.

    No alternative of the pattern runs over such a place, and none looks ahead over it, so the parts have the
    matches of the whole.  Yields (part, False); (part, True) for a stretch without a boundary within another limit
    characters, which the caller splits match by match.
    """
    start, size = 0, len(text)
    while size - start > limit:
        found = BOUNDARY.search(text, start + limit, min(size, start + 2 * limit))
        if found:
            yield text[start : found.start()], False
            start = found.start()
            continue
        found = BOUNDARY.search(text, start + 2 * limit)
        end = found.start() if found else size
        yield text[start:end], True
        start = end
    if start < size:
        yield text[start:], False


def id_parts(text: str, enc: tiktoken.Encoding, pieces: regex.Pattern) -> Iterator[list[int]]:
    """The ids of a whole text, part by part, so that no list grows with a long text."""
    if len(text) <= LONG:
        yield enc.encode_ordinary(text)
        return
    for part, by_match in safe_parts(text):
        if not by_match:
            yield enc.encode_ordinary(part)
            continue
        ids: list[int] = []
        for match in pieces.finditer(part):
            ids += enc._encode_single_piece(match.group())
            if len(ids) > LONG:
                yield ids
                ids = []
        yield ids


def encode_text(text: str, enc: tiktoken.Encoding, pieces: regex.Pattern) -> list[int]:
    return [i for part in id_parts(text, enc, pieces) for i in part]


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode every whole text and decode its ids again; a map over the rows, with no shuffle.

    Returns id_col, ids (binary: little-endian unsigned 32-bit ids, in order) and decoded (binary: the raw bytes of the
    ids).  Decoding works on bytes, so a token that ends inside a character does no harm.  A null text counts as
    empty: no ids, no bytes.  Rows with equal ids stay apart; other columns are left out, whatever their names.
    A long text is cut at places where the pattern has a match boundary in any case, so its ids are those of the whole.
    """
    require(df, id_col, text_col)
    path = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        enc, pieces = encoder(path, pattern)
        for part in slices(batch):
            ids, decoded = [], []
            for text in part.column(1).to_pylist():
                own, back = bytearray(), bytearray()
                for some in id_parts(text or "", enc, pieces):
                    own += np.array(some, "<u4").tobytes()
                    back += enc.decode_bytes(some)
                ids.append(bytes(own))
                decoded.append(bytes(back))
            yield {id_col: part.column(0), "ids": ids, "decoded": decoded}

    return map_batches(df.select(id_col, F.col(text_col).cast("string")), run, schema)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
