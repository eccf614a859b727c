"""Hierarchical multi-length packing of documents into training sequences."""

from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from recallspark.llm._common import require, table, trim

#: Context sizes; the last one is the window.
TIERS = (512, 1024, 2048, 4096)
#: Tokens that a task holds back per tier before it forms sequences of them.
HOLD = 1 << 18
#: Words whose ids a task remembers; the memory is emptied when it is full.
WORDS = 400_000
#: Bytes of text, and rows, whose words are looked up together.
RUN_BYTES, RUN_ROWS = 4 << 20, 8192
#: Sequences of a tier that one step takes, and the ranks that share them.
STEP, RANKS = 64, 8
#: A word of Latin letters, which is one match of the splitting pattern, and a run of marks behind it, which is another.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?*%$#&)]*)")
_encoders: dict[str, WordIds] = {}


class WordIds:
    """Ids of whole texts, word by word, by the tokenizers library.

    The vocabulary drops white space, and neither its normalizer (NFC, one blank for white space, lower case for each
    character) nor its splitting pattern nor its merges reach over a blank, so a text's ids are those of its words in
    a row.  A-Z may be put in lower case before, but where the text could hold a special token.  Words come back often,
    so their ids are remembered; new words of a run of texts are encoded in one call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @staticmethod
    def of(path: str) -> WordIds:
        """The tokenizer is read once in each Python worker; words are forgotten from task to task, as other work follows in the worker."""
        if path not in _encoders:
            _encoders[path] = WordIds(path)
        _encoders[path].known = {}
        return _encoders[path]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of all texts in a row, and where each text begins and the last one ends; null counts as empty."""
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        coded = lists.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        data = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        words = coded.indices.to_numpy()
        own = sizes[words]
        ends = np.append(0, np.cumsum(own))
        starts = np.append(0, np.cumsum(sizes))[:-1]
        out = data[np.repeat(starts[words] - ends[:-1], own) + np.arange(ends[-1])]
        return out, ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > WORDS:
            self.known.clear()
        known = self.known
        found = list(map(known.get, words))
        fresh = [k for k, x in enumerate(found) if x is None]
        plain, cores, others = [], set(), set()
        for k in fresh:
            if m := _PLAIN.fullmatch(words[k]):
                core, marks = m.groups()
                plain.append((k, core, marks))
                cores.add(core)
                if marks:
                    others.add(marks)
            else:
                others.add(words[k])
        self._learn_cores([x for x in cores if x not in known])
        self._learn([x for x in others if x not in known])
        for k, core, marks in plain:
            found[k] = known[words[k]] = known[core] + known[marks] if marks else known[core]
        for k in fresh:
            if found[k] is None:
                found[k] = known[words[k]]
        return found

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            coded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, coded, strict=True))

    def _learn_cores(self, cores: list[str]) -> None:
        """Words of letters only, many in one call: each ends with the only one of its tokens that ends a word."""
        for k in range(0, len(cores), 2048):
            part = cores[k : k + 2048]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(part):
                self._learn(part)
                continue
            data, start = ids.tobytes(), 0
            for w, end in zip(part, ends.tolist(), strict=True):
                self.known[w] = data[start:end]
                start = end


def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts (the second column) are about RUN_BYTES long together; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and (size + n > RUN_BYTES or k - start == RUN_ROWS):
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


class Packer:
    """Packs the documents of one task, in their order, with bounded memory.

    A document of a whole window or more fills windows of its own; what is left goes to the smallest tier that holds
    it.  When a tier has gathered enough, its documents are put into sequences of its size, the longest first; the gap
    behind each is filled with the longest documents of this and the shorter tiers that fit, and the last gap by
    cutting one document exactly.  So these sequences have no padding.  What the task holds at its end becomes full
    windows and one last run, which is cut at powers of two.
    """

    def __init__(self, tiers: tuple[int, ...], hold: int):
        self.tiers, self.window, self.hold = tiers, tiers[-1], hold
        self.pending: dict[int, list[tuple]] = {t: [] for t in tiers}  # sorted by (length, arrival)
        self.held = dict.fromkeys(tiers, 0)
        self.arrived = 0
        self.out: list[tuple[int, list[tuple]]] = []  # (tier, pieces)

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        start = 0
        while total - start >= self.window:
            self.out.append((self.window, [(doc, start, self.window, ids[4 * start : 4 * (start + self.window)], total)]))
            start += self.window
        if start < total:
            tier = self._route((doc, start, total - start, ids[4 * start :], total))
            if self.held[tier] >= self.hold:
                self._form(tier, self.hold // 2)

    def _route(self, piece: tuple) -> int:
        tier = self.tiers[bisect_left(self.tiers, piece[2])]
        self.arrived += 1
        insort(self.pending[tier], (piece[2], self.arrived, piece))
        self.held[tier] += piece[2]
        return tier

    def _take(self, tier: int, k: int) -> tuple:
        length, _, piece = self.pending[tier].pop(k)
        self.held[tier] -= length
        return piece

    def _fit(self, tiers: list[int], gap: int) -> tuple | None:
        """The longest held piece of at most gap tokens, of the longest tier that has one."""
        for t in tiers:
            if k := bisect_right(self.pending[t], (gap, float("inf"))):
                return self._take(t, k - 1)
        return None

    def _form(self, tier: int, keep: int) -> None:
        below = [t for t in reversed(self.tiers) if t <= tier]
        while self.held[tier] > keep and self.pending[tier]:
            if sum(self.held[t] for t in below) < tier:
                return
            pieces, gap = [self._take(tier, -1)], tier
            gap -= pieces[0][2]
            while gap and (found := self._fit(below, gap)):
                pieces.append(found)
                gap -= found[2]
            if gap:  # nothing fits whole: cut the shortest held piece of these tiers
                t = min((t for t in below if self.pending[t]), key=lambda t: self.pending[t][0][0])
                doc, start, length, ids, total = self._take(t, 0)
                pieces.append((doc, start, gap, ids[: 4 * gap], total))
                self._route((doc, start + gap, length - gap, ids[4 * gap :], total))
            self.out.append((tier, pieces))

    def finish(self) -> None:
        """Sequences of all that is held: windows first, then powers of two in falling order."""
        rest = [x for t in reversed(self.tiers) for _, _, x in reversed(self.pending[t])]
        left = sum(x[2] for x in rest)
        room, pieces, size = 0, [], 0
        for doc, start, length, ids, total in rest:
            while length:
                if not room:
                    room = size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    pieces = []
                n = min(room, length)
                pieces.append((doc, start, n, ids[: 4 * n], total))
                start, length, ids, room, left = start + n, length - n, ids[4 * n :], room - n, left - n
                if not room:
                    self.out.append((size, pieces))


class Steps:
    """Deals the sequences of a tier into steps of equal token counts; within a step, ranks get like attention work."""

    def __init__(self, step: int, ranks: int):
        self.step, self.ranks = step, ranks
        self.waiting: dict[int, list] = {}
        self.next = 0

    def deal(self, tier: int, sequence: int, pieces: list[tuple]) -> Iterator[tuple]:
        own = self.waiting.setdefault(tier, [])
        own.append((sum(p[2] ** 2 for p in pieces), sequence, pieces))
        if len(own) == self.step:
            yield from self.close(tier)

    def close(self, tier: int) -> Iterator[tuple]:
        """The heaviest sequence goes first, to the rank with least work among those with room."""
        own = sorted(self.waiting.pop(tier, ()), key=lambda x: (-x[0], x[1]))
        load, count, most = [0] * self.ranks, [0] * self.ranks, -(-len(own) // self.ranks)
        for work, sequence, pieces in own:
            rank = min((r for r in range(self.ranks) if count[r] < most), key=lambda r: (load[r], r))
            load[rank], count[rank] = load[rank] + work, count[rank] + 1
            yield tier, self.next, rank, sequence, pieces
        self.next += bool(own)


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_file: str | None = None,
    end_id: int = 2,
    tiers: tuple[int, ...] = TIERS,
    hold: int = HOLD,
    step: int = STEP,
    ranks: int = RANKS,
) -> DataFrame:
    """Cut and pack all documents into sequences of at most tiers[-1] tokens; one row for each piece.

    Tiers are rising powers of two.  Every task packs what it reads, with no shuffle: memory per task is at most
    `hold` tokens for each tier and one step of sequences, however large the input; padding is none, since every sequence has a
    power of two of tokens, but each task ends with some short ones.  The result of a task follows from its rows in their
    order, so a lost task comes back the same if its input does (files, or a written table; sort others first).

    Returns id_col, start (tokens of its document before the piece), length, ids (binary, little-endian unsigned
    32-bit), doc_tokens (with the closing end_id), sequence_id (unique), offset (place in the sequence), tier, and
    step_group and rank: sequences of one tier that are trained together, with about equal attention work (the
    sum of squared piece lengths) for each rank.  A null or empty text is a document of the one token end_id.  Equal
    documents are packed each for itself, and other columns are left out.  An empty table gives no rows.
    """
    require(df, id_col, text_col)
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be rising powers of two")
    path = tokenizer_file or public_tokenizers.path("word_bpe_49k.json")
    long = T.LongType()
    schema = T.StructType([df.schema[id_col], *[T.StructField(c, long) for c in ("start", "length")], T.StructField("ids", T.BinaryType()), *[T.StructField(c, long) for c in ("doc_tokens", "sequence_id", "offset")], T.StructField("tier", T.IntegerType()), T.StructField("step_group", long), T.StructField("rank", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def rows(dealt) -> pa.RecordBatch:
        flat = []
        for tier, group, rank, sequence, pieces in dealt:
            offset = 0
            for doc, start, length, ids, total in pieces:
                flat.append((doc, start, length, ids, total, sequence, offset, tier, group, rank))
                offset += length
        columns = list(zip(*flat, strict=True)) or [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        base = TaskContext.get().partitionId() << 40
        coder, packer, steps, count = WordIds.of(path), Packer(tiers, hold), Steps(step, ranks), 0
        steps.next = base
        for batch in batches:
            for part in runs(batch):
                ids, at = coder.encode(part.column(1))
                for doc, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    packer.add(doc, ids[a:b].tobytes() + end)
                dealt = []
                for tier, pieces in packer.out:
                    dealt += steps.deal(tier, base + count, pieces)
                    count += 1
                packer.out.clear()
                if dealt:
                    yield rows(dealt)
        coder.known = {}
        packer.finish()
        dealt = []
        for tier, pieces in packer.out:
            dealt += steps.deal(tier, base + count, pieces)
            count += 1
        for tier in sorted(steps.waiting):
            dealt += steps.close(tier)
        if dealt:
            yield rows(dealt)
        del dealt, packer, steps
        trim()

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def op1_hierarchical_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group", "rank")


QUERIES = {"op1_hierarchical_packing": op1_hierarchical_packing}
ORACLES: dict[str, str] = {}
