"""Exact Jaccard join of word shingles by token-combination prefixes, and the classes of linked documents.

How it runs.  (1) One pass gives every document a 128-bit key of its shingle set and counts all shingles in a sketch of fixed
size, from which the frequent class follows.  (2) A second pass sends each shingle that is not frequent to the bucket of its
hash; buckets count in how many documents it stands, and send back only shingles that stand in two or more.  (3) Each
document orders its shingles: those that stand nowhere else, then rare ones by the size class of their count, then frequent ones.  Linked documents
share something in the first n - ceil(0.75 n) + 1 of them, so a document whose prefix is all its own is done: most are.
(4) The others are indexed by their prefix: single rare tokens; and, as frequent tokens come last, combinations of two frequent
ones where the first token that two sets share is frequent.  For these the prefix is extended by one token for each of g
classes that frequent tokens are dealt into by a hash: g + 1 shared ones hold two of one class, so only pairs within a class are
indexed, a few for each token of the prefix however long the set.  (5) Documents that meet in an index key,
over any path, meet in one task, or key by key where they are too many, and are verified by the counts of their common shingles.
(6) Links become components.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recallspark.llm._common import fresh, require, row_key, saved, slices, table
from recallspark.llm.components import components, dealt_join
from recallspark.llm.shingles import _mix, set_key, shingles_of

#: Counters of the sketch, in CHUNKS parts; a shingle is frequent where its counter reaches FLOOR and LOAD times the mean.
WIDTH, CHUNKS, FLOOR, LOAD = 1 << 20, 64, 64, 8
#: Shingles for each bucket of the exact counts, at least, and for each batch that is sent to the buckets.
BUCKET = 1_000_000
#: Shingles of a set for each class that frequent tokens are dealt into.
SPREAD = 16
#: Documents of one index key that meet in one task; more are dealt into parts, and every two parts meet.
PART = 2048
_H48 = np.uint64((1 << 48) - 1)
_HOT = np.uint8(255)
#: Shingles that the sets of a candidate component may hold together to meet in one task.
TOGETHER = 2_000_000


def required(n: int) -> int:
    """The least intersection of a set of n with a set that it is linked to: ceil(0.75 n)."""
    return -(-3 * n // 4)


def _counter(h: np.ndarray) -> np.ndarray:
    return (_mix(h) >> np.uint64(44)).astype(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (its row key), set (128-bit key of the shingle set) and n of every document; with them, rows of the sketch (chunk, counts)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.BinaryType()), T.StructField("set", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    arrow, size = to_arrow_schema(schema), WIDTH // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(WIDTH, np.uint32)
        for batch in (part for whole in batches for part in slices(whole, 512)):
            keys, sizes, seen = [], [], set()
            for text in batch.column(1).to_pylist():
                h = shingles_of(text)
                keys.append(set_key(h) if len(h) else None)
                sizes.append(len(h))
                if keys[-1] not in seen:
                    seen.add(keys[-1])
                    np.add.at(counts, _counter(h), 1)
            nothing = pa.nulls(len(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), nothing.cast(pa.int32()), nothing.cast(pa.binary())], schema=arrow)
        for k in range(CHUNKS):
            part = counts[k * size : (k + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((None, None, None, None, k, zlib.compress(part.tobytes(), 1)), arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), row_key(id_col, text_col)).mapInArrow(run, schema)


def frequent_class(sketch: DataFrame, total: int) -> bytes:
    """A bit for each counter of the sketch: WIDTH bits, whatever the size of the corpus."""
    limit, size = max(FLOOR, LOAD * total // WIDTH), WIDTH // CHUNKS

    def add(part: pa.Table) -> pa.Table:
        counts = np.zeros(size, np.uint64)
        for x in part["counts"].to_pylist():
            counts += np.frombuffer(zlib.decompress(x), np.uint32)
        return pa.table({"chunk": part["chunk"][:1].cast(pa.int32()), "bits": pa.array([np.packbits(counts >= limit).tobytes()], pa.binary())})

    bits = np.zeros(WIDTH // 8, np.uint8)
    for r in sketch.groupBy("chunk").applyInArrow(add, "chunk int, bits binary").collect():
        bits[r.chunk * size // 8 : (r.chunk + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return bits.tobytes()


_MESSAGE = T.StructType([T.StructField("key", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("blob", T.BinaryType())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    arrow = to_arrow_schema(_MESSAGE)
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def bucket_size(total: int) -> int:
    """Shingles of a bucket: beyond some 6e10 shingles they grow with the root of all, as then do the batches, so that messages stay long and few."""
    return max(BUCKET, 4 * isqrt(total))


def exchange(docs: DataFrame, text_col: str, frequent: bytes, buckets: int, most: int) -> DataFrame:
    """Messages of batches of documents: kind 0 to each bucket (shingles and the place of their document), kind 1 for the batch itself."""
    hot = np.unpackbits(np.frombuffer(frequent, np.uint8)).astype(bool)

    def send(held: list[tuple[bytes, np.ndarray]], batch: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(h) for _, h in held])
        all_h = np.concatenate([h for _, h in held])
        place = np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
        common = hot[_counter(all_h)]
        bucket = (all_h >> np.uint64(36)) % np.uint64(buckets)
        token = (bucket << np.uint64(48)) | (all_h & _H48)
        own = [np.array([len(held)], "<u4").tobytes(), b"".join(k for k, _ in held), sizes.astype("<u4").tobytes(), np.bincount(place[common], minlength=len(held)).astype("<u4").tobytes(), token[common].astype("<u8").tobytes()]
        yield _rows([(-1 - batch, batch, 1, b"".join(own))])
        rest = np.flatnonzero(~common)
        rest = rest[np.argsort(bucket[rest], kind="stable")]
        cuts = np.searchsorted(bucket[rest], np.arange(buckets + 1, dtype=np.uint64))
        for b in range(buckets):
            at = rest[cuts[b] : cuts[b + 1]]
            if len(at):
                h = all_h[at] & _H48
                blob = np.array([len(at)], "<u4").tobytes() + place[at].astype("<u2").tobytes() + h.astype("<u4").tobytes() + (h >> np.uint64(32)).astype("<u2").tobytes()
                yield _rows([(b, batch, 0, blob)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 24
        held: list[tuple[bytes, np.ndarray]] = []
        seen, size = set(), 0
        for part in (part for whole in batches for part in slices(whole, 512)):
            for text in part.column(0).to_pylist():
                h = shingles_of(text)
                if not len(h) or (key := set_key(h)) in seen:
                    continue
                seen.add(key)
                held.append((key, h))
                size += len(h)
                if size >= most or len(held) == 60_000:
                    yield from send(held, batch)
                    held, seen, size, batch = [], set(), 0, batch + 1
        if held:
            yield from send(held, batch)

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, _MESSAGE)


def count_bucket(part: pa.Table) -> pa.Table:
    """In one bucket: which shingles stand in two or more documents, and in how many; answers go to the batches."""
    kinds, batches, blobs = (part[c].to_pylist() for c in ("kind", "batch", "blob"))
    if kinds[0] == 1:
        return pa.table({"key": part["batch"], "batch": part["batch"], "kind": part["kind"].cast(pa.int32()), "blob": part["blob"]})
    places, tokens, owners = [], [], []
    for k, blob in enumerate(blobs):
        n = int.from_bytes(blob[:4], "little")
        places.append(np.frombuffer(blob, "<u2", n, 4))
        tokens.append(np.frombuffer(blob, "<u4", n, 4 + 2 * n).astype(np.uint64) | (np.frombuffer(blob, "<u2", n, 4 + 6 * n).astype(np.uint64) << np.uint64(32)))
        owners.append(n)
    place, token, owner = np.concatenate(places), np.concatenate(tokens), np.repeat(np.arange(len(blobs), dtype=np.int32), owners)
    order = np.argsort(token, kind="stable")
    token, place, owner = token[order], place[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.diff(np.append(first, len(token)))
    df = np.repeat(count, count)
    keep = np.flatnonzero(df > 1)
    keep = keep[np.argsort(owner[keep], kind="stable")]
    bucket = np.uint64(part["key"][0].as_py()) << np.uint64(48)
    out = []
    cuts = np.searchsorted(owner[keep], np.arange(len(blobs) + 1))
    for k, batch in enumerate(batches):
        at = keep[cuts[k] : cuts[k + 1]]
        if len(at):
            out.append((batch, batch, 2, np.array([len(at)], "<u4").tobytes() + place[at].tobytes() + (token[at] | bucket).astype("<u8").tobytes() + np.ceil(np.log2(df[at]) / 2).astype("u1").tobytes()))
    return pa.Table.from_batches([_rows(out)])


_MEMBER = T.StructType([T.StructField("set", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def prefix_keys(tokens: np.ndarray, hot: np.ndarray, n: int) -> list[int]:
    """Index keys of a set of n shingles, of which `tokens`, in order, stand in other documents as well.

    Rare tokens of the prefix are single keys.  If the first token that two linked sets share is frequent, all that they share are.
    With a prefix that is g tokens longer they share g + 1 of it, and two of these are of one class when frequent
    tokens are dealt into g classes: pairs of one class are keys.  g follows from the size class (a power of two) of the smaller
    set, which has 0.75 to 1 times the size of the larger one; so a set gives the pairs of one size class or two.
    """
    reach = len(tokens) - required(n) + 1
    base = tokens[: max(0, reach)]
    keys: list[int] = base[~hot[: len(base)]].tolist()
    for level in range(required(n).bit_length(), n.bit_length() + 1):
        classes = max(1, (1 << level) // (2 * SPREAD))
        wide = max(0, reach + classes)
        often = tokens[:wide][hot[:wide]]
        if len(often) < 2:
            continue
        kind = _mix(often + np.uint64(level)) % np.uint64(classes)
        order = np.argsort(kind, kind="stable")
        kind, own, apart = kind[order], often[order], 1
        while (same := kind[:-apart] == kind[apart:]).any():
            keys += _mix(own[:-apart][same] * np.uint64(0x9E3779B97F4A7C15) + own[apart:][same] + np.uint64(level)).tolist()
            apart += 1
    return [k - (1 << 64) if k >= 1 << 63 else k for k in dict.fromkeys(keys)]


def gather_batch(part: pa.Table) -> pa.Table:
    """Put a batch together again: its documents with their shared shingles in order; those without index keys are done."""
    kinds, blobs = part["kind"].to_pylist(), part["blob"].to_pylist()
    own = blobs[kinds.index(1)]
    m = int.from_bytes(own[:4], "little")
    keys = [own[4 + 16 * k : 20 + 16 * k] for k in range(m)]
    sizes, hots = np.frombuffer(own, "<u4", m, 4 + 16 * m), np.frombuffer(own, "<u4", m, 4 + 20 * m)
    place, token, df = [np.repeat(np.arange(m), hots)], [np.frombuffer(own, "<u8", int(hots.sum()), 4 + 24 * m)], [np.full(int(hots.sum()), _HOT, np.uint8)]
    for kind, blob in zip(kinds, blobs, strict=True):
        if kind == 2:
            n = int.from_bytes(blob[:4], "little")
            place.append(np.frombuffer(blob, "<u2", n, 4).astype(np.int64))
            token.append(np.frombuffer(blob, "<u8", n, 4 + 2 * n))
            df.append(np.frombuffer(blob, "u1", n, 4 + 10 * n))
    p, t, d = np.concatenate(place), np.concatenate(token), np.concatenate(df)
    order = np.lexsort((t, d, p))
    p, t, d = p[order], t[order], d[order]
    cuts = np.searchsorted(p, np.arange(m + 1))
    out: list[tuple] = []
    for k in range(m):
        a, b = cuts[k], cuts[k + 1]
        if b > a and (own_keys := prefix_keys(t[a:b], d[a:b] == _HOT, int(sizes[k]))):
            out.append((keys[k], int(sizes[k]), np.sort(t[a:b]).tobytes(), own_keys))
    arrow = to_arrow_schema(_MEMBER)
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


class Meeting:
    """Sets that meet in one index key: finds which are linked, comparing whole sets by the counts of common tokens."""

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray):
        self.sizes, self.m = sizes, len(tokens)
        flat = np.concatenate(tokens)
        owner = np.repeat(np.arange(self.m), [len(t) for t in tokens])
        _, code = np.unique(flat, return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.posting = owner[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(code))])
        self.codes = np.split(code, np.cumsum([len(t) for t in tokens])[:-1])

    def linked(self, k: int) -> np.ndarray:
        """All that set k is linked to."""
        code = self.codes[k]
        begin, count = self.start[code], self.start[code + 1] - self.start[code]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        common = np.bincount(self.posting[at], minlength=self.m)
        return np.flatnonzero((100 * common >= 75 * (self.sizes[k] + self.sizes - common)) & (np.arange(self.m) != k))

    def groups(self) -> list[int]:
        """The smallest member of each set's component; no pair within a component need be compared again."""
        parent = list(range(self.m))

        def find(a: int) -> int:
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        rest, reached = set(range(self.m)), []
        while rest:
            if len(reached) > max(4, len(rest)):  # fewer are left than reached: compare those with all instead
                for k in sorted(rest):
                    for x in self.linked(k).tolist():
                        a, b = find(k), find(x)
                        parent[max(a, b)] = min(a, b)
                break
            k = reached.pop() if reached else rest.pop()
            for x in self.linked(k).tolist():
                if x in rest:
                    rest.discard(x)
                    reached.append(x)
                a, b = find(k), find(x)
                parent[max(a, b)] = min(a, b)
        return [find(k) for k in range(self.m)]


def meet(part: pa.Table) -> pa.Table:
    """Links of the sets of one index key (or of two parts of a large one), as a star for each component."""
    sets = part["set"].to_pylist()
    a, b = [], []
    if len(sets) > 1:
        groups = Meeting([np.frombuffer(t, "<u8") for t in part["tokens"].to_pylist()], part["n"].to_numpy()).groups()
        for k, root in enumerate(groups):
            if k != root:
                a.append(sets[k])
                b.append(sets[root])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def links(members: DataFrame) -> DataFrame:
    """a and b: links between different sets, enough of them to join all that are linked by any path.

    Sets that meet in a key, over any path, are a candidate component.  Where its sets hold few enough shingles to meet in one task, they
    do, so that each set travels once.  The sets of larger ones meet key by key; a key with more than PART sets is dealt into
    parts by a hash, and every two parts meet in a task of bounded size.  A key whose sets all meet in another key is left out.
    """
    index = members.select("set", F.col("keys")[0].alias("first"), F.explode("keys").alias("key"))
    useful = index.groupBy("key").agg(F.count("*").alias("m"), F.min("first").alias("low"), F.max("first").alias("high"), F.min("set").alias("hub"), F.expr("bit_xor(xxhash64(set))").alias("same"))
    useful = useful.where((F.col("m") > 1) & ((F.col("low") != F.col("high")) | (F.col("low") == F.col("key"))))
    useful = saved(useful.groupBy("same", "m", "low", "high", "hub").agg(F.min("key").alias("key")), "keys")
    places = saved(index.select("set", "key").join(useful.select("key", "hub", F.ceil(F.col("m") / PART).cast("int").alias("parts")), "key"), "places")
    candidates = components(places.select(F.col("set").alias("a"), F.col("hub").alias("b")))
    weight = members.select(F.col("set").alias("node"), (F.octet_length("tokens") / 8).alias("w"))
    small = candidates.join(weight, "node").groupBy("root").agg(F.sum("w").alias("w"))
    own = saved(dealt_join(candidates, small, "root", candidates.count()).select(F.col("node").alias("set"), F.when(F.col("w") <= TOGETHER, F.xxhash64("root")).alias("place")), "meetings")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    large = places.join(own.where("place is null").select("set"), "set", "left_semi").withColumn("own", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")).withColumn("other", other)
    by_key = large.select("set", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("place"))
    meetings = own.where("place is not null").union(by_key)
    return meetings.join(members.select("set", "n", "tokens"), "set").groupBy("place").applyInArrow(meet, "a binary, b binary").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, row, set and n of every document; and set, root (the same for linked sets) of every set that is not empty."""
    first = saved(signatures(docs, id_col, text_col), "sets")
    own = first.where("chunk is null").select("doc_id", "row", "set", "n")
    sets = own.where("set is not null").select("set").distinct()
    total = own.agg(F.sum("n")).first()[0] or 0
    if not total:
        return own, sets.withColumn("root", F.col("set"))
    frequent = frequent_class(first.where("chunk is not null").select("chunk", "counts"), total)
    size = bucket_size(total)
    answers = exchange(docs, text_col, frequent, max(1, -(-total // size)), size).groupBy("key").applyInArrow(count_bucket, _MESSAGE)
    members = saved(answers.groupBy("key").applyInArrow(gather_batch, _MEMBER).dropDuplicates(["set"]), "members")
    roots = components(links(members))
    return own, sets.join(roots.withColumnRenamed("node", "set"), "set", "left").select("set", F.coalesce("root", "set").alias("root"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents that are linked, over any path, by the Jaccard similarity of their word shingles.

    Texts have A-Z in lower case and are cut at white space; a set holds the distinct 5-word shingles of a whole text (with
    fewer words, the whole sequence).  Two documents are linked when 100 * |intersection| >= 75 * |union|, with no limit
    on partners or candidates.  Returns one row for each input row: the id, n_shingles and component_id, the smallest id
    of its class.  Null, empty and blank texts have an empty set and are linked with nothing; copies are linked; rows
    with the same id count as documents of that id.  Other columns are left out.  Rows are expected from files or a written table,
    so that a task that runs again sees the same rows in the same order.

    Sets are compared by hashes of their shingles: a bucket and 48 bits more tell shingles apart.
    """
    require(docs, id_col, text_col)
    own, roots = _classes(docs, id_col, text_col)
    classes = own.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("doc_id")).join(roots, "set")
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    n = own.count()
    classes = dealt_join(classes, least, "root", n).select("set", "component_id")
    # Copies of one text, and texts without words, may be any share of the rows: the ones are dealt, the others meet nothing.
    out = dealt_join(own.where("set is not null"), classes, "set", n).select("doc_id", "n", "component_id").union(own.where("set is null").select("doc_id", "n", F.lit(None).cast("long")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of linked documents, the one with the smallest id (null ids last); all columns stay.

    Rows are told apart by id and text: of repeated rows one stays, as of other copies.  A text with an empty set is linked
    with nothing, so only its repeated rows go.
    """
    require(docs, id_col, text_col)
    own, roots = _classes(docs, id_col, text_col)
    own = own.groupBy("row", "doc_id", "set").agg(F.count("*").alias("_n"))
    sets = own.where("set is not null").groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "_n")).alias("x"))
    linked = sets.join(roots, "set").groupBy("root").agg(F.min("x").alias("x")).select("x.row", "x._n")
    kept = saved(linked.union(own.where("set is null").select("row", "_n")), "kept")
    key, n = fresh(docs.columns, "_row_key"), fresh(docs.columns, "_n")
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(kept.select(F.col("row").alias(key), F.col("_n").alias(n)), key)
    return joined.where(F.col(n) == 1).union(joined.where(F.col(n) > 1).dropDuplicates([key])).select(*docs.columns)


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLES: dict[str, str] = {}
