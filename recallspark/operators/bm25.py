"""A full-text index in files: postings in buckets of terms with the best of each block, built once, appended to, and searched by BM25.

Layout below a path: `docs` (id, size) in a folder for each generation, `postings` (term, block, n, max_tf, min_size, and arrays of id, size, tf) in a folder for each
generation and bucket, `removed` (id, generation) and `log`, whose rows make a generation or a removal count: what a job that failed has left is never read.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_type

from recallspark.operators.retrieval import _top
from recallspark.sources.scratch import saved

#: Postings of a block, words of a file about, and blocks that set a query's first threshold.
BLOCK, FILE, FIRST = 128, 16_000_000, 8
#: Bytes of texts whose words are counted together, and postings that are sorted together, about.
RUN, SORTED = 8_000_000, 1_000_000
#: Characters of a text that are looked up together.
PIECE = 1_000_000
K1, B = 1.2, 0.75
_LOG = "seq long, kind string, generation string, docs long, words long, buckets int"


def _impact(tf: Column, size: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


#: ASCII: letters in lower case and digits stay, others become blanks.
_PLAIN = bytes(ord(chr(c).lower()) if c > 127 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


@cache
def _kept() -> np.ndarray:
    """For each code point whether it is a letter or a digit, as \\p{L} and \\p{N} have it."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])


def _words(text: bytes) -> bytes:
    """A text in lower case, with a blank for each character that is no letter or digit."""
    if text.isascii():
        return text.translate(_PLAIN)
    lower, out = text.decode("utf-8", "replace").lower(), []
    for k in range(0, len(lower), PIECE):
        codes = np.frombuffer(lower[k : k + PIECE].encode("utf-32-le", "replace"), "<u4")
        out.append(np.where(_kept()[codes], codes, np.uint32(32)).astype("<u4").tobytes().decode("utf-32-le").encode())
    return b"".join(out)


def _size(words: bytes) -> int:
    blank = np.frombuffer(words, np.uint8) == 32
    return int(np.count_nonzero(blank[:-1] & ~blank[1:])) + int(len(blank) > 0 and not blank[0])


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _sizes(docs: DataFrame) -> DataFrame:
    """id, size: the words of each document (id, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_size(_words(x)) for x in _texts(batch.column(1))], pa.int32())], ["id", "size"])

    return docs.mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("size", T.IntegerType())]))


def _asked(queries: DataFrame) -> DataFrame:
    """qid, term: the different words of each query (qid, text), cut as those of documents are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted({w.decode() for w in _words(x).split(b" ") if w}) for x in _texts(batch.column(1))]
            rows = np.repeat(np.arange(len(words)), [len(x) for x in words])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([w for x in words for w in x], pa.string())], ["qid", "term"])

    return queries.select("qid", "text").mapInArrow(run, T.StructType([queries.schema["qid"], T.StructField("term", T.StringType())]))


def _lists(docs: DataFrame, files: int, buckets: int, parts: int) -> DataFrame:
    """place, part, lists: for some documents (id, body, file) that are read together, the lists of those that hold a term.

    All lists of a bucket, file and part of its terms are one row, as Arrow's bytes of (term, id, size, tf): most terms are rare, so there would be a row for every few postings.
    """
    kind = to_arrow_type(docs.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64) // RUN
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
            for some in (batch.slice(x, y - x) for x, y in zip(cuts, cuts[1:]) if y > x):
                words = pc.ascii_split_whitespace(pa.array(map(_words, _texts(some.column(1))), pa.string()))
                flat = words.flatten().dictionary_encode()
                hashes = np.fromiter(map(zlib.crc32, flat.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(flat.dictionary))
                spots = hashes % buckets * parts + hashes // buckets % parts
                order = np.argsort(spots, kind="stable")
                names, spots, place = flat.dictionary.take(pa.array(order)), spots[order], np.empty_like(order)
                place[order] = np.arange(len(order))
                codes, rows = place[flat.indices.to_numpy()], np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
                real = codes != names.index("").as_py()  # there may be empty ones before a text's first word and after its last
                keys, tf = np.unique((some.column(2).to_numpy()[rows] * np.int64(len(names)) + codes)[real] * len(words) + rows[real], return_counts=True)
                rows, lists = keys % len(words), keys // len(words)
                size = np.bincount(rows, weights=tf, minlength=len(words)).astype(np.int32)
                starts = np.flatnonzero(np.diff(lists, prepend=-1))
                file, code = lists[starts] // len(names), lists[starts] % len(names)
                stops = pa.array(np.append(starts, len(keys)).astype(np.int32))
                columns = (some.column(0).cast(kind).take(pa.array(rows)), pa.array(size[rows]), pa.array(tf.astype(np.int32)))
                made = pa.RecordBatch.from_arrays([names.take(pa.array(code)), *(pa.ListArray.from_arrays(stops, c) for c in columns)], ["term", "id", "size", "tf"])
                first = np.flatnonzero(np.diff(file * (buckets * parts) + spots[code], prepend=-1))
                sent = [made.slice(x, y - x).serialize().to_pybytes() for x, y in zip(first, [*first[1:], len(code)])]
                spot = spots[code[first]]
                yield pa.RecordBatch.from_arrays([pa.array((spot // parts * files + file[first]).astype(np.int32)), pa.array((spot % parts).astype(np.int32)), pa.array(sent, pa.binary())], ["place", "part", "lists"])

    return docs.mapInArrow(run, "place int, part int, lists binary")


def _blocks(lists: DataFrame, mean: float, kind: T.DataType) -> DataFrame:
    """Blocks of postings, from lists that come part by part: of some that are read together, those of a term in blocks, the best first."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("max_tf", T.IntegerType()), T.StructField("min_size", T.IntegerType()), *_arrays(kind)])

    own = pa.schema([("term", pa.string()), ("id", pa.list_(to_arrow_type(kind))), ("size", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        term, ids, size, tf = (pa.concat_arrays([b.column(c) for b in held]) for c in ("term", "id", "size", "tf"))
        term, counts = term.dictionary_encode(), pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        codes, size, tf = np.repeat(term.indices.to_numpy().astype(np.int64), counts), size.flatten().to_numpy(), tf.flatten().to_numpy()
        order = np.argsort((codes << 32) + ((1 - _impact(tf, size, mean) / (K1 + 1)) * 0xFFFFFFFF).astype(np.int64))
        codes, size, tf = codes[order], size[order], tf[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        inside = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
        starts = np.flatnonzero(inside % BLOCK == 0)
        ends = np.append(starts, len(codes)).astype(np.int32)
        best = [np.diff(ends).astype(np.int64), np.maximum.reduceat(tf, starts), np.minimum.reduceat(size, starts)]
        columns = (ids.flatten().take(pa.array(order)), pa.array(size), pa.array(tf))
        return pa.RecordBatch.from_arrays([term.dictionary.take(pa.array(codes[starts])), *map(pa.array, best), *(pa.ListArray.from_arrays(pa.array(ends), c) for c in columns)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        for batch in batches:
            for part, sent in zip(batch.column("part").to_pylist(), batch.column("lists")):
                if n >= SORTED and (part != last or n >= 4 * SORTED):
                    yield made(held)
                    held, n = [], 0
                held.append(pa.ipc.read_record_batch(sent.as_buffer(), own))
                n, last = n + len(held[-1].column("id").flatten()), part
        if n:
            yield made(held)

    return lists.mapInArrow(run, schema)


def _arrays(kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(c, T.ArrayType(k)) for c, k in (("id", kind), ("size", T.IntegerType()), ("tf", T.IntegerType()))]


def _each(postings: DataFrame) -> DataFrame:
    """A row for each posting of blocks."""
    return postings.select("term", "generation", F.inline(F.arrays_zip("id", "size", "tf")))


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.col(term).cast("binary")), F.lit(buckets)).cast("int")


def log(spark: SparkSession, path: str) -> list:
    """The commits of an index in their order; there is one for each build, append and removal."""
    try:
        return spark.read.schema(_LOG).parquet(f"{path}/log").orderBy("seq").collect()
    except Exception as e:  # no commit yet
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def _commit(spark: SparkSession, path: str, *row) -> None:
    spark.createDataFrame([(len(log(spark, path)), *row)], _LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def append(docs: DataFrame, path: str, id_col: str = "id", text: str | list[str] = "text", buckets: int = 64) -> None:
    """Add documents to an index; the first call builds it and sets the number of buckets.

    Each text is read once for its length and once for its postings, whose counts and lists are made before anything is shuffled, and many lists are shuffled as one row.  A file has the
    postings of one bucket and of some hashes of the id, so a word of all documents spreads over files, and each is made by a task of its own.  In a file a term's come
    together, the best first, in blocks that differ in what their best posting can give; a block is a row.  An id that is there already is added once more: `upsert` takes the old one out.
    """
    spark, generation = docs.sparkSession, uuid.uuid4().hex
    done = log(spark, path)
    buckets = done[0].buckets if done else buckets
    own = docs.select(F.col(id_col).alias("id"), F.concat_ws("\n", *([text] if isinstance(text, str) else text)).alias("body"))
    _sizes(own).write.parquet(f"{path}/docs/generation={generation}")
    n, words = spark.read.parquet(f"{path}/docs/generation={generation}").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    files = max(1, -(-words // (buckets * FILE)))
    mean = max(words / max(n, 1), 1.0)
    parts = max(1, -(-words // (buckets * files * SORTED)))
    lists = _lists(own.withColumn("file", F.pmod(F.xxhash64("id"), F.lit(files)).cast("int")), files, buckets, parts)
    lists = lists.repartitionById(buckets * files, F.col("place")).sortWithinPartitions("part")
    own = _blocks(lists.select("part", "lists"), mean, own.schema["id"].dataType).withColumns({"block": F.monotonically_increasing_id(), "bucket": _bucket("term", buckets)})
    own.write.option("parquet.enable.dictionary#id.list.element", "false").partitionBy("bucket").parquet(f"{path}/postings/generation={generation}")
    _commit(spark, path, "append" if words else "empty", generation, n, words, buckets)


def remove(ids: DataFrame, path: str, id_col: str = "id") -> None:
    """Take documents out: their postings no longer count for scores, lengths or document frequencies.  Ids that are not there change nothing."""
    spark = ids.sparkSession
    done = log(spark, path)
    if not any(r.docs > 0 for r in done):
        return
    here = _read(spark, path, "docs", [r.generation for r in done if r.kind != "remove"])
    dead = here.join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    if gone := _removed(spark, path, done):
        dead = dead.join(gone, ["id", "generation"], "left_anti")
    name = uuid.uuid4().hex
    dead.select("id", F.col("generation").alias("of"), "size").write.parquet(f"{path}/removed/commit={name}")
    n, words = spark.read.parquet(f"{path}/removed/commit={name}").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    _commit(spark, path, "remove", name, -n, -words, done[0].buckets)


def upsert(docs: DataFrame, path: str, id_col: str = "id", text: str | list[str] = "text") -> None:
    """Documents take the place of those with their ids."""
    remove(docs, path, id_col)
    append(docs, path, id_col, text)


def build(docs: DataFrame, path: str, id_col: str = "id", text: str | list[str] = "text", buckets: int = 64) -> str:
    """A new index at a path that holds none."""
    if log(docs.sparkSession, path):
        raise ValueError(f"there is an index at {path}; append to it")
    append(docs, path, id_col, text, buckets)
    return path


def _read(spark: SparkSession, path: str, table: str, generations: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/generation={g}" for g in generations])


def _removed(spark: SparkSession, path: str, done: list) -> DataFrame | None:
    names = [r.generation for r in done if r.kind == "remove" and r.docs]
    if not names:
        return None
    return spark.read.parquet(*[f"{path}/removed/commit={n}" for n in names]).select("id", F.col("of").alias("generation"))


def _live(spark: SparkSession, path: str, done: list, table: str, buckets: list[int] | None = None) -> DataFrame | None:
    """Blocks of all generations that count, of some buckets, with their postings or without."""
    names = [r.generation for r in done if r.kind == "append"]
    if not names or buckets == []:
        return None
    own = _read(spark, path, "postings", names)
    own = own.drop("id", "size", "tf") if table == "blocks" else own
    return own if buckets is None else own.where(F.col("bucket").isin(buckets))


def terms(spark: SparkSession, path: str) -> DataFrame:
    """term, df, max_tf: the documents of each term of the index, and the most that it stands in one."""
    done = log(spark, path)
    postings = _live(spark, path, done, "postings")
    if postings is None:
        return spark.createDataFrame([], "term string, df long, max_tf int")
    if gone := _removed(spark, path, done):
        return _each(postings).join(gone, ["id", "generation"], "left_anti").groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"))
    return _live(spark, path, done, "blocks").groupBy("term").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"))


def search(queries: DataFrame, path: str, k: int = 20) -> DataFrame:
    """qid, id, score, rank: the k best documents that hold all terms of a query (qid, text), by BM25; exact, ties by the smaller id.

    Only the buckets of the queries' terms are read: once for the postings of these terms, which are saved, and once for blocks that the threshold leaves.  A query starts from the blocks of its rarest term: the ones with the highest bounds
    give a first k and a threshold, then those that can still reach it; the other terms are looked up for these documents only.  A bound is what the block's best posting
    and the best postings of the other terms could give together.  Queries without a term find nothing.
    """
    spark = queries.sparkSession
    done = log(spark, path)
    asked = saved(_asked(queries).withColumn("bucket", _bucket("term", done[0].buckets if done else 1)), "terms")
    buckets = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # as many as the index has buckets, at most
    postings, blocks = (_live(spark, path, done, t, buckets) for t in ("postings", "blocks"))
    n, words = sum(r.docs for r in done), sum(r.words for r in done)
    if postings is None or not n:
        ids = _read(spark, path, "docs", [r.generation for r in done if r.kind != "remove"]).schema["id"] if done else T.StructField("id", T.LongType())
        return spark.createDataFrame([], T.StructType([queries.schema["qid"], ids, T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    mean = words / n
    wanted = asked.select("bucket", "term").distinct()
    postings, blocks = (x.join(wanted, ["bucket", "term"], "left_semi") for x in (postings, blocks))
    own = saved(postings.select("term", "generation", "block", "id", "size", "tf"), "postings")  # few of those in the buckets
    gone = _removed(spark, path, done)
    known = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max(_impact(F.col("max_tf"), F.col("min_size"), mean)).alias("most"))
    if gone is not None:
        dead = _each(own).join(gone, ["id", "generation"], "left_semi").groupBy("term").agg(F.count("*").alias("dead"))
        known = known.join(dead, "term", "left").withColumn("df", F.col("df") - F.coalesce("dead", F.lit(0))).where("df > 0")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = asked.join(known, "term", "left").withColumn("idf", idf)
    parts = F.array_sort(F.collect_list(F.struct("df", "term", "idf", "most")))
    plans = found.groupBy("qid").agg(parts.alias("parts"), F.count("*").alias("need"), F.count("df").alias("have")).where("need = have")
    plans = plans.select("qid", "need", "parts", F.col("parts")[0]["term"].alias("term"), F.col("parts")[0]["idf"].alias("idf"), F.aggregate(F.slice("parts", 2, F.size("parts")), F.lit(0.0), lambda a, x: a + x["idf"] * x["most"]).alias("rest"))
    order = W.Window.partitionBy("qid").orderBy(F.desc("bound"), "generation", "block")
    ranked = plans.join(blocks, "term").withColumn("bound", F.col("idf") * _impact(F.col("max_tf"), F.col("min_size"), mean) + F.col("rest"))
    ranked = saved(ranked.select("qid", "need", "parts", "term", "generation", "block", "bound", F.row_number().over(order).alias("place")), "blocks")

    def scored(some: DataFrame, held: DataFrame) -> DataFrame:
        """Documents of some blocks that hold all terms: the others are looked up by term and document.  held: where the postings of the blocks are."""
        first = some.join(held.select("term", "generation", "block", "id"), ["term", "generation", "block"]).withColumn("id", F.explode("id")).select("qid", "need", "id", "generation", F.explode(F.transform("parts", lambda x: F.struct(x["term"].alias("term"), x["idf"].alias("idf")))).alias("p"))
        if gone is not None:
            first = first.join(gone, ["id", "generation"], "left_anti")
        hit = first.select("qid", "need", "id", "generation", "p.term", "p.idf").hint("shuffle_hash").join(_each(own), ["term", "generation", "id"])
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
        return hit.groupBy("qid", "id", "generation").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("_n"), F.first("need").alias("need")).where("_n = need").select("qid", "id", "score")

    most = FIRST + -(-k // BLOCK)
    best = saved(scored(ranked.where(F.col("place") <= most), own), "first")
    threshold = _top(best, ["qid"], [F.desc("score"), F.asc("id")], k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    more = ranked.where(F.col("place") > most).join(threshold, "qid", "left").where("least is null or bound >= least - 0.000001").drop("least")
    return _top(best.unionByName(scored(more, postings)).repartition("qid"), ["qid"], [F.desc("score"), F.asc("id")], k)
