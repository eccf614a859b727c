"""Personal data: fixed patterns, and terms that the corpus shows to reveal what the patterns protect."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recallspark.llm._common import fresh, require, row_key, saved, slices, table, trim

KINDS = ("email", "ip", "card", "phone")
#: A term is looked at from so many different documents of an entity; it is generalised where it gives away this share of the
#: entity's information, and removed where it gives away that share.
SUPPORT, GENERALISE, REMOVE = 3, 0.6, 0.85
#: Bits, at least and at most, of the filters that spare most words the count over the corpus, and most documents the search for copies, and bits for each value
#: in between; they let some through, and drop none.
FILTER_BITS, FILTER_SHARE = (1 << 22, 1 << 28), 16
#: Words, and witness keys, that a task remembers; the memory is emptied when it is full.
KNOWN = 200_000
#: Letters at the end of a word that name its more general classes, the narrower first.
CLASS_LETTERS = (3, 1)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, in time linear in the text: every match has an @ behind its whole run."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = max(end, at + 1)
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Every four numbers of a dotted run, if none is over 255."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            size = sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in own):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all fixed patterns, by start, then kind; code points, end exclusive."""
    if not text:
        return []
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b in addresses(text)]
        found += [(a, 2, b) for a, b in cards(text)]
        if "+" in text:
            found += [(a, 3, b) for a, b in phones(text)]
    return sorted(found)


def words(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """Words outside all patterns (spans sorted by start): (word in lower case, start, end)."""
    out, k, far = [], 0, 0
    for m in _WORD.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][0] < e:
            far = max(far, taken[k][2])
            k += 1
        if far <= s:
            out.append((m.group().lower(), s, e))
    return out


def terms_of(text: str | None, taken: list[tuple[int, int, int]]) -> list[str]:
    """The words of a text outside all patterns, in lower case, in order."""
    if not text:
        return []
    return [w[0] for w in words(text, taken)] if taken else " ".join(_WORD.findall(text)).lower().split()


def classes_of(term: str) -> tuple[str, ...]:
    """More general classes of a word, the narrower one first: all words that end in its last three letters, and in its last one."""
    return tuple("…" + term[-n:] for n in CLASS_LETTERS)


def _ending(letters: int) -> Callable[[Column], Column]:
    """classes_of as a column: the class of words that end in so many letters of a word."""
    return lambda term: F.concat(F.lit("…"), F.right(term, F.lit(letters)))


def witness(terms: list[str]) -> bytes:
    """Equal for documents of the same words outside patterns: copies are one witness."""
    return hashlib.sha256(" ".join(terms).encode("utf-8", "surrogatepass")).digest()[:16]


_AT = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_TERM = T.StructType([T.StructField("term", T.StringType()), T.StructField("at", _AT)])


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of every document: the id, base (kind, start, end of every pattern), witness key and distinct entities; with entities, all its terms and their places."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema[id_col], T.StructField("base", T.ArrayType(span)), T.StructField("key", T.BinaryType()), T.StructField("entities", T.ArrayType(T.StringType())), T.StructField("terms", T.ArrayType(_TERM))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                columns = [[], [], [], []]
                for text in part.column(1).to_pylist():
                    own, entities, terms = base_spans(text), set(), {}
                    for a, k, b in own:
                        value = text[a:b].lower() if k < 2 else "".join(_DIGIT.findall(text[a:b]))
                        entities.add(hashlib.sha256(f"{KINDS[k]}:{value}".encode()).hexdigest())
                    if entities:
                        outside = words(text, own)
                        for t, s, e in outside:
                            terms.setdefault(t, []).append({"start": s, "end": e})
                        key = witness([w[0] for w in outside])
                    else:
                        key = witness(terms_of(text, own))
                    row = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in own], key, sorted(entities), [{"term": t, "at": at} for t, at in terms.items()]
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]], schema=arrow)
        trim()

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def _slot(value: str | bytes, size: int) -> int:
    raw = value if isinstance(value, bytes) else value.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) % size


def _filter(values: DataFrame) -> bytes:
    """Bits of the slots of the values of a single column: FILTER_SHARE for each value, between the bounds of FILTER_BITS, set by an aggregation of words of 64 bits."""
    (name,) = values.columns
    least, most = FILTER_BITS
    size = least
    n = values.count()
    while size < most and size < FILTER_SHARE * n:
        size *= 2
    slot = F.pmod(F.crc32(F.col(name).cast("binary")), F.lit(size))
    words = values.select((slot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    whole = np.zeros(size // 64, np.int64)
    for word, bits in words.collect():  # at most size / 64 rows
        whole[word] = bits
    return whole.astype("<i8").tobytes()


def _has(bits: bytes, value: str | bytes) -> bool:
    slot = _slot(value, 8 * len(bits))
    return bool(bits[slot >> 3] >> (slot & 7) & 1)


def term_counts(docs: DataFrame, text_col: str, terms: DataFrame, copied: DataFrame) -> DataFrame:
    """term and n_term: in how many different documents each of `terms` and each of their classes stands, and few others; `copied` holds the witness keys that come more than once.

    Filters keep most other words out of the shuffle, and let most documents be counted without their key.
    """
    classes = F.array(F.col("term"), *[_ending(k)(F.col("term")) for k in CLASS_LETTERS])
    packed, packed_keys = _filter(terms.select(F.explode(classes).alias("term")).distinct()), _filter(copied.select("key"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        told: set[bytes] = set()
        seen: dict[str, int] = {}

        def rows(keys: list, terms: list, counts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, terms, counts), (pa.binary(), pa.list_(pa.string()), pa.int64()), strict=True)], names=["key", "terms", "n"])

        def counted() -> pa.RecordBatch:
            """A row for each term that was counted so far; a task gives it once, or when it has counted very many."""
            out = rows([None] * len(seen), [[t] for t in seen], list(seen.values()))
            seen.clear()
            return out

        for batch in (part for whole in batches for part in slices(whole, 1024)):
            held: list[tuple[bytes, set[str]]] = []
            for text in batch.column(0).to_pylist():
                own = terms_of(text, base_spans(text))
                key = witness(own)
                hits: set[str] = set()
                if maybe := _has(packed_keys, key):
                    if key in told:
                        continue
                    if len(told) > KNOWN:
                        told.clear()
                    told.add(key)
                for term in set(own):
                    hit = known.get(term)
                    if hit is None:
                        if len(known) > KNOWN:
                            known.clear()
                        hit = known[term] = tuple(x for x in (term, *classes_of(term)) if _has(packed, x))
                    hits.update(hit)
                if not maybe:
                    for term in hits:
                        seen[term] = seen.get(term, 0) + 1
                elif hits:
                    held.append((key, hits))
            if held:
                yield rows([k for k, _ in held], [list(h) for _, h in held], [1] * len(held))
            if len(seen) > KNOWN:
                yield counted()
        if seen:
            yield counted()
        known.clear()
        told.clear()
        trim()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, int] = {}
            for own, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in own:
                    sums[term] = sums.get(term, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["term", "n"])

    found = saved(docs.select(F.col(text_col).cast("string")).mapInArrow(count, "key binary, terms array<string>, n long"), "counts")
    once = found.where("key is null").union(found.where("key is not null").dropDuplicates(["key"]))
    return once.select("terms", "n").mapInArrow(add, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def _sets(rows: DataFrame, by: str, name: str) -> DataFrame:
    """by, n and name: what stands in the same documents (_row) has the same `name`, by its number of documents and 128 bits of their hashes."""
    hashes = [F.bit_xor(F.xxhash64(F.lit(k), "_row")).alias(f"h{k}") for k in (1, 2)]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *hashes).select(by, "n", F.struct("n", "h1", "h2").alias(name))


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str, support: int, generalise: float, remove: float) -> tuple[DataFrame, DataFrame]:
    """Sets and shares.  sets: entity and ec, the entities that stand in the same documents; shares: ec, term, share (the part of the information of each of these entities that a
    term gives away) and level (of the class to write for it).

    share = PMI(term, entity) / IC(entity), with PMI = log(n_both * N / (n_term * n_entity)) and IC = log(N / n_entity).  All
    four numbers count whole documents, of which copies (the same words outside patterns) are one.

    Entities do not meet words in every document: words that are too frequent in the corpus to give `generalise` of anything away go first, then entities, and
    words, of the same documents count as one.
    """
    keys = saved(found.groupBy("key").agg(F.count("*").alias("copies")), "keys")
    held = found.where(F.size("entities") > 0)
    one = held.groupBy("key").agg(F.min("_row").alias("_row"))
    seen = saved(held.select("key", F.explode("entities").alias("entity")).distinct().join(one, "key").select("_row", "entity"), "seen")
    sets = saved(_sets(seen, "entity", "ec").where(F.col("n") >= support).select("entity", "ec"), "entities")
    shares = "ec struct<n:bigint,h1:bigint,h2:bigint>, term string, share double, level int"
    if not sets.head(1):
        return sets, docs.sparkSession.createDataFrame([], shares)
    looked = saved(seen.join(sets, "entity").select("_row", "ec").distinct(), "looked")
    rows = looked.select("_row").distinct()
    stand = saved(held.join(rows, "_row", "left_semi").select("_row", F.explode("terms.term").alias("term")), "stand")
    terms = saved(_sets(stand, "term", "tc").where(F.col("n") >= support).withColumnRenamed("n", "n_held"), "terms")
    n = float(max(keys.count(), 2))
    told = saved(term_counts(docs, text_col, terms, keys.where("copies > 1")), "told")
    # No entity is given away more than one that stands in just the documents of the word would be.
    terms = saved(terms.join(told, "term").where(F.log(F.lit(n) / F.col("n_term")) >= generalise * F.log(F.lit(n) / F.col("n_held")) - 1e-9).select("term", "tc", "n_term"), "rare")
    groups = stand.join(terms, "term").select("_row", "tc").distinct()
    both = looked.join(groups, "_row").groupBy("ec", "tc").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    information = F.greatest(F.log(F.lit(n) / F.col("ec.n")), F.lit(1e-9))
    share = F.log(F.col("n_both") * n / (F.col("n_term") * F.col("ec.n"))) / information
    shares = saved(both.join(terms, "tc").select("ec", "term", share.alias("share")).where(F.col("share") >= generalise), "shares")
    # The narrowest class of a word that gives away less than `generalise` of the entity; level 0 is the narrowest, none is beyond the last.
    wide = shares.where(F.col("share") < remove).select("ec", "term", F.posexplode(F.array(*[_ending(k)(F.col("term")) for k in CLASS_LETTERS])).alias("level", "class"))
    wide = saved(wide, "classes")
    held_classes = stand.select("_row", F.explode(F.array(*[_ending(k)(F.col("term")) for k in CLASS_LETTERS])).alias("class")).distinct()
    wanted = looked.join(wide.select("ec", "class").distinct(), "ec")
    both = wanted.join(held_classes, ["_row", "class"], "left_semi").groupBy("ec", "class").agg(F.count("*").alias("n_both"))
    fit = wide.join(both, ["ec", "class"]).join(told.withColumnRenamed("term", "class"), "class").where(share < generalise)
    level = fit.groupBy("ec", "term").agg(F.min("level").alias("level"))
    return sets, saved(shares.join(level, ["ec", "term"], "left").select("ec", "term", "share", F.coalesce("level", F.lit(len(CLASS_LETTERS))).alias("level")), "disclosing")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Spans of personal data in every whole text: the id and spans, an array of (start, end, kind, action, by) in order.

    Kinds email, ip, card and phone are the leftmost non-overlapping matches of fixed patterns that pass their checks, and
    are removed.  Kind term marks every occurrence, in a document that holds an entity, of words that reveal the entity: their
    co-occurrence with it in whole documents over the corpus gives away at least `generalise` of its information (from
    `support` different documents on); from `remove` on they are removed, below that generalised: `by` is the narrowest class of
    the word (all that end in its last three letters, or in its last one) that gives away less than `generalise` of each
    entity, by the same counts, and WORD where none is wide enough.  Offsets count code
    points, ends are exclusive.

    Null and empty texts have no spans; one row comes back for each input row, with the spans of its own text, whatever its
    id.  Only documents with entities send their terms, once each; texts are never shuffled.  Other columns are left out.
    """
    require(docs, id_col, text_col)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = saved(mentions(own, "_id", "_text").withColumn("_row", F.monotonically_increasing_id()), "mentions")
    sets, share = disclosing_terms(found, own, "_text", support, generalise, remove)
    held = found.where(F.size("entities") > 0)
    told = held.select("_row", F.explode("entities").alias("entity")).join(sets, "entity").select("_row", "ec").distinct()
    hits = told.join(share, "ec").groupBy("_row", "term").agg(F.max("share").alias("share"), F.max("level").alias("level"))
    places = held.select("_row", F.explode("terms").alias("t")).select("_row", "t.term", "t.at").join(hits, ["_row", "term"])
    marked = places.select("_row", "share", "level", "term", F.explode("at").alias("p")).select("_row", "p.start", "p.end", "term", "share", "level")
    by = F.when(F.col("share") >= remove, "TERM").otherwise(reduce(lambda rest, k: F.when(F.col("level") == k, _ending(CLASS_LETTERS[k])(F.col("term"))).otherwise(rest), range(len(CLASS_LETTERS)), F.lit("WORD")))
    terms = marked.groupBy("_row").agg(F.collect_list(F.struct("start", "end", F.lit("term").alias("kind"), F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action"), by.alias("by"))).alias("_terms"))
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit("remove").alias("action"), F.upper(x["kind"]).alias("by")))
    joined = found.select("_row", "_id", "base").join(terms, "_row", "left").withColumn("base", base)
    order = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    keyed = F.transform(F.concat("base", F.coalesce("_terms", F.array().cast("array<struct<start:bigint,end:bigint,kind:string,action:string,by:string>>"))), lambda x: F.struct(x["start"].alias("a"), F.array_position(order, x["kind"]).alias("b"), x["end"].alias("c"), x.alias("d")))
    return joined.select(F.col("_id").alias(id_col), F.transform(F.array_sort(keyed), lambda x: x["d"]).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with its texts sanitised: what a span removes becomes [KIND], what it generalises its class, such as […ing].

    Overlapping spans are taken as one, named by the first.  Nulls stay null; all columns and rows stay, repeated ids and
    null ids included: spans find their rows by a key of id and text.
    """
    require(docs, id_col, text_col)
    key, own_spans = fresh(docs.columns, "_row_key"), fresh(docs.columns, "_spans")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    spans = find(keyed.select(key, text_col), key, text_col, **settings).where(F.size("spans") > 0).withColumnRenamed("spans", own_spans).dropDuplicates([key])

    def clean(texts, lists):
        import pandas as pd

        out = []
        for text, own in zip(texts, lists, strict=True):
            if text is not None and own is not None and len(own):
                parts, at = [], 0
                for s in own:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{s['by']}]"]
                    at = max(at, s["end"])
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype="object")

    joined = keyed.join(spans, key, "left")
    new = F.when(F.col(own_spans).isNull(), F.col(text_col)).otherwise(F.pandas_udf(clean, "string")(F.col(text_col), F.col(own_spans)))
    return joined.select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _is(kind: str):
    return lambda x: x == F.lit(kind)


def op6_information_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    text = lambda keep: F.array_join(F.transform(keep, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "term")
    counts = [F.size(F.filter(F.transform("spans", lambda x: x["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


QUERIES = {"op6_information_pii": op6_information_pii}
ORACLES: dict[str, str] = {}
