import hashlib
import math
import random
import time
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from recallspark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None,
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, m.end()))
    return sorted(out)


def test_spans_are_those_of_the_patterns():
    r = random.Random(5)
    pieces = ["a", "é", "@", ".", "-", "+", " ", "1", "22", "255", "256", "300", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1111", "x.y@z.com", "+1 (582) 555-6681", "10.0.0.1", "%", "_", "\n", "٣"]
    for _ in range(20000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text


def test_long_hostile_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1" * 100_000, "1 " * 100_000 + "@", "+1" + "(" * 300_000):
        pii.base_spans(text)


def test_query_equals_brute_force(spark):
    rows = {r.doc_id: r for r in pii.op6_information_pii(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        own = brute(d.text)
        joined = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in own)
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [rows[d.doc_id][f"n_{k}"] for k in PATTERNS] == [sum(x[1] == i for x in own) for i in range(4)]


def brute_find(texts):
    """All spans with what is written for them, by counts in plain Python over whole texts."""
    own = []
    for text in texts:
        spans, places, entities = brute(text), defaultdict(list), set()
        for m in re.finditer(r"[^\W\d_]{3,}", text or ""):
            if not any(a < m.end() and m.start() < b for a, _, b in spans):
                places[m.group().lower()].append(m.span())
        for a, k, b in spans:
            entities.add((k, text[a:b].lower() if k < 2 else re.sub("[^0-9]", "", text[a:b])))
        order = tuple(w for _, w in sorted((at, w) for w, ats in places.items() for at in ats))
        own.append((spans, places, entities, order))
    distinct = {}
    for _, places, entities, order in own:
        names = set(places) | {w[-3:].join(["…", ""]) for w in places} | {"…" + w[-1] for w in places}
        distinct.setdefault(order, [set(), names])[0].update(entities)
    n, n_term, n_entity, n_both = max(2, len(distinct)), Counter(), Counter(), Counter()
    for entities, names in distinct.values():
        n_term.update(names)
        n_entity.update(entities)
        n_both.update((e, x) for e in entities for x in names)
    share = lambda e, x: math.log(n_both[e, x] * n / (n_term[x] * n_entity[e])) / max(math.log(n / n_entity[e]), 1e-9)
    out = []
    for spans, places, entities, _ in own:
        rows = [(a, k, b, list(PATTERNS)[k].upper()) for a, k, b in spans]
        for word, ats in places.items():
            told = [(share(e, word), e) for e in entities if n_both[e, word] >= pii.SUPPORT]
            told = [(x, e) for x, e in told if x >= pii.GENERALISE]
            if told:
                by = "TERM"
                if max(told)[0] < pii.REMOVE:
                    fits = [[k for k, c in enumerate(("…" + word[-3:], "…" + word[-1])) if share(e, c) < pii.GENERALISE] for _, e in told]
                    by = ("…" + word[-3:], "…" + word[-1], "WORD")[max(min(f, default=2) for f in fits)]
                rows += [(a, 4, b, by) for a, b in ats]
        out.append(sorted(rows))
    return out


def same_as_brute(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [*PATTERNS, "term"]
    got = {r.doc_id: [(s.start, kinds.index(s.kind), s.end, s.by) for s in r.spans] for r in pii.find(df).collect()}
    want = brute_find(texts)
    assert [(k, texts[k], own, got[k]) for k, own in enumerate(want) if got[k] != own] == []
    return [x[3] for rows in want for x in rows]


def test_all_spans_equal_brute_force(spark):
    r = random.Random(9)
    words = ["".join(r.choice("bcdfglmnrst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(160)]
    texts = [None, "", "12 ab"]
    for k in range(500):
        own = [r.choice(words) for _ in range(r.randint(3, 40))]
        if k % 5 == 0:
            e = r.randrange(12)
            own.insert(r.randrange(len(own)), f"user{e}@mail.com")
            own += [f"secret{words[e]}"] * r.randint(0, 2) + [words[e * 3]] * (r.random() < 0.8) + [f"mark{words[e]}"]
        elif k % 3 == 1:
            own.append(f"mark{words[r.randrange(12)]}")
        texts += [" ".join(own).title() if k % 7 == 0 else " ".join(own)] * (3 if k % 13 == 0 else 1)
    by = same_as_brute(spark, texts)
    assert by.count("TERM") > 20 and sum(x.startswith("…") for x in by) > 5, Counter(by)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    same_as_brute(spark, [d.text for d in docs])


def test_many_mentions_in_one_text_take_linear_time(spark):
    text = " ".join(f"word{chr(97 + k % 26)} someone{k}@mail.com" for k in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(pii.find(df).first().spans) == 100_000


def test_many_entities_and_words_in_the_same_documents(spark):
    """50,000 addresses and as many words, which all stand in the same three documents."""
    letters = lambda k: "".join(chr(97 + int(c)) for c in f"{k:06d}")
    text = " ".join(f"zq{letters(k)} someone{k}@mail.com" for k in range(50_000))
    noise = [f"plain text number {letters(k)}" for k in range(300)]
    df = spark.createDataFrame(list(enumerate([*(f"{text} copy{letters(k)}" for k in range(3)), *noise])), "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.n for r in pii.find(df).select("doc_id", F.size("spans").alias("n")).collect()}
    assert got[0] == got[1] == got[2] == 100_000 and got[10] == 0
    assert time.time() - began < 120


def test_filters_hold_all_and_grow(spark, monkeypatch):
    monkeypatch.setattr(pii, "FILTER_BITS", (1 << 8, 1 << 12))
    values = [f"w{k}é" for k in range(200)]
    whole = pii._filter(spark.createDataFrame([(v,) for v in values], "v string"))
    assert len(whole) == (1 << 12) // 8 and all(pii._has(whole, v) for v in values) and sum(map(int.bit_count, whole)) <= 200
    assert pii._filter(spark.createDataFrame([], "v string")) == bytes((1 << 8) // 8)


def test_terms_that_reveal_an_entity(spark):
    noise = [f"plain common words number{chr(97 + k % 26)}{chr(97 + k // 26)} stand here" for k in range(300)]
    told = [f"{w} common zorblax wrote from boss@corp.com about {w} words" for w in ("alpha", "bravo", "charlie", "delta")]
    copies = ["same quuxword sent by other@corp.com again"] * 6
    rows = [(k, t, "x") for k, t in enumerate([*told, *copies, *noise, None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(df).collect()}
    assert len(found) == len(rows)
    for k, t in enumerate(told):
        terms = {t[a:b] for kind, a, b in found[k] if kind == "term"}
        assert "zorblax" in terms and "common" not in terms
    for k in range(len(told), len(rows)):
        assert not [s for s in found[k] if s[0] == "term"]  # copies of one passage are one witness
    clean = {r.doc_id: r for r in pii.sanitise(df.withColumnRenamed("spans", "other")).collect()}
    assert "zorblax" not in clean[0].text and "[EMAIL]" in clean[0].text and "alpha common" in clean[0].text
    assert clean[20].text == rows[20][1] and clean[len(rows) - 2].text is None and clean[0].other == "x"


def test_terms_count_over_whole_documents(spark):
    far = lambda k: " ".join(f"plain common number{chr(97 + k)}{chr(97 + i % 26)}" for i in range(30))
    told = [f"Zorblax wrote {far(k)} about this. Mail: boss@corp.com" for k in range(4)]
    split = ["rareword plain common"] * 50  # one copied document beside the four: n_term is 5, not 54
    told = [t.replace("about", "rareword") for t in told]
    noise = [f"plain common wrote this mail {far(k % 26)} item{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    again = [told[0].replace("Mail", "Zorblax rareword. Mail")]
    texts = [*told, *again, *split, *noise]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in pii.find(df).collect()}
    for k, t in enumerate([*told, *again]):
        marked = [t[a:b].lower() for a, b in found[k]]
        assert marked.count("zorblax") == t.lower().count("zorblax") and marked.count("rareword") == t.count("rareword")
        assert not {"plain", "common", "wrote", "this", "mail"} & set(marked)
    assert not any(found[k] for k in range(len(told) + len(again), len(texts)))
    keyed = [[w[0] for w in pii.words(t, pii.base_spans(t))] for t in texts]
    docs = {tuple(w): bool(pii.base_spans(t)) for w, t in zip(keyed, texts, strict=True)}
    n, n_entity = len(docs), sum(docs.values())
    for w in ("zorblax", "rareword", "plain"):
        both, n_term = sum(e and w in d for d, e in docs.items()), sum(w in d for d in docs)
        share = math.log(both * n / (n_term * n_entity)) / math.log(n / n_entity)
        assert (share >= pii.GENERALISE) == (w != "plain")


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []
