import random
from collections import defaultdict

import numpy as np

from recallspark.llm import components, ngram_join, shingles as hashed


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def test_words_are_hashed_run_by_run(monkeypatch):
    """Whatever the runs, a word's hash is the polynomial of its own bytes."""
    r = random.Random(5)
    texts = ["a", " ", "\t\n", "x" * 40, "x" * 14 + " " + "y" * 7, " ab  Cd\x0b", *["".join(r.choice("abC é漢 \n ") for _ in range(r.randint(1, 60))) for _ in range(300)]]

    def plain(text):
        own = [sum(int(hashed._BYTES[b]) * pow(hashed._ODD, k, 1 << 64) for k, b in enumerate(w)) + len(w) for w in text.encode().lower().split()]
        return hashed._mix(np.array([x % (1 << 64) for x in own], np.uint64)).tolist()

    for run in (1, 2, 7, 1 << 16):
        monkeypatch.setattr(hashed, "RUN", run)
        assert [hashed.words_of(t).tolist() for t in texts] == [plain(t) for t in texts]


def brute_components(texts):
    """doc_id -> (size of its set, smallest id of its component), by comparing all sets that share a shingle."""
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    where = defaultdict(list)
    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for other in where[x]:
                common[other] += 1
            where[x].append(d)
        for other, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[other]) - n):
                a, b = find(d), find(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def same(rows, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    same(ngram_join.op3_ngram_jaccard(spark, "/root/testdata/sf0.01").collect(), {d.doc_id: d.text for d in docs})


def made_texts(seed):
    """Copies, chains of near copies, short texts, passages that most texts share, nulls and blanks."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choice(words) for _ in range(30))
    texts = {}
    base = [r.choice(words) for _ in range(90)]
    chain = list(base)
    for k in range(400):
        kind = k % 8
        if kind < 2:  # near copies of one text, each with its own changes
            own = list(base)
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = r.choice(words)
            texts[k] = " ".join(own)
        elif kind == 2:  # each changes the one before
            chain[r.randrange(len(chain))] = r.choice(words)
            texts[k] = " ".join(chain)
        elif kind == 3:
            texts[k] = passage + " " + " ".join(r.choice(words) for _ in range(r.randint(0, 60)))
        elif kind == 4:
            texts[k] = " ".join(r.choice(words[:3]) for _ in range(r.randint(1, 12)))
        elif kind == 5:
            texts[k] = r.choice([None, "", " \n", "one", "A b C", "a B c", "a\x0bb c d e f"])
        elif kind == 6:
            texts[k] = " ".join(r.choice(words) for _ in range(r.randint(1, 80)))
        else:
            texts[k] = " ".join(r.choice(words[:6]) for _ in range(r.randint(5, 60)))
    return texts


def test_made_texts_equal_brute_force(spark, monkeypatch):
    for seed, floor, part in ((1, 64, 2048), (2, 3, 2048), (3, 3, 2), (4, 64, 7)):
        monkeypatch.setattr(ngram_join, "FLOOR", floor)
        monkeypatch.setattr(ngram_join, "LOAD", 0)
        monkeypatch.setattr(ngram_join, "PART", part)
        monkeypatch.setattr(ngram_join, "BUCKET", 3000)
        monkeypatch.setattr(ngram_join, "TOGETHER", 2_000_000 if seed < 3 else 300)
        texts = made_texts(seed)
        df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, component_id string").repartition(3, "doc_id")
        same(ngram_join.ngram_join(ngram_join.saved(df, "made")).collect(), texts)


def test_linked_sets_share_an_index_key():
    """Any two linked sets meet, whatever their size and however many of their tokens are frequent."""
    r = np.random.default_rng(11)
    mixed = lambda n: np.unique(r.integers(1, 1 << 62, 2 * n, dtype=np.uint64))[:n]
    for trial in range(400):
        n = int(r.integers(2, 60)) if trial % 3 else int(r.integers(60, 2500))
        common = mixed(n)
        r.shuffle(common)
        extra = mixed(n)
        changed = int(r.integers(1, max(2, n // 7 + 1)))
        a, b = set(common.tolist()), set(common[changed:].tolist()) | set(extra[: int(r.integers(0, changed + 1))].tolist())
        if 100 * len(a & b) < 75 * len(a | b):
            continue
        hot = np.array([True, False, r.random() < 0.5])[trial % 3] if trial % 2 else None
        is_hot = {x: bool(hot) if hot is not None else x % 3 > 0 for x in a | b}
        keys = []
        for own in (a, b):
            shared = sorted((x for x in own if x in a & b or is_hot[x] or x % 5 == 0), key=lambda x: (is_hot[x], x))
            keys.append(ngram_join.prefix_keys(np.array(shared, np.uint64), np.array([is_hot[x] for x in shared], bool), len(own)))
            assert len(keys[-1]) <= 60 + 4 * len(own)
        assert set(keys[0]) & set(keys[1]), (len(a), len(b), len(a & b))


def test_repeated_and_null_ids(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (3, text), (None, text), (5, "another text of its own here"), (None, None), (7, text + " eight nine")]
    got = ngram_join.ngram_join(ngram_join.saved(spark.createDataFrame(rows, "doc_id long, text string"), "made")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("5", 3, "3")] * 2 + [("3", 3, "3"), ("None", 3, "3"), ("5", 2, "5"), ("None", 0, "None"), ("7", 5, "7")])


def test_components_of_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(components, "LEAST", 5)
    monkeypatch.setattr(components, "HUBS", 20)
    r = random.Random(8)
    links = [(1000, k) for k in range(300)] + [(k, k + 1) for k in range(2000, 2200)] + [(r.randint(3000, 3300), r.randint(3000, 3300)) for _ in range(250)] + [(2100, 2100), (None, 4), (9000, 8999)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for k in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_tables(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = ngram_join.ngram_join(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(1, 0, 1), (2, 0, 2)]
