"""SimHash: fingerprints, trie join and components against brute force."""
import random

import numpy as np
import pytest
import xxhash

from ownerlens.llm import simhash
from ownerlens.llm.components import components
from ownerlens.llm.trie import connect


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(pairs, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in (p for p in pairs if p[0] != p[1]):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near_keys(seed, n=600):
    rnd = random.Random(seed)
    keys = {rnd.getrandbits(64) for _ in range(n // 3)}
    for k in list(keys):
        for _ in range(2):
            x = k
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                x ^= 1 << b
            keys.add(x)
    return sorted(keys)


def test_fingerprint():
    rnd = random.Random(1)
    for t in [None, "", " \t\x0b", "One", "a b c", "É é A\x1cB", *[" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 60))) for _ in range(60)]]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint("x y z w v " * 20_000) == plain_fingerprint("x y z w v " * 20_000)


@pytest.mark.parametrize("leaf", [1, 16, 256])
def test_trie_connects_like_brute_force(monkeypatch, leaf):
    monkeypatch.setattr("ownerlens.llm.trie.LEAF", leaf)
    keys = np.array(near_keys(2), np.uint64)
    root = connect(keys, [0], [len(keys)], [0], [len(keys)], 0, 4)
    pairs = [(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= 4]
    assert root.tolist() == list(plain_classes(pairs, range(len(keys))).values())


@pytest.mark.parametrize("max_node", [1 << 16, 3])
def test_links_in_spark(spark, max_node):
    keys = near_keys(3, 300) + [0, 1, 2**64 - 1, 2**64 - 16]
    keys = sorted(set(keys))
    signed = [k - 2**64 if k >= 2**63 else k for k in keys]
    links = simhash.links(spark.createDataFrame([(k,) for k in signed], "fp bigint"), max_node)
    got = plain_classes([(r["u"], r["v"]) for r in links.collect()], signed)
    pairs = [(signed[i], signed[j]) for i in range(len(keys)) for j in range(i + 1, len(keys)) if (keys[i] ^ keys[j]).bit_count() <= 4]
    assert got == plain_classes(pairs, signed)


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (400, 401), (401, 400)]
    want = plain_classes(pairs, {x for p in pairs if p[0] != p[1] for x in p})
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_clusters_on_edges(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, 1), (9, base, 1), (7, base + " tail", 1), (3, None, 1), (4, "", 1), (2, "solo word", 1), (5, "other text here now and then", 1), (None, "nobody", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    got = simhash.clusters(docs).collect()
    assert len(got) == len(rows)
    prints = {t: plain_fingerprint(t) for _, t, _ in rows}
    nodes = list(range(len(rows)))
    near = [(i, j) for i in nodes for j in nodes if i < j and (prints[rows[i][1]] ^ prints[rows[j][1]]).bit_count() <= 4]
    cls = plain_classes(near, nodes)
    want = []
    for i in nodes:
        ids = [rows[j][0] for j in nodes if cls[j] == cls[i] and rows[j][0] is not None]
        want.append((rows[i][0], f"{prints[rows[i][1]]:016x}", min(ids) if ids else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert simhash.clusters(docs.limit(0)).count() == 0
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(x) for x in {(cls[i], min((rows[j][0] is None, rows[j][0]) for j in nodes if cls[j] == cls[i])[1]) for i in nodes} for x in [x[1]])


def gram_set(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def alike(a, b):
    a, b = gram_set(a), gram_set(b)
    return len(a & b) >= 0.8 * len(a | b)


def edited(rnd, words, rate):
    out = []
    for w in words:
        x = rnd.random()
        out += [] if x < rate / 3 else [w, "added"] if x < 2 * rate / 3 else ["other"] if x < rate else [w]
    return " ".join(out)


@pytest.mark.parametrize("equal", [1, 2])
def test_tries_with_several_equal_blocks_link_like_brute_force(spark, equal):
    scheme = simhash.Scheme(budget=6, equal=equal)
    keys = sorted(set(near_keys(9, 240)))
    signed = [k - 2**64 if k >= 2**63 else k for k in keys]
    got = simhash.links(spark.createDataFrame([(k,) for k in signed], "fp bigint"), scheme=scheme).collect()
    pairs = [(signed[i], signed[j]) for i in range(len(keys)) for j in range(i + 1, len(keys)) if (keys[i] ^ keys[j]).bit_count() <= 6]
    assert plain_classes([(r["u"], r["v"]) for r in got], signed) == plain_classes(pairs, signed)
    for depth, pieces in scheme.tries + simhash.WIDE.tries:
        x = np.array(keys, np.uint64)
        assert (simhash.turn_back(simhash.turn(x, pieces), pieces) == x).all() and sum(w for _, w in pieces) == 64


def test_near_copies_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(400)]
    texts = []
    for k in range(70):
        words = rnd.choices(vocabulary, k=rnd.choice([60, 150, 400]))
        texts.append(" ".join(words))
        # Families around an original, some of them too far from it.
        texts += [edited(rnd, words, rnd.choice([0.005, 0.01, 0.02, 0.1])) for _ in range(rnd.choice([0, 1, 3, 12]))]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    near = [(i, j) for i, a in rows for j, b in rows if i < j and a != b and alike(a, b)]
    caught = sum(1 for i, j in near if not (i in kept and j in kept)) / len(near)
    assert len(near) > 100 and caught >= 0.9
    # What goes is like a member of its group; what is like nothing stays.
    partner = {i for p in near for i in p}
    assert all(i in partner or texts.index(texts[i]) != i for i in set(range(len(rows))) - kept)
    group = {r["doc_id"]: r["group"] for r in simhash.near_groups(docs).collect()}
    by = {}
    for i, g in group.items():
        by.setdefault(g, []).append(i)
    assert all(any(all(alike(texts[i], texts[c]) for i in g) for c in g) for g in by.values())


def test_documents_without_words_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (None, "one two"), (4, "one two"), (7, "two one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("_kept_doc", "_kept_rid", "rid", "root", "fp", "group", "n", "grams", "centre", "_n", "_r", "_h", "_t"):
        docs = docs.withColumn(name, docs["text"])
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 4, 6, 7]
    assert simhash.one_of_each(docs.limit(0)).count() == 0
