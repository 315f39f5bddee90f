"""Operators 2 and 6 against brute force."""

import random

import numpy as np
import xxhash

from sieveline.llm import repeats, simhash
from sieveline.llm.common import connected_components
from sieveline.llm.suffix_array import permuted_lcp, suffix_array

from . import helpers as H


def test_suffix_array_and_plcp():
    r = random.Random(1)
    for n, k in [(1, 1), (2, 2), (60, 1), (80, 2), (90, 3), (100, 20), (300, 4)] * 8:
        t = np.array([r.randint(1, k) for _ in range(n)] + [0])
        b = t.astype(np.uint8).tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix_array(t)
        assert sa.tolist() == want
        plcp = permuted_lcp(t, sa, 7)
        for x, y in zip(want, want[1:]):
            m = next((d for d in range(7) if b[x + d : x + d + 1] != b[y + d : y + d + 1] or y + d >= len(b)), 7)
            assert plcp[y] == m


def test_repeats_matches_brute_force(spark):
    want = sorted(H.repeats(H.texts_of()), key=H.key)
    for options in ({}, {"hot": 1}, {"blocks": 1, "shards": 1}, {"blocks": 50, "shards": 3}):
        got = sorted((tuple(x) for x in repeats.repeats(H.table(spark), **options).collect()), key=H.key)
        assert got == want, options


def test_repeats_of_one_letter_and_borders(spark):
    r = random.Random(5)
    base = "".join(r.choice("ab ") for _ in range(700))
    data = [(1, "a" * 500), (2, "a" * 99), (3, "a" * 100), (4, base), (5, base[50:160] + "x" + base[200:299]), (6, base[:100] + base[400:500]), (7, "zz" + base[300:420] * 2), (8, base[:99])]
    for hot in (1, 1000):
        got = repeats.repeats(spark.createDataFrame(data, "doc_id long, text string"), hot=hot).collect()
        assert sorted(map(tuple, got)) == sorted(H.repeats(data))


def test_repeats_empty(spark):
    assert repeats.repeats(H.table(spark, [])).count() == 0


def fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for _, t in H.texts_of():
        assert simhash.fingerprint(t) == fingerprint(t)


def brute_links(fps, ids, radius):
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    comp = list(range(len(x)))
    while True:
        new = [min(comp[j] for j in np.flatnonzero(near[i])) for i in range(len(x))]
        if new == comp:
            break
        comp = new
    low = {c: min((ids[i] for i in range(len(x)) if comp[i] == c and ids[i] is not None), default=None) for c in set(comp)}
    return [(ids[i], int(near[i].sum()) - 1, low[comp[i]]) for i in range(len(x))]


def test_near_duplicates(spark):
    docs = H.texts_of()
    want = brute_links([fingerprint(t) for _, t in docs], [i for i, _ in docs], simhash.RADIUS)
    got = [(r["doc_id"], r["n_near"], r["component_id"]) for r in simhash.near_duplicates(H.table(spark)).collect()]
    assert sorted(got, key=H.key) == sorted(want, key=H.key)
    assert simhash.near_duplicates(H.table(spark, [])).count() == 0


def test_tiles_with_hot_bands(spark):
    """Close fingerprints, many in one band, cut into blocks and not: the same links as all pairs."""
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:12]:
        for _ in range(12):
            g = f
            for b in r.sample(range(64), r.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    want = {f: n for f, (_, n, _) in zip(fps, brute_links(fps, list(range(len(fps))), 4))}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    classes = spark.createDataFrame([(signed(f), 1) for f in fps], "fp long, n long")
    for hot in (2, 10_000):
        near = {r["fp"]: r["s"] for r in simhash.linked(classes, hot=hot).groupBy("fp").sum("near").withColumnRenamed("sum(near)", "s").collect()}
        assert {f: near.get(signed(f), 0) for f in fps} == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    r = random.Random(0)
    r.shuffle(edges)
    got = {x["node"]: x["comp"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
