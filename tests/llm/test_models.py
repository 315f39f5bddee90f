"""Operators 8, 9 and 10, and the pipeline."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from sieveline.llm import leaks, mixing, simhash, toxicity
from sieveline.llm.common import docs_table

from . import helpers as H
from .test_dedup import brute_links, fingerprint

SF = "/root/testdata/sf0.001"


def test_mixing_matches_sql(spark):
    data = [x for x in H.rows() if x[0] is not None]
    docs = H.table(spark, data)
    got = sorted((tuple(r) for r in mixing.select(docs).selectExpr("id", "domain", "lang", "source", "epoch", "n_tokens").collect()), key=H.key)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    want = sorted((tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in con.sql(mixing.sql()).fetchall()), key=H.key)
    assert got == want
    for hexes in (1, 2):
        again = mixing.select(docs, bucket_hex=hexes).selectExpr("id", "domain", "lang", "source", "epoch", "n_tokens").collect()
        assert sorted(map(tuple, again), key=H.key) == got
    assert mixing.select(H.table(spark, [])).count() == 0


def test_shortage_goes_to_siblings_then_ancestors(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 5), ("b", "en", "s4", 1000)], "domain string, lang string, source string, tokens long")
    flat = {"*": 1.0}
    from pyspark.sql import functions as F

    budget = lambda total, e=1: {r["source"]: r["budget"] for r in mixing.budgets(leaves, F.lit(float(total)), e, (flat, flat, flat)).collect()}
    assert budget(400) == {"s1": 10, "s2": 185, "s3": 5, "s4": 200}
    assert budget(1800) == {"s1": 10, "s2": 885, "s3": 5, "s4": 900}
    assert budget(2010) == {"s1": 10, "s2": 995, "s3": 5, "s4": 1000}
    assert budget(10_000) == {"s1": 10, "s2": 1000, "s3": 5, "s4": 1000}


def test_selection_is_a_prefix_of_seeded_order(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "en", "src1", "x") for i in range(300)], "doc_id long, text string, lang string, source string, id string")
    got = {r["doc_id"] for r in mixing.select(docs, budget_share=0.4).select("doc.*").collect()}
    order = sorted(range(300), key=lambda i: (hashlib.md5(f"{mixing.SEED}:0:{i}".encode()).hexdigest(), i))
    budget, want, used = int(0.4 * sum(i % 7 + 1 for i in range(300))), set(), 0
    for i in order:
        used += i % 7 + 1
        if used > budget:
            break
        want.add(i)
    assert got == want


def planted(r, item, how):
    w = item.split()
    if how == "edit":
        w = [x if k % 9 else "changed" for k, x in enumerate(w)]
    if how == "case":
        w = [x.upper() + "," for x in w]
    return H.prose(r, 200) + " " + " ".join(w) + " " + H.prose(r, 150)


def plain_words(t):
    return [w for x in (t or "").lower().split() if (w := x.strip(leaks._SIGNS))]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_leaks(docs, items):
    """Every stretch of every document against every item, by words and a table of common subsequences."""
    out = set()
    for n, t in docs:
        w = plain_words(t)
        for i, text in items:
            own = plain_words(text)
            answer = next((p for s in reversed(leaks._SENTENCE.split(text)) if len(p := plain_words(s)) >= 3), own)
            for at in range(-leaks.STEP, len(w), leaks.STEP):
                around = w[max(0, at - len(own)) : at + 2 * leaks.STEP + len(own)]
                if sum(x in set(around) for x in own) < 0.55 * len(own):
                    continue
                share = plain_lcs(own, around) / len(own)
                if share >= 0.75 or share >= 0.55 and plain_lcs(answer, around) >= 0.7 * len(answer):
                    out.add((n, i))
                    break
    return out


def test_leaks_found_and_clean_left_alone(spark):
    r = random.Random(8)
    alphabet = [f"{a}{b}{c}" for a in ("zor", "kel", "mip", "dra", "fun", "gol") for b in ("a", "e", "ita", "ou") for c in ("n", "st", "rk", "l")]
    items = [(i, " ".join(r.choice(alphabet) for _ in range(r.randint(20, 45))) + ". " + " ".join(r.choice(alphabet) for _ in range(6)) + ".") for i in range(12)]
    bench = spark.createDataFrame([*items, (98, None), (99, "too short")], "item_id long, text string")
    data = [(x[0], x[1]) for x in H.rows()]
    want = set()
    for i, (k, t) in enumerate(items):
        for how in ("copy", "edit", "case"):
            n = 1000 + 10 * i + len(how)
            data.append((n, planted(r, t, how)))
            want.add((n, k))
    for n in range(60):  # one item in most documents
        data.append((5000 + n, planted(r, items[0][1], "copy")))
        want.add((5000 + n, 0))
    docs = spark.createDataFrame([(*d, "c", 1) for d in data], "doc_id long, text string, ids string, item_id int")
    got = {(x["doc_id"], x["item_id"]) for x in leaks.matches(docs, bench).collect()}
    brute = brute_leaks(data, items)
    assert want <= brute and got == brute
    assert {(x["doc_id"], x["item_id"]) for x in leaks.matches(docs, bench, part_chars=700).collect()} == brute
    clean = leaks.clean(docs, bench)
    assert clean.columns == docs.columns
    assert leaks.clean(docs, bench, part_chars=700).count() == clean.count()
    assert sorted((x["doc_id"] for x in clean.collect()), key=lambda v: (v is None, v or 0)) == sorted((i for i, _ in data if i not in {d for d, _ in brute}), key=lambda v: (v is None, v or 0))


def test_leak_query_against_brute_force(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert {(x["doc_id"], x["item_id"]) for x in leaks.query(spark, SF).collect()} == brute_leaks(docs, items) != set()


def scattered():
    """Documents that have few of 76 words each, in pairs whose kind changes along the table, and items of these words."""
    r = random.Random(21)
    words = [f"{a}{b}" for a in ("zor", "kel", "mip", "dra") for b in range(19)]
    items = [(i, " ".join(r.sample(words, 14)) + ".") for i in range(7)] + [(7, " ".join(words))]
    docs = []
    for n in range(1500):
        some = [words[(n // 20 + k * k) % 76] for k in range(n % 5 // 3 * 2)] + ([r.choice(words)] if n % 3 == 0 else [])
        docs.append((n, " ".join(["filler"] * r.randint(0, 40) + some + ["filler"] * r.randint(0, 60))))
    return [*docs, (None, None), (5, ""), *[(2000 + i, f"filler {t} filler") for i, t in items]], items


def brute_space(docs, items):
    """(words, inner products of their embeddings): all passages of all documents as dense rows, eigenvectors of their products."""
    own = [plain_words(t) for _, t in items]
    words = sorted({w for x in own for w in x})
    number = {w: k for k, w in enumerate(words)}
    df = np.array([sum(w in plain_words(t) for _, t in docs) for w in words])
    idf = np.log((1 + len(docs)) / (1 + df)) + 1
    keep = df <= 0.02 * len(docs)
    for x in own:
        keep[sorted({number[w] for w in x}, key=lambda k: (df[k], k))[:6]] = True
    idf = np.where(keep, idf, 0)

    def products(texts):
        total = np.zeros((len(words), len(words)))
        for w in texts:
            for at in range(-16, len(w), 16):
                row = np.zeros(len(words))
                for x in w[max(0, at) : at + 32]:
                    if x in number:
                        row[number[x]] += idf[number[x]]
                if row.any():
                    row /= np.linalg.norm(row)
                    total += np.outer(row, row)
        return total

    both = 64 * len(docs) / 500 * products(own) + products([plain_words(t) for _, t in docs])
    v = np.linalg.eigh(both)[1][:, ::-1][:, :64]
    return words, (v @ v.T) * np.outer(idf, idf)


def test_latent_space_is_that_of_all_documents(spark):
    data, items = scattered()
    bench = spark.createDataFrame(items, "item_id long, text string")
    words, want = brute_space(data, items)
    assert (want.diagonal() > 0).sum() > 64  # the space can't hold all of them, so what it keeps depends on the documents
    docs = spark.createDataFrame(data, "doc_id long, text string")
    spaces = []
    for some in (docs.coalesce(1), docs.orderBy(docs.text.desc())):
        found, emb, _, _ = leaks._prepared(some, bench)[1].value
        assert list(found.vocabulary) == words
        assert np.abs(emb @ emb.T - want).max() < 1e-3
        spaces.append(emb.tobytes())
    assert len(set(spaces)) == 1
    got = {(x["doc_id"], x["item_id"]) for x in leaks.matches(docs, bench).collect()}
    assert got == brute_leaks(data, items) >= {(2000 + i, i) for i, _ in items}


def test_decontamination_stage_fits_on_all_its_documents(spark, tmp_path, monkeypatch):
    cp = pytest.importorskip("corpus_pipeline")
    data, items = scattered()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen, prepared = spark.createDataFrame(data, "doc_id long, text string"), [], leaks._prepared
    monkeypatch.setattr(leaks, "_prepared", lambda *a: seen.append(prepared(*a)) or seen[-1])
    got = [(x["doc_id"], x["text"]) for x in cp.decontamination(spark, docs, str(tmp_path)).collect()]
    gone = {d for d, _ in brute_leaks(data, items)}
    assert sorted(got, key=H.key) == sorted((x for x in data if x[0] not in gone), key=H.key)
    (_, shared), (_, want) = seen[0], brute_space(data, items)
    emb = shared.value[1]
    assert len(seen) == 1 and np.abs(emb @ emb.T - want).max() < 1e-3


def test_hot_items_are_found_at_every_alignment():
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("zor", "kel", "mip", "dra", "fun", "gol") for b in ("a", "e", "ita", "ou") for c in ("n", "st", "rk", "l")]
    rows = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate((51, 59, 40, 24, 15))]
    items = leaks.Items(rows)
    number = leaks.Numbers(items.vocabulary)
    texts, copies = [H.prose(r, 60) for _ in range(1500)], set()
    for k, (_, text) in enumerate(rows):
        for at in range(2 * leaks.STEP):
            for changed in (0.0, 0.1):
                own = [w if r.random() >= changed else "other" for w in text.split()]
                copies.add((len(texts), k)) if not changed else None
                texts.append(" ".join(["filler"] * (at + 160 * (at % 3)) + own + ["filler"] * r.randint(0, 90)))
    docs = [number.of(t) for t in texts]
    df = np.zeros(len(items.vocabulary), np.int64)
    for ids in docs:
        df[np.unique(ids[ids >= 0])] += 1
    idf = items.weights(df, len(docs))
    assert (idf == 0).any()  # the items are in so many documents that most of their words carry no weight
    emb = np.diag(idf).astype(np.float32)
    queries = np.array([emb[w].sum(axis=0) for w in items.words])
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    brute = {}
    for d, ids in enumerate(docs):
        for k in range(len(rows)):
            for at in range(0, len(ids), leaks.STEP):
                share, answer = leaks._verify(items, k, ids, at)
                if share >= leaks.SURE or share >= leaks.MAYBE and answer:
                    brute[d, k] = max(share, brute.get((d, k), 0))
    assert copies <= brute.keys()
    for weight, space in ((idf, emb), (np.zeros_like(idf), np.zeros_like(emb))):
        got = {(d, k): v[1] for d, f in enumerate(leaks.search(docs, items, space, queries, weight)) for k, v in f.items()}
        assert got == brute


def test_short_items_match_as_whole_sequences(spark):
    items = [(1, "What is the capital of France?"), (2, "capital"), (3, "what is the capital of france"), (4, " ?! "), (5, "the end the end"), (6, "a much longer item that has more than eight words of its own")]
    texts = ["So: what is the Capital, of France -", "what is the capital of Spain", "France what is the capital of", None, "what is the capital", "of France", "the end the end the end", "the end of the end", items[5][1]]
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if (w := leaks.words_of(x)) and f" {' '.join(w)} " in f" {' '.join(leaks.words_of(t))} "}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for some in (items, items[:5]):
        bench = spark.createDataFrame(some, "item_id long, text string")
        got = [(x["doc_id"], x["item_id"]) for x in leaks.matches(docs, bench).collect()]
        assert sorted(got) == sorted(p for p in want if p[1] <= len(some)) and {(0, 1), (0, 2), (0, 3), (6, 5)} <= set(got)
    assert {x["doc_id"] for x in leaks.clean(docs, bench).collect()} == {3, 5, 7, 8}


def test_dedup_stage_keeps_one_document_of_each_group(spark):
    cp = pytest.importorskip("corpus_pipeline")
    r = random.Random(4)
    a, b, c, d = (H.prose(r, 80) for _ in range(4))
    data = [(None, a), (None, a), (3, a), (None, b), (None, b), (5, c), (5, c), (5, d), (None, H.prose(r, 80)), (9, H.prose(r, 80))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = [(x["doc_id"], x["text"]) for x in cp.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=H.key) == sorted([(3, a), (None, b), (5, c), (5, d), *data[8:]], key=H.key)


def test_leaks_empty(spark):
    docs, bench = H.table(spark), spark.createDataFrame([(1, "some words that are here and there in a row")], "item_id long, text string")
    assert leaks.matches(docs, bench.limit(0)).count() == 0
    assert leaks.matches(docs.limit(0), bench).count() == 0
    assert leaks.clean(docs, bench.limit(0)).count() == len(H.rows())


def test_lcs():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(1, 14))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leaks.lcs(leaks._masks(a), len(a), b) == t[-1][-1]


def test_block_max_neighbours_are_exact():
    r = np.random.default_rng(3)
    for n, size, k in ((700, 400, 15), (40, 30, 5), (3, 5, 4), (0, 5, 2)):
        v = r.random((n, size)) * (r.random((n, size)) < np.where(np.arange(size) < 8, 0.6, 0.03))
        v[1::9] = v[::9][: len(v[1::9])]  # ties
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        v = v.astype(np.float32).astype(float)
        rows = [(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in v]
        rank = r.permutation(n)
        index = toxicity.BlockMax(rows, size, rank)
        q = np.concatenate([v[:60], r.random((9, size)) * (r.random((9, size)) < 0.2), np.zeros((1, size))])
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
        places, cos = index.nearest([(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in q], k)
        for x, p, c in zip(q, places, cos):
            s = np.round(v @ x, 9)
            want = np.lexsort((rank, -s))[:k]
            assert p[: len(want)].tolist() == want.tolist() and (p[len(want) :] == -1).all() and np.allclose(c[: len(want)], s[want], atol=2e-9)


def brute_toxicity(docs, labels):
    """Scores by dictionaries: every text against every example, nothing skipped."""
    import math
    import re
    from collections import Counter

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    mark = {}
    for i, y in labels:
        if i is not None and y is not None and not held(i):
            mark[i] = max(y, mark.get(i, 0))
    text = {}
    for i, t in docs:
        if i in mark:
            text[i] = max(t or "", text.get(i, ""))
    bag = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    train = {i: bag(t) for i, t in sorted(text.items())}
    df, pos, neg = Counter(), Counter(), Counter()
    for _, t in docs:
        df.update(set(bag(t)))
    for i, c in train.items():
        (pos if mark[i] else neg).update(set(c))
    n1 = sum(mark[i] for i in train)
    n0 = len(train) - n1
    weight = {}
    for w in pos.keys() | neg.keys():
        a, b = pos[w], neg[w]
        low = (a + b) * (n1 + n0 - a - b) * n1 * n0
        chi2 = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / low if low else 0
        gain = toxicity.GAIN * math.sqrt(max(0, chi2 - toxicity.CHANCE)) if a * n0 > b * n1 else 0
        weight[w] = (math.log((1 + len(docs)) / (1 + df[w])) + 1) * (1 + gain)

    def vector(c):
        v = {w: (1 + math.log(n)) * weight[w] for w, n in c.items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    groups = {}
    for i, c in train.items():
        groups.setdefault(frozenset(c.items()), []).append(i)
    known = {g[0]: (vector(train[g[0]]), len(g), sum(mark[i] for i in g)) for g in groups.values() if train[g[0]]}
    rate = n1 / (n1 + n0)

    def vote(v, without=None, label=0):
        """Nearest first, equal ones by doc_id; of copies that don't all fit, each counts in part."""
        if not v:
            return rate
        up = down = used = 0
        for c, i in sorted((-round(sum(x * known[i][0].get(w, 0) for w, x in v.items()), 9), i) for i in known):
            n, p = known[i][1] - (i == without), known[i][2] - label * (i == without)
            if n and used < toxicity.K:
                w = min(n, toxicity.K - used) / n / (1 - min(1, -c) + toxicity.EPS)
                up, down, used = up + w * p, down + w * n, used + n
        return (up + toxicity.PRIOR * rate) / (down + toxicity.PRIOR)

    votes, ys, ns = [], [], []
    for i, (v, n, p) in known.items():
        for y, m in ((1, p), (0, n - p)):
            if m:
                votes, ys, ns = [*votes, vote(v, i, y)], [*ys, y], [*ns, m]
    a, b = toxicity.platt(np.array(votes), np.array(ys, float), np.array(ns, float))
    return [1 / (1 + math.exp(-(a * math.log((p + 0.01) / (1.01 - p)) + b))) for p in (vote(vector(bag(t))) for _, t in docs)]


def test_toxicity_scores_are_those_of_brute_force(spark):
    d, l, docs = toxic_tables(spark, 400)
    want = sorted((x[0] is None, x[0] or 0, s) for x, s in zip(docs, brute_toxicity([(x[0], x[1]) for x in docs], [(r["doc_id"], r["toxic"]) for r in l.collect()])))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in toxicity.toxicity(d, l).collect())
    assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 for a, b in zip(got, want)), [(a, b) for a, b in zip(got, want) if abs(a[2] - b[2]) >= 1e-5]
    from pyspark.sql import functions as F

    # The query itself, over whole tables.
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()
    want = dict(zip([r[0] for r in rows], brute_toxicity([tuple(r) for r in rows], [tuple(r) for r in marks])))
    got = toxicity.query(spark, sf).withColumn("h", F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert len(got) == len(want) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-5 and r["h"] == r["held_out"] and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def toxic_tables(spark, n=700):
    r = random.Random(6)
    bad = ["grubzak", "vilnort", "skumple", "drexo"]
    docs, labels = [], []
    for i in range(n):
        w = H.prose(r, 60).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w.insert(r.randint(0, len(w)), r.choice(bad) + r.choice(["", "en", "ing"]))
        docs.append((i, " ".join(w), "x", toxic))
        labels.append((i, 1, int(toxic)))
    docs += [(None, None, "x", False), (9001, "", "x", False), (9002, "grubzak vilnort drexo", "x", True), (3, docs[3][1], "x", False)]
    labels += [(5, 1, None), (None, 1, 1), (77777, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, toxic boolean"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def test_toxicity_on_held_out_rows(spark):
    d, l, docs = toxic_tables(spark)
    got = toxicity.toxicity(d, l).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    truth = {x[0]: x[3] for x in docs}
    held = [r for r in got if r["held_out"] or r["doc_id"] == 9002]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    # Labels of held-out rows play no part.
    from pyspark.sql import functions as F

    other = l.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(d, other).collect() if r["doc_id"] is not None) == sorted((r["doc_id"], r["score"]) for r in got if r["doc_id"] is not None)


def test_toxicity_without_labels_or_rows(spark):
    d, l, docs = toxic_tables(spark, 20)
    assert {r["score"] for r in toxicity.toxicity(d, l.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.toxicity(d, l.filter("toxic = 1")).collect()} == {1.0}
    assert toxicity.toxicity(d, l.limit(0)).count() == len(docs)
    assert toxicity.toxicity(d.limit(0), l).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    docs, cols = docs_table(spark, SF), ["doc_id", "text", "lang", "source", "n_chars"]
    made = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        made.append((docs.toPandas(), spark.read.parquet(str(tmp_path / str(k)))))
        docs = made[-1][1]
        assert k == 4 or docs.columns == cols
    before, after = made[1][0], {r["doc_id"] for r in made[1][1].collect()}
    links = brute_links([fingerprint(t) for t in before.text], before.doc_id.tolist(), simhash.RADIUS)
    assert after == {c for _, _, c in links}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    before, after = made[2][0], {r["doc_id"] for r in made[2][1].collect()}
    assert not any(t in x for i, x in zip(before.doc_id, before.text) if i in after for t in items.text)
    whole = sorted(map(tuple, docs.select("doc_id", "epoch").collect()))
    assert whole == sorted(map(tuple, cp.run(spark, SF).select("doc_id", "epoch").collect()))


def test_pipeline_stages_on_awkward_rows(spark):
    """Each stage against a brute-force version, over a table with every awkward case and clashing columns."""
    cp = pytest.importorskip("corpus_pipeline")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    r = random.Random(12)
    leak = [(900 + k, H.prose(r, 50) + " " + items[k][1] + " " + H.prose(r, 50), *H.rows()[0][2:]) for k in range(3)]
    private = (910, H.prose(r, 60) + ' write to a.b@example.org or token = "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c" ' + H.prose(r, 30), *H.rows()[1][2:])
    shared = [(7, H.prose(r, 90), *H.rows()[2][2:]), (None, None, *H.rows()[3][2:]), (920, H.rows()[1][1], *H.rows()[5][2:])]
    data = [*H.rows(), *leak, private, *shared]
    docs = H.table(spark, data)
    plain = lambda df: sorted((tuple(x) for x in df.collect()), key=lambda t: H.key(map(repr, t)))
    rows = lambda df: [(x["doc_id"], x["text"]) for x in df.collect()]
    same = lambda a, b: sorted(a, key=H.key) == sorted(b, key=H.key)

    from sieveline.llm import pii, quality

    # Quality: the SQL's verdict by text.
    kept = cp.quality_rules(spark, docs, SF)
    con = duckdb.connect()
    texts = [t for t in dict.fromkeys(x[1] for x in data)]
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    good = {texts[i] for i, k in con.sql(f"SELECT doc_id, kept FROM ({quality.sql()})").fetchall() if k}
    assert kept.columns == docs.columns and plain(kept) == sorted((tuple(x) for x in docs.collect() if x["text"] in good), key=lambda t: H.key(map(repr, t)))
    assert same(rows(kept), [(x[0], x[1]) for x in data if x[1] in good])
    # Near-duplicates, on everything: one document of each group, once.
    out = cp.near_duplicates(spark, docs, SF)
    keys = list(dict.fromkeys((x[0], x[1] or "") for x in data))
    links = brute_links([fingerprint(t) for _, t in keys], list(range(len(keys))), simhash.RADIUS)
    groups = {}
    for (i, t), (_, _, c) in zip(keys, links):
        groups.setdefault(c, []).append((i is None, i or 0, i, t))
    got = [(x["doc_id"], x["text"] or "") for x in out.collect()]
    assert out.columns == docs.columns and len(got) == len(groups) == len(set(got))
    for g in groups.values():
        least = min(x[:2] for x in g)
        assert sum((i, t) in got for _, _, i, t in g) == 1 and any((i, t) in got for a, b, i, t in g if (a, b) == least)
    assert same(rows(simhash.one_each(docs, broadcast_rows=0)), rows(out))
    # Decontamination.
    bad = {t for t in texts if brute_leaks([(0, t)], items)}
    out = cp.decontamination(spark, docs, SF)
    assert len(bad) == 3 and out.columns == docs.columns and same(rows(out), [(x[0], x[1]) for x in data if x[1] not in bad])
    # Personal data.
    fit, limits = pii.model()
    out = cp.personal_data(spark, docs, SF)
    redacted = [(x[0], pii.masked(x[1], pii.spans(x[1], fit, limits)[1])) for x in data]
    assert out.columns == docs.columns and same(rows(out), redacted)
    text = next(x["text"] for x in out.collect() if x["doc_id"] == 910)
    assert "[EMAIL]" in text and "[SECRET]" in text and "9f8e" not in text
    assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in out.collect())
    # The mixture: that of the SQL, columns that clash kept beside it.
    whole = [x for x in data if x[0] is not None]
    out = cp.mixture(spark, H.table(spark, whole), SF)
    assert out.columns == [*docs.columns, "epoch_", "domain_", "n_tokens"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [x[:4] for x in whole])
    assert same([(x["doc_id"], x["domain_"], x["lang"], x["source"], x["epoch_"], x["n_tokens"]) for x in out.collect()], con.sql(mixing.sql()).fetchall())
    assert all(x["epoch"] == 9 and x["domain"] == "dom" for x in out.collect())
    # All of them in a row, and over nothing.
    for table in (docs, docs.limit(0)):
        out = table
        for _, stage in cp.STAGES:
            out = stage(spark, out, SF)
        ids = {x["doc_id"] for x in out.collect()}
        assert ids <= {x[0] for x in data} and not ids & {900, 901, 902} and (910 in ids) == (table is docs)
