"""Chunkers, embedder, retrieval, fusion, filters and metrics against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline import queries as core
from sieveline.errors import ConfigurationError, PluginNotFoundError, ProviderUnavailableError
from sieveline.operators import chunking as C
from sieveline.operators import metrics as M
from sieveline.operators import retrieval as R
from sieveline.operators.embedding import Hashing, embed, l2_normalize
from sieveline.operators.filters import SearchFilters, predicate
from sieveline.registry import Registry, chunkers

PROSE = " ".join(f"Sentence number {w} talks about {'authentication ' * (k % 3)}things." for k, w in enumerate("one two three four five six seven eight nine ten".split()))


def greedy(text, size, overlap, count):
    import re

    w = [(m.start(), m.end(), max(1, count(m.group()))) for m in re.finditer(r"\S+", text)]
    out, i = [], 0
    while i < len(w):
        j, used = i, 0
        while j < len(w) and (j == i or used + w[j][2] <= size):
            used += w[j][2]
            j += 1
        out.append((w[i][0], w[j - 1][1]))
        if j == len(w):
            return out
        back, got = j, 0
        while overlap and back > i + 1 and got < overlap:
            back -= 1
            got += w[back][2]
        i = max(back, i + 1)
    return out


def test_fixed_windows_match_the_walk():
    r = random.Random(2)
    for _ in range(150):
        text = " ".join("x" * r.randint(1, 30) for _ in range(r.randint(0, 60)))
        size = r.randint(1, 20)
        overlap = r.randint(0, size - 1)
        for count in (C.approx_count, C.ws_count):
            assert C.fixed_spans(text, size, overlap, count) == greedy(text, size, overlap, count)


@pytest.mark.parametrize("text, want", [("Dr. Who came. He left.", ["Dr. Who came.", "He left."]), ("See e.g. Fig. 4 here. J. R. R. wrote 3.14 twice! Yes?", ["See e.g. Fig. 4 here.", "J. R. R. wrote 3.14 twice!", "Yes?"]), ("no stop\n\nnext para", ["no stop", "next para"]), ('He said "go." Then left.', ['He said "go."', "Then left."]), ("  ", [])])
def test_sentences(text, want):
    assert [text[a:b] for a, b in C.sentence_spans(text)] == want


def test_sentence_packing_covers_and_ends():
    spans = C.packed_sentences(PROSE, 12, 5, C.approx_count)
    assert spans[0][0] == 0 and spans[-1][1] == len(PROSE) and all(a[0] < b[0] for a, b in zip(spans, spans[1:]))


def test_semantic_breaks_at_the_gap():
    vec = lambda texts: np.array([[1.0, 0.0] if "A" in t else [0.0, 1.0] for t in texts])
    text = "A one. A two. A three. B one. B two. B three."
    cut = C.semantic_spans(text, vec, 0.5, 0, 1000, 1, C.approx_count)
    assert [text[a:b] for a, b in cut] == ["A one. A two. A three.", "B one. B two. B three."]
    assert len(C.semantic_spans(text, vec, 0.95, 0, 4, 1, C.approx_count)) == 6
    assert C.semantic_spans("A one. A two.", vec, 0.5, 0, 100, 5, C.approx_count) == [(0, 13)]


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("d1", PROSE * 3), ("d2", ""), ("d3", None)], "id string, content string")
    for name, options in (("fixed", {"chunk_size": 20, "overlap": 4}), ("sentence", {"chunk_size": 20}), ("semantic", {"max_chunk_size": 30, "dimensions": 16})):
        rows = C.with_chunks(docs, chunkers.create(name, **options), name=name).collect()
        assert {r["document_id"] for r in rows} == {"d1"} and len({r["chunk_id"] for r in rows}) == len(rows)
        assert all((PROSE * 3)[r["start_char"] : r["end_char"]] == r["content"] and r["token_count"] == C.approx_count(r["content"]) for r in rows)
        assert sorted(r["position"] for r in rows) == list(range(len(rows)))


def test_hierarchy(spark):
    docs = spark.createDataFrame([("d1", PROSE * 4)], "id string, content string")
    rows = C.hierarchical_chunks(docs, 60, 20, 4).collect()
    parents = {r["chunk_id"]: r for r in rows if r["chunk_level"] == "parent"}
    kids = [r for r in rows if r["chunk_level"] == "child"]
    assert sorted(r["position"] for r in rows) == list(range(len(rows))) and max(k["position"] for k in kids) < min(p["position"] for p in parents.values())
    for k in kids:
        p = parents[k["parent_id"]]
        assert p["start_char"] <= k["start_char"] and k["end_char"] <= p["end_char"]


def test_bad_options():
    for bad in (lambda: chunkers.create("fixed", chunk_size=10, overlap=10), lambda: R.weights_of(["a"], {"a": 0}), lambda: R.weights_of(["a", "b"], {"a": -1})):
        with pytest.raises(ConfigurationError):
            bad()
    r = Registry("thing")
    r.register("My-Name", dict)
    assert "my_name" in r and r.names() == ["my_name"]
    with pytest.raises(ConfigurationError):
        r.register("my-name", dict)
    with pytest.raises(PluginNotFoundError):
        r.get("other")


def test_hash_embedder(spark):
    m = Hashing(32).embed(["Token tokens", "", "token"])
    assert np.allclose(np.linalg.norm(m, axis=1), [1, 0, 1])
    got = spark.createDataFrame([("Token tokens",)], "t string").select(embed(F.col("t"), "hash", dimensions=32).alias("v"), l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), l2_normalize(F.array(F.lit(0.0))).alias("z")).first()
    assert np.allclose(got["v"], m[0]) and got["u"] == [0.6, 0.8] and got["z"] == [0.0]


DOCS = [("c1", "authentication service for users"), ("c2", "the service of the service in a long text about many other things and more words"), ("c3", "deployment of the service"), ("c4", "authentication authentication authentication"), ("c5", "")]


def okapi(query, docs, k1=1.2, b=0.75):
    toks = {i: t.split() for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, ts in toks.items():
        s = 0.0
        for q in set(query.split()):
            df = sum(q in x for x in toks.values())
            tf = ts.count(q)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ts) / avg))
        if s:
            out[i] = s
    return out


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "chunk_id string, text string")
    q = spark.createDataFrame([("q1", "authentication service service"), ("q2", "!!!"), ("q3", "absent")], "query_id string, text string")
    for options in ({}, {"b": 0.0}, {"k1": 0.5, "b": 1.0}):
        got = {r["chunk_id"]: r["score"] for r in R.bm25(q, docs, 10, **options).collect()}
        want = okapi("authentication service", DOCS, **options)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)
    part = [d for d in DOCS if d[0] != "c2"]
    got = {r["chunk_id"]: r["score"] for r in R.bm25(q, docs.filter("chunk_id <> 'c2'"), 10).collect()}
    assert all(abs(got[i] - s) < 1e-5 for i, s in okapi("authentication service", part).items())
    assert R.bm25(q, docs, 0).count() == 0 and R.bm25(q, docs.limit(0), 5).count() == 0


def test_bm25_plan_stays_in_the_jvm(spark):
    docs = spark.createDataFrame(DOCS, "chunk_id string, text string")
    q = spark.createDataFrame([("q1", "service")], "query_id string, text string")
    plan = R.bm25(q, docs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "WindowGroupLimit" in plan


def test_dense_skips_zero_vectors_and_other_models(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "m1"), ("b", [1.0, 1.0], "m1"), ("c", [0.0, 0.0], "m1"), ("d", [1.0, 0.0], "m2")], "chunk_id string, vector array<double>, model_key string")
    q = spark.createDataFrame([("q", [2.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, vector array<double>")
    got = [(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in R.dense(q, v, 5, "m1").orderBy("rank").collect()]
    assert got == [("q", "a", 1.0, 1), ("q", "b", 0.707107, 2)]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int, retriever string")


def test_fusion(spark):
    lists = ranked(spark, [("q", "A", 0.9, 1, "dense"), ("q", "B", 0.5, 2, "dense"), ("q", "B", 7.0, 1, "bm25"), ("q", "C", 3.0, 2, "bm25")])
    rrf = {r["chunk_id"]: r for r in R.rrf(lists, 5).collect()}
    assert rrf["B"]["score"] == round(0.5 / 62 + 0.5 / 61, 8) and rrf["B"]["rank"] == 1
    assert rrf["B"]["component_ranks"] == {"bm25": 1, "dense": 2} and rrf["A"]["component_scores"] == {"dense": 0.9}
    w = {r["chunk_id"]: r["score"] for r in R.weighted(lists, 5, {"dense": 3, "bm25": 1}).collect()}
    assert w == {"A": 0.75, "B": 0.25, "C": 0.0}
    flat = ranked(spark, [("q", "A", 1.0, 1, "dense"), ("q", "B", 1.0, 2, "dense")])
    assert {r["score"] for r in R.weighted(flat, 5, names=["dense"]).collect()} == {1.0}
    with pytest.raises(ConfigurationError):
        R.hybrid({"hybrid": lambda n: lists})


def test_rerankers(spark):
    hits = ranked(spark, [("q", "A", 0.9, 1, "dense"), ("q", "B", 0.5, 2, "dense"), ("q", "C", 0.1, 3, "dense")]).withColumn("query", F.lit("x")).withColumn("content", F.col("chunk_id"))
    assert R.candidates(5, "none") == 5 and R.candidates(5, "cross_encoder", 50) == 50
    assert R.search(lambda n: hits, 2).count() == 2 and R.search(lambda n: hits, 0).count() == 0
    out = R.search(lambda n: hits, 2, "cross_encoder", scorer=lambda q, c: [{"A": 0.0, "B": 1.0, "C": 1.0}[x] for x in c]).orderBy("rank").collect()
    assert [(r["chunk_id"], r["retrieval_score"]) for r in out] == [("B", 0.5), ("C", 0.1)]
    with pytest.raises(ProviderUnavailableError):
        R.search(lambda n: hits, 2, "cross_encoder")


def test_filters(spark):
    rows = spark.createDataFrame(
        [("1", "fs", "a.md", "md", "ann", None, ["x", "y"], '{"k": 1, "n": {"a": [1, 2, {"z": "q"}]}, "s": "1"}', "2024-01-01"), ("2", "pdf", "b.pdf", "pdf", None, "r", None, '{"k": "1", "b": true}', "2024-06-01"), ("3", "fs", "c", None, "bob", None, [], None, None)],
        "id string, source_type string, source_id string, file_type string, author string, repository string, tags array<string>, metadata string, created_at string",
    )
    hit = lambda **f: "".join(r["id"] for r in rows.filter(predicate(SearchFilters(**f))).orderBy("id").collect())
    assert hit() == "123" and SearchFilters().is_empty and not SearchFilters(tags=("x",)).is_empty
    assert hit(source_types=("fs",)) == "13" and hit(source_types=("fs",), file_types=("md", "pdf")) == "1"
    assert hit(authors=("ann", "bob")) == "13" and hit(tags=("y", "zz")) == "1" and hit(document_ids=("2",)) == "2"
    assert hit(created_after="2024-01-01", created_before="2024-06-01") == "12"
    assert hit(metadata={"k": 1}) == "1" and hit(metadata={"k": "1"}) == "2" and hit(metadata={"b": True}) == "2" and hit(metadata={"b": 1}) == ""
    assert hit(metadata={"n": {"a": [2, 1]}}) == "1" and hit(metadata={"n": {"a": [{"z": "q"}]}}) == "1" and hit(metadata={"n": {"a": [3]}}) == "" and hit(metadata={"n": {}}) == "1"


def test_metrics_by_hand(spark):
    judged = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("q", "z", 0), ("miss", "a", 1)], "query_id string, key string, grade int")
    got = spark.createDataFrame([("q", "x", 1), ("q", "b", 2), ("q", "b", 3), ("q", "z", 4), ("q", "a", 5)], "query_id string, key string, rank int")
    r = {x["query_id"]: x for x in M.per_query(got, judged, 4).collect()}
    assert r["q"]["precision"] == 0.5 and r["q"]["coverage"] == 0.5 and r["q"]["mrr"] == 0.5 and r["q"]["hit_rate"] == 1.0
    assert abs(r["q"]["ndcg"] - (1 / math.log2(3)) / (7 + 1 / math.log2(3))) < 1e-12
    assert [r["miss"][m] for m in M.METRICS] == [0.0] * 5
    long = M.evaluate(got, judged, (1, 4))
    assert long.count() == 2 * 2 * 5
    mean = M.mean_by_run(long.withColumn("run_id", F.lit("r")).withColumn("error", F.when(F.col("query_id") == "miss", "boom"))).collect()
    assert {x["n_queries"] for x in mean} == {1}


def test_summaries(spark):
    s = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 4.0)], "g string, v double")
    r = {x["g"]: x for x in M.latency_summary(s, "v", ["g"]).collect()}
    assert r["a"]["p50"] == 5.0 and r["a"]["p95"] == 9.5 and r["b"]["p99"] == 4.0
    assert s.limit(0).agg(M.percentile("v", 0.5).alias("p")).first()["p"] == 0.0
    c = spark.createDataFrame([(1000000, 0.02, False), (5, None, True), (5, None, False)], "t long, p double, l boolean").select(M.cost(F.col("t"), F.col("p"), F.col("l")).alias("c")).collect()
    assert [x["c"] for x in c] == [0.02, 0.0, None]
    base = spark.createDataFrame([("r1", "m", 0.5), ("r2", "m", 0.0), ("gone", "m", 1.0), ("edge", "m", 0.5)], "run_id string, metric string, value double")
    now = spark.createDataFrame([("r1", "m", 0.4), ("r2", "m", 0.1), ("new", "m", 1.0), ("edge", "m", 0.48)], "run_id string, metric string, value double")
    v = {x["run_id"]: x for x in M.compare(base, now).collect()}
    assert {k: x["verdict"] for k, x in v.items()} == {"r1": "regressed", "r2": "improved", "gone": "missing", "new": "added", "edge": "same"} and v["r2"]["relative"] is None


def _slow_vector(text, dimensions):
    """The hashing embedder, feature by feature."""
    out = [0.0] * dimensions
    for w in re.findall(r"\w+", (text or "").lower()):
        marked = f"^{w}$"
        grams = [marked[i : i + 3] for i in range(len(marked) - 2)] if len(w) > 3 else []
        for feature, size in [("w:" + w, 1.0), *[("c:" + g, 0.35) for g in grams]]:
            d = hashlib.blake2b(feature.encode(), digest_size=8).digest()
            out[int.from_bytes(d[:4], "big") % dimensions] += size if d[4] % 2 else -size
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def _slow_semantic(text, dimensions, size):
    """Texts of the chunks: split at gaps above the 95th percentile, then at the widest gap while too large."""
    sents = [text[a:b] for a, b in C.sentence_spans(text)]
    near = [_slow_vector(" ".join(sents[max(0, i - 1) : i + 2]), dimensions) for i in range(len(sents))]
    gap = [round(1.0 - sum(x * y for x, y in zip(a, b)), 9) if any(a) and any(b) else 1.0 for a, b in zip(near, near[1:])]
    limit = sorted(gap)[int(0.95 * (len(gap) - 1))] if gap else 0
    above = sorted(gap)[min(len(gap) - 1, int(0.95 * (len(gap) - 1)) + 1)] if gap else 0
    limit += (above - limit) * (0.95 * (len(gap) - 1) % 1) if gap else 0
    groups = [[]]
    for i, s in enumerate(sents):
        if i and gap[i - 1] > limit:
            groups.append([])
        groups[-1].append(i)

    def split(g):
        if len(g) > 1 and sum(C.approx_count(sents[i]) for i in g) > size:
            cut = max(g[:-1], key=lambda i: (gap[i], -i)) + 1
            return split([i for i in g if i < cut]) + split([i for i in g if i >= cut])
        return [g]

    return [(x[0], x[-1]) for g in groups if g for x in split(g)], sents


def test_semantic_chunks_and_vectors_cover_documents(spark, tmp_path):
    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("zor", "kel", "mip", "dra") for b in ("a", "ita", "ou") for c in ("n", "st", "rk")]
    long = " ".join(" ".join(r.choice(words) for _ in range(r.randint(3, 25))).capitalize() + "." for _ in range(400))
    texts = [PROSE, PROSE, PROSE * 3, long, "One. Two. Three.", "word", "", None, " \n ", "ÉÉ ß. Ünder wörd!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x["doc_id"], x["position"]): x["digest"] for x in core.QUERIES["chunk_semantic"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        spans = C.sentence_spans(t or "")
        for k, (a, b) in enumerate(_slow_semantic(t or "", 64, 256)[0]):
            want[i, k] = hashlib.sha256(t[spans[a][0] : spans[b][1]].encode()).hexdigest()
    assert got == want and sum(i == 3 for i, _ in want) > 20
    vectors = {x["doc_id"]: [float(v) for v in x["vector"].split(",")] for x in core.QUERIES["embed_hash"](spark, str(tmp_path)).collect()}
    assert vectors.keys() == set(range(len(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(vectors[i], _slow_vector(t, 64), atol=2e-6)


def test_hierarchy_counts_each_word_once(spark):
    r = random.Random(5)
    text = " ".join("x" * r.randint(1, 30) for _ in range(600))
    asked = []

    def count(w):
        asked.append(w)
        return C.approx_count(w)

    found = C.hierarchical_spans(text, 90, 25, 7, count)
    assert asked == text.split() and [p for p, _ in found] == greedy(text, 90, 0, C.approx_count)
    for (a, b), kids in found:
        assert [(s - a, e - a) for s, e in kids] == greedy(text[a:b], 25, 7, C.approx_count)
    docs = spark.createDataFrame([("d", text)], "id string, content string")
    plan = C.hierarchical_chunks(docs, 90, 25, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "_t#" not in plan  # no copy of the text beside each chunk


def test_tokens_of_chunks_are_the_native_ones(spark):
    from sieveline.functions.text import TOKEN_COUNTERS

    plain = "".join(chr(c) for c in range(0x20, 0x2060) if c < 0x250 or c > 0x200F)
    odd = ["".join(c if c.isspace() else f"ab{c}cdef " for c in plain), "\x1c a\x1db\x85c\xa0d ", "漢字 １２３ e\u0301e ǅ", "ab.cd ef-gh, ij"]
    docs = spark.createDataFrame([(str(i), (t + " end. ") * 3) for i, t in enumerate(odd)], "id string, content string")
    for counter, native in TOKEN_COUNTERS.items():
        for name, options in (("fixed", {"chunk_size": 20, "overlap": 4}), ("hierarchical", {"parent_size": 60, "chunk_size": 20, "overlap": 4}), ("sentence", {"chunk_size": 20})):
            rows = C.with_chunks(docs, chunkers.create(name, counter=counter, **options), counter=counter, name=name).withColumn("n", native(F.col("content"))).collect()
            assert {r["document_id"] for r in rows} == set("0123") and all(r["token_count"] == r["n"] for r in rows)


def test_windows_of_sentences_are_hashed_once_and_to_the_bit():
    r = random.Random(4)
    parts = [" ".join("".join(r.choices("abcdeéß", k=r.randint(1, 9))) for _ in range(r.randint(0, 12))) for _ in range(50)]
    for buffer in (0, 1, 3):
        model, seen = Hashing(24), []
        known = model._known.__getitem__
        model._known = type("Seen", (), {"__getitem__": lambda _, w: seen.append(w) or known(w), "__len__": lambda _: 0})()
        got = model.windows(parts, buffer)
        assert seen == " ".join(parts).split()
        want = Hashing(24).embed([" ".join(parts[max(0, i - buffer) : i + buffer + 1]) for i in range(len(parts))])
        assert (got == want).all()


def test_dense_memory_and_hits_are_bounded(spark):
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(3)
    vectors = lambda n: pa.array(list(r.normal(size=(n, 64))), pa.list_(pa.float64()))
    block = pa.table({"query_id": np.arange(4096), "vector": vectors(4096)})
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), vectors(10_000)], ["chunk_id", "vector"])
    tracemalloc.start()
    found = list(R._best_of(block, 10, False)(iter([batch])))
    assert tracemalloc.get_traced_memory()[1] < 150e6 and sum(b.num_rows for b in found) == 40_960
    tracemalloc.stop()
    # Copies tie: the least ids count, over batches, products and tasks.
    rows = [(f"v{i:05}", [1.0, float(i % 3)]) for i in range(6000)]
    r.shuffle(rows)
    v = spark.createDataFrame([(str(i), [float(x) for x in e]) for i, e in rows], "chunk_id string, vector array<double>").repartition(2)
    q = v.filter("chunk_id < 'v00007'").withColumnRenamed("chunk_id", "query_id")
    for others in (False, True):
        assert R.nearest(q, v, 4, others).count() <= 7 * 4 * 2
        got = {}
        for x in R.dense(q, v, 4, others=others).orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append(x["chunk_id"])
        for i in range(7):
            like = [f"v{j:05}" for j in range(i % 3, 60, 3) if not (others and j == i)]
            assert got[f"v{i:05}"] == like[:4]


def test_bm25_shuffles_the_hits_once(spark):
    docs = spark.createDataFrame(DOCS, "chunk_id string, text string")
    q = spark.createDataFrame([("q1", "service of authentication"), ("q2", "the text")], "query_id string, text string")
    plan = R.bm25_scores(q, docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\w+, chunk_id#|hashpartitioning\(chunk_id#\w+, dl#", plan)
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in R.bm25_scores(q, docs).collect()}
    want = {(i, c): s for i, t in (("q1", "service of authentication"), ("q2", "the text")) for c, s in okapi(t, DOCS).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_remembered_words_take_little_memory():
    import tracemalloc

    texts = [" ".join(f"{w:08x}" for w in range(k, k + 100)) for k in range(0, 60_000, 100)]
    model = Hashing(64)
    tracemalloc.start()
    for at in range(0, len(texts), 100):
        model.embed(texts[at : at + 100])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 18e6, held
