"""Identifiers, text functions, extraction and the analyzer."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from sieveline.functions import extract, ids, stem, text
from sieveline.operators.chunking import approx_count

NS = uuid.UUID(ids.NAMESPACE_HEX)
TEXTS = ["", "a", "Hello, world! internationalization", "  tab\there \r\n\r\n\r\n\r\n x  ", "ünïcödé 日本語 test", "3.14 e.g. Dr. Who", "a\x0bb\x0cc"]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


def test_identifiers(rows):
    out = rows.select("t", ids.document_id(F.lit("memory"), F.col("t")).alias("d"), ids.checksum(F.col("t"), F.lit("x")).alias("c"), ids.chunk_id(F.lit("D"), F.col("i"), F.col("t")).alias("k"), "i").collect()
    for r in out:
        assert r["d"] == str(uuid.uuid5(NS, f"document:memory:{r['t']}"))
        assert r["k"] == str(uuid.uuid5(NS, f"chunk:D:{r['i']}:{r['t']}"))
        raw = r["t"].encode()
        assert r["c"] == hashlib.sha256(str(len(raw)).encode() + b"\0" + raw + b"1\0x").hexdigest()


def test_checksum_minds_borders(spark):
    r = spark.range(1).select(ids.checksum(F.lit("ab"), F.lit("c")).alias("a"), ids.checksum(F.lit("a"), F.lit("bc")).alias("b")).first()
    assert r["a"] != r["b"]


def test_counters_and_whitespace(rows):
    for r in rows.select("t", text.approx_tokens(F.col("t")).alias("a"), text.whitespace_tokens(F.col("t")).alias("w"), text.normalize_whitespace(F.col("t")).alias("n")).collect():
        assert r["a"] == approx_count(r["t"]) and r["w"] == len(r["t"].split())
        assert r["n"] == extract.squeeze(r["t"])


def test_half_to_even(spark):
    words = ["a" * n for n in range(1, 31)]
    got = spark.createDataFrame([(w,) for w in words], "t string").select(text.approx_tokens(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [max(1, round(len(w) / 4)) if len(w) >= 6 else 1 for w in words]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<title> T </title><p>a</p><p>b&amp;c</p><script>x='</p>'</script>", ("a\nb&c", "T")),
        ("<div>x<br>y<style>z</style></div>", ("x\ny", None)),
        ("plain", ("plain", None)),
    ],
)
def test_html(raw, want):
    assert extract.html_text(raw) == want


def test_json():
    assert extract.json_text('{"name": " N ", "a": {"b": [1, null, "x"]}, "t": true}') == ("name:  N \na.b[0]: 1\na.b[2]: x\nt: True", "N")
    assert extract.json_text("{oops  x") == ("{oops x", None)
    assert extract.json_text('[1, {"title": "no"}]') == ("[0]: 1\n[1].title: no", None)
    assert extract.json_text("7") == ("7", None)


def test_markdown():
    assert extract.markdown_text("\n\n## Head \n\nx")[1] == "Head"
    assert extract.markdown_text("text\n# Late")[1] is None
    assert extract.markdown_text("#\n# Late")[1] is None


def test_one_bad_file_leaves_others(spark):
    df = spark.createDataFrame([("x", "txt"), ("y", "exe"), (None, "txt")], "r string, e string")
    out = df.select(extract.by_extension(F.col("r"), F.col("e")).alias("x")).select("x.*").collect()
    assert out[0]["text"] == "x" and out[0]["error"] is None and "exe" in out[1]["error"] and out[2]["error"]


@pytest.mark.parametrize("word, want", [("running", "run"), ("ponies", "poni"), ("caresses", "caress"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("authentication", "authent"), ("authenticate", "authent"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("happy", "happi"), ("said", "said"), ("bled", "bled"), ("feed", "feed"), ("agreed", "agre"), ("sky", "sky"), ("skies", "sky"), ("controlling", "control"), ("adjustment", "adjust"), ("effective", "effect")])
def test_stems(word, want):
    assert stem.stem(word) == want


def test_english_terms(spark):
    got = spark.createDataFrame([("The services were Authenticating users",), (None,)], "t string").select(stem.english_terms(F.col("t")).alias("x")).collect()
    assert got[0]["x"] == ["servic", "authent", "user"] and got[1]["x"] is None


def test_preview(spark):
    r = spark.createDataFrame([("a\n b  c" * 50,), ("x",)], "t string").select(text.preview(F.col("t"), 20).alias("p")).collect()
    assert len(r[0]["p"]) <= 20 and r[0]["p"].endswith("…") and r[1]["p"] == "x"
