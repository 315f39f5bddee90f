"""Operators 1, 3, 4, 5 and 7."""

import hashlib
import os
import random
import re

import duckdb

from sieveline.llm import html, pii, quality, tokens, urls

from . import helpers as H


def test_token_counts_are_those_of_the_whole_encoder(spark):
    c = tokens.counter(tokens.VOCABULARY)
    for t in [t for _, t in H.texts_of() if t] + ["it's  a\n\n test   ", "don't 123456 ümlaut??  \t x", " ", "\n\n\n", "a  b"]:
        assert c.count(t) == len(c.encode(t)), t
    got = tokens.count_tokens(H.table(spark)).collect()
    assert len(got) == len(H.rows()) and all(r["n_tokens"] == c.count(t) for r, (_, t) in zip(sorted(got, key=lambda r: H.key([r["doc_id"], r["n_tokens"]])), sorted(H.texts_of(), key=lambda x: H.key([x[0], c.count(x[1])]))))


def test_rollup_of_deltas_is_idempotent(spark, tmp_path):
    cols = "op string, source string, lang string, tokenizer_version string, n_tokens long, n_chars long, old_tokens long, old_chars long"
    batch = lambda rows: spark.createDataFrame(rows, cols)
    store = tokens.Rollup(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    first = batch([("insert", "a", "en", "v1", 10, 40, None, None), ("insert", "a", "en", "v1", 5, 20, None, None), ("insert", None, None, "v1", 1, 4, None, None), ("insert", "b", "en", "v2", 3, 9, None, None)])
    assert store.commit("b1", first) and not store.commit("b1", first)
    assert store.commit("b2", batch([("delete", "a", "en", "v1", 5, 20, None, None), ("revise", "a", "en", "v1", 12, 41, 10, 40), ("delete", "b", "en", "v2", 3, 9, None, None)]))
    assert not tokens.Rollup(spark, str(tmp_path / "r")).commit("b2", first)
    got = {tuple(r) for r in store.totals().collect()}
    assert got == {("a", "en", "v1", 1, 12, 41), (None, None, "v1", 1, 1, 4)}


def test_rollup_compacts_and_takes_two_writers(spark, tmp_path):
    cols = "op string, source string, lang string, tokenizer_version string, n_tokens long, n_chars long"
    batch = lambda n, op="insert": spark.createDataFrame([(op, "a", "en", "v", n, n)], cols)
    store, other = (tokens.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    folders = lambda: sorted(os.listdir(tmp_path / "r" / "data"))
    sums = lambda: [tuple(r)[3:] for r in store.totals().collect()]
    assert store.commit("b0", batch(3, "delete")) and sums() == [(-1, -3, -3)]  # the delete came first
    for k in range(1, 5):
        assert store.commit(f"b{k}", batch(k))
    assert sums() == [(3, 7, 7)] and store.compact() and sums() == [(3, 7, 7)] and len(folders()) == 6
    assert not store.commit("b2", batch(2)) and store.commit("b5", batch(10)) and sums() == [(4, 17, 17)]
    assert store.compact() and store.compact() and sums() == [(4, 17, 17)] and not store.commit("b5", batch(10))
    assert store.batches() == {f"b{k}" for k in range(6)}
    # Two writers past the check: the second one's table is not read, and goes.
    n, put = len(folders()), other._put

    def slow(df):
        table = put(df)
        assert store.commit("b6", batch(100))
        return table

    other._put = slow
    assert not other.commit("b6", batch(100)) and sums() == [(5, 117, 117)] and len(folders()) == n + 1
    # So do two compactions.
    other._put = lambda df: (put(df), store.compact())[0]
    assert not other.compact() and sums() == [(5, 117, 117)]


def test_token_query_commits_all_kinds_of_changes(spark, monkeypatch):
    seen, commit = {}, tokens.Rollup.commit

    def counted(self, batch, changes):
        seen.setdefault(batch, {(r["op"], r["count"]) for r in changes.groupBy("op").count().collect()})
        return commit(self, batch, changes)

    monkeypatch.setattr(tokens.Rollup, "commit", counted)
    d = "/root/testdata/sf0.001"
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in tokens.query(spark, d).collect()}
    want = {}
    for r in tokens.count_tokens(spark.read.parquet(f"{d}/documents.parquet")).collect():
        k = r["source"], r["lang"]
        want[k] = tuple(x + y for x, y in zip(want.get(k, (0, 0, 0)), (1, r["n_tokens"], r["n_chars"])))
    assert got == want
    n = sum(v[0] for v in want.values())
    assert set.union(*seen.values()) == {("insert", n), ("revise", n), ("delete", n)}


def test_token_query_on_empty(spark):
    assert tokens.deltas(tokens.count_tokens(H.table(spark, [])).selectExpr("*", "'insert' as op")).count() == 0


def base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    double = lambda s: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(s[::-1])) % 10 == 0
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m.group())) <= 19 and double(digits(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]


PRIVATE = 'Mail a.b@c-d.org, x@y.z@w.net or +1 (555) 010-2030; host 10.0.0.256 and 10.0.0.25.1, card 4111 1111 1111 1111, no 4111111111111112, token = "deadbeefdeadbeefdeadbeefdeadbeef00112233" end.'


def test_pii_base_is_exact_on_random_strings():
    r = random.Random(4)
    for _ in range(4000):
        t = "".join(r.choice("a1.@+- ()25_%9é") for _ in range(r.randint(0, 50)))
        assert pii.base_spans(t) == base(t), t


def test_pii_query(spark):
    data = [*H.rows(), (500, PRIVATE, *H.rows()[0][2:]), (501, "1" * 50_000 + "@" * 1000, *H.rows()[0][2:])]
    got = pii.find(H.table(spark, data)).collect()
    assert len(got) == len(data)
    by = {r["doc_id"]: r for r in got}
    for i, t in H.texts_of(data):
        b = base(t or "") if i != 501 else pii.base_spans(t)
        assert by[i]["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % x for x in b).encode()).hexdigest()
        assert set("%s:%d:%d" % x for x in b) <= set(by[i]["spans"].split(","))
    assert by[500]["n_email"] == 2 and by[500]["n_card"] == 1 and by[500]["n_ip"] == 1 and "secret" in by[500]["spans"]
    assert pii.find(H.table(spark, [])).count() == 0


def test_redaction_keeps_rows_columns_and_other_text(spark):
    data = [*H.rows(), (500, PRIVATE, *H.rows()[0][2:])]
    out = pii.redact(H.table(spark, data))
    assert out.columns == H.table(spark, data).columns and out.count() == len(data)
    text = next(r["text"] for r in out.collect() if r["doc_id"] == 500)
    assert "[EMAIL]" in text and "deadbeef" not in text and text.startswith("Mail ") and text.endswith('" end.')


def test_trees_tell_formats_apart():
    fit, limits = pii.model()
    score = lambda text, part, kind: fit.score(pii.features(text, kind, text.index(part), text.index(part) + len(part))) >= limits[kind]
    assert score("key is token = 9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c end", "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c", "secret")
    assert not score("came on 2021-10-12 to us", "2021-10-12", "phone")


def test_added_spans_on_unseen_examples():
    found = pii.measured()
    assert set(found) == {"secret", "phone", "email", "ip", "iban", "national_id"}
    assert all(precision >= 0.87 and share >= 0.5 for precision, share in found.values()), found
    limits = {k: v for k, v in pii.model()[1].items() if k in found}
    assert len({round(v, 3) for v in limits.values()}) == len(limits) and all(0 < v < 1 for v in limits.values()), limits


def test_generators_propose_and_trees_decide():
    fit, limits = pii.model()
    added = lambda t: [(k, t[s:e]) for k, s, e in pii.spans(t, fit, limits)[1] if (k, s, e) not in pii.base_spans(t)]
    for text, kind, part in (
        ("My SSN is 123-45-6789 ok", "national_id", "123-45-6789"), ("DNI 12345678Z", "national_id", "12345678Z"),
        ("IBAN DE89 3704 0044 0532 0130 00 IS mine", "iban", "DE89 3704 0044 0532 0130 00"), ("address 2001:db8::ff00:42:8329 up", "ip", "2001:db8::ff00:42:8329"),
        ("john at example dot com", "email", "john at example dot com"), ("mail john [at] example [dot] com", "email", "john [at] example [dot] com"),
        ("call 030 1234567 now", "phone", "030 1234567"), ("call 555-123-4567", "phone", "555-123-4567"),
    ):
        assert (kind, part) in added(text), (text, added(text))
    for text in ("order 555-123-4567", "commit 3f2a9c1b7d3f2a9c1b7d3f2a9c1b7d3f2a9c1b7d", "came at 12:30:45 to us", "look at the dot there", "on 2021-10-12", "12345678A", "", "IBAN DE00 3704 0044 0532 0130 00 then 9"):
        assert [x for x in added(text) if x[0] != "phone"] == [] and not (text.startswith(("order", "on ")) and added(text)), (text, added(text))
    # What is inside or across a base span stays out, however many spans lie between.
    text = "token = " + "a1." * 20 + "x@b.co.uk 1.1.1.1 1.1.1.2 1.1.1.3 1.1.1.4 1.1.1.5"
    base, full = pii.spans(text, fit, limits)
    kept = sorted((s, e) for _, s, e in full)
    assert set(base) <= set(full) and all(a[1] <= b[0] for a, b in zip(kept, kept[1:]))
    r = random.Random(2)
    for _ in range(300):
        t = " ".join(r.choice(["a@b.com", "1.2.3.4", "4864330342310537", "+1 (337) 555-7349", "token=9f8e7d6c5b4a3928a", "x", "030 1234567", "DE89370400440532013000", "a at b dot com", "1.2.3.4.5@c.de", "2001:db8::1"]) for _ in range(12)).replace(" ", r.choice((" ", "", ",")))
        base, full = pii.spans(t, fit, limits)
        added_ = [x for x in full if x not in base]
        assert set(base) <= set(full) and not any(x[1] < y[2] and y[1] < x[2] for i, x in enumerate(added_) for y in added_[i + 1 :] + base), t


def test_quality_matches_sql_and_cases(spark):
    data = [*H.rows(), (600, "a b c d e f g h i j\n" * 9, *H.rows()[0][2:]), (601, "### $$$ x " * 30, *H.rows()[0][2:]), (602, "word " * 8_000, *H.rows()[0][2:])]
    docs = H.table(spark, data)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = [tuple(r) for r in quality.quality(docs).select(*cols).collect()]
    assert len(got) == len(data)
    seen = {}
    for i, t in H.texts_of(data):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        ln = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        cov = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
        seen[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ln) - len(set(ln)), len(cov), len(w) < 20 or 100 * len(cov) > 30 * len(w))
    assert all(r[1:7] == seen[r[0]] for r in got)
    assert not any(r[7] for r in got if r[6])
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").filter("doc_id is not null").dropDuplicates(["doc_id"]).toPandas())
    want = sorted(con.sql(quality.sql()).fetchall())
    assert sorted(tuple(r) for r in quality.quality(docs).filter("doc_id is not null").dropDuplicates(["doc_id"]).select(*cols, "n_lines", "stop_kinds").collect()) == want
    assert quality.quality(H.table(spark, [])).count() == 0


def test_quality_of_long_texts(spark):
    long = H.prose(random.Random(6), 50_000)
    data = [(600, long, *H.rows()[0][2:]), (601, "word " * 50_000, *H.rows()[0][2:])]
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_repeat_words"]) for r in quality.quality(H.table(spark, data)).collect()}
    for i, t in H.texts_of(data):
        w, at = t.split(), {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeated = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
        assert got[i] == (50_000, sum(map(len, w)), len(repeated))


def test_quality_plan_has_no_shuffle_or_python(spark):
    plan = quality.quality(H.table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_url_lists_over_time(spark):
    entries = spark.createDataFrame(
        [("bad.org", "block", "add", "2024-02-01"), ("bad.org", "block", "remove", "2024-03-01"), ("bad.org", "block", "add", "2024-04-01"), ("ok.bad.org", "allow", "add", "2024-01-01"), ("bad.org/x", "allow", "add", "2024-01-01"), ("bad.org/x", "block", "add", "2024-01-01"), ("same.net", "block", "add", "2024-01-05"), ("same.net", "block", "remove", "2024-01-05"), ("bad.org", "block", "add", "2024-04-01"), (None, "block", "add", "2024-01-01")],
        "pattern string, verdict string, action string, listed_on string",
    )
    day = lambda d: f"2024-{d} 00:00:00"
    caps = [
        (1, "http://Bad.org/a", day("01-31"), "unlisted"), (2, "http://www.bad.org:80/a", day("02-01"), "block"), (3, "https://u:p@sub.bad.org#q", day("02-29"), "block"), (4, "http://bad.org", day("03-01"), "unlisted"),
        (5, "http://bad.org", day("05-01"), "block"), (6, "http://deep.ok.bad.org/", day("05-01"), "allow"), (7, "http://bad.org/x/y?z", day("05-01"), "allow"), (8, "http://notbad.org/", day("05-01"), "unlisted"),
        (9, None, day("05-01"), "unlisted"), (10, "no url", day("05-01"), "unlisted"), (11, "http://bad.org", None, "unlisted"), (12, "http://same.net", day("02-01"), "unlisted"), (5, "http://bad.org", day("05-01"), "block"),
    ]
    df = spark.createDataFrame([c[:3] for c in caps], "page_id long, url string, fetched_at string").selectExpr("*", "'x' as pattern", "1 as r", "'y' as verdict", "null as html")
    for bound in (0, 100):
        got = [(r["page_id"], r["verdict"]) for r in urls.judge(df, entries, bound).collect()]
        assert sorted(got) == sorted((c[0], c[3]) for c in caps)
    assert urls.judge(df.limit(0), entries).count() == 0
    assert {r["verdict"] for r in urls.judge(df, entries.limit(0)).collect()} == {"unlisted"}


PAGE = """<!doctype html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, the best.</div>
<article><header><h1>A &amp; B</h1></header><p>First <b>para&shy;graph</b>,<br>with&nbsp;more.</p><form><p>Sign up</p></form>
<p>Second one.<div class="ad">Buy the thing and all of it now</div><p>Third &lt;one&gt;<!-- no --> here</article>
<section id="comments"><p>I think the article is good and all that</p></section><aside>side of the page</aside><footer>(c) the site</footer></body></html>"""


def test_url_patterns_of_any_depth(spark):
    path = "/".join(f"s{k}" for k in range(12))
    urls_ = [f"https://a.com/{path}", f"https://a.com/{path}/more", "https://a.com/s0", f"https://b.com/{path}"]
    caps = spark.createDataFrame([(i, u, "2024-05-01") for i, u in enumerate(urls_)], "page_id long, url string, fetched_at string")
    entries = spark.createDataFrame([(f"a.com/{path}", "block", "add", "2024-01-01"), ("a.com", "allow", "add", "2024-01-01")], "pattern string, verdict string, action string, listed_on string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(caps, entries).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "unlisted"}


def test_html_blocks():
    assert html.main_text(PAGE) == "A & B\nFirst para\xadgraph, with more.\nSecond one.\nThird <one> here"
    for x in (None, "", "<", "<p", "</div></p>", "plain words", "<div><div><nav>", "<p>" * 2000, "&#" + "9" * 6000 + ";", "<p a='x", "<!-- x", "<script>y"):
        html.main_text(x)


LONG = "the river and the stone of it was in the garden that is as it is on the way to a house"
NAMES = "Ardo Belim Cavot Denza Elgar Fimur Gontas Hilvar Ipsen Jolka Kerrim Lodvan"


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def link(text):
    return f"<a href='/x'>{text}</a>"


def test_html_rules_decide_without_containers():
    plain = lambda *x: html.main_text(f"<body>{''.join(x)}</body>").split("\n")
    assert plain("<div>", p(LONG, "short", LONG), "</div><div>", p("x"), f"<ul><li>{link('link ' * 20)}</li></ul>", p("y"), "</div>") == [LONG, "short", LONG]
    assert plain(p(link("Home"), "menu", NAMES), "<h1>Title</h1>", p(LONG, "By the author", "near it", LONG), p(link(LONG)), p("imprint")) == ["Title", LONG, "By the author", "near it", LONG]
    assert plain(p("one", "two")) == [""]
    # Nearer to bad than to good, nearer to good than to bad, and as far from both.
    assert plain(p(LONG, "a", "b", "c", link("z"))) == [LONG, "a"]
    assert plain(p(LONG, "a", "b", link("z"))) == [LONG, "a"]


def test_html_rules_decide_inside_an_article():
    art = lambda *x: html.main_text(f"<body>{p(link('nav'))}<article>{''.join(x)}</article>{p(link('more'))}</body>").split("\n")
    assert art("<h1>Title</h1>", p("One short line.")) == ["Title", "One short line."]  # nothing decided: the prior
    assert art(p(LONG, NAMES, "short")) == [LONG, NAMES, "short"]  # names inherit, they don't decide
    assert art(p(LONG, link("Read more"), LONG)) == [LONG, LONG]  # link density
    assert art(p(LONG), p(link(LONG) + " and the rest of it")) == [LONG, LONG + " and the rest of it"]
    assert art(p(LONG, "a", link("b"), link("c"))) == [LONG, "a"]
    found = html.blocks(f"<article>{p(LONG, NAMES, 'x', link('y'))}</article>")
    assert html.labels(found) == [(True, "rules"), (True, "neighbours"), (True, "neighbours"), (False, "rules")]


def test_html_priors_of_boilerplate():
    for tag in ("nav", "aside", "footer", "header", "form", "div class='ad'", "div id=cookie-notice", "section class='user comments'", "div role='navigation'", "div hidden", "div style='display: none'", "dialog", "div class=sidebar"):
        page = f"<body><{tag}>{p(LONG)}</{tag.split()[0]}><div>{p(LONG + ' indeed')}</div></body>"
        assert html.main_text(page) == LONG + " indeed", tag
    for tag in ("form method=post", "div class='sidebar-left'", "div id=header"):  # around the whole page it says nothing
        page = f"<body><{tag}>{p(LONG)}<div class=comments>{p(LONG + ' yes')}</div></{tag.split()[0]}></body>"
        assert html.main_text(page) == LONG, tag
    assert html.main_text(f"<article><header><h1>T</h1></header>{p(LONG)}<div class=ad>{p(LONG)}</div>{p('end')}</article>") == f"T\n{LONG}\nend"
    assert html.main_text("<article><p>a &am<b>p; b</b> &#x41;&#0000000066;&nbsp;c</p></article>") == "a &amp; b AB c"


def simple_text(page):
    """Another implementation for pages whose article is marked: all its blocks, split at tags of blocks."""
    import html as stdlib

    body = re.search(r"(?s)<article>(.*)</article>", page).group(1)
    parts = re.split(r"</?(?:p|h1)>", body)
    return "\n".join(t for x in parts if (t := " ".join(stdlib.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))).split())))


def test_html_query_against_another_implementation(spark):
    d = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = html.query(spark, d).collect()
    assert len(got) == len(pages) and all(r["text"] == simple_text(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)
    why = [w for x in pages.values() for _, w in html.labels(html.blocks(x))]
    assert 3 * why.count("rules") >= len(why) and why.count("neighbours") > 0


def test_html_scan_is_linear():
    import time

    for page in ("<a " * 1_700_000, "<!x" * 1_700_000, "</b>" * 1_250_000, "<b><div>" * 60_000 + "</b>" * 100_000, "<a x='" * 200_000 + ">", '<a x=">" ' * 100_000, "<form>" * 200_000, "<title>" * 200_000 + "x>", "<div>" + "<i>" * 100_000 + "<p></p>" * 100_000, "<a class='" * 100_000 + "<p>"):
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 20, page[:40]


def test_html_table(spark):
    rows = [(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (2, None, None, "c"), (None, "v", "", "c"), (3, "w", "<article><p>" + "the end " * 100_000 + "</p></article>", "c")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and {r["n_chars"] for r in got if r["page_id"] in (2, None)} == {0}
    assert next(r for r in got if r["page_id"] == 3)["n_chars"] == 799_999
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
