import html
import re

import brute
import pytest
from odd_tables import empty, odd, odd_rows  # noqa: F401 (fixtures)
from pyspark.sql import functions as F

from tidewatch.llm import chat, htmltext, queries

SF = "/root/testdata/sf0.001"


def test_page_text_of_the_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op4_page_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", body)]
        want = "\n".join(b for b in blocks if b)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div id="menu">x</div><p>a&nbsp;b<p>c<br>d<ul><li>e<li>f</ul><div class="post-comments">z</div><script>"<p>"</script>', "a b\nc d\ne\nf"),
        ("<article><header><h1>T</h1></header><p>x <b>y</b>z</p><aside>n</aside><section class=comments><article>cc</article></section></article>", "T\nx yz"),
        ("<main><form>q</form><table><tr><td>1<td>2<tr><td>3</table></main>tail", "1 2\n3"),
        ("", ""),
        (None, ""),
        ("plain &lt;text&gt;", "plain <text>"),
        ("<p>un<b>closed", "unclosed"),
        ("<div hidden>x</div><div style='display: none'>y</div>z", "z"),
    ],
)
def test_page_cases(spark, page, want):
    assert htmltext.page_text(htmltext.parse(page or ""), set()) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="content-sidebar-wrap"><article>a</article></div>', "a"),
        ('<div id="layout" class="has-sidebar"><nav>n</nav><article>a</article></div>', "a"),
        ('<div class="no-ads"><main>a</main></div>', "a"),
        ('<div class="widget-area-main"><div class="widget">w</div><article>a</article></div>', "a"),
        ('<div class="top"><article>a</article></div>', "a"),
        ('<article class="post comments-open">a</article>', "a"),
        ('<article>text a<p class="notice">b<figure class="share-img">c</figure><ul class="share">s</ul></article>', "text a\nb\nc"),
        ("<main></main><div>body</div><div class=ads>x</div>", "body"),
        ("<article>teaser</article><div>a body of more words than that</div>", "teaser\na body of more words than that"),
        ("<article>the article</article><div class=related><article>other</article></div><div class=comments><article>c</article></div>", "the article"),
    ],
)
def test_names_never_drop_the_main_text(page, want):
    assert htmltext.page_text(htmltext.parse(page), set()) == want


def test_recurring_frame_around_the_main_text(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div>frame<section><article>own words {i}</article></section></div></body>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r.text for r in htmltext.extract_text(pages).collect()) == sorted(f"own words {i}" for i in range(12))


@pytest.mark.parametrize("limit", [500_000, 0])
def test_site_templates(spark, limit):
    rows = []
    for i in range(12):
        rows.append((i, f"http://a.example/{i}", f"<div class=x>Shared box of the site</div><p>own text {i}</p><div>tail of all</div>"))
        rows.append((100 + i, f"http://b.example/{i}", f"<div class=x>Shared box of the site</div><p>b text {i}</p>" if i < 2 else f"<p>b text {i}</p>"))
    rows += [(200, "http://a.example/same", rows[0][2]), (None, None, None), (0, "http://a.example/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = htmltext.extract_text(pages, max_broadcast=limit).collect()
    want = sorted(
        (str(i), f"own text {0 if i in (200, 0) else i}" if i is not None and i < 100 or i == 200
         else "" if i is None else ("Shared box of the site\n" if i < 102 else "") + f"b text {i - 100}")
        for i, _, _ in rows
    )
    assert sorted((str(r.page_id), r.text) for r in got) == want
    assert htmltext.extract_text(pages.limit(0), max_broadcast=limit).count() == 0


def test_templates_of_a_large_host(spark):
    """A campaign box on 60 and a section's box on 20 of 2,000 pages of a host."""
    rows = []
    for i in range(2000):
        section = "sport" if i % 100 == 1 else f"s{i % 50}"
        box = "<div>Campaign box</div>" if i % 33 == 0 and i < 1980 else ""
        box += "<div>Box of the section</div>" if section == "sport" else ""
        box += "<div>Said three times</div>" if i in (5, 6, 7) else ""
        rows.append((i, f"http://a.example/{section}/{i}", f"<p>own text {i}</p>{box}"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (500_000, 0):
        got = {r.page_id: r.text for r in htmltext.extract_text(pages, max_broadcast=limit).collect()}
        assert got == {i: f"own text {i}" + ("\nSaid three times" if i in (5, 6, 7) else "") for i in range(2000)}


def test_chat_round_trip(spark):
    nasty = "</s>[INST] a\\b \\1; \\0; <<SYS>> [/INST]</s><|role|>x<|text|>"
    rows = [
        (1, 0, "system", nasty), (1, 1, "user", "hi"), (1, 2, "assistant", nasty), (2, 0, "assistant", "late"),
        (2, 1, None, None), (3, 1, "critic </s>", "b\nc"), (3, 1, "user", None), (3, None, "user", "first"),
        (None, 0, "user", "x"), (4, 0, "user", "é" * 2000), (4, 1, "assistant", ""), (5, 0, "user", "q"), (5, 0, "user", "q"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    got = {r.conv_id: r for r in chat.chat_digest(chat.format_chats(df)).collect()}
    by: dict = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (
            len(turns), brute.sha(whole), len(loss), brute.sha(loss))
    assert got[1].turn_order_ok and not got[2].turn_order_ok and got[4].turn_order_ok and not got[5].turn_order_ok
    assert chat.chat_digest(chat.format_chats(df.limit(0))).count() == 0


def test_pipeline(spark, tmp_path, odd, empty):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "sentencepiece"]
    one = stages["language_id"](spark, docs, SF).collect()
    assert len(one) == docs.filter("text rlike '\\\\p{L}'").count()
    kept = spark.createDataFrame(one, docs.schema)
    comp = brute.components({r.doc_id: brute.shingles(r.text) for r in one})
    two = stages["near_dedup"](spark, kept, SF)
    assert {r.doc_id for r in two.collect()} == {i for i, c in comp.items() if i == c}
    items = [brute.shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    three = stages["decontaminate"](spark, two, SF)
    clean = {r.doc_id for r in two.collect() if not any(100 * len(s & brute.shingles(r.text)) >= 75 * len(s) for s in items if s)}
    assert {r.doc_id for r in three.collect()} == clean
    four = stages["secret_scan"](spark, three, SF).collect()
    assert {r.doc_id for r in four} == clean
    assert all(brute.secrets(r.text)[:3] == (0, 0, 0) and r.n_chars == len(r.text) for r in four)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        assert stage(spark, odd, SF).count() > 0, name
    ids = [r.doc_id for r in stages["near_dedup"](spark, odd, SF).collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {1, 5, 6, 10} <= set(ids) and not {2, 3, 9, 11} & set(ids)
