import base64
import hashlib
import html as html_lib
import re

import pyarrow.fs
import pytest
from oracle_compare import connect

from plumbline.llm import html_extraction as he
from plumbline.llm import url_filters, warc
from plumbline.llm.common import load
from plumbline.llm.queries import URL_RULES
from plumbline.session import shared_folder

PAGES = "page_id long, url string, html string"
SF_DIR = "/root/testdata/sf0.001"
URLS = ["http://a.Example.NET/en/x", "https://example.net/en/", "http://example.net/en", "http://net/x", "http://net", "http://x.net?/y", "http://m.example.com/de/1#a",
        "http://org/fr/", "http://b.org/fr", "http://xorg/fr/1", "no scheme", None, "", "://", "http://EXAMPLE.com:80/de/", "a://b://c.net/x", "http://x.net/" + "y" * 50000]


def judged_by_hand(url):
    rest = (url or "").partition("://")[2]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_rules(spark, table):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x"), (None, URLS[0], None)]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    out = url_filters.judge(table(rows, PAGES), rules).collect()
    got = sorted((str(r["page_id"]), str(r["url"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in out)
    assert got == sorted((str(i), str(u), h, p, str(r), v) for i, u, _ in rows for h, p, r, v in [judged_by_hand(u)])
    assert url_filters.judge(table([], PAGES), rules).count() == 0
    assert {r["verdict"] for r in url_filters.judge(table(rows, PAGES), rules.limit(0)).collect()} == {"allow"}
    odd = spark.createDataFrame([(None, "/", "block"), ("NET", None, "block"), ("net", "", "allow")], "host string, path string, action string")
    assert {r["verdict"] for r in url_filters.judge(table([(1, "http://a.net", "")], PAGES), odd).collect()} == {"block"}


def warc_rows():
    return [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, "same"), (3, None, "same"), (4, "u\r\nX: y", "<p>é\x00"), (5, "u", None), (6, "u", ""),
            (7, "u", "z" * 3_000_000), (None, "u", "alone"), (None, "u", "same")] + [(100 + i, "http://copy", "copied page") for i in range(300)]


def test_warc_round_trip(table):
    rows = warc_rows()
    out = warc.round_trip(table(rows, PAGES), keep_payload=True).collect()
    assert len(out) == len(rows) and not [r for r in out if r["error"]]
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = last[h or ""] >= 0 and i != last[h or ""]
        expected.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response",
                         str(last[h or ""] if revisit else None), None if revisit else data))
    got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]), r["payload"] and bytes(r["payload"]) or
            (None if r["record_type"] == "revisit" else b"")) for r in out]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert warc.round_trip(table([], PAGES)).count() == 0
    kinds = {r["page_id"]: r["record_type"] for r in warc.round_trip(table(rows[:3], PAGES), min_bytes=5).collect()}
    assert set(kinds.values()) == {"response"}


def test_warc_damage_is_reported(spark, table):
    folder = "file://" + shared_folder(spark, "damage")
    rows = [(i, "u", f"page {i} " + "text " * 50) for i in range(200)]
    names = [r["archive"] for r in warc.write_archives(warc.plan_records(table(rows, PAGES)).coalesce(1), folder, archive_bytes=4000, sample_bytes=3000).collect()]
    assert len(names) > 1
    fs, at = pyarrow.fs.FileSystem.from_uri(names[0])
    with fs.open_input_stream(at, compression=None) as f:
        data = f.read()
    with fs.open_input_stream(at, compression=None) as f:
        first = next(warc.read_frames(f))
    assert warc.parse_record(first)["error"] is None
    assert "length" in warc.parse_record(first[:-5])["error"]
    assert "digest" in warc.parse_record(first.replace(b"page", b"pagE"))["error"]
    with fs.open_output_stream(at, compression=None) as f:
        f.write(data[:-10])
    found = warc.read_archives(spark.createDataFrame([(n,) for n in names], "archive string")).collect()
    assert len([r for r in found if r["error"]]) == 1 and 0 < len([r for r in found if not r["error"]]) < 200


def article_by_hand(page):
    inside = re.search("<article>(.*)</article>", page, re.S)[1]
    parts = (re.sub(r"\s+", " ", html_lib.unescape(re.sub("</?b>|<br>", " " if "<br>" in x else "", re.sub("</?b>", "", x)))).strip()
             for x in re.split("</?(?:p|h1)>", inside))
    return "\n".join(x for x in parts if x)


def test_articles_of_the_table(spark):
    pages = load(spark, SF_DIR, "pages")
    expected = {i: article_by_hand(h) for i, h in connect(SF_DIR).execute("SELECT page_id, html FROM pages").fetchall()}
    out = he.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in out} == expected and all(r["n_chars"] == len(r["text"]) for r in out)


MIXED = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="menu"><a href=x>Home</a></div>
<main><h1>Title &lt;b&gt;</h1><p>First para with <a href=q>link</a> and   text that is long enough to read.<p>Second one<br>after &amp; break, with words.
<div class="share"><p>Share this</p></div><ul><li>point one is here<li>point two is there</ul><script>var a = "<p>no</p>";</script>
<section class="comments"><h3>Comments</h3><p>Great article, I like it very much!</p></section></main><aside><p>Related stuff to read</p></aside>
<form><label>Mail</label><input></form><div id="cookie-notice">We use cookies</div><footer>&copy; x</footer>"""


def test_parts_that_are_not_the_article(spark, table):
    rows = [(1, "u", MIXED), (2, "u", None), (3, "u", ""), (4, "u", "<p"), (5, None, "<article><p>" + "word " * 40000), (1, "u", MIXED), (6, "u", "<div>" * 3000 + "deep"),
            (7, "u", '<article><p title="' + "x" * 20000)]
    out = he.extract(table(rows, PAGES), load(spark, SF_DIR, "pages")).collect()
    text = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows)
    assert text[1] == ("Title <b>\nFirst para with link and text that is long enough to read.\nSecond one after & break, with words.\n"
                       "point one is here\npoint two is there")
    assert text[2] == text[3] == "" and len(text[5]) == 5 * 40000 - 1
    assert he.extract(table([], PAGES)).count() == 0
    assert he.extract(table(rows, PAGES), table([], PAGES)).count() == len(rows)


@pytest.mark.parametrize("tag", ['<img src="data:image/png;base64,{}">', "<img data-x='{{\"a\": \"{}>\"}}' alt=\"b > c\">", "<a title=it's {}>five</a>",
                                 '<img alt="{}" src=x" y>', "<img srcset = '{}'/>"])
def test_long_attribute_values_are_one_tag(tag):
    """Nothing after a value of 100 KB is swallowed and nothing of the value is text."""
    page = he.parse("<article><p>one</p>" + tag.format("QUJD" * 25000) + '<p>don\'t <a href="y">two</a></p><p>a "three"</p></article><p>four</p>')
    assert [run for _, _, run in page.runs if run != "five"] == ["one", "don't ", "two", 'a "three"', "four"]
    assert [t for t in page.tag if t not in ("img", "a")] == ["#root", "article", "p", "p", "p", "p"]


def test_odd_quotes():
    page = he.parse('<p a=\'x>one</p><p a="x>two <b>three</b>')
    assert [run for _, _, run in page.runs] == ["one", "two ", "three"]
    assert he.parse('<p title="class=ad" data-id=menu href=?id=menu CLASS=x id = \'y\'>').words[1] == ("x", "y")


ARTICLE = """<article><h1>Law</h1><p>The law of the land is a long story about many people.</p>{}<p>A last paragraph closes the matter.</p></article>"""
NAMED = [('<h2 id="legal-history">History</h2>', "History"), ('<h2 id="Social_structure">Ranks</h2>', "Ranks"), ('<h3 id="comments">Remarks</h3>', "Remarks"),
         ('<p class="form-intro">How to read on</p>', "How to read on"), ('<p class="notice">Take note</p>', "Take note"),
         ('<section id="legal-notice"><h2>Rights</h2><p>All of them</p></section>', "Rights\nAll of them"), ('<table><tr><td class="header">cell</td></tr></table>', "cell"),
         ('<p>E = <math><mi>m</mi><msup>c2</msup><annotation>mc^2</annotation></math></p>', "E = mc2"), ("<p>x <svg><title>t</title><text>axis</text></svg></p>", "x axis"),
         ("<p><object>fallback</object> <noscript><b>plain</b></noscript></p>", "fallback plain"),
         ('<div class="share"><p>Share this</p></div>', ""), ('<section class="comments"><p>Great article, I like it very much!</p></section>', ""),
         ('<ul class="related"><li><a href=x>Other article</a><li><a href=y>One more</a></ul>', "")]


def test_names_of_parts_are_whole_and_of_containers(spark, table):
    rows = [(i, "u", ARTICLE.format(part)) for i, (part, _) in enumerate(NAMED)]
    text = {r["page_id"]: r["text"] for r in he.extract(table(rows, PAGES), load(spark, SF_DIR, "pages")).collect()}
    for i, (part, expected) in enumerate(NAMED):
        assert text[i].split("\n")[2:-1] == [x for x in expected.split("\n") if x], part


def test_names_are_learned(table):
    """A name of an aside part that holds the article on the labelled pages is no reason against it."""
    page = ARTICLE.format("").replace("<article>", '<article><div class="header">').replace("</article>", "</div></article>")
    out = he.extract(table([(i, "u", page) for i in range(60)], PAGES)).collect()
    assert {r["text"] for r in out} == {"Law\nThe law of the land is a long story about many people.\nA last paragraph closes the matter."}


def test_messages_give_the_exact_marginals():
    """Against the sum over all states of a small tree."""
    from itertools import product

    import numpy as np

    page = he.parse("<div class='ad'><p>one</p><a>two three</a></div><article><p>four</p></article>")
    model = he.Model({"step|p|1|1": 30, "step|div|0|0": 9, "all|0": 50, "all|1": 40, "len|p|1|1": 22, "len|p|1|0": 2, "len|p|2|0": 20})
    found, kinds = he.evidence(page), he.kinds(page)
    total, content = 0.0, np.zeros(len(page.tag))
    for states in product((0, 1), repeat=len(page.tag)):
        log = np.log([0.999, 0.001])[states[0]] + sum(model.weight(f)[states[i]] for i, fs in enumerate(found) for f in fs)
        log += sum(model.step(kinds[i])[states[page.parent[i]], states[i]] for i in range(1, len(page.tag)))
        total += np.exp(log)
        content += np.exp(log) * np.array(states)
    assert np.allclose(he.marginals([page], model)[0], content / total)
    assert pytest.approx(content[0] / total, abs=1) == 0


def test_url_rules_without_a_leading_slash(spark, table):
    rules = spark.createDataFrame([("example.net", "en", "block"), ("x.org", None, "block"), ("y.org", "/a", "block")], "host string, path string, action string")
    urls = ["http://example.net/en/a", "http://a.example.neten/x", "http://example.neten", "http://a.x.org/en", "http://y.org/ab", "http://y.org/b", "http://y.org" + "/a" * 50_000]
    out = url_filters.judge(table([(i, u, "") for i, u in enumerate(urls)], PAGES), rules)
    assert {r["page_id"]: r["rule"] for r in out.collect()} == {0: None, 1: None, 2: None, 3: "x.org", 4: "y.org/a", 5: None, 6: "y.org/a"}
