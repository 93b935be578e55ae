"""Operators on pages, conversations and tables, and the pipeline, against brute force."""

import gzip
import hashlib
import html
import os
import random
import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weightscope.llm import chat, html_extract, pii, queries, sharding, warc

DATA = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies, yes, really, on this site, always.</div>
<div id="sidebar"><p>Something, about, other, things that is long enough to count here.</p></div>
{main}
<div class="comments"><p>First, what a post, really, I like it a lot, do you?</p></div><form><p>Sign up, now, please, for all the news there is.</p></form><footer>&copy; Me</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p>First,&nbsp;paragraph \n with <b>bold</b> and <a href='x'>a link</a>, and more, to be long enough.<p>Second<br>one, unclosed, with some more words in it, really.<ul><li>item one</ul>"
TEXT = "Head & line\n\nFirst, paragraph with bold and a link, and more, to be long enough.\n\nSecond one, unclosed, with some more words in it, really.\n\nitem one"


@pytest.mark.parametrize("main", ["<article>{}</article>", "<main><div>{}</div></main>", '<div class="content"><div>{}</div></div>', "<div>{}</div>", "<section><article><div><b>{}</div></article></section>"])
def test_articles(main):
    assert html_extract.main_text(PAGE.format(main=main.format(BODY))) == TEXT


LONG = "<p>" + "some words, of a text, that goes on, " * 8 + "</p>"
LONG_TEXT = ("some words, of a text, that goes on, " * 8).strip()


@pytest.mark.parametrize("n", [3, 8])
def test_titles_stay(n):
    page = f"<article><header><h1>T</h1></header><div class='entry-content'>{LONG * n}</div></article>"
    assert html_extract.main_text(page) == "\n\n".join(["T"] + [LONG_TEXT] * n)


def test_siblings_stay():
    links = "<ul>" + "<li><a href='/x'>Another page here</a></li>" * 9 + "</ul>"
    page = f"<body><nav>N</nav><h1><a href='/'>T</a></h1><div><section>{LONG * 6}</section><h2>H</h2><p>Short.</p><ul><li>item</ul><blockquote>Q</blockquote>loose <b>text</b><table><tr><td>cell</table><section><p>End.</p></section>{links}</div><footer>F</footer>"
    assert html_extract.main_text(page) == "\n\n".join(["T", *[LONG_TEXT] * 6, "H", "Short.", "item", "Q", "loose text", "cell", "End."])


def test_odd_pages(spark):
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""
    assert html_extract.main_text("plain &lt;text&gt;") == "plain <text>"
    assert html_extract.main_text("<article><p>cut off <b") == "cut off <b"
    assert html_extract.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(html_extract.main_text("<article><p>" + "word " * 100_000 + "</article>")) == 499_999
    rows = [(1, "u", PAGE.format(main=f"<article>{BODY}</article>"), "x"), (1, "u", PAGE.format(main=f"<article>{BODY}</article>"), "x"), (None, None, None, "y")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == [("1", TEXT, len(TEXT))] * 2 + [("None", "", 0)]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("words", ["share-price", "side-effects", "related-work", "social-notes", "reply-time"])
def test_classes_that_say_something_else(words):
    block = f"<div class='{words}'><p>Said here.</p></div>"
    assert html_extract.main_text(f"<article><h1>T</h1>{LONG * 4}{block}</article>").endswith("Said here.")
    assert html_extract.main_text(f"<div class='content'><h1>T</h1>{LONG * 4}{block}</div>").endswith("Said here.")


@pytest.mark.parametrize("words", ["comments", "comment-list", "share-buttons", "related-posts", "social share", "newsletter-signup", "sidebar left", "adSlot", "x cookie-notice"])
def test_boilerplate_in_articles(words):
    block = f"<div class='{words}'><p>Said here, at some length, with commas, for points, too.</p></div>"
    for page in (f"<article>{LONG * 4}{block}</article>", f"<div class='content'>{LONG * 4}{block}</div>", f"<div>{LONG * 4}</div>{block}"):
        assert html_extract.main_text(page) == "\n\n".join([LONG_TEXT] * 4)


def test_content_beside_the_container():
    page = f"<body><nav>N</nav><h1>Head</h1><p>Lead.</p><div class='content'>{LONG * 5}</div><p>Tail.</p><footer>F</footer></body>"
    assert html_extract.main_text(page) == "\n\n".join(["Head", "Lead.", *[LONG_TEXT] * 5, "Tail."])


def test_formulas_and_pictures():
    page = "<article><p>Let <math><mi>x</mi><annotation>TeX</annotation></math> be, <svg><svg><text>a</text></svg><text>b</text></svg>in this.</article>"
    assert html_extract.main_text(page) == "Let x be, in this."


BAD_PAGES = {
    "open tags": "<a " * 330_000, "open quotes": '<a b="' * 160_000, "other quotes": "<a b='\"" * 120_000 + ">", "lone quote": "<a " * 330_000 + '"', "ends of others": "<b>x" * 100_000 + "</i>" * 100_000,
    "ends out of scope": "<i><div>" + "<b>x" * 100_000 + "</i>" * 100_000, "blocks in inline": "<b>x" * 100_000 + "<div></div>" * 50_000, "deep": "<div>" * 100_000 + "x", "comments": "<!--" * 200_000, "blanks": "<a" + " " * 900_000 + ">x",
    "attributes": "<a" + " x" * 400_000 + ">x", "links": "<p><a href='x'>y</a>" * 40_000, "raw": "<style>" * 100_000, "no end": "<style></styl" * 70_000, "lists": "<ul><li>" * 80_000,
}


@pytest.mark.parametrize("name", BAD_PAGES)
def test_bad_pages_take_linear_time(name):
    begin = time.monotonic()
    html_extract.main_text(BAD_PAGES[name])
    assert time.monotonic() - begin < 6  # about one second here; quadratic ones took minutes


class Article(HTMLParser):
    """Another way to the text of pages that have one article element, without boilerplate in it."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks += [""] * (tag in html_extract.BLOCKS)
        self.blocks[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.blocks += [""] * (tag in html_extract.BLOCKS)

    def handle_data(self, data):
        self.blocks[-1] += data * (self.inside > 0)

    @classmethod
    def text(cls, page):
        parser = cls()
        parser.feed(page)
        parser.close()
        return "\n\n".join(t for b in parser.blocks if (t := " ".join(b.split())))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_pages_of_the_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.QUERIES["op3_html_extract"](spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        want = Article.text(pages[r["page_id"]]["html"] or "")
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


@given(st.lists(st.tuples(st.sampled_from(["p", "h2", "li", "blockquote", "td", "pre"]), st.text(st.sampled_from("ab ,.&<é\n"), min_size=1, max_size=40)), min_size=1, max_size=8), st.sampled_from(["<article>{}</article>", "<main><div>{}</div></main>", "<body><div><section>{}</section></div></body>"]))
@settings(max_examples=150, deadline=None)
def test_made_pages(blocks, frame):
    body = "".join(f"<{t}>{html.escape(x)}</{t}>" for t, x in blocks)
    menu = "<nav><ul>" + "<li><a href='/x'>Menu</a></li>" * 3 + "</ul></nav>"
    want = "\n\n".join(t for _, x in blocks if (t := " ".join(x.split())))
    assert html_extract.main_text(menu + frame.format(body) + "<footer>F</footer>") == want


@given(st.text(st.sampled_from("<>/pa b\"'=!-&;"), max_size=80))
@settings(max_examples=200, deadline=None)
def test_no_page_breaks_the_parser(source):
    assert isinstance(html_extract.main_text(source), str)


def brute_shards(rows, limit):
    """Split buckets bit by bit; rows: (doc_id, bytes)."""
    bits = lambda d: f"{int(hashlib.md5(('' if d is None else str(d)).encode()).hexdigest()[:15], 16):060b}"
    out, todo = [], [("", [(d, n, bits(d)) for d, n in rows])]
    while todo:
        prefix, own = todo.pop()
        if sum(n for _, n, _ in own) <= limit or len(own) <= 1:
            out += [(str(d), n, prefix, len(prefix), sum(x for _, x, _ in own), len(own)) for d, n, _ in own]
        else:
            todo += [(prefix + b, [r for r in own if r[2][len(prefix)] == b]) for b in "01"]
    return sorted(out)


def test_shards(spark):
    rng = random.Random(5)
    rows = [(i, "é" * rng.randrange(60)) for i in range(300)] + [(1000, "x" * 900), (1001, None), (None, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("doc_bytes", "shard", "depth", "shard_bytes", "shard_rows")
    for limit in (10**6, 700, 90):
        got = sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in sharding.shard_documents(docs, limit).collect())
        assert got == brute_shards([(d, len((t or "").encode())) for d, t in rows], limit)


def test_shards_of_a_hot_key(spark, tmp_path):
    docs = spark.createDataFrame([(7, "same text")] * 60 + [(7, f"other {i}") for i in range(20)], "doc_id long, text string")
    got = sharding.shard_documents(docs, 100)
    assert got.count() == 80 and got.where("shard_bytes > 100").count() == 0
    path = sharding.write_shards(docs.withColumnRenamed("x", "y"), f"file://{tmp_path}/s", 200)
    back = spark.read.parquet(path)
    assert back.count() == 80 and back.groupBy("shard").agg({"text": "count"}).count() > 3
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    names = ["_h", "_bytes", "_key", "depth", "shard_bytes", "c0", "_shard0"]
    path = sharding.write_shards(docs.select("*", *[F.lit(n).alias(n) for n in names], F.lit("x").alias("shard")), f"file://{tmp_path}/t", 200)
    back = spark.read.parquet(path)
    assert back.count() == 80 and all(r[n] == n for r in back.collect() for n in names)
    assert all(r["b"] <= 200 for r in back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).collect())


def luhn(digits):
    return sum(int(x) if i % 2 == 0 else 2 * int(x) - 9 * (int(x) > 4) for i, x in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    found = [(m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0])]
    return [f"{n}:{s}:{e}" for s, _, e, n in sorted(found)]


def personal_texts():
    rng = random.Random(11)
    parts = ["a@b.co", "x.y+z@mail-1.example.org", "@", "a@b", "a@b.c@d.e", "10.0.0.255", "1.2.3.256", "1.2.3.4.5", "000.01.2.3", "4539 1488 0343 6467", "4539-1488-0343-6467", "4539148803436468", "1 2 3", "+49 (30) 123456", "+1", "+123456789", "++4912345678.", "é€", " ", "\n", "-", "word", "12", ".", "_"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(250)] + [None, "", "9" * 30_000, "a" * 30_000 + "@", "1." * 10_000, "a.b@" + "c." * 10_000 + "d"]


def test_personal_data(spark):
    texts = personal_texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.summary(pii.detect(docs)).collect():
        want = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(r["spans"].split(",")) | {""}
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weak_supervision(spark):
    """Labelers are weighed without labels: secrets are found, versions and dates are left alone."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        h = "".join(rng.choices("0123456789" + "abcdef" * 4, k=40))  # few digits in a row, lest they make a card number
        rows.append((i, f'noise token = "{h}" more' if i % 3 == 0 else f"see version 2021-03-{i % 28 + 1:02d} of page12345 and commit 12345678", i % 3 == 0))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = pii.fit(pii.extract(docs))
    assert model.accuracies["context"] > 0.8
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.detect(docs, model).collect()}
    assert all(got[i] == (["secret"] if secret else []) for i, _, secret in rows)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert clean[0] == 'noise token = "[SECRET]" more' and clean[1] == rows[1][1]


def test_names_addresses_and_accounts(spark):
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choices("the of word lower text here and more".split(), k=12))
    finds = ["contact Anna Schmidt", "Dear Dr. Peter Miller", "address: 12 Old Mill Road", "wohnhaft Hauptstraße 5", "IBAN GB82 WEST 1234 5698 7654 32", "account DE89370400440532013000"]
    leaves = ["Next Chapter", "Paris. Then", "page 12 of Things", "Table Four"]
    rows = [(i, f"{filler()} {(finds + leaves)[i % 10]} {filler()}") for i in range(300)]
    got = {r["doc_id"]: [(s["kind"], rows[r["doc_id"]][1][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = [("person", "Anna Schmidt"), ("person", "Dear Dr. Peter Miller"), ("address", "12 Old Mill Road"), ("address", "Hauptstraße 5"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000")]
    for i in range(10):
        assert got[i] == ([want[i]] if i < 6 else []), rows[i][1]


def test_clashing_columns(spark):
    names = ["_text", "_base", "_cand", "_candidate", "_email", "_ip", "_card", "_phone", "_spans", "spans", "c0", "c1"]
    docs = spark.createDataFrame([(1, "mail a@b.co", *names)], ["doc_id", "text", *names])
    found = pii.detect(docs)
    assert found.columns == [c for c in docs.columns if c != "spans"] + ["spans"]
    assert [found.first()[c] for c in names if c != "spans"] == [c for c in names if c != "spans"]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and list(clean.first()) == [1, "mail [EMAIL]", *names]


def test_redaction(spark):
    rows = [(1, "é mail a@b.co, ip 10.0.0.1!"), (2, None), (3, "nothing")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "é mail [EMAIL], ip [IP]!", 2: None, 3: "nothing"}


CONTROL = st.text(st.sampled_from("<|\\\na>im_end"), max_size=30)


@given(st.lists(st.tuples(CONTROL, CONTROL), max_size=6))
@settings(max_examples=150, deadline=None)
def test_markup_round_trip(turns):
    messages = [{"role": r, "content": c} for r, c in turns]
    text = chat.chat_markup(messages)
    assert chat.read_markup(text) == messages
    made = chat.render_incrementally(chat.chat_markup, messages)
    assert made.text == text and not made.rewrites
    assert [chat.unescape(text[a:b]) for a, b in made.contents] == [c for _, c in turns]
    assert "".join(text[a:b] for a, b in made.spans) == text


def test_rewriting_templates():
    last_only = lambda ms: "".join(f"[{m['role']}]{m['content'] if i == len(ms) - 1 else '...'}\n" for i, m in enumerate(ms))
    many = [{"role": "user", "content": f"turn {i} <b>"} for i in range(100)]
    assert chat.render_incrementally(last_only, many[:3]).rewrites and chat.render_incrementally(last_only, many).rewrites
    with_end = lambda ms: chat.chat_markup(ms) + "<eos>"
    assert chat.render_incrementally(with_end, many[:3]).rewrites
    numbered = lambda ms: "".join(f"{i}:{m['content']};" for i, m in enumerate(ms))
    made = chat.render_incrementally(numbered, many)  # windows can't show the right numbers: the whole prefixes do
    assert not made.rewrites and [made.text[a:b] for a, b in made.contents] == [m["content"] for m in many]


def test_a_template_that_changes_at_one_length():
    at_70 = lambda ms: chat.chat_markup(ms) + "<eos>" * (len(ms) == 70)
    turns = [{"role": "user", "content": f"turn {i}"} for i in range(100)]
    assert chat.render_incrementally(at_70, turns).rewrites and not chat.render_incrementally(at_70, turns[:69]).rewrites


def test_contents_that_are_changed():
    turns = [{"role": "user", "content": " a b "}, {"role": "x", "content": ""}, {"role": "y", "content": "\ue000\ue001"}]
    made = chat.render_incrementally(lambda ms: "".join(f"[{m['content'].strip()}|{m['content'].strip()}]" for m in ms), turns)
    assert not made.rewrites and [made.text[a:b] for a, b in made.spans] == ["[a b|a b]", "[|]", "[\ue000\ue001|\ue000\ue001]"]
    made = chat.render_incrementally(chat.chat_markup, turns, context=1)
    assert made == chat.render_incrementally(chat.chat_markup, turns) and [made.text[a:b] for a, b in made.contents] == [m["content"] for m in turns]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", None), (None, 5, None, "x"), (1, 1, "assistant", "b"), (3, None, "a\nb\\n<|", chat.PROBE)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest("user\na\nassistant\nb\nassistant\nb\n") and got[1]["loss_sha256"] == digest("bb") and got[1]["n_turns"] == 3
    assert got[2]["loss_chars"] == 0 and got[None]["turns_sha256"] == digest("\nx\n") and got[3]["turns_sha256"] == digest(f"a\nb\\n<|\n{chat.PROBE}\n")
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    big, small = "p\r\n\r\nWARC/1.1\r\né" * 90, "s"
    rows = [(1, "http://a/x\r\ny", big), (5, "http://a/2", big), (3, None, big), (2, "u", small), (4, "u", small), (None, "u", None), (None, "n", big), (9, "q", "z" * 1000), (9, "q", "z" * 1000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, type string")
    path = warc.write_archives(pages, f"file://{tmp_path}/w")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("w/part*"))
    assert len(list(warc.records(raw))) == 3 * len(rows) and raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    found = warc.read_archives(spark, path, payloads=True)
    payloads = [bytes(r["payload"]).decode() for r in found.where("type = 'response'").collect()]
    assert sorted(payloads) == sorted([big, small, small, "", "z" * 1000, "z" * 1000])
    captures = warc.assemble(found).collect()
    assert len(captures) == len(rows) and all(len(c["requests"]) == len(c["metadata"]) == 1 for c in captures)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        to = 5 if h == big and p != 5 else None
        want.append((str(p), len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=lambda x: x[:4])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_records_that_are_cut_off():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len(list(warc.records(one + one[:-6]))) == 1 and warc.inflate(gzip.compress(one) + gzip.compress(one)) == one * 2


def one_record(length="3", body=b"abc", more=b""):
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\n" + more + f"Content-Length: {length}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("length", ["-30", "abc", "", "99", "1e3", "²", "9" * 30])
def test_lengths_that_are_none(length):
    got = list(warc.records(one_record() + one_record(length) + one_record(), errors=True))
    assert [r["type"] for r in got] == ["response", "error"] and got[1]["error"] and got[0]["payload_bytes"] == 3


def test_damaged_archives(spark, tmp_path):
    rng, text = random.Random(6), one_record() * 50
    packed = gzip.compress(text) + gzip.compress(one_record())
    assert len(list(warc.records(packed, errors=True))) == 51
    for _ in range(300):
        bad = bytearray(packed[: rng.randrange(len(packed))] if rng.random() < 0.5 else rng.choice((packed, text)))
        for _ in range(rng.randrange(4) if bad else 0):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        assert all(r["type"] == "error" or r["error"] is None for r in warc.records(bytes(bad), errors=True))
    assert len(list(warc.records(b"x" * (3 << 20) + b"\r\n\r\n", errors=True))) == 1
    big = one_record(str(5 << 20), b"y" * (5 << 20), b"WARC-Concurrent-To: <b>\r\nwarc-concurrent-to: <c>\r\n")
    assert [(r["payload_bytes"], r["concurrent_to"]) for r in warc.records(gzip.compress(big) + b"trailing")] == [(5 << 20, ["<b>", "<c>"])]
    (tmp_path / "a.warc.gz").write_bytes(packed[:-20])
    (tmp_path / "b.warc").write_bytes(text)
    (tmp_path / "c.warc").write_bytes(b"")
    got = {r["type"]: r["count"] for r in warc.read_archives(spark, f"file://{tmp_path}").groupBy("type").count().collect()}
    assert got["error"] == 1 and got["response"] >= 100


def test_links_between_records(spark):
    row = lambda i, t, *c: (i, t, [x for x in c if x], None, None, None, None, 0, None, None, None, None)
    rows = [row("r1", "response", None), row("q1", "request", "r1"), row("m1", "metadata", "q1"), row("r2", "response", "q2"), row("q2", "request", None), row("m2", "metadata", "gone"), row(None, "request", "r1"), row("r3", "response", "q3", "m3"), row("q3", "request"), row("m3", "metadata"), row("m4", "metadata", "gone", "r3"), row(None, "error")]
    got = {r["record_id"]: (len(r["requests"]), len(r["metadata"])) for r in warc.assemble(spark.createDataFrame(rows, warc._RECORD_SQL)).collect()}
    assert got == {"r1": (1, 1), "r2": (1, 0), "r3": (1, 2)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(n))
    item = prose(15)
    base = prose(200)
    # The prose is no English, so its language is left open.
    rows = [(0, base, None), (1, base, None), (2, base + " end", None), (3, "too short", "en"), (4, item + " " + prose(60), None), (5, prose(150) + " mail a@b.co", None), (6, "the the " * 200, "en"), (None, None, None)]
    docs = spark.createDataFrame([(d, t, g, "s", len(t or "")) for d, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: bytes(r["decoded"]).decode() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {0: base, 5: rows[5][1].replace("a@b.co", "[EMAIL]")}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "personal data", "byte-level BPE"]


def test_pipeline_with_odd_tables(spark, tmp_path):
    """Columns named as any operator's own pass through every stage, null ids and texts too; an empty table gives one."""
    import corpus_pipeline

    names = ["quality", "_quality", "leak", "_leak", "spans", "_spans", "_text", "_base", "_cand", "fp", "key", "root", "least", "n", "_n", "_key", "c0", "c9", "hits", "shard", "text_"]
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(n))
    texts = [prose(200), prose(150), None, "", prose(180) + " ip 10.0.0.1"]
    rows = [(i if i != 1 else None, t, None, "s", None, *names) for i, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(1, "x y z"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table, want in ((docs, {0, None, 4}), (docs.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, str(tmp_path))
            if name != "byte-level BPE":
                assert table.columns == docs.columns
                assert all([r[n] for n in names] == names for r in table.collect()), name
        got = table.collect()
        assert {r["doc_id"] for r in got} == want and len(got) == len(want)
        assert all(bytes(r["decoded"]).decode().endswith("ip [IP]") for r in got if r["doc_id"] == 4)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_of_the_queries(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    shown = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert shown(tuple(r) for r in got.select(*want.columns).collect()) == shown(want.fetchall()) != []
