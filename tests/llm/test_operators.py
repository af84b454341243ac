"""Every training-data operator against brute force, and on odd tables."""

import base64
import hashlib
import html as html_module
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from millrace.llm import _shared, chat, decontam, html_text, line_dedup, packing, quality, simhash, token_files, url_lm, warc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

R = random.Random(3)
WORDS = ["".join(R.choice("abcdefghijklmnoprstuvéß") for _ in range(R.randint(1, 9))) for _ in range(400)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


ODD_TEXTS = [None, "", " ", "\n\n", "one", "a  b\tc\n\n d ", "x<|endoftext|>y z", "\u00a0b c\u3000", "caf\u00e9 \u0301x a\x1cb", "A B C", "# * $ % & | < >" * 4]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = prose(200, r)
    own = [prose(r.randint(1, 300), r) for _ in range(40)] + [base, base, base + " " + r.choice(WORDS), base.translate(str.maketrans(url_lm.LOWER, url_lm.UPPER))]
    own += ["\n".join([prose(12, r)] * 3 + [prose(60, r)]), prose(9_000, r), *ODD_TEXTS]
    line = prose(55, r)
    own += [f"{prose(20, r)}\n{line}\n{prose(30, r)}" for _ in range(12)]
    return own


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 7}", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def clashing(df):
    """A column whose name differs from ``text`` in case only, and names that operators use themselves."""
    own = df.withColumns({c: F.lit("mine") for c in ("quality", "removed", "clean_text", "row", "hit", "fp", "component_id", "_row", "_key", "main_text")})
    return own.toDF(*own.columns).select("*", F.lit("other").alias("TEXT"))


# --- 1 token files ------------------------------------------------------------------------


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    for n in (0, 1, 7, 8, 9, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32 if n == 9 else 60_000, n).astype("<u4")
        assert (token_files.from_planes(token_files.to_planes(ids, planes), n, planes) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_match_whole_encoding(spark, docs, texts, planes):
    path = _shared.tokenizer_path("byte_bpe_50k.json")
    uri = _shared.shared_dir(spark)
    manifest = token_files.write_token_files(docs, uri, path, planes=planes, chunk_ids=100, files=3)
    got, t, start = by_id(token_files.read_token_files(manifest)), Tokenizer.from_file(path), 0
    whole = []
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids)), (i, text)
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        start += len(ids)
        whole += ids
    for row in manifest.collect():
        f = token_files.TokenFile(row["path"])
        n = row["n_ids"]
        for a in (0, 1, 99, 100, n // 2):
            if a < n:
                assert f.read(a, min(250, n - a)).tolist() == whole[row["first"] + a :][: min(250, n - a)]


def test_token_files_odd_tables(spark, none):
    path = _shared.tokenizer_path("byte_bpe_50k.json")
    m = token_files.write_token_files(none, _shared.shared_dir(spark), path)
    assert token_files.read_token_files(m).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    m = token_files.write_token_files(clashing(rows), _shared.shared_dir(spark), path)
    got = token_files.read_token_files(m).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1] and got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:])) and sorted(r["n_tokens"] for r in got) == [1, 3, 3, 3]
    equal = spark.range(2000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    m = token_files.write_token_files(equal, _shared.shared_dir(spark), path, files=8)
    assert m.count() == 8 and m.agg(F.max("n_docs")).first()[0] < 500  # equal rows are several tasks'
    assert sorted(r["start"] for r in token_files.read_token_files(m).collect()) == list(range(0, 6000, 3))


def test_damaged_chunk_is_noticed(spark, docs):
    path = _shared.tokenizer_path("byte_bpe_50k.json")
    m = token_files.write_token_files(docs, _shared.shared_dir(spark), path, chunk_ids=100, files=1).first()
    fs, name = _shared.open_fs(m["path"])
    raw = bytearray(_shared.read_blob(m["path"]))
    raw[len(token_files.MAGIC) + 20] ^= 255
    with open(name, "wb") as f:
        f.write(bytes(raw))
    with pytest.raises(Exception):
        token_files.TokenFile(m["path"]).chunk(0)
    with open(name, "wb") as f:
        f.write(bytes(raw[:-1]))
    with pytest.raises(ValueError, match="whole"):
        token_files.TokenFile(m["path"])


# --- 2 WARC -------------------------------------------------------------------------------


def pages(spark):
    rows = [(i, f"http://a.com/{i}?é", h) for i, h in enumerate(["<p>a", "<p>b", "<p>a", None, "", "x" * 50_000, "<p>a\x00é"])]
    rows += [(None, None, "<p>a"), (9, "bad\r\nurl", "<p>c"), (9, "u", "<p>c")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_archives_round_trip(spark):
    got = warc.read_archives(warc.write_archives(clashing(pages(spark)), _shared.shared_dir(spark)), with_payload=True).collect()
    assert len(got) == 10 and all(r["gap"] is None for r in got)
    at = {(r["page_id"], r["url"]): r for r in got}
    for i, h in enumerate(["<p>a", "<p>b", "<p>a", "", "", "x" * 50_000, "<p>a\x00é"]):
        r = next(r for (k, _), r in at.items() if k == i)
        raw = (h or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == {0: ("revisit", 2), 3: ("revisit", 4)}.get(i, ("response", None))
        assert r["payload"] == (None if r["record_type"] == "revisit" else raw)
    assert [r["record_type"] for r in got if r["page_id"] == 9] == ["response", "response"]
    assert [(r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None] == [("revisit", 2)]
    least = warc.read_archives(warc.write_archives(pages(spark), _shared.shared_dir(spark), 5)).filter("record_type = 'revisit'").count()
    assert least == 0
    assert warc.read_archives(warc.write_archives(pages(spark).limit(0), _shared.shared_dir(spark))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_what_follows_damage(packed):
    raw = [warc.record(i, f"http://x/{i}", b"WARC/1.1\r\n" * i + bytes([i]) * 300) for i in range(12)]
    parts = [warc.member(r) if packed else r for r in raw]
    bad = list(parts)
    bad[2] = bad[2][:-30] + bytes(30)  # overwritten
    bad[5] = bad[5][: len(bad[5]) // 2]  # cut off
    bad[8] = b"garbage" + bad[8]  # something before
    bad[11] = bad[11][:-5]  # the archive ends early
    out = list(warc.salvage(b"".join(bad)))
    ids = [warc._page_id(x.headers["warc-record-id"]) for x in out if isinstance(x, warc.Record)]
    assert ids == [0, 1, 3, 4, 6, 7, 8, 9, 10]
    at = 0
    for x in out:  # records and gaps cover every byte once
        assert x.offset == at
        at += x.length
    assert at == sum(map(len, bad))
    assert sum(isinstance(x, warc.Gap) for x in out) == 4
    assert list(warc.salvage(b"")) == [] and isinstance(next(warc.salvage(b"nothing here")), warc.Gap)


@pytest.mark.parametrize("window", [64, warc.WINDOW])
@pytest.mark.parametrize("packed", [True, False])
def test_nothing_makes_the_reader_fail(monkeypatch, packed, window):
    monkeypatch.setattr(warc, "WINDOW", window)
    r = random.Random(window)
    raw = [warc.record(i, "http://x/é", b"page " * i, 7, i % 3 == 2) for i in range(5)]
    whole = b"".join(warc.member(x) if packed else x for x in raw)
    fields = [m.start() for m in re.finditer(rb"Length: ", whole)]
    for k in range(2500):
        data = bytearray(whole)
        for _ in range(r.randint(1, 3)):
            at = r.choice(fields) + 8 + r.randrange(3) if fields and r.random() < 0.3 else r.randrange(len(data))
            if k % 3 == 0:
                del data[at : at + r.randint(1, 40)]
            elif at < len(data):
                data[at] = r.choice([r.randrange(256), 0xB2, 0x39])
        at = 0
        for x in warc.salvage(bytes(data)):
            assert x.offset == at and x.length > 0
            at += x.length
        assert at == len(data)


def test_numbers_that_are_none_are_damage():
    for bad in ("²", "-5", "1e3", "9" * 30, ""):
        one = warc.record(1, "u", b"abc").replace(b"Content-Length: 3", f"Content-Length: {bad}".encode())
        two = warc.record(2, "u", b"abc", 1, True).replace(b"HTTP/1.1 200 OK", f"HTTP/1.1 200 OK\r\nX: 1\r\nContent-Length: {bad}".encode())
        two = two.replace(b"Content-Length: 3", b"X: 3")
        for x in (one.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: " + bad.encode(), 2), two):
            assert [type(y).__name__ for y in warc.salvage(x)][0] == "Gap"


def test_search_is_linear_and_records_inside_damaged_ones_are_doubtful():
    started = time.perf_counter()
    assert [type(x).__name__ for x in warc.salvage(b"WARC/1.1\r\n" * 100_000)] == ["Gap"]
    assert time.perf_counter() - started < 5
    inner = warc.record(777, "http://inner", b"inner")
    outer = warc.record(1, "http://outer", b"<p>" + inner + b"</p>" + b"x" * 100)
    after = warc.record(2, "http://after", b"after")
    # The payload is damaged, its length isn't: what follows is found, nothing inside is.
    got = list(warc.salvage(outer.replace(b"<p>", b"<q>") + after))
    assert [type(x).__name__ for x in got] == ["Gap", "Record"] and warc._page_id(got[1].headers["warc-record-id"]) == 2
    # Bytes are missing: what is found inside the stated length is marked.
    got = [x for x in warc.salvage(outer.replace(b"x" * 50, b"") + after) if isinstance(x, warc.Record)]
    assert [(warc._page_id(x.headers["warc-record-id"]), x.doubtful) for x in got] == [(777, True), (2, False)]


def test_archives_are_of_bounded_size_and_gaps_are_no_silence(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "u", f"{i} " * 400) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(rows, _shared.shared_dir(spark), archive_bytes=5_000)
    sizes = [r["n_bytes"] for r in archives.collect()]
    assert len(sizes) > 3 and max(sizes) < 7_000 and archives.agg(F.sum("n_records")).first()[0] == 60
    assert warc.read_archives(archives).count() == 60
    path = archives.first()["path"]
    fs, name = _shared.open_fs(path)
    raw = bytearray(_shared.read_blob(path))
    raw[len(raw) // 2] ^= 255
    with open(name, "wb") as f:
        f.write(bytes(raw))
    seen = warc.read_archives(archives.select("path"))
    assert seen.filter("gap IS NOT NULL").count() == 1 and seen.filter("gap IS NULL").count() == 59
    with pytest.raises(Exception, match="valid records"):
        warc.read_archives(archives).collect()
    monkeypatch.setattr(_shared, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(_shared, "HOT_ROWS", 5)
    many = spark.createDataFrame([(i, "u", "same" if i % 2 else f"{i % 40}") for i in range(60)], "page_id long, url string, html string")
    got = by_id(warc.read_archives(warc.write_archives(many, _shared.shared_dir(spark))), "page_id")
    assert len(got) == 60 and all(got[i]["refers_to"] == (59 if i != 59 else None) for i in range(1, 60, 2))
    assert all(got[i]["refers_to"] == (i + 40 if i < 20 else None) for i in range(0, 60, 2))


# --- 3 HTML ---------------------------------------------------------------------------------


#: Pages of other making than the labelled ones, with class names that those don't have.
HELD_OUT = (
    "<div class=topbar><a>{-1}</a> <a>{-2}</a> <a>{-1}</a></div><main id=lead><h1>{+8}</h1><p>{+45.}</p><h2>{+3}</h2><p>{+70.}</p><p>{+4.}</p><ol><li>{+12}</li><li>{+3}</li></ol></main><footer><p>{-30.}</p></footer>",
    "<table><tr><td><a>{-1}</a></td><td><a>{-1}</a></td></tr></table><div class=z9><div class=q1><p>{+61.}</p><p>{+18.}</p><p>{+3.}</p></div></div><div class=k3><div><a>{-3}</a></div><div><a>{-4}</a></div><div><a>{-2}</a></div></div><div>{-4}</div>",
    "<article class=x1><h1>{+4}</h1><p>{+30.}</p><div class=y2>{+9.}</div><p>{+2}</p><p>{+51.}</p><div class=y3><p><a>{-5}</a></p><p><a>{-6}</a></p><p><a>{-4}</a></p><p><a>{-6}</a></p></div></article><aside>{-33.}</aside>",
    "<nav class=n><a>{-2}</a></nav><div class=b7><h1>{+7}</h1><p>{+37.}</p><p>{+80.}</p><p>{+12.}</p></div><form class=f2><p>{-6}</p></form>",
    "<main><p>{+33.}</p><p><a>{+3}</a></p><p>{+64.}</p><p><a>{+9}</a></p><p>{+41.}</p></main><div><a>{-2}</a></div>",
    "<article><p>{+12.}</p><p>{+50.}</p><p><a>{-9}</a></p><p><a>{-7}</a></p><p><a>{-8}</a></p></article>",
    "<div><a>{-2}</a></div><div><a>{-1}</a></div><div>{-3}</div><div><a>{-2}</a></div><p>{+56.}</p><div>{+3}</div><p>{+48.}</p><div><a>{-3}</a></div><div>{-2}</div><div><a>{-3}</a></div>",
    "<div class='layout has-sidebar'><article><h1>{+3}</h1><p>{+40.}</p><p>{+3.}</p><p>{+29.}</p></article></div>",
)


def test_tree_on_held_out_pages():
    def score(by):
        right = [(by.keep(html_text.blocks(page)) == y).tolist() for page, y in map(html_text.labelled_page, HELD_OUT)]
        return sum(map(sum, right)) / sum(map(len, right))

    whole, alone = html_text.classifier(), html_text.train(without=html_text.NEIGHBOURS)
    assert score(whole) >= 0.95
    assert score(alone) < score(whole)  # the neighbours' words and links decide some blocks
    used = {html_text.FEATURES[n[0]] for n in whole.nodes if n[0] >= 0}
    assert {"words_before", "words_after", "links_before"} & used and {"links"} <= used
    assert max(whole.odds.values()) > 0 > min(whole.odds.values())


def test_neighbours_decide():
    links = "".join(f'<p><a href="/{i}">Another page of ours</a></p>' for i in range(4))
    prose_ = "<p>" + "One more word of prose " * 8 + "here.</p>"
    own = "<p><a href=/x>Another page of ours</a></p>"
    assert "Another page" not in html_text.main_text(f"<article>{prose_}{links}</article>")
    assert "Another page" in html_text.main_text(f"<article>{prose_}{own}{prose_}</article>")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="sidebar-content"><p>Something at the side of it.</p></div><article><p>Main one.</p></article>', "Main one."),
        ('<div class="footer-content"><p>We are here to stay.</p></div><article><p>Main one.</p></article>', "Main one."),
        ('<article><section id="search-methods"><h2>Methods</h2><p>We searched many data bases.</p></section></article>', "Methods We searched many data bases."),
        ('<article><h2 class="section-header">Head</h2><div class="entry-header"><h1>Title</h1></div><p>End.</p></article>', "Head Title End."),
        ("<article><p>a b c <button>Share<p>next para<noscript>x<p>third para</article>", "a b c next para third para"),
        ("<article><p>x <math><mi>y</mi></math> <object>obj text</object> z</article>", "x y obj text z"),
        ("<article><p>x <select><option>no</select> z <button>no</button> w</article>", "x z w"),
        ('<article><p><span class="tags"><b class=y>buy</span></b> rest of it</p></article>', "buy rest of it"),
        ("<div><p>Short one.</p><p>Also short.</p></div>", "Short one. Also short."),
        ("<form id=f><div><a>Home</a></div><article><p>In a form.</p></article></form>", "In a form."),
    ],
)
def test_odd_markup(page, text):
    assert html_text.main_text(page) == text


def plain_text(page):
    """The text that the test tables' pages have in their article, by another way."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    for gone in ("script", "style"):
        inner = re.sub(rf"<{gone}[^>]*>.*?</{gone}>", "", inner, flags=re.S)
    inner = re.sub(r"<!--.*?-->", "", inner, flags=re.S)
    inner = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner)
    return " ".join(html_module.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", inner)).split())


def test_tables_pages_by_another_way():
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    own = [h for h in pq.read_table(path, columns=["html"])["html"].to_pylist() if h and "<article>" in h]
    assert len(own) > 100 and [html_text.main_text(h) for h in own] == [plain_text(h) for h in own]


def test_many_open_controls_take_no_square_time():
    assert html_text.main_text("<article>" + "<p>a<button>b" * 20_000).count("a") == 20_000


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href=/>Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, and so on.</div><div class="ad">Buy now, it is cheap and good.</div>
<article><h1>Head&amp;line</h1><p>First&nbsp;<b>par<i>a</i>graph</b>\n with <a href=x>a link</a>.<p>Second &lt;one&gt;<br>goes on &#8212; here
<aside>Read also this other article of ours</aside><form><label>Name</label><input></form><p>The.</p>
<section id="comments"><article><p>I am a reader and I have much to say about all of this here.</p></article></section></article>
<div id="sidebar"><p>Many words stand in this sidebar, which nobody reads at any time.</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head&line First paragraph with a link. Second <one> goes on — here The."
    for odd in (None, "", "<", "<p", "</", "<!--", "<script>x", "a < b", "<p>a<", "&am", "<article>" * 500, "<a " + '"<a ' * 2000):
        assert isinstance(html_text.main_text(odd), str)
    long = "<article>" + "<p>" + prose(30_000) + "</p></article>"
    assert html_text.main_text(long) == " ".join(html_module.unescape(long[12:-14]).split())


def test_extract_keeps_columns(spark):
    df = spark.createDataFrame([(1, None, PAGE), (1, "u", PAGE), (2, "v", None)], "page_id long, url string, html string")
    out = html_text.extract(clashing(df))
    assert out.columns[:3] == df.columns and out.columns[-1] == "main_text_"
    assert sorted(len(r[-1]) for r in out.collect()) == [0, 71, 71]
    assert html_text.extract(df.limit(0)).count() == 0


# --- 4 quality ---------------------------------------------------------------------------


def brute_coverage(text, n):
    w = WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - n + 1):
        seen.setdefault(tuple(w[i : i + n]), []).append(i)
    every = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + n)}
    later = {j for v in seen.values() for i in v[1:] for j in range(i, i + n)}
    return len(every), sum(len(w[j]) for j in later)


def test_coverage_is_exact(texts):
    r = random.Random(8)
    own = texts + [" ".join(r.choice("ab") for _ in range(60)) for _ in range(20)]
    c = quality.coverage(own)
    for i, t in enumerate(own):
        for n in (quality.BASE, *quality.NGRAM_LIMITS):
            assert (c[f"repeat_words_{n}"][i], c[f"repeat_chars_{n}"][i]) == brute_coverage(t, n), (i, n)
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert c["n_dup_lines"][i] == len(lines) - len(set(lines))
        assert c["word_chars"][i] == sum(map(len, WORD.findall(t or "")))


def test_colliding_hashes_are_counted_exactly():
    code, doc = np.array([0, 1, 2, 0, 1, 2, 5, 6, 7]), np.zeros(9, int)
    assert sorted(quality._repeated(code, doc, np.zeros(7, np.uint64), 3).tolist()) == [0, 3]


def test_quality_verdicts(spark, docs, none):
    good, bad = prose(300), "\n".join([prose(30)] * 2 + [prose(20)] * 9 + [prose(200)])
    df = spark.createDataFrame([(1, good), (2, bad), (3, "a b"), (4, None), (1, good), (5, "%%% " * 100 + good)], "doc_id long, text string")
    out = quality.judge(clashing(df))
    assert "quality_" in out.columns
    assert [r["doc_id"] for r in quality.keep_stage(spark, clashing(df), "").collect()] == [1, 1]
    assert quality.keep_stage(spark, clashing(df), "").columns == clashing(df).columns
    assert quality.judge(none).count() == 0
    got = by_id(quality.judge(docs).select("doc_id", "quality.*"))
    assert len(got) == docs.count() and not got[44]["base_failed"]


def test_limits_are_shares_at_any_length():
    r = random.Random(9)
    for size in (45, 450, 4500):
        own = [f"{w}{i}" for i, w in enumerate(prose(size, r).split())]
        for share, failed in ((0.25, True), (0.05, False)):
            spam, text = "buy cheap now today here".split(), list(own)
            for k in range(1 + max(1, round(share * sum(map(len, own)) / (1 - share) / sum(map(len, spam))))):  # the first occurrence is no repeat
                at = r.randrange(len(text) // 6) * 6 + k
                text[at:at] = [*spam, f"{k}"]
            c = quality.coverage([" ".join(text)])
            most = max(brute_coverage(" ".join(text), n)[1] / limit for n, limit in quality.NGRAM_LIMITS.items()) / c["word_chars"][0]
            assert quality.verdicts(c)["repetition_failed"][0] == (most > 1)
            assert (most > 1) == failed or size == 45
    spam = quality.coverage([" ".join(["buy cheap now today here", prose(11, r)] * 4)])
    assert quality.verdicts(spam)["repetition_failed"][0]


# --- 5 line dedup ------------------------------------------------------------------------


def brute_lines(rows, min_sites=line_dedup.MIN_SITES):
    at = {}
    for d, t, s in rows:
        for i, x in enumerate((t or "").split("\n") if t is not None else []):
            x = x.strip(" \t\x0b\x0c\r")
            if x:
                at.setdefault(x, []).append((d, i, s))
    gone = {}
    for line, own in at.items():
        if len({s for *_, s in own}) >= min_sites * (2 if len(re.split(r"[ \t\x0b\x0c\r]+", line)) < 4 else 1):
            for d, i, _ in sorted(own)[1:]:
                gone.setdefault(d, []).append(i)
    return {d: sorted(v) for d, v in gone.items()}


@pytest.mark.parametrize("min_sites", [3, 5, 40])
def test_lines_removed_are_those_of_brute_force(spark, docs, texts, min_sites):
    r = random.Random(min_sites)
    rows = [(i, t, f"s{i % 7}") for i, t in enumerate(texts)]
    for k in range(300):
        line = f"shared line number {k % 9} of many"
        rows.append((1000 + k, f"{prose(8, r)}\n {line}\t\n{line}\nRead more {k % 9}\n", f"site{r.randint(0, 10 + 15 * (k % 9))}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = {x["doc_id"]: x for x in line_dedup.remove_lines(df, min_sites=min_sites).collect()}
    want = brute_lines(rows, min_sites)
    assert {d: x["removed"] for d, x in got.items() if x["removed"]} == want
    for d, t, _ in rows:
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(d, ()))
        assert got[d]["clean_text"] == left


def test_only_near_lines_are_counted_exactly(spark, monkeypatch):
    rows = [(i, f"on very many sites indeed\nonly in this document {i}\non about five sites here {i % 12}", f"s{i % 60}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    asked, real = [], line_dedup.near_sites
    monkeypatch.setattr(line_dedup, "near_sites", lambda lines, near, total: asked.append(near.count()) or real(lines, near, total))
    want = brute_lines(rows)
    for keys in (_shared.BROADCAST_KEYS, 0):  # a join by broadcast, and one by shuffle with hot keys apart
        monkeypatch.setattr(_shared, "BROADCAST_KEYS", keys)
        monkeypatch.setattr(_shared, "HOT_ROWS", 50)
        got = {x["doc_id"]: x["removed"] for x in line_dedup.remove_lines(df).collect()}
        assert {d: x for d, x in got.items() if x} == want
    assert asked == [12, 12]
    plan = line_dedup.near_sites(*[spark.createDataFrame([], t) for t in ("_h long, _g long, _site string", "_h long, _g long, n long")], 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")  # the join is below the aggregation


def test_a_document_of_many_lines(spark):
    line = "the same five words here again"
    text = "\n".join(f"{line}\n{i} is the number of it" for i in range(20_000))
    df = spark.createDataFrame([(0, text, "s0"), *[(i, line, f"s{i}") for i in range(1, 9)]], "doc_id long, text string, source string")
    got = {x["doc_id"]: x for x in line_dedup.remove_lines(df).collect()}
    assert len(got[0]["removed"]) == 19_999 and got[0]["clean_text"].count("\n") == 20_000 and got[1]["clean_text"] == ""


def test_line_dedup_odd_tables(spark, none):
    assert line_dedup.remove_lines(none).count() == 0 and line_dedup.clean_stage(spark, none, "").count() == 0
    line = "the same five words here again"
    rows = [(None, line, "a"), (1, line, "b"), (2, f"{line}\nown words", "c"), (3, line, None), (4, line, "d"), (4, line, "d"), (5, None, "e"), (6, "", None)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = line_dedup.clean_stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r[0] if r[0] is not None else -1, r[1]) for r in out.collect()) == sorted([(-1, line), (2, "own words"), (5, None), (6, "")], key=lambda x: (x[0], str(x[1])))


# --- 6 packing ------------------------------------------------------------------------------


def check_plan(counts, capacity):
    layouts, bound, share = packing.plan(counts, capacity)
    seen = np.zeros(capacity + 1, int)
    for layout, n in layouts:
        assert n > 0 and sum(layout) <= capacity
        for size in layout:
            seen[size] += n
    assert (seen == counts).all()
    used = sum(n for _, n in layouts)
    assert used >= bound - 1e-6
    return used, bound, share


def test_plans_hold_all_and_are_near_the_bound():
    rng = np.random.default_rng(0)
    for n in (0, 1, 40, 3000, 60_000):
        counts = np.bincount(np.clip(rng.lognormal(4.5, 1, n).astype(int), 1, 256), minlength=257)
        used, bound, share = check_plan(counts, 256)
        assert used <= np.ceil(bound) + 1
        assert n < 3000 or share >= 0.9  # the program places the pieces, not the best fit after it
    thirds = np.zeros(257, int)
    thirds[[86, 85, 85]] = 0
    thirds[128], thirds[129], thirds[127] = 10, 10, 10
    assert check_plan(thirds, 256)[0] == 15
    same = np.zeros(257, int)
    same[100] = 1001  # two to a sequence, none of them full
    assert check_plan(same, 256)[::2] == (501, pytest.approx(1, abs=0.05))


def test_the_program_places_the_tables_pieces():
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    encode = _shared.memo(_shared.tokenizer_path("word_bpe_49k.json"), False)
    sizes = np.array([len(x) // 4 + 1 for x in encode(pq.read_table(path, columns=["text"])["text"].to_pylist())])
    counts = np.bincount(sizes % 2048, minlength=2049)
    counts[0], counts[2048] = 0, (sizes // 2048).sum()
    used, bound, share = check_plan(counts, 2048)
    assert used == np.ceil(bound) and share >= 0.9


def test_knapsack_pricing_is_optimal():
    r = random.Random(1)
    for _ in range(20):
        v = np.zeros(31)
        for size in r.sample(range(1, 31), 5):
            v[size] = r.random()
        best, last = packing.price(v, 30)

        def brute(c, v=v, memo={}):  # noqa: B006
            return max([0.0, *[v[s] + brute(c - s, v) for s in range(1, c + 1) if v[s]]])

        memo = [0.0]
        for c in range(1, 31):
            memo.append(max([memo[c - 1], *[v[s] + memo[c - s] for s in range(1, c + 1) if v[s]]]))
        assert np.allclose(best, memo) and np.isclose(sum(v[s] for s in packing.filling(last, 30)), best[30])


def test_packing_places_every_piece_once(spark, docs, texts, none):
    path = _shared.tokenizer_path("word_bpe_49k.json")
    out = packing.pack(clashing(docs), path, capacity=256, with_ids=True).collect()
    t, want = Tokenizer.from_file(path), {}
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 256)):
            want[(i, k)] = (a, ids[a : a + 256])
    sequences = {}
    for r in out:
        start, ids = want.pop((r["doc_id"], r["piece"]))
        assert (r["start"], r["length"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert not want
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(none, path).count() == 0
    same = spark.createDataFrame([(1, "a b c")] * 70 + [(None, None)], "doc_id long, text string")
    got = packing.pack(same, path, capacity=8).collect()
    assert len(got) == 71 and len({(r["sequence_id"], r["offset"]) for r in got}) == 71
    many = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))  # equal rows
    got = packing.pack(many, path)
    assert got.select("sequence_id", "offset").distinct().count() == 20_000 and got.agg(F.countDistinct("sequence_id")).first()[0] == 40


# --- 7 SimHash ---------------------------------------------------------------------------------


def brute_fingerprint(text, n=3):
    w = WORD.findall((text or "").translate(str.maketrans(url_lm.UPPER, url_lm.LOWER)))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(items, near):
    root = {k: k for k, _ in items}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if near(x, y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k, _ in items}


def test_near_duplicates_match_brute_force(docs, texts, none):
    got = by_id(simhash.near_duplicates(clashing(docs)))
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == fps
    want = brute_components(sorted(fps.items()), lambda x, y: bin(x ^ y).count("1") <= 3)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert simhash.near_duplicates(none).count() == 0


def test_hot_copies_keep_their_class(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW_KEYS", 0)
    monkeypatch.setattr(_shared, "HOT_ROWS", 10)
    texts = [prose(40) for _ in range(30)]
    rows = [(i, "" if i % 3 == 0 else texts[i % 30] if i % 3 == 1 else f"{texts[0]} {i}") for i in range(300)]
    got = by_id(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(sorted(fps.items()), lambda x, y: bin(x ^ y).count("1") <= 3)
    assert {i: r["component_id"] for i, r in got.items()} == want


@pytest.mark.parametrize("cells_from", [0, 1 << 30])
def test_tiles_lose_no_link(monkeypatch, cells_from):
    monkeypatch.setattr(simhash, "CELLS_FROM", cells_from)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    flips = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for b in base[:60] for k in (1, 2, 3, 4, 5)]
    fps = np.unique(np.r_[base, np.array(flips, np.uint64)])
    fps = fps[np.lexsort((fps, *simhash.quarters(fps).T[::-1]))]
    want = brute_components(list(enumerate(fps.tolist())), lambda x, y: bin(x ^ y).count("1") <= 3)

    def labels(edges):
        return brute_components(list(enumerate(range(len(fps)))), lambda a, b: (min(a, b), max(a, b)) in edges)

    whole = simhash.Forest(len(fps))
    fps = fps[:, None]
    simhash.tile_links(fps, None, 3, whole)
    assert labels({tuple(sorted(e)) for e in whole.edges}) == want and len(whole.edges) < len(fps)
    half, edges = len(fps) // 2, set()
    for a, b, shift in ((fps[:half], None, 0), (fps[half:], None, half), (fps[:half], fps[half:], 0)):
        f = simhash.Forest(len(a) + (0 if b is None else len(b)))
        simhash.tile_links(a, b, 3, f)
        edges |= {tuple(sorted((i + shift, j + shift))) for i, j in f.edges}
    assert labels(edges) == want


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_TILE", 50)
    monkeypatch.setattr(simhash, "LARGEST_TILE", 60)
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 62, 400)
    fps = np.unique(np.r_[fps, fps[:100] ^ 5, fps[:50] ^ (1 << 40)])
    df = spark.createDataFrame([(int(f), 1, [int(f)]) for f in fps], "key long, size long, fps array<long>")
    uri = _shared.shared_dir(spark)
    edges = simhash.links(df, 3, uri, len(fps))
    got = {r["node"]: r["root"] for r in simhash.components(edges, uri).collect()}
    want = brute_components([(int(f), int(f)) for f in fps], lambda x, y: bin(x ^ y).count("1") <= 3)
    assert {f: got.get(f, f) for f in want} == want


def test_wide_fingerprints_find_similar_texts(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    rows, group = [], {}
    for g in range(120):
        own = [r.choice(vocabulary) for _ in range(r.randint(60, 400))]
        for k in range(3 if g % 2 else 1):
            text = list(own)
            for at in range(len(own) // 60 * (k > 0)):  # a word in sixty or fewer: similarities of 0.8 and more
                text[r.randrange(len(text))] = f"x{at}{k}"
            rows.append((len(rows), " ".join(text)))
            group[len(rows) - 1] = g
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    got = by_id(simhash.near_duplicates(df, simhash.WIDE_RADIUS, words=5, width=simhash.WIDE, repeats=False))
    first, linked, pairs = {}, 0, 0
    for d, g in group.items():
        first.setdefault(g, d)
        assert group[got[d]["component_id"]] == g  # nothing unlike is linked
        if len(sets[d] & sets[first[g]]) >= 0.8 * len(sets[d] | sets[first[g]]):
            pairs, linked = pairs + 1, linked + (got[d]["component_id"] == first[g])
    assert pairs > 200 and linked >= 0.99 * pairs


def near_texts(seed, pairs, low, high):
    """Pairs of texts whose five-word shingle sets have similarities from low to high, their ends being different."""
    r, rows = random.Random(seed), []
    for g in range(pairs):
        own = [f"w{r.randrange(10**9)}" for _ in range(r.randint(60, 300))]
        n = len(own) - 4
        m = r.choice([m for m in range(1, n) if low <= (n - m) / (n + m) <= high] or [n // 9])
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(own[:-m] + [f"v{r.randrange(10**9)}" for _ in range(m)]))]
    return rows


def similar_components(rows):
    sets = [(d, {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}) for d, t in rows]
    return brute_components(sets, lambda x, y: 5 * len(x & y) >= 4 * len(x | y))


@pytest.mark.parametrize("tile", [1_024, 40])
def test_links_are_exact(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "LEAST_TILE", tile)
    rows = near_texts(3, 80, 0.6, 0.79)
    chain = [f"c{i}" for i in range(200)]  # a chain of similar texts whose ends differ, and texts that many are nearly similar to
    rows += [(1000 + k, " ".join(chain[10 * k :] + [f"d{i}" for i in range(10 * k)])) for k in range(8)]
    rows += [(2000 + k, " ".join(chain[::-1][: 200 - 26] + [f"e{k}x{i}" for i in range(26)])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = by_id(simhash.near_duplicates(df, simhash.WIDE_RADIUS, words=5, width=simhash.WIDE, repeats=False))
    want = similar_components(rows)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert sum(d != c for d, c in want.items()) == 7  # only the chain
    assert simhash.keep_one_stage(spark, df, "").count() == len(rows) - 7


def test_every_similar_pair_is_linked(spark):
    rows = near_texts(8, 1500, 0.8, 0.81)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = by_id(simhash.near_duplicates(df, simhash.WIDE_RADIUS, words=5, width=simhash.WIDE, repeats=False))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    want = {d: d - (d % 2 and 5 * len(sets[d - 1] & sets[d]) >= 4 * len(sets[d - 1] | sets[d])) for d, _ in rows}
    assert sum(d != c for d, c in want.items()) > 1000
    assert {d: r["component_id"] for d, r in got.items()} == want


def test_keep_one_of_each_group(spark, docs):
    df = clashing(docs)
    out = simhash.keep_one_stage(spark, df, "")
    ids = [r[0] for r in out.collect()]
    assert out.columns == df.columns and 40 in ids and 41 not in ids and 43 not in ids
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (2, "a")], "doc_id long, text string")
    assert sorted(str(r[0]) for r in simhash.keep_one_stage(spark, rows, "").collect()) == ["1", "None"]


# --- 8 URLs -----------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = {
        "http://A.com/x": ("a.com", "/x", "com/", "allow"), "https://www.example.com/en/1?q#f": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"), "x://b.net/es/?a": ("b.net", "/es/", "net/es/", "block"),
        "http://com": ("com", "", None, None), "http://xcom/": ("xcom", "/", None, None), "nothing": ("", "", None, None), None: ("", "", None, None), "http://a.com?x=/": ("a.com", "", None, None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = by_id(url_lm.judge(clashing(df)), "page_id")
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"])
    assert url_lm.judge(df.limit(0)).count() == 0


def test_url_model_separates_held_out_classes(spark):
    r = random.Random(4)
    good, bad = ["garden", "river", "meadow", "stone"], ["xqzpil", "wjkqcas", "zzbonu", "qxwin"]
    rows = []
    for i in range(600):
        kind = i % 2
        name = "".join(r.choice(good if kind else bad) for _ in range(3))
        tld = ("com/a" if kind else "net/es") if i < 400 else "org/"
        rows.append((i, f"http://{name}.{tld}/{r.randint(0, 99)}"))
    got = by_id(url_lm.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(4)), "page_id")
    right = sum(got[i]["verdict"] == ("allow" if i % 2 else "block") for i in range(400, 600))
    assert right >= 190
    fold = [(r[0], hashlib.md5(r[1].encode()).hexdigest()[0] in url_lm.HELD_OUT) for r in rows if r[0] < 400]
    assert 60 < sum(held for _, held in fold) < 140
    seen = []
    real = url_lm.model
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(url_lm, "model", lambda judged: seen.append(judged.filter("label IS NOT NULL").count()) or real(judged))
        url_lm.judge(spark.createDataFrame(rows, "page_id long, url string")).count()
    assert seen == [sum(not held for _, held in fold)]  # what calibrates doesn't train
    long = spark.createDataFrame([(1, "http://a.org/" + "gardenriver" * 20_000), *rows[:400]], "page_id long, url string")
    assert len(by_id(url_lm.judge(long), "page_id")) == 400
    one = spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.com/")], "page_id long, url string")
    assert {r["verdict"] for r in url_lm.judge(one).collect()} == {"allow"}


# --- 9 decontamination -------------------------------------------------------------------------


def brute_hits(docs, items, n=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans(url_lm.UPPER, url_lm.LOWER)
    win = {}
    for k, t in items:
        w = word.findall((t or "").translate(low))
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            win.setdefault(tuple(w[i : i + m]), set()).add(str(k))
    out = {}
    for d, t in docs:
        w = word.findall((t or "").translate(low))
        hit, ids = set(), set()
        for m in {len(x) for x in win}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in win:
                    hit |= set(range(i, i + m))
                    ids |= win[tuple(w[i : i + m])]
        out[d] = (len(w), sorted(hit), sorted(ids))
    return out


@pytest.mark.parametrize(("bits", "size"), [(decontam.MOST_BITS, decontam.BROADCAST_BYTES), (6, 0)])
def test_hits_are_those_of_brute_force(spark, texts, monkeypatch, bits, size):
    monkeypatch.setattr(decontam, "MOST_BITS", bits)  # in a table of 64 bits nearly all are set
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", size)
    items = [(i, prose(n)) for i, n in enumerate([30, 13, 14, 12, 5, 1])] + [(6, None), (7, ""), (8, "..."), (10, None), (0, "x y")]
    items[5] = (5, "unusualword")
    own = list(enumerate(texts)) + [(100, items[0][1].translate(str.maketrans(url_lm.LOWER, url_lm.UPPER))), (101, "a, " + items[1][1].replace(" ", "--") + "! z"), (102, prose(500) + " " + items[2][1]), (103, items[3][1]), (104, "see UnusualWord there"), (105, items[4][1])]
    df = clashing(spark.createDataFrame(own, "doc_id long, text string").repartition(4))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontam.scan(df, bench))
    want = brute_hits(own, items)
    assert {d: (r["n_words"], r["hit"], r["items"]) for d, r in got.items()} == want
    kept = {r["doc_id"] for r in decontam.clean(df, bench).collect()}
    assert kept == {d for d, (n, hit, _) in want.items() if not (hit and 20 * len(hit) >= n)} and 100 not in kept
    spans = by_id(decontam.clean(df, bench, how="spans"))
    assert len(spans) == len(own) and spans[101][1] == "a z" and spans[0][1] == texts[0]


def test_a_passage_that_all_documents_share(spark):
    item = prose(40)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{prose(30)} "), F.when(F.col("id") % 3 == 0, F.lit(item)).otherwise(F.lit("clean")), F.lit(" end")).alias("text"))
    got = decontam.scan(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.filter("size(hit) = 40").count() == 1000 and got.filter("size(hit) = 0").count() == 2000


def test_decontamination_odd_tables(spark, none, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(docs, empty).filter("size(hit) > 0").count() == 0
    assert decontam.clean(docs, empty).count() == docs.count() and decontam.scan(none, empty).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    item = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "item_id long, text string")
    got = decontam.scan(twice, item).collect()
    assert len(got) == 3 and all(r["items"] == ["3"] and r["hit"] == [0, 1] for r in got)


# --- 10 chat -----------------------------------------------------------------------------------

TEXTS = ["plain", "", None, "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "a<|b", "<|im_end|", "\n\n", "|>", "<", "\\<|im_end|>\\", "é😀<|im_start|>", "x" * 30_000]


def test_conversations_come_back(spark):
    rows = [(i, k, r, t) for i, t in enumerate(TEXTS) for k, r in enumerate(["system", "user", "assistant", None, "as%7C|\nsist"])]
    rows += [(99, None, "user", "first"), (99, 1, "assistant", "b"), (99, 1, "assistant", "a"), (99, 1, "assistant", "a"), (None, 0, "assistant", "no id")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    got = by_id(chat.format_conversations(df).withColumn("loss", chat.loss_text()), "conv_id")
    own = {}
    for c, k, r, t in rows:
        own.setdefault(c, []).append((k is not None, k or 0, r or "", t or ""))
    for c, turns in own.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [t[2:] for t in turns]
        assert got[c]["loss"] == "".join(t[3] for t in turns if t[2] == "assistant")
        cut = [got[c]["formatted"][x["start"] : x["start"] + x["length"]] for x in got[c]["loss_spans"]]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in cut] == [t[3] for t in turns if t[2] == "assistant"]
        assert got[c]["formatted"].count("<|im_start|>") == len(turns) == got[c]["formatted"].count("<|im_end|>")
    assert got[0]["formatted"].startswith("<|im_start|>system\nplain<|im_end|>\n<|im_start|>user\nplain<|im_end|>\n")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_a_conversation_of_many_turns(spark):
    def seconds(n):
        df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("some <|im_end|> words "), "id").alias("text"))
        started = time.perf_counter()
        r = chat.format_conversations(df).withColumn("loss", chat.loss_text()).first()
        assert len(r["turns"]) == n and len(r["loss_spans"]) == n // 2 and r["loss"].count("words") == n // 2
        return time.perf_counter() - started

    seconds(100)
    assert seconds(20_000) < 20
