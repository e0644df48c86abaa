"""Quality, tokens, mixing, pages, archives, language model and the pipeline, against plain versions."""

import base64
import hashlib
import io
import itertools
import math
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from weirflow.llm import bpe, hmm, mixing, quality, queries, warc, webtext

ODD = [None, "", " \n\t", "a", "a b", "a b c", "A b  a b\x0ba b a b c", "x\nx\n\ny\n x\nx", "é Ä ß " * 30, "***" * 9, "one " * 4000, "w" * 50_000]
CLASHES = ", size long, words string, lines string, votes string, n long, target string"


def with_clashes(rows, docs, more=""):
    data = [(i, t, *rest, 1, "a", "b", "c", 2, "d") for i, t, *rest in docs]
    return rows(data, f"doc_id long, text string{more}{CLASHES}")


def plain_measures(text):
    words = brute.WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if seen[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_measures_of_odd_texts(rows):
    docs = list(enumerate(ODD))
    got = quality.measures(with_clashes(rows, docs)).select("doc_id", *BASE).collect()
    assert {tuple(r) for r in got} == {(i, *plain_measures(t)) for i, t in docs}


def plain_learning(votes):
    """Expectation-maximisation over single documents."""
    p = [sum(x for x in v if x is not None) / n if (n := sum(x is not None for x in v)) else 0.5 for v in votes]
    old = None
    for _ in range(30):
        prior = (sum(p) + 1) / (len(p) + 2)
        rates = []
        for k in range(len(votes[0])):
            cast = [(v[k], q) for v, q in zip(votes, p, strict=True) if v[k] is not None]
            good = (sum(q for x, q in cast if x == 1) + 1) / (sum(q for _, q in cast) + 2)
            bad = (sum(1 - q for x, q in cast if x == 0) + 1) / (sum(1 - q for _, q in cast) + 2)
            rates.append((max(0.5, good), max(0.5, bad)))
        p = []
        for v in votes:
            odds = math.log(prior / (1 - prior))
            for x, (good, bad) in zip(v, rates, strict=True):
                odds += 0 if x is None else math.log(good / (1 - bad)) if x else math.log((1 - good) / bad)
            p.append(1 / (1 + math.exp(-odds)))
        now = [prior, *itertools.chain(*rates)]
        if old and max(abs(a - b) for a, b in zip(old, now, strict=True)) < 1e-4:
            break
        old = now
    return p


def test_quality_query_equals_brute_force_and_labels(spark, sf_dir):
    judged = quality.judge(queries.table(spark, sf_dir, "documents")).toPandas()
    names = [f"vote_{n}" for n in quality.rules()]
    votes = [[None if x != x else int(x) for x in r] for r in judged[names].astype(float).to_numpy().tolist()]
    assert np.allclose(judged["quality"], plain_learning(votes), atol=1e-6)
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    for r in judged.itertuples():
        n = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert r.base_failed == failed and r.kept == (not failed and r.quality >= 0.5)
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf_dir}/labels.parquet'").fetchall())
    said = [(labels[r.doc_id], r.kept) for r in judged.itertuples() if r.doc_id in labels and not r.base_failed]
    assert sum(q == k for q, k in said) >= 0.98 * len(said)


def test_quality_without_rows_or_votes(rows):
    assert quality.judge(rows([], "doc_id long, text string")).collect() == []
    assert [r["kept"] for r in quality.judge(rows([(None, None), (1, "")], "doc_id long, text string")).collect()] == [False, False]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_has_no_free_slot(vocabulary):
    assert sorted(vocabulary.hash.slots) == list(range(len(vocabulary.keys)))
    assert all(vocabulary.hash.slot(k) == i for i, k in enumerate(vocabulary.keys))
    for n in (1, 2, 7):
        keys = [bytes([i]) for i in range(n)]
        assert sorted(bpe.PerfectHash(keys).slot(k) for k in keys) == list(range(n))


def test_tokens_of_odd_texts(rows, vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    more = ["<|endoftext|>", "it's 12 　x", "\x00\x01é😀" * 9, "ab" * 9000, " " * 999 + "z", "Ωμέγα ǅ ٣"]
    docs = list(enumerate(ODD + more))
    df = with_clashes(rows, docs)
    encoded = bpe.encode(df, vocabulary)
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in encoded.collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in docs}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(encoded, vocabulary).collect()} == {i: (t or "").encode() for i, t in docs}
    assert bpe.encode(rows([], "doc_id long, text string"), vocabulary).collect() == []


def test_token_query_equals_the_public_encoder(spark, sf_dir, reference):
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, len(e := reference.encode_ordinary(t or "")), digest(np.array(e, "<u4").tobytes()), digest((t or "").encode())) for i, t in texts.items()}
    assert {tuple(r) for r in queries.QUERIES["op4_byte_bpe"](spark, sf_dir).collect()} == want


def plain_targets(sizes, repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(repeats * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        above = {s for s in rest if level * weight[s] > repeats * sizes[s]}
        if not above:
            return {s: repeats * sizes[s] if s in full else level * weight[s] for s in names}
        full |= above


SIZES = {"a": 900, "b": 40, "Z": 3000, "é": 7, None: 500, "": 60, "empty": 0}


@pytest.fixture(scope="module")
def sources():
    docs, n = [], 0
    for source, size in SIZES.items():
        while size > 0:
            k = min(size, 1 + n * 7 % 90)
            docs.append((n, " ".join(["w"] * k), source, "en"))
            size, n = size - k, n + 1
        docs.append((n, None, source, "en"))
        n += 1
    return docs


def test_mix_keeps_targets_and_reruns(rows, sources):
    df = with_clashes(rows, sources, ", source string, lang string")
    got = mixing.mix(df, block_words=8).collect()
    want = plain_targets(SIZES)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == SIZES[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 16 for s in want)
    again = mixing.mix(df.orderBy(F.desc("doc_id")), block_words=8).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_takes_the_words_it_counts(rows, sources):
    df = rows(sources, "doc_id long, text string, source string, lang string")
    for r in mixing.mix(df, block_words=8, carry=["text"]).collect():
        text = mixing.taken_text(r["text"], r["whole"], r["first_word"], r["extra"], r["blocks"], r["turn"], r["block_words"])
        assert len(brute.WORD.findall(text)) == r["taken"]


def test_seats_go_to_the_highest_quotients(rows):
    r = np.random.default_rng(2)
    parties = [(g, p, int(v), seats) for g, seats in ((0, 1), (1, 7), (2, 500), (3, 0)) for p, v in enumerate(r.integers(0, 1000, 9))]
    parties += [(4, 0, 10, 3), (4, 1, 10, 3), (5, 0, 0, 2)]
    table = rows(parties, "g long, p long, votes long, seats long")
    got = mixing.sainte_lague(table, ["g"], "p", "votes", "seats")
    grouped = mixing.sainte_lague_of_groups(table, "g", "p", "votes", "seats")
    assert sorted(map(tuple, grouped.collect())) == sorted(map(tuple, got.select("g", "p", "quota").collect()))
    want = {(g, p): 0 for g, p, _, _ in parties}
    for g in range(5):
        own = [x for x in parties if x[0] == g]
        quotients = sorted((-v / (2 * i + 1), p) for _, p, v, _ in own if v for i in range(own[0][3] + 1))
        for _, p in quotients[: own[0][3]]:
            want[g, p] += 1
    assert {(r["g"], r["p"]): r["quota"] for r in got.collect()} == want


@pytest.mark.parametrize("seats", [0, 1, 7, 500, 5000])
def test_seats_of_many_parties_are_ranked_over_all_tasks(rows, seats):
    votes = [float(v) for v in np.random.default_rng(3).integers(0, 40, 300)]  # many equal quotients
    parties = rows(list(enumerate(votes)), "p long, votes double")
    got = mixing.sainte_lague_of_all(parties, "p", "votes", seats)
    quotients = sorted((-v / (2 * i + 1), p) for p, v in enumerate(votes) if v for i in range(seats + 1))
    want = Counter(p for _, p in quotients[:seats])
    assert {r["p"]: r["quota"] for r in got.collect()} == {p: want[p] for p in range(300)}
    assert "row_number" not in got._jdf.queryExecution().toString()


def test_mix_without_rows_or_words(rows):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(rows([], schema)).collect() == []
    assert [r["taken"] for r in mixing.mix(rows([(1, None, None), (None, "", "a")], schema)).collect()] == [0, 0]


PAGE = """<!doctype html><html><head><title>no</title></head><body class="c-7"><div id=nav><p>Menu menu menu menu menu menu menu</div>
<div class="post-12 body"><h1>A &amp; B</h1><p>First   long paragraph of running&nbsp;text<br>with a break, and <a href=x>a link</a>.
<p>Second &#233;t&eacute; paragraph of running text &lt;tag&gt;, quite long.<ul><li>One<li>Two</ul><form><p>Sign up</form>
<div class="comments"><p>A reader says something long about this article here.</div></div>
<aside><p>Aside aside aside aside aside aside aside aside aside</aside><script>if (a</p>b) x();</script><footer>Foot</footer>"""
TEXT = "A & B\nFirst long paragraph of running text with a break, and a link.\nSecond été paragraph of running text <tag>, quite long.\nOne\nTwo"


def test_pages_follow_their_host(rows):
    short = PAGE.replace("First   long", "A").replace("<aside><p>", '<div class="box"><p>Much longer text beside it that is no article at all, but very long. </div><aside><p>')
    pages = [(i, f"http://H.example/{i}", PAGE.replace("post-12", f"post-{i}"), "x", "y") for i in range(5)]
    pages += [(9, "http://h.example:80/q", '<div class="post-9 body"><p>Hi.</div><div class="box"><p>' + "Long text of some other box. " * 9, "x", "y")]
    pages += [(10, None, PAGE, "x", "y"), (11, "nonsense", None, "x", "y"), (12, "http://e.example", "", "x", "y"), (13, "http://e.example", "plain text", "x", "y")]
    pages += [(14, "http://e.example/x", "<p>" * 3000 + "deep" + "</div>" * 50, "x", "y"), (15, "http://h.example/s", short, "x", "y")]
    got = {r["page_id"]: r["text"] for r in webtext.extract(rows(pages, "page_id long, url string, html string, host string, winners string")).collect()}
    assert {got[i] for i in (0, 1, 2, 3, 4, 10)} == {TEXT}
    assert got[9] == "Hi." and got[11] == got[12] == "" and got[13] == "plain text" and got[14] == "deep"
    assert got[15] == TEXT.replace("First long", "A")


def test_page_query_equals_the_articles(spark, sf_dir):
    """In the driver's pages the article element holds exactly the main text."""
    from html import unescape

    want = set()
    for page_id, html in duckdb.sql(f"select page_id, html from '{sf_dir}/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)</article>", html, re.S)[1].replace("<br>", " ")
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body))
        text = "\n".join(t for p in parts if (t := " ".join(unescape(p).split())))
        want.add((page_id, text, len(text)))
    got = queries.QUERIES["op5_html_extraction"](spark, sf_dir).select("page_id", "text", "n_chars")
    assert {tuple(r) for r in got.collect()} == want


def extracted_pages(rows, pages):
    found = webtext.extract(rows([(i, f"http://h.example/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string"))
    return {r["page_id"]: r["text"].split("\n") for r in found.collect()}


SAID = "A long sentence of running text that stands in the article, part {}."


def test_pages_keep_all_parts_of_an_article(rows):
    """Tables, quote boxes and sections inside of the article stay, and its sibling sections too; no article element."""
    inner = "<p>{0}</p><table><tr><td>cell</td></tr></table><div class=quote><p>{1}</p></div><section><p>{2}</p></section>"
    said = [SAID.format(i) for i in range(3)]
    post = "<div class=wrap><div class=post>" + inner.format(*said) + "</div><div class=box><p>Box</div></div>"
    assert list(extracted_pages(rows, [post] * 4).values()) == [[said[0], "cell", *said[1:]]] * 4
    parts = "".join(f"<section class={c}><p>{t * n}</p></section>" for c, t, n in zip(("lead", "body", "end"), said, (1, 5, 2), strict=True))
    want = [said[0], said[1] * 5, said[2] * 2]
    assert list(extracted_pages(rows, [f"<div class=post>{parts}</div>"] * 4).values()) == [want] * 4
    assert list(extracted_pages(rows, [parts] * 4).values()) == [want] * 4


def test_pages_of_two_templates_and_deep_ones(rows):
    one = [f"<div class=wrap><div class=post><p>{SAID}</div><div class=box><p>Beside</div></div>"] * 6
    two = [f"<div class=wrap><div class=product><p>{SAID * 2}</div><div class=box><p>Beside</div></div>"] * 3
    got = extracted_pages(rows, one + two + ["<div class=x>" * 20_000 + SAID])
    assert all(got[i] == [SAID] for i in (*range(6), 9)) and all(got[i] == [SAID * 2] for i in range(6, 9))


@pytest.mark.parametrize(("head", "names"), [("<!doctype html>", ["svg"]), ('<?xml version="1.0"?>', ["svg", "iframe", "object", "canvas", "script"]), ('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN" "x">', ["iframe"]), ('<html xmlns="http://www.w3.org/1999/xhtml">', ["canvas"])])
def test_self_closed_elements_swallow_nothing(head, names):
    for name in names:
        for icon in (f"<{name}/>", f"<{name} class=icon/>", f'<{name} title="a > b" />', f"<{name}>out</{name}>"):
            page = f"{head}{icon}<article><p>Before {icon}it.</p>{icon}<p>After.</p></article>"
            assert [text for _, text, *_ in webtext.blocks(page)] == ["Before it.", "After."], page
    assert [text for _, text, *_ in webtext.blocks("<p>a<iframe src=x/>raw</iframe>b<svg><path d=x/>raw</svg>")] == ["ab"]


AROUND_NOT = ["content has-sidebar", "no-sidebar", "with-sidebar", "login-required", "entry comments-open", "search-results", "search"]


def test_pages_keep_wrappers_and_headings_with_odd_names(rows):
    ids = ["related-work", "navier-stokes", "promotion-rules", "side-effects", "share-prices", "recommendations", "search"]
    inner = "".join(f"<h2 id={i}>Head {i}</h2><section id={i}><p id={i}>{SAID.format(i)}</p></section>" for i in ids)
    junk = '<div class="post-comments"><p>A reader says something long about this article here.</div><div class="widget-area-2"><p>Much other text of a box.</div>'
    want = [x for i in ids for x in (f"Head {i}", SAID.format(i))]
    for c in AROUND_NOT:
        pages = [f'<div class="{c}">{inner}</div>{junk}', f'<div class="page"><div class="{c}">{inner}{junk}</div></div>', f"<article>{inner}{junk}</article>"]
        for page in pages:
            assert webtext.extracted(webtext.blocks(page), None).split("\n") == want, (c, page)
    short = '<div class="search"><p>Little.</div><div class="comments"><p>' + SAID * 3 + "</div>"
    pages = [f'<div class="search">{inner}</div><div class="comments"><p>{SAID}</div>'] * 5 + [short]
    got = extracted_pages(rows, pages)
    assert all(got[i] == want for i in range(5)) and got[5] == ["Little."]


def test_a_page_of_comments_does_not_open_them_for_its_host(rows):
    said = [SAID * 20] * 3 + ["Short."]
    page = '<div class="post"><p>{}</div><div class="comments"><p>' + SAID * 20 + "</div>"
    assert extracted_pages(rows, [page.replace("{}", s, 1) for s in said]) == {i: [s] for i, s in enumerate(said)}


def numbered(pattern, n=10):
    return [re.sub(r"\{(\w+)\}", lambda m: f"{m[1]} of page {i}, with some words of its own {i * 7}", pattern) for i in range(n)]


HANDWRITTEN = [
    # A heading outside of the container that holds the text; a footer nobody marked, and a list of links.
    (
        "<body><h1>{Title}</h1><div class=content><p>{First}</p><p>{Second} " + "and more of it " * 20 + "</p></div>"
        "<div class=bottom-line><p>All rights reserved by nobody.</p></div><div class=more><p><a href=x>{Linked}</a></p></div>",
        ["{Title}", "{First}", "{Second} " + ("and more of it " * 20).strip()],
    ),
    # Lead, body and end in containers of their own, the body holding most of the text.
    (
        "<div class=top><p>The same on all pages, every time.</p></div><div class=post><div class=lead><p>{Lead}</p></div>"
        "<div class=body><p>{Body} " + "going on and on " * 60 + "</p></div><div class=end><p>{End}</p></div></div>",
        ["{Lead}", "{Body} " + ("going on and on " * 60).strip(), "{End}"],
    ),
    # An article made of table cells.
    (
        "<table><tr><td class=m>Home</td></tr></table><table class=text><tr><td>{One} " + "in a cell " * 10 + "</td><td>{Two} " + "in a cell " * 10
        + "</td></tr></table>",
        ["{One} " + ("in a cell " * 10).strip(), "{Two} " + ("in a cell " * 10).strip()],
    ),
    # Marked parts stay out, whatever they say.
    ("<h2>{Head}</h2><div class=text><p>{Text} " + "of an article " * 20 + "</p></div><div class=comments><p>{Comment}</p></div>", ["{Head}", "{Text} " + ("of an article " * 20).strip()]),
]


@pytest.mark.parametrize("case", range(len(HANDWRITTEN)))
def test_pages_without_an_article_element_keep_what_is_their_own(rows, case):
    pattern, want = HANDWRITTEN[case]
    got = extracted_pages(rows, numbered(pattern))
    wanted = [numbered(w) for w in want]
    assert got == {i: [w[i] for w in wanted] for i in range(10)}


def test_two_templates_of_one_host_and_repeated_pages(rows):
    pages = numbered(HANDWRITTEN[0][0]) + numbered(HANDWRITTEN[1][0]) + numbered(HANDWRITTEN[0][0], 3)
    got = extracted_pages(rows, pages)
    for case, offset, n in ((0, 0, 10), (1, 10, 10), (0, 20, 3)):
        wanted = [numbered(w) for w in HANDWRITTEN[case][1]]
        assert {i: got[offset + i] for i in range(n)} == {i: [w[i] for w in wanted] for i in range(n)}


def test_pages_joined_by_shuffle_and_without_rows(rows, monkeypatch):
    monkeypatch.setattr(webtext, "BROADCAST_BYTES", -1)
    pages = rows([(1, "http://a.b/c", PAGE)], "page_id long, url string, html string")
    assert webtext.extract(pages).first()["text"] == TEXT
    assert webtext.extract(pages.limit(0)).collect() == []


PAGES = [(1, "http://a/é\r\nx", "h" * 120), (2, None, "h" * 120), (3, "http://b", "h" * 120), (4, "u", None), (5, "u", ""), (6, "u", "s" * 99), (7, "u", "s" * 99), (8, "u", "é" * 20_000), (None, "u", "h" * 120)]


def test_archive_of_odd_pages(rows, folder, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_PACKAGE", 2)
    pages = rows([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, digest string, refers_to string")
    target = folder()
    read = {r["record_id"]: r for r in warc.archive_and_read(pages, target).collect()}
    assert len(read) == len(PAGES)
    for page_id, _, html in PAGES:
        r = read[f"<urn:page:{'' if page_id is None else page_id}>"]
        data = (html or "").encode()
        later = page_id in (2, 3)
        assert (r["record_type"], r["refers_to"]) == (("revisit", "<urn:page:1>") if later else ("response", None))
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert r["payload"] is None if later else bytes(r["payload"]) == data
    assert warc.read_packages(warc.packages_in(pages.sparkSession, target)).count() == len(PAGES)


def test_rows_that_share_a_page_id_keep_their_payloads(rows):
    pages = [(1, "u", "a" * 200), (2, "u", "a" * 200), (2, "u", "b" * 200), (2, "u", "b" * 200), (3, "u", "b" * 200)]
    read = warc.archive_and_read(rows(pages, "page_id long, url string, html string")).collect()
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", bytes(r["payload"] or b"").decode()) for r in read)
    one, two, three = (f"<urn:page:{i}>" for i in (1, 2, 3))
    assert got == sorted(
        [(one, "response", "", "a" * 200), (two, "revisit", one, ""), (two, "response", "", "b" * 200)]
        + [(two, "response", "", "b" * 200), (three, "revisit", two, "")]
    )


def test_archive_without_rows(rows):
    assert warc.archive_and_read(rows([], "page_id long, url string, html string")).collect() == []


def test_archive_query_equals_sql(spark, sf_dir, duck):
    want = set(duck.execute(queries.ORACLES["op8_warc_zip"]).fetchall())
    got = queries.QUERIES["op8_warc_zip"](spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert {tuple(r) for r in got.collect()} == want


def reader(data):
    return lambda start, length: data[start : start + length]


def test_directories_with_wide_numbers():
    """A package whose sizes, offsets and count stand in ZIP64 fields only, with a comment and a packed index."""
    body = zlib.compressobj(6, zlib.DEFLATED, 31)
    record = body.compress(warc.record(3, "u", "hi", None, "d", "t")) + body.flush()
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    index = packer.compress(b'u t {"filename": "data.warc.gz", "offset": 4, "length": %d}\n' % len(record)) + packer.flush()
    out, central = b"", b""
    for name, method, data in ((b"archive/data.warc.gz", 0, b"junk" + record), (b"indexes/index.cdxj", 8, index)):
        at = len(out)
        out += b"PK\3\4" + struct.pack("<HHHIIIIHH", 45, 0, method, 0, 0, 0, 0, len(name), 5) + name + b"extra" + data
        wide = struct.pack("<HHHHQQQ", 9, 0, 1, 24, len(data), len(data), at)
        central += b"PK\1\2" + struct.pack("<HHHHIIIIHHHHHII", 45, 45, 0, method, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 2, 0, 0, 0, 0xFFFFFFFF) + name + wide + b"cc"
    end64 = len(out) + len(central)
    data = out + central + b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 2, 2, len(central), len(out))
    data += b"PK\6\7" + struct.pack("<IQI", 0, end64, 1) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 5) + b"hello"
    [(start, length)] = warc.locate(reader(data), len(data))
    assert data[start : start + length] == record


def test_bad_packages_are_refused():
    with pytest.raises(ValueError, match="ZIP"):
        warc.locate(reader(b"x" * 99), 99)
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("archive/data.warc.gz", b"abc" * 99, zipfile.ZIP_DEFLATED)
        z.writestr("indexes/index.cdxj", 'u t {"filename": "data.warc.gz", "offset": 0, "length": 3}\n')
    with pytest.raises(ValueError, match="compressed"):
        warc.locate(reader(file.getvalue()), len(file.getvalue()))


def forward(model, sequence):
    a = [float(s) * float(model.emit[i][sequence[0]]) for i, s in enumerate(model.start)]
    for k in sequence[1:]:
        a = [sum(a[i] * float(model.move[i][j]) for i in range(len(a))) * float(model.emit[j][k]) for j in range(len(a))]
    return math.log10(sum(a))


def test_forward_and_expected_counts():
    r = np.random.default_rng(4)
    model = hmm.Model.first(r.random(hmm.CLASSES) * 50)
    sequences = [r.integers(0, hmm.CLASSES, n).astype("<u2") for n in (1, 5, 2, 5, 9)]
    batch = hmm.Batch(sequences)
    assert np.allclose(batch.log10(model), [forward(model, s) for s in sequences])
    start, move, emit = batch.counts(model)
    assert np.allclose(start.sum(), 5, rtol=1e-4) and np.allclose(move.sum(), 22 - 5, rtol=1e-3)
    assert np.allclose(emit.sum(axis=0), np.bincount(np.concatenate(sequences), minlength=hmm.CLASSES), atol=1e-3)
    paths = list(itertools.product(range(hmm.STATES), repeat=2))
    two = hmm.Batch([sequences[2]]).counts(model)[1]
    p = np.array([model.start[i] * model.emit[i][sequences[2][0]] * model.move[i][j] * model.emit[j][sequences[2][1]] for i, j in paths])
    assert np.allclose(two.ravel(), p / p.sum(), atol=1e-4)


def test_training_makes_the_texts_likelier():
    r = np.random.default_rng(5)
    sequences = [np.array([*(r.integers(0, 40, 30) + 40 * (i % 3)), hmm.END], "<u2") for i in range(60)]
    batch, model, before = hmm.Batch(sequences), hmm.Model.first(np.bincount(np.concatenate(sequences), minlength=hmm.CLASSES)), -1e9
    for _ in range(5):
        now = batch.log10(model).sum()
        assert now > before
        before, model = now, hmm.Model.from_counts(*batch.counts(model))


def plain_base(docs):
    tokens = {i: [*brute.WORD.findall((t or "").translate(brute.UPPER)), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for i, x in tokens.items()}


@pytest.mark.parametrize("frequent", [hmm.FREQUENT, 4])
def test_scores_of_odd_texts(rows, frequent, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    docs = list(enumerate([*ODD, *(" ".join(ODD[6:9]), "b a c A zz", "Z z é ß a")]))
    got = {r["doc_id"]: r for r in hmm.score(with_clashes(rows, docs)).collect()}
    for i, (held, n, known, total, base) in plain_base(docs).items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base) and -math.inf < r["score"] < 0


@pytest.mark.parametrize("frequent", [hmm.FREQUENT, 4])
def test_score_is_the_likelihood_of_the_whole_text(rows, frequent, monkeypatch):
    """The forward recursion over every word's class, times the word's share of its class, one text at a time."""
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    trained = []
    train = hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: (trained.append((train(*a), a[1])), trained[-1][0])[1])
    docs = list(enumerate([*ODD[:9], "b a c A zz", "Z z é ß a", "unseen words here", "a a a b b zz zz c"]))
    got = {r["doc_id"]: r["score"] for r in hmm.score(rows(docs, "doc_id long, text string")).collect()}
    [(model, class_n)] = trained
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: [w.encode() for w in brute.WORD.findall((t or "").translate(brute.UPPER))] for i, t in docs}
    c = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    steps = sorted({math.floor(8 * math.log2(n)) for n in c.values()}, reverse=True)
    top: list[bytes] = []
    for step in steps:
        more = [w for w, n in c.items() if math.floor(8 * math.log2(n)) == step]
        if len(top) + len(more) > frequent:
            break
        top += more
    top.sort(key=lambda w: (-c[w], w.decode()))
    class_of = {w: i if i < hmm.OWN_CLASS else hmm.shared_class(w) for i, w in enumerate(top)}
    kinds = Counter(class_of.get(w, hmm.shared_class(w)) for w in c)
    for i, words in tokens.items():
        classes = [class_of.get(w, hmm.shared_class(w)) for w in words]
        want = forward(model, [*classes, hmm.END])
        for w, k in zip(words, classes, strict=True):
            if k >= hmm.OWN_CLASS:
                want += math.log10((c[w] + 1) / (class_n[k] + kinds[k] + 1))
        assert got[i] == pytest.approx(want, rel=1e-6), i


def test_score_query_beats_the_base_on_held_out_texts(spark, sf_dir):
    got = queries.QUERIES["op6_hmm_scores"](spark, sf_dir).toPandas()
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    want = plain_base(docs)
    assert all(r.base_score == pytest.approx(want[r.doc_id][4]) for r in got.itertuples())
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() + 0.1 * held["n_tokens"].sum()


def test_scores_without_rows_or_training(rows):
    assert hmm.score(rows([], "doc_id long, text string")).collect() == []
    r = hmm.score(rows([(None, "a b")], "doc_id long, text string")).first()
    assert (r["held_out"], r["n_known"], r["train_tokens"]) == (True, 0, 0) and r["base_score"] == 0.0


def test_pipeline_stages_equal_plain_versions(spark, sf_dir, reference):
    docs = queries.table(spark, sf_dir, "documents")
    for (name, stage), k in zip(corpus_pipeline.STAGES, itertools.count()):
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        after = corpus_pipeline.materialize(stage(spark, docs, sf_dir), f"test-{k}")
        rows = {r["doc_id"]: r.asDict() for r in after.collect()}
        assert len(rows) == after.count()
        texts = [(i, r["text"]) for i, r in before.items()]
        if k < 4:
            assert set(after.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        if name == "quality rules":
            assert all(rows[i] == before[i] for i in rows)
            assert set(rows) == {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
        elif name == "line dedup":
            assert {(i, hashlib.sha256(r["text"].encode()).hexdigest()) for i, r in rows.items()} == {(x[0], x[3]) for x in brute.lines_kept(texts)}
        elif name == "simhash near-dedup":
            assert set(rows) == {i for i, _, c in brute.simhash_components(texts) if i == c} and all(rows[i] == before[i] for i in rows)
        elif name == "mixing":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
            assert {i: len(brute.WORD.findall(r["text"])) for i, r in rows.items()} == taken
        else:
            assert {i: r["n_tokens"] for i, r in rows.items()} == {i: len(reference.encode_ordinary(t)) for i, t in texts}
        docs = after
    sums = defaultdict(int)
    for r in docs.collect():
        sums[r["ids_sha256"]] += 1
    again = Counter(r["ids_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert again == sums


def test_pipeline_stages_take_odd_rows_and_clashing_names(spark, rows):
    names = "doc_id long, text string, lang string, source string, n_chars long, wanted string, kept string, row string, of long"
    data = [(i, t, "en", f"s{i % 2}", len(t or ""), "w", "k", "r", 1) for i, t in enumerate(ODD)]
    data += [(None, None, None, None, None, None, None, None, None), (3, "shared id " * 60, "en", None, 600, "w", "k", "r", 1)]
    for some in (data, []):
        docs = rows(some, names)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, "")
            ids = {r["doc_id"] for r in after.collect()}
            assert ids <= {d[0] for d in some}, name
            if name in ("quality rules", "simhash near-dedup"):
                assert after.columns == docs.columns
