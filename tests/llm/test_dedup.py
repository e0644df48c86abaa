"""Operators that find copies, against plain versions on hard small inputs and on the driver's table."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import graph, lines, pivots, postings, queries, simhash, substrings

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
CLASHES = ", fp string, rep string, key string, n long, component_id string, h double"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(LOREM) + r.choice(["", "", ".", f"{r.randrange(99)}"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    base = prose(1, 120)
    texts = [None, "", " \t\n", "one", "one two", base, base, base.upper(), base + " end", prose(2, 3000), "x" * 5000, "é " * 300, base + "\x0b\x0c"]
    return list(enumerate(texts))


def with_clashes(rows, docs):
    """The same documents with columns that carry the operators' own names."""
    data = [(i, t, "x", "y", "z", 7, "c", 0.5) for i, t in docs]
    return rows(data, "doc_id long, text string" + CLASHES)


@pytest.fixture(scope="module")
def small(sf_dir, spark):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return [tuple(r) for r in docs.collect()]


def found_simhash(df):
    return {tuple(r) for r in df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()}


def test_simhash_of_odd_texts(rows, odd_texts):
    assert found_simhash(simhash.near_duplicates(with_clashes(rows, odd_texts))) == brute.simhash_components(odd_texts)


def test_simhash_query_equals_brute_force(spark, sf_dir, small):
    got = {tuple(r) for r in queries.QUERIES["op3_simhash_near_dedup"](spark, sf_dir).collect()}
    assert got == brute.simhash_components(small)


@pytest.mark.parametrize("segments", [4, 8, 16])
def test_ring_of_segments_loses_no_link(rows, segments):
    r = random.Random(segments)
    seeds = [r.getrandbits(64) for _ in range(30)]
    fps = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for s in seeds for _ in range(12)})
    table = rows([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    for block in (3, postings.BLOCK):  # lists cut into blocks, and whole
        pairs = [tuple(x) for x in simhash.links(table, segments=segments, block=block).collect()]
        want = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
        assert brute.smallest_reachable(range(len(fps)), pairs) == brute.smallest_reachable(range(len(fps)), want)


def test_simhash_without_rows_or_id(rows):
    assert simhash.near_duplicates(rows([], "doc_id long, text string")).collect() == []
    got = simhash.near_duplicates(rows([(None, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string"))
    assert sorted((r[0] or 0, r[2] or 0) for r in got.collect()) == [(0, 0), (4, 4), (4, 4)]


def test_components_of_a_chain_a_star_and_rings(rows):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r["node"]: r["component"] for r in graph.components(rows(links, "a long, b long")).collect()}
    want = brute.smallest_reachable({x for e in links for x in e}, links)
    assert {n: got.get(n, n) for n in want} == want


LINES = [
    (1, "Shared line here\nown line one\nshort\nshort"),
    (2, "  SHARED LINE HERE\t\nshort\nanother own line"),
    (3, "shared line here\nshared line here\n\n"),
    (4, None),
    (5, ""),
    (6, "ÉCOLE publique ici\ntwice in one\ntwice in one"),
    (7, "école publique ici\nexactly10!"),
    (8, "\x0bexactly10!\x0c"),
    (9, "z" * 50_000 + "\nown line nine"),
    (10, "z" * 50_000),
]


def cut_lines(df, **more):
    cut = lines.deduplicate_lines(df, **more)
    return {tuple(r) for r in cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()}


def test_lines_of_odd_texts(rows):
    assert cut_lines(with_clashes(rows, LINES)) == brute.lines_kept(LINES)


def test_lines_with_a_filter_too_small_to_help(rows, monkeypatch):
    monkeypatch.setattr(lines, "MAX_BITS", lines._PAGE)
    docs = [(i, "\n".join(prose(i * 100 + k % (7 + i), 5) for k in range(30))) for i in range(40)]
    assert cut_lines(rows(docs, "doc_id long, text string")) == brute.lines_kept(docs)


def test_lines_query_equals_brute_force(spark, sf_dir, small):
    assert {tuple(r) for r in queries.QUERIES["op9_line_dedup"](spark, sf_dir).collect()} == brute.lines_kept(small)


def test_lines_without_rows_or_id(rows):
    assert cut_lines(rows([], "doc_id long, text string")) == set()
    docs = rows([(None, "one and the same"), (3, "one and the same"), (3, "one and the same")], "doc_id long, text string")
    assert [r["n_dropped"] for r in lines.deduplicate_lines(docs).collect()] == [0, 0, 0]


def test_lines_keep_named_columns(rows):
    docs = rows([(1, "x", [1, 2], {"a": 1.5})], "doc_id long, text string, tags array<int>, more map<string,double>")
    assert lines.deduplicate_lines(docs, keep=["tags", "more"]).first()[2:4] == ([1, 2], {"a": 1.5})


def test_repeats_in_odd_texts(rows):
    passage = prose(7, 90)[:420]
    docs = [
        (1, prose(11, 200) + passage + prose(12, 150)),
        (2, passage[:410] + prose(13, 100)),
        (3, "Und " * 400),
        (4, "a" * 3000),
        (5, passage[5:404]),  # 399 bytes: no string of 400
        (6, prose(14, 300)),
        (7, prose(14, 300)[:800] + "!" + prose(14, 300)[801:]),
        (8, None),
        (9, ""),
        (10, "ü" * 100 + prose(11, 200)[-500:] + "é"),
    ]
    got = substrings.remove_repeats(with_clashes(rows, docs))
    got = {tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == brute.repeats_removed(docs)


def test_repeats_are_found_at_any_length_and_chunk(rows, monkeypatch):
    monkeypatch.setattr(substrings, "_CHUNK", 700)
    monkeypatch.setattr(substrings, "_STARTS", 8)
    docs = [(i, prose(i % 6, 150 + i) + prose(i, 20)) for i in range(12)]
    got = substrings.remove_repeats(rows(docs, "doc_id long, text string"), 60)
    got = {tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == brute.repeats_removed(docs, 60)


def test_crowded_cores_are_cut_into_shorter_pieces(rows, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_PIECES", 1)
    monkeypatch.setattr(substrings, "_STARTS", 32)
    base = prose(5, 120)
    docs = [(i, base[: 40 * i] + prose(100 + i, 3) + base[40 * i + 9 :]) for i in range(1, 12)] + [(20, base), (21, base)]
    got = substrings.remove_repeats(rows(docs, "doc_id long, text string"), 80)
    got = {tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == brute.repeats_removed(docs, 80)


def test_repeats_query_equals_brute_force(spark, sf_dir, small):
    got = queries.QUERIES["op7_repeated_substrings"](spark, sf_dir).collect()
    assert {tuple(r)[:5] for r in got} == brute.repeats_removed(small)
    texts = dict(small)
    for r in got:
        assert r["untouched"] == (r["n_removed"] == 0)
        assert r["kept_text"] == (texts[r["doc_id"]] or "") if r["untouched"] else len(r["kept_text"]) < len(texts[r["doc_id"]])


def test_repeats_without_rows_or_id(rows):
    assert substrings.remove_repeats(rows([], "doc_id long, text string")).collect() == []
    text = prose(3, 100)
    got = substrings.remove_repeats(rows([(None, text), (None, text), (5, prose(4, 100))], "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["n_bytes"] == r["n_removed"]) for r in got.collect()) == [(0, True), (0, True), (5, False)]


def vectors():
    r = np.random.default_rng(3)
    out = []
    for _ in range(25):
        v = r.normal(size=24)
        out += [v + r.normal(size=24) * s for s in (0, 0.05, 0.1, 0.15, 0.2, 0.25)]
    out += [out[0]] * 20 + [out[0] * 3.0]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]


def linked(vecs, least=0.95):
    ok = [(i, np.array(v)) for i, v in vecs if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: v / np.linalg.norm(v) for i, v in ok}
    ids = sorted(unit)
    return [(a, b) for n, a in enumerate(ids) for b in ids[:n] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_near_the_limit_and_odd_ones(rows, kind):
    vecs = vectors()
    odd = [None, [], [0.0] * 24, [None, *[1.0] * 23], [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [1.0, 2.01]]
    vecs += [(1000 + i, v) for i, v in enumerate(odd)]
    data = [(i, v, 1, "x", "y") for i, v in vecs]
    got = pivots.near_duplicates(rows(data, f"vec_id long, embedding array<{kind}>, label int, vec string, size string")).collect()
    pairs = linked(vecs)
    n = dict.fromkeys((i for i, _ in vecs), 0)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    found = {r["vec_id"]: r["n_links"] for r in got}
    assert len(got) == len(vecs) and all(found[i] <= n[i] for i in n)
    assert sum(found.values()) >= 0.97 * sum(n.values())
    assert all(found[i] == 0 for i in range(1000, 1006)) and found[1006] == found[1007] == 1
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_recall_of_the_index_on_the_table_of_the_driver(spark):
    """All rows are indexed; links found are real, and at least nine in ten are found."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    r = np.random.default_rng(1)
    base = [(x["vec_id"], x["embedding"]) for x in table.limit(400).collect()]
    near = [(10_000 + i, [float(x) for x in np.array(v) + r.normal(size=len(v)) * s]) for i, v in base for s in (0.02, 0.035)][::2]
    vecs = [(i, [float(np.float32(x)) for x in v]) for i, v in base + [(20_000 + k, v) for k, (_, v) in enumerate(near)]]
    got = pivots.near_duplicates(spark.createDataFrame(vecs, "vec_id long, embedding array<float>"))
    want = 2 * len(linked(vecs))
    assert want > 100 and want >= got.agg(F.sum("n_links")).first()[0] >= 0.9 * want


def test_vectors_without_rows(rows):
    assert pivots.near_duplicates(rows([], "vec_id long, embedding array<float>")).collect() == []
    got = pivots.near_duplicates(rows([(1, None), (None, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in got.collect()) == [(0, 0), (1, 0), (2, 0)]


def test_lines_in_several_rounds_of_small_filters(rows, small, monkeypatch):
    """Filters of a fixed small size: more rounds, the same lines, and no larger share of suspects."""
    docs = rows(small, "doc_id long, text string")
    one = lines.suspects(docs, 10)
    few = one.count()
    monkeypatch.setattr(lines, "MAX_BITS", 1 << 16)
    monkeypatch.setattr(lines, "_PAGE", 1 << 12)
    parted = lines.suspects(docs, 10)
    assert parted.count() <= 1.2 * few + 50
    cut = lines.deduplicate_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert {tuple(r) for r in cut.collect()} == brute.lines_kept(small)


def test_vectors_that_share_an_id_have_links_of_their_own(rows):
    e = lambda *x: [float(v) for v in x]
    data = [(1, e(1, 0, 0)), (1, e(0, 1, 0)), (2, e(1, 0.01, 0)), (3, e(0, 1, 0.01)), (4, e(0, 0, 1)), (1, e(1, 0, 0))]
    got = sorted(tuple(r) for r in pivots.near_duplicates(rows(data, "vec_id long, embedding array<double>")).collect())
    want = [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
    assert got == want
