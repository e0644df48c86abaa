"""The ring against a fold over single rows, and what it promises about balance and movement."""

import hashlib
import zlib

import pytest

from weirflow.llm import queries, sharding

COLUMNS = ["doc_id", "size", "text_crc32", "shard", "slot"]


def _ring(text):
    return "0" * 32 if text is None else hashlib.md5(text.encode()).hexdigest()


def folded(docs, shards, virtual=sharding.VIRTUAL, slack=0.0):
    """Rows dealt one at a time: round by round, places in order, each to the next shard clockwise."""
    nodes = sorted(
        (int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:4], 16), s) for s in range(shards) for v in range(virtual)
    )
    n = len(docs)
    room = [n // shards + (s < n % shards) for s in range(shards)] if not slack else [-(-n * (1 + slack) // shards)] * shards
    waiting = []
    for doc_id, text in docs:
        data = (text or "").encode()
        order = int(hashlib.md5(f"{'' if doc_id is None else doc_id}:{_ring(text)}".encode()).hexdigest()[:15], 16)
        waiting.append((int(_ring(text)[:4], 16), order, (doc_id, len(data) + 1, zlib.crc32(data))))
    waiting.sort(key=lambda w: (w[0], w[1], str(w[2])))
    taken, out = [0] * shards, []
    for turn in range(shards):
        later = []
        for place, order, row in waiting:
            met = list(dict.fromkeys(s for _, s in sorted(nodes, key=lambda x: ((x[0] - place) % sharding.PLACES, x[1]))))
            shard = met[turn]
            if taken[shard] < room[shard]:
                out.append((*row, shard, taken[shard]))
                taken[shard] += 1
            else:
                later.append((place, order, row))
        waiting = later
    return out


def dealt(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def odd_rows():
    prose = [(i, f"text {i}") for i in range(60)]
    hot = [(100 + i, "the same text") for i in range(40)]
    odd = [(None, None), (None, None), (None, "x"), (3, "text 3"), (3, "text 3"), (7, None), (8, ""), (9, "é" * 9000), (-4, " ")]
    return prose + hot + odd + [(500, "equal rows")] * 30


@pytest.mark.parametrize(("shards", "virtual", "slack"), [(1, 1, 0.0), (4, 2, 0.0), (5, 16, 0.0), (4, 8, 0.25), (200, 1, 0.0)])
def test_shards_equal_a_fold_over_rows(rows, shards, virtual, slack):
    docs = odd_rows()
    got = dealt(sharding.shard(rows(docs, "doc_id long, text string"), shards, virtual, slack))
    assert got == sorted(folded(docs, shards, virtual, slack), key=str)


def test_large_places_are_ranked_in_cells(rows, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 2)
    monkeypatch.setattr(sharding, "_COPIES_AT_ONCE", 4)
    docs = odd_rows()
    assert dealt(sharding.shard(rows(docs, "doc_id long, text string"), 4)) == sorted(folded(docs, 4), key=str)


def test_empty_table_and_clashing_names(rows):
    empty = rows([], "doc_id long, text string")
    assert sharding.shard(empty).collect() == []
    names = "doc_id long, text string, shard string, slot string, place string, rank long, copies long, size string"
    clash = rows([(i, f"t{i}", "a", "b", "c", 1, 2, "d") for i in range(20)], names)
    assert dealt(sharding.shard(clash, 3)) == sorted(folded([(i, f"t{i}") for i in range(20)], 3), key=str)


def test_query_is_balanced_and_gapless(spark, sf_dir):
    got = queries.QUERIES["op12_ring_shards"](spark, sf_dir).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()


def moved(counts, shards, slack):
    before, after = (
        {(p, r + k): s for p, s, r, n, _ in sharding.fill(counts, k_shards, 64, slack) for k in range(n)}
        for k_shards in (shards, shards + 1)
    )
    return sum(before[k] != after[k] for k in before) / len(before)


def test_one_more_shard_moves_few_rows():
    counts = {int(hashlib.md5(str(i).encode()).hexdigest()[:4], 16): 1 for i in range(20_000)}
    # 1 / 17 has to move; dealing all rows anew would move 16 / 17.
    assert moved(counts, 16, 0.5) < 0.08
    assert moved(counts, 16, 0.0) < 0.35
