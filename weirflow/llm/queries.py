"""One query per operator over the whole of its table, with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import bpe, clusters, hmm, lines, mixing, pivots, quality, search, sharding, simhash, substrings, warc, webtext

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# Texts and pages have no bounded length, so a batch handed to Python has few of them.
ROWS_PER_BATCH = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(*base, "base_failed", "kept", "quality")


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op2_embedding_near_dedup"] = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), u as (
  select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v where list_dot_product(e, e) > 0
), pairs as (
  select a.vec_id as a, b.vec_id as b from u a join u b
  on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) >= 0.95 * a.norm * b.norm
), reach as (
  select vec_id as a, vec_id as b from embeddings
  union
  select r.a, p.b from reach r join pairs p on r.b = p.a
), lowest as (
  select a as vec_id, min(b) as component_id from reach group by a
)
select vec_id, (select count(*) from pairs where a = vec_id) as n_links, component_id, vec_id = component_id as kept
from lowest
"""


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def tokens(docs: DataFrame) -> DataFrame:
    """Ids and decoded bytes of every text as count and digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.round_trip(docs, bpe.Vocabulary(path, public_tokenizers.PATTERN))
    return done.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"))


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = webtext.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


@query
def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") == 0).alias("untouched"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )


@query
def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(table(spark, sf_dir, "pages"))
    number = lambda c: F.nullif(F.regexp_extract(c, ":([-0-9]*)>$", 1), F.lit("")).cast("long")
    return read.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


ORACLES["op8_warc_zip"] = """
with p as (
  select page_id, coalesce(html, '') as html from pages
), d as (
  select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from p
), f as (
  select *, min(page_id) over (partition by payload_digest) as first_id from d
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to
from f
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.deduplicate_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cut.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


ORACLES["op9_line_dedup"] = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n
  from documents
), keys as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), repeated as (
  select key, min(doc_id) as first_id from keys where length(key) >= 10 group by key having count(distinct doc_id) > 1
), marked as (
  select k.*, coalesce(r.first_id < k.doc_id, false) as gone from keys k left join repeated r on k.key = r.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op10_mixing"] = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         ('0x' || substr(md5('17:' || doc_id), 1, 15))::bigint as place
  from documents
), s as (
  select source, sum(size)::bigint as source_size, count(*) as n_docs,
         row_number() over (order by source nulls last) - 1 as sid
  from d group by source
), w as (
  select *, [5, 2, 1][sid % 3 + 1] as weight, sum(source_size) over () as total from s
), o as (
  select *, row_number() over fill as k,
         (total - 3 * coalesce(sum(source_size) over (fill rows between unbounded preceding and 1 preceding), 0))::double
         / sum(weight) over (fill rows between current row and unbounded following)::double as level
  from w window fill as (order by 3.0 * source_size / weight, sid)
), lvl as (
  select min_by(level, k) as level, min(k) as k from o where level * weight <= 3 * source_size
), t as (
  select o.*, case when o.k < lvl.k then 3.0::double * source_size else lvl.level * weight end as target,
         floor(total / {mixing.BLOCK_WORDS}.0 + 0.5)::bigint as seats,
         greatest(1, ceil(source_size / {mixing.SHARD_WORDS}.0), ceil(n_docs / {mixing.SHARD_DOCS}.0))::bigint as shards
  from o, lvl
), seat as (
  select sid, seats, row_number() over (order by target / (2 * i - 1) desc, sid) as r
  from t, generate_series(1, (select max(seats) from t)) g(i) where target > 0
), sq as (
  select t.*, (select count(*) from seat where seat.sid = t.sid and r <= seat.seats) as source_quota from t
), e as (
  select d.*, sq.sid, sq.source_size, sq.target, sq.source_quota, d.place % sq.shards as shard
  from d join sq on d.source is not distinct from sq.source
), h as (
  select sid, shard, sum(size)::bigint as words, first(source_quota) as seats,
         greatest(1, ceil(sum(size) / {mixing.BLOCK_WORDS}.0))::bigint as blocks
  from e group by sid, shard
), hseat as (
  select sid, shard, seats, row_number() over (partition by sid order by words / (2 * i - 1) desc, shard) as r
  from h, generate_series(1, (select max(seats) from h)) g(i) where words > 0
), hq as (
  select h.*, least((select count(*) from hseat x where x.sid = h.sid and x.shard = h.shard and x.r <= x.seats),
                    3 * blocks) as quota,
         ('0x' || substr(md5('17:' || sid || '/' || shard), 1, 15))::bigint % blocks as turn
  from h
), p as (
  select e.*, hq.blocks, hq.turn, quota // blocks as whole, quota % blocks as extra,
         coalesce(sum(size) over (partition by e.sid, e.shard order by place, doc_id, size
                                  rows between unbounded preceding and 1 preceding), 0)::bigint as first_word
  from e join hq on e.sid = hq.sid and e.shard = hq.shard
), b as (
  select *, first_word // {mixing.BLOCK_WORDS} as b0, (first_word + size) // {mixing.BLOCK_WORDS} as b1 from p
), c as (
  select *, (b0 * extra + turn) // blocks as c0, ((b0 + 1) * extra + turn) // blocks as c0_next,
         (b1 * extra + turn) // blocks as c1, ((b1 + 1) * extra + turn) // blocks as c1_next
  from b
)
select doc_id, size::bigint as size, source_size, target,
       (whole * size + {mixing.BLOCK_WORDS} * c1 + (first_word + size) % {mixing.BLOCK_WORDS} * (c1_next - c1)
        - {mixing.BLOCK_WORDS} * c0 - first_word % {mixing.BLOCK_WORDS} * (c0_next - c0))::bigint as taken
from c
"""


@query
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


_NEAREST = """
n{0} as (
  select i, arg_min(c, (d, c)) as c, min(d) as d
  from (select v.i, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d
        from v, c{0} m) group by i
)"""
_MOVED = """
c{1} as (
  with s as (
    select n.c, k.k, sum(v.x[k.k])::bigint as s, count(*) as n from n{0} n join v using (i), range(1, 65) k(k) group by n.c, k.k
  ), f as (
    select c, list((s - ((s % n) + n) % n) // n order by k) as x from s group by c
  )
  select m.c, coalesce(f.x, m.x) as x from c{0} m left join f using (c)
)"""
ORACLES["op11_centroid_clusters"] = (
    """
with v as (
  select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as x
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
  select row_number() over (order by h, vec_id, x) - 1 as c, x from (select *, sha256('1:' || vec_id) as h from v) qualify c < 16
), """
    + ", ".join(_NEAREST.format(r) + ", " + _MOVED.format(r, r + 1) for r in range(3))
    + ", "
    + _NEAREST.format(3)
    + """
select vec_id, n.c::int as cluster, d as distance, (sum(d) over (partition by n.c))::bigint as cluster_inertia,
  (sum(d) over ())::bigint as inertia, sha256(array_to_string(m.x, ',')) as centroid_sha256
from n3 n join v using (i) join c3 m on n.c = m.c
"""
)


@query
def op12_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    law, none = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return dealt.select("doc_id", "size", "text_crc32", law, "shard", "slot", none)


# Checksums by the table of 256 remainders; the ring by folding places round by round, as in ``sharding.fill``.
ORACLES["op12_ring_shards"] = f"""
with recursive remainders as (
  select list(r order by b) as t from (
    select b, list_reduce(list_prepend(b, range(8)),
      lambda x, i: case when x % 2 = 1 then xor(3988292384, x // 2) else x // 2 end) as r
    from range(256) g(b))
), d as (
  select doc_id, text, octet_length(encode(coalesce(text, ''))) + 1 as size, coalesce(md5(text), repeat('0', 32)) as digest
  from documents
), p as (
  select *, ('0x' || substr(digest, 1, 4))::int as place,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || digest), 1, 15))::bigint as ord
  from d
), ranks as (
  select *, row_number() over (partition by place order by ord, doc_id, size) - 1 as rank from p
), nodes as (
  select s as shard, ('0x' || substr(md5(s || '/' || v), 1, 4))::int as spot
  from range(16) a(s), range({sharding.VIRTUAL}) b(v)
), meets as (
  select place, n, shard, min((spot - place + {sharding.PLACES}) % {sharding.PLACES}) as far
  from (select place, count(*) as n from p group by place), nodes group by place, n, shard
), offers as (
  select place, n, shard, row_number() over (partition by place order by far, shard) as turn,
    (select count(*) from p) // 16 + (shard < (select count(*) from p) % 16)::int as room
  from meets
), dealt as (
  select 0::bigint as round, place, n, shard, turn, room, 0::bigint as take, 0::bigint as slot0 from offers
  union all
  select round + 1, place, n, shard, turn, room,
    case when turn = round + 1 then greatest(0, least(rest, room - taken - before)) else take end::bigint,
    case when turn = round + 1 then taken + least(before, room - taken) else slot0 end::bigint
  from (select *, coalesce(sum(case when turn = round + 1 then rest else 0 end) over (
          partition by shard order by place rows between unbounded preceding and 1 preceding), 0) as before
        from (select *, n - sum(take) over (partition by place) as rest, sum(take) over (partition by shard) as taken from dealt))
  where round < 16
), parts as (
  select *, sum(take) over (partition by place order by turn) - take as first from dealt where round = 16
)
select doc_id, size::bigint as size,
  case when coalesce(text, '') = '' then 0 else xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint)),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) end::bigint as text_crc32,
  'rows' as law, shard::int as shard, (slot0 + rank - first)::bigint as slot, null::int as grown_shard
from ranks join parts using (place) cross join remainders where rank >= first and rank < first + take
"""


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


_TERMS = """unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"""
ORACLES["op13_lexical_search"] = f"""
with d as (
  select row_number() over () as d, doc_id, text from documents
), q as (
  select row_number() over () as q, item_id, text from benchmark
), asked as (
  select q, t, count(*) as times from (select q, {_TERMS} as t from q) group by q, t
), held as (
  select d, t, count(*) as tf from (select d, {_TERMS} as t from d) group by d, t
), sizes as (
  select d, sum(tf)::bigint as n from held group by d
), corpus as (
  select count(*) as n_docs, sum(n)::bigint as len from sizes
), w as (
  select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from held, corpus group by t, n_docs
), m as (
  select d, 100 - 25 + (25 * n * n_docs) // len as m from sizes, corpus
), scores as (
  select q, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from asked join held using (t) join w using (t) join m using (d) group by q, d
), ranked as (
  select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id nulls last) as rank
  from scores join d using (d) where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked join q using (q) where rank <= 20
"""
