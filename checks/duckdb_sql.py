"""The same results in plain SQL over the same tables."""

from __future__ import annotations

from checks import fixtures as fx
from checks.spark_queries import LAG_POSITIONS, MARK, POLL, SNAPSHOT_POLL, SPLIT_POLL, SYNC_POLLS

LOG = f"l as ({fx.in_sql(fx.LOG_SQL)})"
HOT_LOG = f"l as ({fx.in_sql(fx.HOT_LOG_SQL)})"
UPSERTS = f"v as ({fx.in_sql(fx.UPSERTS_SQL)}), stored as ({fx.in_sql(fx.STORED_SQL)})"
PAIR = f"src as ({fx.in_sql(fx.SOURCE_SQL)}), cpy as ({fx.in_sql(fx.COPY_SQL)})"

OP = "case when op = 'D' then 'D' else 'U' end"
TS = "case when op = 'D' then changed_at else coalesce(updated_at, changed_at) end"


def periods(source: str, keys: str, name: str = "periods") -> str:
    """CTEs for status periods of ``source`` (keys, op, status, ts, a, b = reading order)."""
    return f"""
{name}_s as (select {keys}, case when op = 'D' then null else status end as s, ts, a, b from {source}),
{name}_m as (
  select * from (select *, lag(s) over (partition by {keys} order by a, b) as prev_s from {name}_s) q
  where s is distinct from prev_s
),
{name} as (
  select {keys}, s as status, ts as valid_from, valid_to from (
    select *, lead(ts) over (partition by {keys} order by a, b) as valid_to from {name}_m
  ) q where s is not null
)"""


def survivors(source: str, keys: str, columns: str, name: str = "rows_left") -> str:
    """CTEs for the rows left by versioned upserts and deletes, starting empty."""
    return f"""
{name}_n as (select *, row_number() over (partition by {keys} order by a, b) as n from {source}),
{name}_b as (
  select *, max(case when op = 'D' then n end) over (partition by {keys}) as bar from {name}_n
),
{name} as (
  select {keys}, {columns} from (
    select *, row_number() over (partition by {keys} order by updated_at desc, n desc) as best
    from {name}_b where op <> 'D' and (bar is null or n > bar)
  ) q where best = 1
)"""


COMMIT_ORDER = f"""
c as (select tbl, pk, {OP} as op, status, amount_cents, updated_at, {TS} as ts,
             commit_lsn as a, seq as b from l)"""
QUEUE_ORDER = f"""
c as (select tbl, pk, {OP} as op, status, amount_cents, updated_at, {TS} as ts,
             poll_no as a, seq as b from l)"""

SURFACED = """
surfaced as (
  select * from (
    select *, row_number() over (partition by tbl, pk, poll_no order by commit_lsn desc, seq desc) as r from l
  ) q where r = 1 and op <> 'D'
)"""
POLLS = """
tops as (select poll_no, max(seq) as max_seq from l group by poll_no),
prev_seq as (
  select poll_no, max_seq,
         max(max_seq) over (order by poll_no rows between unbounded preceding and 1 preceding) as prev_max_seq
  from tops
)"""
MARKS = """
marks as (select poll_no, max(updated_at) as mark from surfaced group by poll_no),
prev_mark as (
  select t.poll_no,
         max(m.mark) over (order by t.poll_no rows between unbounded preceding and 1 preceding) as prev_mark
  from tops t left join marks m on t.poll_no = m.poll_no
)"""
CAPTURED = f"""
{SURFACED}, {POLLS}, {MARKS},
captured as (
  select 'commit_order' as method, tbl, pk, {OP} as op, status, amount_cents, updated_at, {TS} as ts,
         commit_lsn as a, seq as b, poll_no, seq from l
  union all
  select 'queue', tbl, pk, {OP}, status, amount_cents, updated_at, {TS}, poll_no, seq, poll_no, seq from l
  union all
  select 'sequence', tbl, pk, {OP}, status, amount_cents, updated_at, {TS}, l.poll_no, seq, l.poll_no, seq
  from l join prev_seq p on l.poll_no = p.poll_no
  where p.prev_max_seq is null or seq > p.prev_max_seq
  union all
  select 'high_watermark', tbl, pk, 'U', status, amount_cents, updated_at, {TS}, s.poll_no, seq,
         s.poll_no, seq
  from surfaced s join prev_mark p on s.poll_no = p.poll_no
  where p.prev_mark is null or updated_at > p.prev_mark
)"""
TRUTH = """
truth as (
  select * from (
    select *, row_number() over (partition by tbl, pk order by commit_lsn desc, seq desc) as r from l
  ) q where r = 1 and op <> 'D'
)"""
REPLICAS = survivors("captured", "method, tbl, pk", "status, amount_cents, updated_at", "replicas")
HISTORIES = periods("captured", "method, tbl, pk", "histories")
COUNTED_PERIODS = "select method, count(*) as periods from histories group by method"

DIFF = """
select 'orders' as tbl, cast(count(s.o_orderkey) as bigint) as source_rows,
       cast(count(*) filter (where c.o_orderkey is null) as bigint) as missing,
       cast(count(*) filter (where s.o_orderkey is not null and c.o_orderkey is not null
         and (s.o_custkey is distinct from c.o_custkey or s.o_orderstatus is distinct from c.o_orderstatus
              or s.o_orderdate is distinct from c.o_orderdate)) as bigint) as stale,
       cast(count(*) filter (where s.o_orderkey is null) as bigint) as ghost
from src s full join cpy c on s.o_orderkey = c.o_orderkey
union all
select 'customer', count(*) filter (where c_custkey % 5 <> 0), 0, 0, count(*) filter (where c_custkey % 5 = 0)
from customer"""



def synced(consumer: str, order: str, position: str) -> str:
    """Rows, periods and position of two tables read by one reader at a few polls."""
    first, second, _ = SYNC_POLLS
    return f"""
with {LOG},
m as (select *, case when pk % 2 = 0 then 'users' else 'visits' end as t,
             case when poll_no <= {first} then 1 when poll_no <= {second} then 2 else 3 end as read_at from l),
c as (select t as tbl, pk, {OP} as op, status, amount_cents, updated_at, {TS} as ts, {order} as a, seq as b from m),
{survivors("c", "tbl, pk", "status, amount_cents, updated_at")}, {periods("c", "tbl, pk")}
select 'row' as kind, tbl, pk, status, amount_cents, updated_at as valid_from, cast(null as timestamp) as valid_to
from rows_left
union all select 'period', tbl, pk, status, null, valid_from, valid_to from periods
union all select 'position', '{consumer}', null, {position}, null, null, null from l"""


TWO_TABLES = "case when pk % 2 = 0 then 'users' else 'visits' end"


def synced_by(method: str, position: str) -> str:
    """The same for a method that loses changes: what it captures when it reads at those polls."""
    first, second, _ = SYNC_POLLS
    return f"""
with l0 as ({fx.in_sql(fx.LOG_SQL)}),
l as (select * replace ({TWO_TABLES} as tbl,
        case when poll_no <= {first} then 1 when poll_no <= {second} then 2 else 3 end as poll_no) from l0),
{CAPTURED}, c as (select * from captured where method = '{method}'),
{survivors("c", "tbl, pk", "status, amount_cents, updated_at")}, {periods("c", "tbl, pk")}
select 'row' as kind, tbl, pk, status, amount_cents, updated_at as valid_from, cast(null as timestamp) as valid_to
from rows_left
union all select 'period', tbl, pk, status, null, valid_from, valid_to from periods
union all select 'position', '{method}', null, {position}, null, null, null from c"""


# Two tables as they were at a poll (init), the log after it (l), and where each method starts.
SNAPSHOT = f"""
l0 as (select * replace ({TWO_TABLES} as tbl) from ({fx.in_sql(fx.LOG_SQL)}) x),
init as (
  select tbl, pk, status, amount_cents, updated_at from (
    select *, row_number() over (partition by tbl, pk order by commit_lsn desc, seq desc) as r
    from l0 where poll_no <= {SNAPSHOT_POLL}) q
  where r = 1 and op <> 'D'
),
l as (select * from l0 where poll_no > {SNAPSHOT_POLL}),
starts as (
  select max(seq) as seq0, max(commit_lsn) as lsn0, (select max(updated_at) from init) as mark0
  from l0 where poll_no <= {SNAPSHOT_POLL}
)"""
# Rows of the copy as the first changes of every method, then what each captures behind its start.
CAPTURED_AFTER = f"""
{SURFACED}, {POLLS}, {MARKS},
methods as (select unnest(['high_watermark', 'sequence', 'queue', 'commit_order']) as method),
read as (
  select 'commit_order' as method, tbl, pk, {OP} as op, status, amount_cents, updated_at, {TS} as ts, commit_lsn as a, seq as b
  from l, starts where commit_lsn > lsn0
  union all
  select 'queue', tbl, pk, {OP}, status, amount_cents, updated_at, {TS}, poll_no, seq from l
  union all
  select 'sequence', tbl, pk, {OP}, status, amount_cents, updated_at, {TS}, l.poll_no, seq
  from l join prev_seq p on l.poll_no = p.poll_no, starts where seq > greatest(coalesce(p.prev_max_seq, seq0), seq0)
  union all
  select 'high_watermark', tbl, pk, 'U', status, amount_cents, updated_at, {TS}, s.poll_no, seq
  from surfaced s join prev_mark p on s.poll_no = p.poll_no, starts
  where updated_at > greatest(coalesce(p.prev_mark, mark0), mark0)
),
captured as (
  select * from read
  union all
  select method, tbl, pk, 'U', status, amount_cents, updated_at, updated_at, -1, -1 from init, methods
)"""
# The two tables and their histories after the whole log, from the copy on.
AFTER_SNAPSHOT = f"""
c as (
  select tbl, pk, {OP} as op, status, amount_cents, updated_at, {TS} as ts, commit_lsn as a, seq as b from l
  union all
  select tbl, pk, 'U', status, amount_cents, updated_at, updated_at, -1, -1 from init
), {survivors("c", "tbl, pk", "status, amount_cents, updated_at")}, {periods("c", "tbl, pk")}"""


APPLIED = """
seeded as (
  select pk, -1 as a, 0 as b, 'U' as op, status, updated_at from stored
  union all
  select pk, pos, 0, op, status, updated_at from v{where}
)"""

# Replayed with the unsent amount taken from the key's last sent one since its last delete.
FILLED = f"""
sent as (
  select tbl, pk, {OP} as op, status, updated_at, commit_lsn as a, seq as b,
         case when op = 'U' and seq % 11 = 0 then 0 else 1 end as sent, amount_cents,
         row_number() over (partition by pk order by commit_lsn, seq) as n from l
),
lasts as (
  select *, max(case when op = 'D' or sent = 1 then n end) over (
    partition by pk order by n rows between unbounded preceding and current row) as last_n from sent
),
c as (
  select x.tbl, x.pk, x.op, x.status, x.updated_at, x.a, x.b, y.amount_cents
  from lasts x left join lasts y on x.pk = y.pk and x.last_n = y.n
)"""

_lag_rows = " union all ".join(
    f"select '{n}' as consumer, cast({p} as bigint) as position" for n, p in LAG_POSITIONS.items()
)

ORACLES: dict[str, str] = {
    "snapshot_scan": """
select c_custkey, c_name, c_mktsegment, timestamp '2026-01-01 00:00:00' as loaded_at from customer""",
    "snapshot_parts": """
select c_custkey, c_name, c_mktsegment, timestamp '2026-01-01 00:00:00' as loaded_at from customer""",
    "bootstrap_history": """
select o_orderkey, o_orderstatus, o_orderdate as valid_from, cast(null as timestamp) as valid_to from orders""",
    "high_watermark_start": """
select greatest((select max(o_orderdate) from orders), (select max(l_shipdate) from lineitem)) as mark""",
    "high_watermark_poll": f"""
select 'orders' as tbl, 'U' as op, o_orderkey as pk, o_orderdate as ts,
       epoch_us(o_orderdate) as pos_hi, o_orderkey as pos_lo from orders
where o_orderdate > timestamp '{MARK}'
union all
select 'lineitem', 'U', l_orderkey, l_shipdate, epoch_us(l_shipdate), l_orderkey
from lineitem where l_shipdate > timestamp '{MARK}'""",
    "high_watermark_position": f"""
select coalesce(greatest((select max(o_orderdate) from orders where o_orderdate > timestamp '{MARK}'),
                         (select max(l_shipdate) from lineitem where l_shipdate > timestamp '{MARK}')),
                timestamp '{MARK}') as position""",
    "seq_poll": f"""
with {LOG}
select tbl, {OP} as op, pk, {TS} as ts, seq as pos_hi, seq, status, amount_cents, updated_at from l
where poll_no <= {POLL} and seq > (select max(seq) from l where poll_no < {POLL})""",
    "queue_poll": f"""
with {LOG}
select tbl, {OP} as op, pk, {TS} as ts, seq as pos_hi, seq, status, amount_cents, updated_at from l
where poll_no = {POLL}""",
    "queue_poll_intervals": f"""
with {LOG}
select tbl, {OP} as op, pk, {TS} as ts, seq as pos_hi, seq, status, amount_cents, updated_at from l
where poll_no = {POLL}""",
    "taken_runs": f"""
with {LOG}, n as (select seq, seq - row_number() over (order by seq) as run from l where poll_no between 0 and {POLL})
select min(seq) as low, max(seq) as high from n group by run""",
    "commit_order_poll": f"""
with {LOG}
select tbl, {OP} as op, pk, {TS} as ts, commit_lsn as pos_hi, seq as pos_lo, status, amount_cents, updated_at
from l where poll_no <= {POLL} and commit_lsn > (select max(commit_lsn) from l where poll_no < {POLL})""",
    "next_position_by_poll": f"with {LOG}, {POLLS} select poll_no, max_seq, prev_max_seq from prev_seq",
    "latest_image_at_poll": f"""
with {LOG}, seen as (select * from l where poll_no <= {POLL})
select tbl, pk, status, amount_cents, updated_at from (
  select *, row_number() over (partition by tbl, pk order by commit_lsn desc, seq desc) as r from seen
) q where r = 1 and op <> 'D'""",
    "canonical_changes": f"""
with {LOG}
select tbl, {OP} as op, pk, {TS} as ts, commit_lsn as pos_hi, seq as pos_lo, status, amount_cents, updated_at
from l""",
    "document_changes": f"""
with {LOG}
select {OP} as op, pk, {TS} as ts, commit_lsn as pos_hi, seq as pos_lo, status, amount_cents,
       case when op <> 'D' then updated_at end as updated_at from l""",
    "published_changes": f"""
with {LOG} select tbl, {OP} as op, cast(count(*) as bigint) as n_changes from l group by 1, 2""",
    "changelog_from_snapshots": f"""
with {PAIR}
select op, o_orderkey, o_custkey, o_orderstatus, o_orderdate from (
  select case when c.o_orderkey is null then 'I' when s.o_orderkey is null then 'D'
              when c.o_custkey is distinct from s.o_custkey or c.o_orderstatus is distinct from s.o_orderstatus
                or c.o_orderdate is distinct from s.o_orderdate then 'U' end as op,
         coalesce(s.o_orderkey, c.o_orderkey) as o_orderkey, s.o_custkey, s.o_orderstatus, s.o_orderdate
  from cpy c full join src s on c.o_orderkey = s.o_orderkey
) q where op is not null""",
    "time_texts": """
select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso, strftime(ts, '%H:%M:%S') as clock, ts as ts_back
from events""",
    "versioned_upsert": f"""
with {UPSERTS}, {APPLIED.format(where=" where op = 'U'")}, {survivors("seeded", "pk", "status, updated_at")}
select * from rows_left""",
    "key_delete": f"""
with {UPSERTS} select * from stored where pk not in (select pk from v where op = 'D')""",
    "apply_batch": f"""
with {UPSERTS}, {APPLIED.format(where="")}, {survivors("seeded", "pk", "status, updated_at")}
select * from rows_left""",
    "fold_batches": f"""
with {LOG}, {QUEUE_ORDER}, {survivors("c", "pk", "status, amount_cents, updated_at")} select * from rows_left""",
    "scd2_history": f"with {LOG}, {COMMIT_ORDER}, {periods('c', 'pk')} select * from periods",
    "scd2_history_busy_keys": f"with {HOT_LOG}, {COMMIT_ORDER}, {periods('c', 'pk')} select * from periods",
    "scd2_history_split": f"with {HOT_LOG}, {COMMIT_ORDER}, {periods('c', 'pk')} select * from periods",
    "net_of_hot_keys": f"""
with {HOT_LOG}, {QUEUE_ORDER}, {survivors("c", "pk", "status, amount_cents, updated_at")} select * from rows_left""",
    "open_periods": f"""
with {LOG}, {COMMIT_ORDER}, {periods('c', 'pk')}
select pk, status, valid_from from periods where valid_to is null""",
    "touched_open_periods": f"""
with {LOG}, {QUEUE_ORDER}, early as (select * from c where a <= {SPLIT_POLL}), {periods('early', 'pk')}
select pk, status, valid_from from periods
where valid_to is null and pk in (select pk from c where a = {SPLIT_POLL} + 1)""",
    "history_across_batches": f"with {LOG}, {QUEUE_ORDER}, {periods('c', 'pk')} select * from periods",
    "replica_diff": f"with {PAIR} {DIFF}",
    "replica_diff_buckets": f"with {PAIR} {DIFF}",
    "rows_wrong": f"""
with {PAIR}, report as ({DIFF}) select cast(sum(missing + stale + ghost) as bigint) as rows_wrong from report""",
    "wrong_by_method": f"""
with {PAIR}, report as ({DIFF}),
both_ways as (select case when tbl = 'orders' then 'first' else 'second' end as method, * from report
              union all select 'both', * from report)
select method, cast(sum(missing) as bigint) as missing, cast(sum(stale) as bigint) as stale,
       cast(sum(ghost) as bigint) as ghost from both_ways group by method""",
    "wrong_rows": f"""
with {PAIR}
select o_orderkey, verdict from (
  select coalesce(s.o_orderkey, c.o_orderkey) as o_orderkey,
         case when c.o_orderkey is null then 'missing' when s.o_orderkey is null then 'ghost'
              when s.o_orderstatus is distinct from c.o_orderstatus then 'stale' end as verdict
  from src s full join cpy c on s.o_orderkey = c.o_orderkey
) q where verdict is not null""",
    "row_difference": f"""
with {PAIR}
select 'left' as side, * from (select * from src except all select * from cpy) a
union all
select 'right', * from (select * from cpy except all select * from src) b""",
    "row_fingerprint": """
select o_orderkey, md5('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"'
  || o_orderstatus || '","note":'
  || case when o_orderkey % 3 = 0 then '"' || o_orderstatus || '"' else 'null' end || '}') as fingerprint
from orders""",
    "captured_changes": f"""
with {LOG}, {CAPTURED} select method, pk, op, ts, seq, poll_no from captured""",
    "replay_replicas": f"""
with {LOG}, {CAPTURED}, {REPLICAS} select method, pk, status, amount_cents, updated_at from replicas""",
    "replay_histories": f"""
with {LOG}, {CAPTURED}, {HISTORIES} select method, pk, status, valid_from, valid_to from histories""",
    "replay_four_policies": f"""
with {LOG}, {CAPTURED}, {REPLICAS}, {HISTORIES}, {TRUTH},
methods as (select distinct method from captured),
expected as (select m.method, t.* from truth t, methods m),
wrong as (
  select coalesce(t.method, r.method) as method, cast(count(t.pk) as bigint) as source_rows,
         cast(count(*) filter (where r.pk is null) as bigint) as missing,
         cast(count(*) filter (where r.pk is not null and t.pk is not null
           and (t.status is distinct from r.status or t.amount_cents is distinct from r.amount_cents
                or t.updated_at is distinct from r.updated_at)) as bigint) as stale,
         cast(count(*) filter (where t.pk is null) as bigint) as ghost
  from expected t full join replicas r on t.method = r.method and t.tbl = r.tbl and t.pk = r.pk group by 1
)
select w.method, a.n as changes_applied, source_rows, missing, stale, ghost,
       missing + stale + ghost as rows_wrong, p.periods
from wrong w
join (select method, cast(count(*) as bigint) as n from captured group by method) a on w.method = a.method
join ({COUNTED_PERIODS}) p on w.method = p.method""",
    "replay_from_snapshot": f"""
with {SNAPSHOT}, {CAPTURED_AFTER}, {REPLICAS}, {HISTORIES},
truth as (
  select * from (
    select tbl, pk, op, status, amount_cents, updated_at, ts, a, b,
           row_number() over (partition by tbl, pk order by a desc, b desc) as r
    from (select tbl, pk, {OP} as op, status, amount_cents, updated_at, {TS} as ts, commit_lsn as a, seq as b from l
          union all select tbl, pk, 'U', status, amount_cents, updated_at, updated_at, -1, -1 from init) y
  ) q where r = 1 and op <> 'D'
),
expected as (select m.method, t.tbl, t.pk, t.status, t.amount_cents, t.updated_at from truth t, methods m),
wrong as (
  select coalesce(t.method, r.method) as method, coalesce(t.tbl, r.tbl) as tbl, count(t.pk) as source_rows,
         count(*) filter (where r.pk is null) as missing,
         count(*) filter (where r.pk is not null and t.pk is not null
           and (t.status is distinct from r.status or t.amount_cents is distinct from r.amount_cents
                or t.updated_at is distinct from r.updated_at)) as stale,
         count(*) filter (where t.pk is null) as ghost
  from expected t full join replicas r on t.method = r.method and t.tbl = r.tbl and t.pk = r.pk group by 1, 2
)
select w.method, w.tbl, coalesce(a.n, 0) as changes_applied, source_rows, missing, stale, ghost,
       missing + stale + ghost as rows_wrong, coalesce(p.periods, 0) as periods
from wrong w
left join (select method, tbl, count(*) as n from read group by 1, 2) a on w.method = a.method and w.tbl = a.tbl
left join (select method, tbl, count(*) as periods from histories group by 1, 2) p on w.method = p.method and w.tbl = p.tbl""",
    "truth_after_snapshot": f"""
with {SNAPSHOT}, {AFTER_SNAPSHOT},
alive as (select tbl, pk, op, 'row' as status, ts, a, b from c), {periods('alive', 'tbl, pk', 'lives')}
select (select count(*) from periods) as status_periods,
       (select count(*) from periods) - (select count(*) from lives) as transitions,
       (select count(*) from lives) - (select count(*) from init) as inserted,
       (select count(*) from lives where valid_to is not null) as deleted,
       (select count(*) from (select distinct tbl, pk, txid from l where commit_lsn % 2 = 1) q) as late_keys""",
    "capture_miss_audit": f"""
with {LOG}, {SURFACED}, {POLLS}, {MARKS},
numbered as (
  select *, row_number() over (partition by tbl, pk, poll_no order by commit_lsn desc, seq desc) as r from l
)
select l.pk, l.seq, l.poll_no,
       case when op = 'D' then 'delete' when r > 1 then 'superseded'
            when m.prev_mark is not null and updated_at <= m.prev_mark then 'late' else 'captured' end
         as high_watermark,
       case when p.prev_max_seq is not null and seq <= p.prev_max_seq then 'late' else 'captured' end as sequence,
       'captured' as queue, 'captured' as commit_order
from numbered l join prev_seq p on l.poll_no = p.poll_no join prev_mark m on l.poll_no = m.poll_no""",
    "capture_miss_audit_split": f"""
with {HOT_LOG}, {SURFACED}, {POLLS}, {MARKS},
numbered as (
  select *, row_number() over (partition by tbl, pk, poll_no order by commit_lsn desc, seq desc) as r from l
)
select l.pk, l.seq, l.poll_no,
       case when op = 'D' then 'delete' when r > 1 then 'superseded'
            when m.prev_mark is not null and updated_at <= m.prev_mark then 'late' else 'captured' end
         as high_watermark,
       case when p.prev_max_seq is not null and seq <= p.prev_max_seq then 'late' else 'captured' end as sequence,
       'captured' as queue, 'captured' as commit_order
from numbered l join prev_seq p on l.poll_no = p.poll_no join prev_mark m on l.poll_no = m.poll_no""",
    "truth_counts": f"""
with {LOG}, {COMMIT_ORDER}, {periods('c', 'tbl, pk')},
alive as (select tbl, pk, op, 'row' as status, ts, a, b from c), {periods('alive', 'tbl, pk', 'lives')}
select cast((select count(*) from periods) as bigint) as status_periods,
       cast((select count(*) from periods) - (select count(*) from lives) as bigint) as transitions,
       cast((select count(*) from lives) as bigint) as inserted,
       cast((select count(*) from lives where valid_to is not null) as bigint) as deleted,
       cast((select count(*) from (select distinct tbl, pk, txid from l where commit_lsn % 2 = 1) q) as bigint)
         as late_keys""",
    "history_completeness": f"""
with {LOG}, {CAPTURED}, {HISTORIES}, counted as ({COUNTED_PERIODS}),
{COMMIT_ORDER}, {periods('c', 'tbl, pk')},
whole as (select count(*) as true_periods from periods)
select method, periods as recorded, true_periods,
       round(cast(100 as double) * periods / true_periods, 2) as pct, true_periods - periods as lost
from counted, whole""",
    "poll_statistics": f"""
with {LOG}, {CAPTURED},
sizes as (select method, poll_no, count(*) as n from captured group by method, poll_no),
ranked as (
  select *, row_number() over (partition by method order by n, poll_no) - 1 as i,
         floor((count(*) over (partition by method) - 1) * cast(0.95 as double)) as pick from sizes
)
select method, cast(count(*) as bigint) as polls, cast(median(n) as double) as median,
       cast(max(case when i = pick then n end) as bigint) as p95, cast(sum(n) as bigint) as total
from ranked group by method""",
    "consumer_lag": f"""
with {LOG}, positions as ({_lag_rows})
select consumer, position, max(commit_lsn) as end_lsn, max(commit_lsn) - position as lag_bytes,
       cast(count(*) filter (where commit_lsn > position) as bigint) as unread
from positions, l group by consumer, position""",
    "lsn_roundtrip": f"""
with {LOG}, w as (select seq, commit_lsn * 1000003 as v from l)
select seq, printf('%X/%X', v >> 32, v & 4294967295) as lsn, v as lsn_number, v - 255 as distance from w""",
    "pg_epoch": """
select event_id, event_id * 86400000123 + 946684800000000 as unix_us from events""",
    "pgoutput_decode": f"""
with {LOG}
select poll_no as batch_id, txid as xid, commit_lsn, max(changed_at) over (partition by txid) as commit_ts,
       tbl, op, pk, status, case when op = 'U' and seq % 11 = 0 then null else amount_cents end as amount_cents,
       case when op = 'D' or (op = 'U' and seq % 11 = 0) then 0 else 1 end as amount_sent,
       case when op <> 'D' then updated_at end as updated_at,
       case when op = 'D' or (op = 'U' and seq % 5 = 0) then pk end as old_pk
from l""",
    "pgoutput_decode_ranges": f"""
with {LOG}
select cast(0 as bigint) as batch_id, txid as xid, commit_lsn, max(changed_at) over (partition by txid) as commit_ts,
       tbl, op, pk, status, case when op = 'U' and seq % 11 = 0 then null else amount_cents end as amount_cents,
       case when op = 'D' or (op = 'U' and seq % 11 = 0) then 0 else 1 end as amount_sent,
       case when op <> 'D' then updated_at end as updated_at,
       case when op = 'D' or (op = 'U' and seq % 5 = 0) then pk end as old_pk
from l""",
    "decoded_transactions": f"""
with {LOG}
select poll_no as batch_id, txid as xid, commit_lsn, cast(count(*) as bigint) as n_changes
from l group by 1, 2, 3""",
    "messages_to_replica": f"""
with {LOG}, {FILLED}, {survivors("c", "pk", "status, amount_cents, updated_at")} select * from rows_left""",
    "message_sync": f"""
with {LOG}, {FILLED}, {survivors("c", "pk", "status, amount_cents, updated_at")}
select * from rows_left
union all
select null, printf('%X/%X', (max(commit_lsn) + 1) >> 32, (max(commit_lsn) + 1) & 4294967295), null, null from l""",
    "message_source_stream": f"""
with {LOG}, {FILLED}, {survivors("c", "pk", "status, amount_cents, updated_at")}
select * from rows_left
union all
select null, printf('%X/%X', max(commit_lsn) >> 32, max(commit_lsn) & 4294967295), null, null from l""",
    "message_poll": f"""
with {LOG}
select case when op = 'D' then 'D' else 'U' end as op, pk, commit_lsn as pos_hi, status,
       case when op = 'U' and seq % 11 = 0 then null else amount_cents end as amount_cents,
       case when op <> 'D' then updated_at end as updated_at
from l where poll_no <= {POLL} and commit_lsn > (select max(commit_lsn) from l where poll_no < {POLL})""",
    "message_position": f"""
with {LOG} select printf('%X/%X', max(commit_lsn) >> 32, max(commit_lsn) & 4294967295) as position from l""",
    "smallest_key": """
select o_orderkey, o_custkey, o_orderstatus, o_orderdate from orders order by o_orderkey limit 1""",
    "full_reload_counts": """
select 'orders' as tbl, cast(count(*) as bigint) as n_rows from orders
union all select 'customer', count(*) from customer""",
    "stream_apply": f"""
with {LOG}, {QUEUE_ORDER}, {survivors("c", "pk", "status, amount_cents, updated_at")}, {periods('c', 'pk')}
select 'row' as kind, pk, status, amount_cents, updated_at as valid_from, cast(null as timestamp) as valid_to
from rows_left
union all
select 'period', pk, status, null, valid_from, valid_to from periods""",
    "sync_queue_store": synced("queue", "read_at", "cast(max(seq) as varchar)"),
    "sync_commit_order_store": synced(
        "commit_order", "commit_lsn", "upper(format('{:x}/{:x}', max(commit_lsn) >> 32, max(commit_lsn) & 4294967295))"
    ),
    "sync_high_watermark_store": synced_by("high_watermark", "strftime(max(updated_at), '%Y-%m-%dT%H:%M:%S.%f')"),
    "sync_sequence_store": synced_by("sequence", "cast(max(seq) as varchar)"),
    "bucketed_sync": f"""
with {SNAPSHOT}, {AFTER_SNAPSHOT}
select 'row' as kind, tbl, pk, status, amount_cents, updated_at as valid_from, cast(null as timestamp) as valid_to
from rows_left
union all select 'period', tbl, pk, status, null, valid_from, valid_to from periods
union all select 'position', 'commit_order', null,
  upper(format('{{:x}}/{{:x}}', max(commit_lsn) >> 32, max(commit_lsn) & 4294967295)), null, null, null from l""",
    "stream_lag": f"""
with {LOG}, chunks as (select case when poll_no <= 3 then 0 when poll_no <= 7 then 1 else 2 end as batch_id, commit_lsn from l),
tops as (select batch_id, max(commit_lsn) as position from chunks group by batch_id)
select batch_id, position, (select max(commit_lsn) from l) as end_lsn, (select max(commit_lsn) from l) - position as lag_bytes,
       (select count(*) from l where commit_lsn > position) as unread
from tops""",
    "redelivered_batches": f"with {LOG}, {QUEUE_ORDER}, {periods('c', 'pk')} select * from periods",
    "stateful_history": f"""
with l as ({fx.in_sql(fx.LOG_SQL)}),
c as (
  select pk, {OP} as op, status, {TS} as ts, poll_no as a, seq as b from l where poll_no > {SNAPSHOT_POLL}
  union all
  select pk, 'U', status, updated_at, -1, -1 from (
    select *, row_number() over (partition by pk order by commit_lsn desc, seq desc) as r
    from l where poll_no <= {SNAPSHOT_POLL}) q
  where r = 1 and op <> 'D'
), {periods('c', 'pk')} select * from periods""",
    "changes_of_versions": f"""
with {SNAPSHOT}, {AFTER_SNAPSHOT}
select case when i.pk is null then 'I' when r.pk is null then 'D' else 'U' end as op, coalesce(i.tbl, r.tbl) as tbl,
       coalesce(i.pk, r.pk) as pk, r.status, r.amount_cents, r.updated_at
from init i full join rows_left r on i.tbl = r.tbl and i.pk = r.pk
where i.pk is null or r.pk is null or i.status is distinct from r.status
   or i.amount_cents is distinct from r.amount_cents or i.updated_at is distinct from r.updated_at""",
    "report_as_json": f"with {LOG}, {POLLS} select poll_no, max_seq, prev_max_seq from prev_seq",
    "key_uniqueness": """
select l_orderkey, l_linenumber, cast(count(*) as bigint) as n_rows from lineitem group by 1, 2
having count(*) > 1""",
    "open_period_uniqueness": f"""
with {LOG}, {COMMIT_ORDER}, {periods('c', 'pk')},
q as (select pk, op, status, ts, poll_no as a, seq as b from
      (select pk, {OP} as op, status, {TS} as ts, poll_no, seq from l where poll_no <= {SPLIT_POLL}) x),
{periods('q', 'pk', 'others')},
opened as (select pk from periods where valid_to is null union all select pk from others where valid_to is null)
select pk, cast(count(*) as bigint) as n_rows from opened group by pk having count(*) > 1""",
    "null_check": f"""
with {LOG}
select 'seq' as column_name, cast(count(*) - count(seq) as bigint) as null_rows from l
union all select 'pk', count(*) - count(pk) from l
union all select 'status', count(*) - count(status) from l
union all select 'amount_cents', count(*) - count(amount_cents) from l
union all select 'updated_at', count(*) - count(updated_at) from l""",
}
ORACLES["capture_scorecard"] = f"""
with audit as ({ORACLES["capture_miss_audit"].strip()}),
flat as (
  select 'high_watermark' as method, high_watermark as verdict from audit
  union all select 'sequence', sequence from audit
  union all select 'queue', queue from audit
  union all select 'commit_order', commit_order from audit
)
select method, verdict, cast(count(*) as bigint) as n_changes from flat group by 1, 2"""
