"""The named queries over the driver's tables, each with the SQL that an independent engine runs for it.

Keys are shown as hex; ordered results carry their rank, since results are compared without order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import be_bytes, pad_or_cut, purge_mark, record_span, shard_of
from ..operators import accounting, compact, reads, reports
from ..operators.resolve import hidden_by_covers, narrowed, newest, resolve, versions
from ..operators.schema import DATA
from ..operators.scope import Scope, delete_bounds
from ..operators.writes import WriteBatch, batch_rows, plan_batch
from ..sources.store import Store
from ..streaming.follower import Follower
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Sequence numbers that queries read as of.
EARLY, LATER = 300, 5000
#: Segments of E that queries rewrite, and the held snapshot that gates them.
REWRITE, HELD = [2, 7, 10], 2500
PREFIX = "http://m."
CUSTOMER = 42
MANY = [7, 3, 7, 999_999, 149, 0, 3]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def key(c: str = "k") -> Column:
    return F.hex(c).alias("key")


# ---- SQL of the logs

E = """elog AS (SELECT event_id + 1 AS lsn, unhex(lpad(printf('%X', user_id), 16, '0')) AS k,
  CASE WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END AS kind,
  unhex(lpad(printf('%X', user_id + 8), 16, '0')) AS e, encode(props) AS v, CAST(event_id // 1000 + 1 AS INTEGER) AS seg FROM events)"""
O = """olog AS (SELECT o_orderkey + 1 AS lsn, unhex(lpad(printf('%X', o_custkey), 16, '0')) || unhex(lpad(printf('%X', o_orderkey), 16, '0')) AS k,
  octet_length(encode(o_orderpriority)) AS len, o_orderpriority AS v, CAST(o_orderkey // 1500 + 1 AS INTEGER) AS seg FROM orders)"""
P = """plog AS (SELECT page_id + 1 AS lsn, encode(url) AS k, octet_length(encode(html)) AS len, CAST(page_id // 50 + 1 AS INTEGER) AS seg FROM pages)"""
L = """llog AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS lsn,
  unhex(lpad(printf('%X', l_orderkey), 16, '0')) || unhex(lpad(printf('%X', l_linenumber), 8, '0')) AS k FROM lineitem)"""


def live_sql(as_of: int | None = None, covers: bool = True) -> str:
    s = "" if as_of is None else f" AND lsn <= {as_of}"
    hidden = " AND NOT EXISTS (SELECT 1 FROM c WHERE c.lsn > w.lsn AND w.k >= c.s AND w.k < c.e)" if covers else ""
    return f"""{E}, w AS (SELECT k, max(lsn) AS lsn, arg_max(kind, lsn) AS kind, arg_max(v, lsn) AS v, arg_max(seg, lsn) AS seg FROM elog WHERE kind < 2{s} GROUP BY k),
  c AS (SELECT k AS s, e, lsn FROM elog WHERE kind = 2{s}),
  live AS (SELECT k, lsn, v, CAST(octet_length(v) AS INTEGER) AS len, seg FROM w WHERE kind = 0{hidden})"""


SHOWN = "SELECT hex(k) AS key, lsn, len FROM live"
SEGS = f"""{live_sql()}, spans AS (SELECT seg, lsn, kind, CASE kind WHEN 0 THEN octet_length(v) WHEN 2 THEN 8 ELSE 0 END AS n,
  EXISTS (SELECT 1 FROM live WHERE live.lsn = elog.lsn) AS alive FROM elog),
  segs AS (SELECT seg AS segment_id, CAST(sum(CASE WHEN alive OR kind > 0 THEN 10 + n ELSE 0 END) AS BIGINT) AS live, CAST(sum(CASE WHEN kind = 0 AND NOT alive THEN 10 + n ELSE 0 END) AS BIGINT) AS dead,
    CAST(sum(CASE WHEN kind > 0 THEN 10 + n ELSE 0 END) AS BIGINT) AS held, max(CASE WHEN kind > 0 THEN lsn END) AS held_lsn, min(lsn) AS min_lsn, max(lsn) AS max_lsn, count(*) AS records FROM spans GROUP BY seg),
  floored AS (SELECT *, (SELECT min(o.min_lsn) FROM segs o WHERE o.segment_id <> segs.segment_id) AS floor FROM segs),
  ranked AS (SELECT *, CASE WHEN floor IS NULL OR held_lsn < floor THEN held ELSE 0 END AS droppable FROM floored),
  judged AS (SELECT *, dead + droppable AS reclaimable, CAST(dead AS DOUBLE) / CAST(dead + live AS DOUBLE) AS dead_fraction, CAST(dead + droppable AS DOUBLE) / CAST(live + dead AS DOUBLE) AS fraction FROM ranked)"""


def shown(view: DataFrame) -> DataFrame:
    return view.select(key(), "lsn", "len")


def ranked_keys(rows: DataFrame, ascending: bool = True) -> DataFrame:
    order = F.col("k").asc() if ascending else F.col("k").desc()
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(order)).cast("long"))


def events_live(spark: SparkSession, sf_dir: str, as_of: int | None = None) -> DataFrame:
    return resolve(fx.events(spark, sf_dir), as_of)


def events_of(spark: SparkSession, sf_dir: str, users: list[int]) -> DataFrame:
    """The live view of some users."""
    return resolve(narrowed(fx.events(spark, sf_dir), "events", [be_bytes(u, 8) for u in users]))


def orders_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(fx.orders(spark, sf_dir))


# ---- resolution

query("kv_resolve_live", f"WITH {live_sql()} {SHOWN}")(lambda s, d: shown(events_live(s, d)))
query("kv_resolve_no_covers", f"WITH {live_sql(covers=False)} {SHOWN}")(lambda s, d: shown(newest(fx.events(s, d)).where(F.col("kind") == DATA)))
for _name, _at in (("as_of_events", LATER), ("kv_as_of", EARLY)):
    query(_name, f"WITH {live_sql(_at)} {SHOWN}")(lambda s, d, at=_at: shown(events_live(s, d, at)))


@query("kv_as_of_before_drop", f"WITH {live_sql(97 * 2)} {SHOWN}")
def _(s, d):
    return shown(events_live(s, d, 97 * 2))


query("kv_hidden_by_covers", f"WITH {live_sql(covers=False)} SELECT hex(k) AS key, lsn, len FROM live WHERE EXISTS (SELECT 1 FROM c WHERE c.lsn > live.lsn AND live.k >= c.s AND live.k < c.e)")(lambda s, d: shown(hidden_by_covers(fx.events(s, d))))
query("kv_version_history", f"WITH {E} SELECT hex(k) AS key, lsn, CAST(kind AS TINYINT) AS kind, lead(lsn) OVER (PARTITION BY k ORDER BY lsn) AS superseded_at FROM elog WHERE kind < 2")(lambda s, d: versions(fx.events(s, d)).select(key(), "lsn", "kind", "superseded_at"))
query("kv_newest_lines", f"WITH {L} SELECT hex(k) AS key, max(lsn) AS lsn FROM llog GROUP BY k")(lambda s, d: newest(fx.lines(s, d)).select(key(), "lsn"))

# ---- point reads

VALUES = "SELECT hex(k) AS key, lsn, hex(v) AS value, len FROM live"
for _name, _user in (("kv_point_get", 7), ("kv_get_missing", 999_999)):
    query(_name, f"WITH {live_sql()} {VALUES} WHERE k = unhex(lpad(printf('%X', {_user}), 16, '0'))")(lambda s, d, u=_user: reads.get(events_live(s, d), "events", be_bytes(u, 8)).select(key(), "lsn", F.hex("v").alias("value"), "len"))

ASKED = "asked AS (SELECT CAST(pos AS BIGINT) AS pos, unhex(lpad(printf('%X', u), 16, '0')) AS k FROM (VALUES " + ", ".join(f"({i}, {u})" for i, u in enumerate(MANY)) + ") t(pos, u))"


def asked(s: SparkSession) -> DataFrame:
    return reads.key_list(s, [be_bytes(u, 8) for u in MANY])


query("kv_get_many_ordered", f"WITH {live_sql()}, {ASKED} SELECT pos, hex(asked.k) AS key, lsn, hex(v) AS value FROM asked LEFT JOIN live ON asked.k = live.k")(lambda s, d: reads.get_many(events_of(s, d, MANY), "events", asked(s)).select("pos", key(), "lsn", F.hex("v").alias("value")))
query("kv_contains", f"WITH {live_sql()}, {ASKED} SELECT pos, hex(asked.k) AS key, live.k IS NOT NULL AS present FROM asked LEFT JOIN live ON asked.k = live.k")(lambda s, d: reads.contains(events_of(s, d, MANY), "events", asked(s)).select("pos", key(), "present"))
query("kv_size_of", f"WITH {live_sql()} SELECT hex(k) AS key, len FROM live WHERE k = unhex(lpad('3', 16, '0'))")(lambda s, d: reads.size_of(events_live(s, d), "events", be_bytes(3, 8)).select(key(), "len"))

SLICE = "SELECT hex(unhex(lpad(printf('%X', doc_id), 16, '0'))) AS key, substr(hex(encode(text)), 2 * {0} + 1, 2 * {1}) AS value FROM documents WHERE doc_id = 5"
for _name, _at, _n in (("kv_get_range", 10, 64), ("kv_get_range_past_end", 1_000_000, 64)):
    query(_name, SLICE.format(_at, _n))(lambda s, d, a=_at, n=_n: reads.get_range(resolve(fx.documents(s, d)), "documents", be_bytes(5, 8), a, n).select(key(), F.hex("v").alias("value")))

# ---- ordered scans

RANKED = "SELECT hex(k) AS key, lsn, row_number() OVER (ORDER BY k {order}) AS rank FROM live {where}"
for _name, _scope, _up, _where in (
    ("kv_iter", Scope(), True, ""),
    ("kv_iter_desc", Scope(), False, ""),
    ("kv_iter_from_asc", Scope.from_key(be_bytes(40, 8)), True, "WHERE k >= unhex(lpad(printf('%X', 40), 16, '0'))"),
    ("kv_iter_from_desc", Scope.from_key(be_bytes(40, 8), False), False, "WHERE k <= unhex(lpad(printf('%X', 40), 16, '0'))"),
):
    query(_name, f"WITH {live_sql()} " + RANKED.format(order="" if _up else "DESC", where=_where))(lambda s, d, sc=_scope, up=_up: ranked_keys(reads.scan(events_live(s, d), "events", sc, up, ("k", "lsn")), up).select(key(), "lsn", "rank"))

query("kv_iter_prefix", f"WITH {O} SELECT hex(k) AS key, v AS value, row_number() OVER (ORDER BY k) AS rank FROM olog WHERE substr(hex(k), 1, 16) = lpad(printf('%X', {CUSTOMER}), 16, '0')")(lambda s, d: ranked_keys(reads.iter_prefix(orders_live(s, d), "orders", be_bytes(CUSTOMER, 8))).select(key(), F.decode("v", "utf-8").alias("value"), "rank"))
query("kv_iter_keys_prefix", f"SELECT hex(encode(url)) AS key FROM pages WHERE starts_with(url, '{PREFIX}')")(lambda s, d: reads.iter_keys_prefix(resolve(fx.page_entries(s, d), carry=("len",)), "pages", PREFIX.encode()).select(F.hex(fx.url_of(F.col("k"))).alias("key")))
query("kv_iter_range", f"WITH {O} SELECT hex(k) AS key FROM olog WHERE k >= unhex(lpad(printf('%X', 10), 16, '0')) AND k < unhex(lpad(printf('%X', 20), 16, '0'))")(lambda s, d: reads.iter_range(orders_live(s, d), "orders", be_bytes(10, 8), be_bytes(20, 8)).select(key()))
query("kv_locate", f"WITH {O} SELECT where_, count(*) AS n FROM (SELECT CASE WHEN k < unhex(lpad(printf('%X', 10), 16, '0')) THEN 'before' WHEN k >= unhex(lpad(printf('%X', 20), 16, '0')) THEN 'past' ELSE 'inside' END AS where_ FROM olog) GROUP BY where_")(lambda s, d: orders_live(s, d).groupBy(Scope.range(be_bytes(10, 8), be_bytes(20, 8)).locate_column(F.col("k")).alias("where_")).agg(F.count("*").alias("n")))

PAGED = "SELECT hex(k) AS key{more}, pos FROM (SELECT *, row_number() OVER (ORDER BY k) AS pos FROM olog {where}) WHERE pos > 100 AND pos <= 150"
query("kv_sweep_page", f"WITH {O} " + PAGED.format(more=", v AS value", where=""))(lambda s, d: reads.nth_page(orders_live(s, d), "orders", 50, 2, columns=("k", "v")).select(key(), F.decode("v", "utf-8").alias("value"), F.col("pos").cast("long")))
query("kv_sweep_prefix_page", f"WITH {O} SELECT hex(k) AS key, pos FROM (SELECT *, row_number() OVER (ORDER BY k) AS pos FROM olog WHERE substr(hex(k), 1, 14) = '00000000000000') WHERE pos > 40 AND pos <= 60")(lambda s, d: reads.nth_page(orders_live(s, d), "orders", 20, 2, Scope.prefix(bytes(7))).select(key(), F.col("pos").cast("long")))
query("kv_sweep_keys_page", f"WITH {O} " + PAGED.format(more="", where=""))(lambda s, d: reads.nth_page(orders_live(s, d), "orders", 50, 2).select(key(), F.col("pos").cast("long")))

# ---- aggregates

OF_CUSTOMER = f"WHERE substr(hex(k), 1, 16) = lpad(printf('%X', {CUSTOMER}), 16, '0')"
query("kv_count_prefix", f"WITH {O} SELECT count(*) AS n FROM olog {OF_CUSTOMER}")(lambda s, d: reads.count_prefix(orders_live(s, d), "orders", be_bytes(CUSTOMER, 8)))
query("kv_bytes_prefix", f"WITH {O} SELECT CAST(coalesce(sum(len), 0) AS BIGINT) AS bytes FROM olog {OF_CUSTOMER}")(lambda s, d: reads.bytes_prefix(orders_live(s, d), "orders", be_bytes(CUSTOMER, 8)))
query("kv_bytes_prefix_empty", f"WITH {O} SELECT CAST(coalesce(sum(len), 0) AS BIGINT) AS bytes FROM olog WHERE substr(hex(k), 1, 4) = 'FFFF'")(lambda s, d: reads.bytes_prefix(orders_live(s, d), "orders", b"\xff\xff"))


def three_live(s: SparkSession, d: str) -> DataFrame:
    return resolve(fx.events(s, d).unionByName(fx.orders(s, d)).unionByName(fx.page_entries(s, d)), carry=("len",))


THREE = f"{live_sql()}, {O}, {P}, three AS (SELECT 'events' AS cf, len FROM live UNION ALL SELECT 'orders', len FROM olog UNION ALL SELECT 'pages', len FROM plog)"
query("kv_totals", f"WITH {THREE} SELECT count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes FROM three")(lambda s, d: reads.totals(three_live(s, d)))
query("kv_column_totals", f"WITH {THREE} SELECT cf, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes FROM three GROUP BY cf")(lambda s, d: reads.column_totals(three_live(s, d)))
query("kv_prefix_totals", f"WITH {O} SELECT substr(hex(k), 1, 16) AS prefix, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes FROM olog GROUP BY 1")(lambda s, d: reads.prefix_totals(orders_live(s, d), "orders", 8).withColumn("prefix", F.hex("prefix")))
query(
    "kv_cf_disk_usage",
    f"""WITH {THREE} SELECT f.cf, CAST(f.id AS SMALLINT) AS id, CAST(0 AS BIGINT) AS sst_bytes, CAST(coalesce(sum(len), 0) AS BIGINT) AS blob_bytes, 'bulk' AS volume
    FROM (VALUES ('events', 1), ('orders', 2), ('lines', 3), ('pages', 4), ('documents', 5), ('unused', 6)) f(cf, id) LEFT JOIN three ON three.cf = f.cf GROUP BY f.cf, f.id""",
)(lambda s, d: reads.cf_disk_usage(three_live(s, d), fx.REGISTRY))
query("kv_grave_count", f"WITH {live_sql()} SELECT count(*) AS n FROM w WHERE kind = 1")(lambda s, d: accounting.standing(fx.events(s, d)).select(F.col("graves").alias("n")))
query("kv_cover_count", f"WITH {E} SELECT count(*) AS n FROM elog WHERE kind = 2")(lambda s, d: accounting.standing(fx.events(s, d)).select(F.col("covers").alias("n")))

# ---- mutations


def with_batch(s: SparkSession, log: DataFrame, batch: WriteBatch) -> DataFrame:
    base = 1 << 40
    planned = plan_batch(batch, fx.REGISTRY)
    return log.unionByName(batch_rows(s, planned, base, base, 1 << 20)) if planned else log


ORDERS_LEFT = "SELECT hex(k) AS key, lsn FROM olog WHERE NOT ({0})"
TWENTY = "unhex(lpad(printf('%X', 20), 16, '0'))"
query("kv_delete_range_open_end", f"WITH {O} " + ORDERS_LEFT.format(f"k >= {TWENTY}"))(lambda s, d: resolve(with_batch(s, fx.orders(s, d), WriteBatch().delete_range("orders", be_bytes(20, 8)))).select(key(), "lsn"))
query("kv_delete_range_inverted", f"WITH {O} " + ORDERS_LEFT.format("false"))(lambda s, d: resolve(with_batch(s, fx.orders(s, d), WriteBatch().delete_range("orders", be_bytes(20, 8), be_bytes(10, 8)))).select(key(), "lsn"))


@query(
    "kv_bound_pad_cut",
    f"""WITH {O} SELECT hex(k) AS key, k < rpad_ AS deleted, k < wide AS scanned FROM (SELECT k, unhex(lpad(printf('%X', 20), 16, '0') || lpad(printf('%X', (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 20)), 16, '0')) AS rpad_,
      unhex(lpad(printf('%X', 20), 16, '0') || lpad(printf('%X', (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 20)), 16, '0') || '00') AS wide FROM olog) WHERE k <= rpad_""",
)
def _(s, d):
    """An over-wide end bound: a delete cuts it to the key's width, a scan doesn't, and they differ by one key."""
    first = s.read.parquet(f"{d}/orders.parquet").where("o_custkey = 20").agg(F.min("o_orderkey")).first()[0]
    wide = be_bytes(20, 8) + be_bytes(first, 8) + b"\0"
    _, cut = delete_bounds(b"", wide, 16)
    rows = orders_live(s, d).where(F.col("k") <= F.lit(cut))
    padded = pad_or_cut(F.lit(wide), 16)
    return rows.select(key(), (F.col("k") < padded).alias("deleted"), Scope.range(b"", wide)(F.col("k")).alias("scanned"))


@query("kv_batch_last_wins", f"WITH {live_sql()} SELECT hex(k) AS key, len FROM live WHERE k NOT IN (unhex(lpad('1', 16, '0')), unhex(lpad('2', 16, '0'))) UNION ALL SELECT lpad('1', 16, '0'), 3")
def _(s, d):
    batch = WriteBatch().put("events", be_bytes(1, 8), b"a").delete("events", be_bytes(1, 8)).put("events", be_bytes(1, 8), b"bcd").put("events", be_bytes(2, 8), b"x").delete("events", be_bytes(2, 8))
    return resolve(with_batch(s, fx.events(s, d), batch)).select(key(), "len")


@query("kv_batch_range_then_put", f"WITH {live_sql()} SELECT hex(k) AS key, len FROM live WHERE k >= unhex(lpad(printf('%X', 50), 16, '0')) UNION ALL SELECT lpad('5', 16, '0'), 2")
def _(s, d):
    batch = WriteBatch().put("events", be_bytes(6, 8), b"gone").delete_range("events", be_bytes(0, 8), be_bytes(50, 8)).put("events", be_bytes(5, 8), b"ok").delete_range("events", b"\x01", b"\x01")
    return resolve(with_batch(s, fx.events(s, d), batch)).select(key(), "len")


# ---- accounting


def segs(s: SparkSession, d: str) -> DataFrame:
    return accounting.segment_bytes(fx.events(s, d))


query("kv_segment_bytes", f"WITH {SEGS} SELECT * FROM segs")(segs)
query("kv_dead_fraction", f"WITH {SEGS} SELECT segment_id, dead_fraction FROM judged")(lambda s, d: accounting.ranked(segs(s, d)).select("segment_id", "dead_fraction"))
query("kv_droppable", f"WITH {SEGS} SELECT segment_id, droppable FROM judged")(lambda s, d: accounting.ranked(segs(s, d)).select("segment_id", F.col("droppable").cast("long")))
query("kv_reclaimable", f"WITH {SEGS} SELECT segment_id, reclaimable, fraction FROM judged")(lambda s, d: accounting.ranked(segs(s, d)).select("segment_id", F.col("reclaimable").cast("long"), "fraction"))
query("kv_floors_excluding", f"WITH {SEGS} SELECT segment_id, floor FROM floored")(lambda s, d: accounting.floors_excluding(segs(s, d)).select("segment_id", "floor"))
query("kv_select_target", f"WITH {SEGS} SELECT segment_id, fraction FROM judged WHERE fraction >= 0.5 AND reclaimable > 0 ORDER BY fraction DESC, segment_id LIMIT 1")(lambda s, d: accounting.select_target(segs(s, d)).select("segment_id", "fraction"))
query("kv_ranked_cue_floor", f"WITH {SEGS} SELECT segment_id, fraction FROM judged WHERE fraction >= 0.5 AND reclaimable > 0 AND min_lsn > {HELD} ORDER BY fraction DESC, segment_id LIMIT 1")(lambda s, d: accounting.select_target(segs(s, d), held_floor=HELD).select("segment_id", "fraction"))
query("kv_whole_dead", f"WITH {SEGS} SELECT segment_id FROM judged WHERE fraction >= 1")(lambda s, d: accounting.whole_dead(segs(s, d)).select("segment_id"))
query("kv_record_span", f"WITH {P} SELECT hex(k) AS key, CAST(CASE WHEN len <= 4096 THEN 10 ELSE 21 + octet_length(k) END + len AS INTEGER) AS span FROM plog")(lambda s, d: fx.pages(s, d).select(key(), record_span(F.col("k"), F.col("len")).alias("span")))
query(
    "kv_dead_runs",
    f"""WITH {SEGS}, marked AS (SELECT seg, lsn, n, kind = 0 AND NOT alive AS gone FROM spans),
    islands AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY lsn) - row_number() OVER (PARTITION BY seg, gone ORDER BY lsn) AS island FROM marked)
    SELECT seg AS segment_id, min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) AS records, CAST(sum(10 + n) AS BIGINT) AS bytes FROM islands WHERE gone GROUP BY seg, island""",
)(lambda s, d: accounting.dead_runs(fx.events(s, d)))
query(
    "kv_overlap_depth",
    f"""WITH {O}, spans AS (SELECT seg, min(k) AS lo, max(k) AS hi FROM olog GROUP BY seg), points AS (SELECT lo AS p FROM spans UNION SELECT hi FROM spans)
    SELECT max(n) AS depth FROM (SELECT p, count(*) AS n FROM points JOIN spans ON p >= lo AND p <= hi GROUP BY p)""",
)(lambda s, d: accounting.overlap_depth(accounting.key_spans(fx.orders(s, d))).select(F.col("depth").cast("long")))
query("kv_sealed_spans", f"WITH {O} SELECT 'orders' AS cf, count(DISTINCT seg) AS sealed_segments FROM olog")(lambda s, d: accounting.sealed_spans(fx.orders(s, d)))
query("kv_span_overlap_prune", f"WITH {O}, spans AS (SELECT seg AS segment_id, min(k) AS lo, max(k) AS hi FROM olog GROUP BY seg) SELECT segment_id FROM spans WHERE lo <= {TWENTY} AND hi >= {TWENTY}")(lambda s, d: accounting.overlapping(accounting.key_spans(fx.orders(s, d)), F.lit(be_bytes(20, 8)), F.lit(be_bytes(20, 8))).select("segment_id"))

# ---- compaction

IN = f"({', '.join(map(str, REWRITE))})"
query("kv_compact_live_copy", f"WITH {live_sql()} SELECT hex(k) AS key, lsn FROM live WHERE seg IN {IN}")(lambda s, d: compact.live_copies(fx.events(s, d), REWRITE).select(key(), "lsn"))
CARRIED = f"""(t.kind = 1 AND NOT EXISTS (SELECT 1 FROM elog n WHERE n.kind < 2 AND n.k = t.k AND n.lsn > t.lsn) AND EXISTS (SELECT 1 FROM elog o WHERE o.kind = 0 AND o.k = t.k AND o.lsn < t.lsn AND o.seg NOT IN {IN}))
  OR (t.kind = 2 AND EXISTS (SELECT 1 FROM elog o WHERE o.kind = 0 AND o.k >= t.k AND o.k < t.e AND o.lsn < t.lsn AND o.seg NOT IN {IN}))"""
query("kv_tombstone_carry", f"WITH {E} SELECT hex(k) AS key, lsn, CAST(kind AS TINYINT) AS kind FROM elog t WHERE seg IN {IN} AND ({CARRIED})")(lambda s, d: compact.carried_tombstones(fx.events(s, d), REWRITE).select(key(), "lsn", "kind"))


@query("kv_tombstone_drop", f"WITH {E} SELECT hex(k) AS key, lsn, CAST(kind AS TINYINT) AS kind FROM elog t WHERE kind > 0 AND seg IN {IN} AND NOT ({CARRIED})")
def _(s, d):
    log = fx.events(s, d)
    mine = log.where(F.col("segment_id").isin(REWRITE) & (F.col("kind") != DATA))
    return mine.join(compact.carried_tombstones(log, REWRITE).select("cf", "k", "lsn"), ["cf", "k", "lsn"], "left_anti").select(key(), "lsn", "kind")


@query("kv_compaction_invariance", "SELECT CAST(0 AS BIGINT) AS differences")
def _(s, d):
    """Rows that differ between the live view before and after a rewrite."""
    log = fx.events(s, d)
    after = log.where(~F.col("segment_id").isin(REWRITE)).unionByName(compact.rewritten(log, REWRITE))
    a, b = (shown(resolve(x)) for x in (log, after))
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("differences"))


MARK = "CASE WHEN octet_length(k) >= 8 THEN CAST(CAST('0x' || substr(hex(k), 1, 16) AS UBIGINT) AS DECIMAL(20, 0)) ELSE 0 END"


@query("kv_purge_below", f"WITH {E} SELECT hex(k) AS key, lsn FROM elog WHERE kind = 0 AND NOT ({MARK} < 40)")
def _(s, d):
    return fx.events(s, d).where((F.col("kind") == DATA) & ~(purge_mark(F.col("k"), 0) < 40)).select(key(), "lsn")


@query("kv_purge_short_keys", f"WITH {P}, cut AS (SELECT lsn, unhex(substr(hex(k), 1, CAST(2 * (4 + lsn % 6) AS BIGINT))) AS k FROM plog) SELECT hex(k) AS key, lsn, CAST({MARK} AS VARCHAR) AS mark, {MARK} < 1 AS purged FROM cut")
def _(s, d):
    """Keys too short to hold a whole mark read as 0."""
    cut = fx.pages(s, d).select("lsn", F.substring("k", F.lit(1), (4 + F.col("lsn") % 6).cast("int")).alias("k"))
    mark = purge_mark(F.col("k"), 0)
    return cut.select(key(), "lsn", mark.cast("string").alias("mark"), (mark < 1).alias("purged"))


query(
    "kv_key_merge",
    f"WITH {L} SELECT hex(k) AS key, max(lsn) AS lsn, count(*) - 1 AS shadowed FROM llog WHERE (lsn - 1) // 6000 + 1 IN (1, 2, 3) GROUP BY k",
)(lambda s, d: compact.key_merge(fx.lines(s, d), [1, 2, 3]).select(key(), "lsn", "shadowed"))
query("kv_shard_of", f"WITH {O}, {P}, both_ AS (SELECT k, 8 AS n FROM olog UNION ALL SELECT k, 4 FROM plog) SELECT hex(k) AS key, CAST(CAST('0x' || rpad(substr(hex(k), 1, CAST(2 * n AS BIGINT)), CAST(2 * n AS INTEGER), '0') AS UBIGINT) AS VARCHAR) AS shard FROM both_")(
    lambda s, d: fx.orders(s, d).select("k", shard_of(F.col("k"), 8).cast("string").alias("shard")).unionByName(fx.pages(s, d).select("k", shard_of(F.col("k"), 4).cast("string").alias("shard"))).select(key(), "shard")
)

# ---- reports

query("kv_stat_report", f"""WITH {live_sql()}, f(name, id) AS (VALUES ('events', 1), ('orders', 2), ('lines', 3), ('pages', 4), ('documents', 5), ('unused', 6))
  SELECT name AS "column", CAST(id AS SMALLINT) AS id, CASE WHEN id = 1 THEN (SELECT count(DISTINCT seg) FROM elog) ELSE 0 END AS runs, CASE WHEN id = 1 THEN (SELECT count(*) FROM live) ELSE 0 END AS records,
  CAST(CASE WHEN id = 1 THEN (SELECT sum(len) FROM live) ELSE 0 END AS BIGINT) AS bytes FROM f""")(lambda s, d: reports.stat_report(fx.events(s, d), fx.REGISTRY))
query("kv_cue_report", f"WITH {SEGS} SELECT segment_id AS segment, live, dead, held, dead_fraction FROM judged ORDER BY dead_fraction DESC, segment_id LIMIT 5")(lambda s, d: reports.sequence_report(fx.events(s, d), 5))
query(
    "kv_summary",
    f"WITH {SEGS} SELECT max(max_lsn) + 1 AS sequence, count(*) AS segments, CAST(sum(live) AS BIGINT) AS live_bytes, CAST(sum(dead) AS BIGINT) AS dead_bytes, CAST(sum(held) AS BIGINT) AS tombstone_bytes, CAST(sum(dead) AS DOUBLE) / CAST(sum(dead) + sum(live) AS DOUBLE) AS dead_share, (SELECT count(*) FROM w WHERE kind = 1) AS graves, (SELECT count(*) FROM c) AS covers FROM judged",
)(lambda s, d: reports.summary(fx.events(s, d)))


@query("kv_verify_checksums", "SELECT count(*) AS faults, CAST(min(doc_id) + 1 AS BIGINT) AS first_lsn FROM documents WHERE doc_id % 97 = 5 AND text <> ''")
def _(s, d):
    """Payloads damaged by rule, after their checksums were taken: just those are found."""
    damaged = F.when(F.col("lsn") % 97 == 6, F.substring("v", F.lit(2), F.length("v"))).otherwise(F.col("v"))
    return reports.faulty(fx.documents(s, d).withColumn("v", damaged)).agg(F.count("*").alias("faults"), F.min("lsn").alias("first_lsn"))


query("kv_verify_report", f"WITH {SEGS} SELECT seg AS segment, true AS sealed, true AS indexed, count(*) AS records, CAST(sum(n) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS faults, count(*) FILTER (WHERE kind = 0 AND NOT alive) AS dead, CAST(NULL AS VARCHAR) AS fault FROM spans GROUP BY seg")(
    lambda s, d: reports.verify_report(fx.events(s, d), [r[0] for r in fx.events(s, d).select("segment_id").distinct().collect()])
)


# ---- through a store: segments, manifest, compaction and reads of files


def scratch(s: SparkSession) -> str:
    """A folder of its own below the shared one; a warehouse only where no shared one is named."""
    return f"{s.conf.get('spark.checkpoint.dir', None) or s.sparkContext.getConf().get('spark.checkpoint.dir') or s.conf.get('spark.sql.warehouse.dir')}/kv-{uuid.uuid4().hex[:12]}"


def stored(s: SparkSession, d: str, where: str, batches: int = 3) -> Store:
    """E, appended to a store in so many batches."""
    store = Store(s, where, fx.REGISTRY.families)
    top = fx.events(s, d).agg(F.max("lsn")).first()[0]
    for i in range(batches):
        store.append(fx.events(s, d, top * i // batches, top * (i + 1) // batches).select("cf", "k", "kind", "v", "range_end", "lsn"), ["lsn"])
    return store


@query("kv_store_view", f"WITH {live_sql()} {SHOWN}")
def _(s, d):
    with stored(s, d, scratch(s)) as store:
        return shown(store.view("events"))


@query("kv_store_as_of", f"WITH {live_sql(EARLY)} {SHOWN}")
def _(s, d):
    """A held number is read after further writes; compaction leaves what it holds."""
    with stored(s, d, scratch(s)) as store:
        return shown(store.view("events", as_of=EARLY))


@query("kv_store_compacted", f"WITH {live_sql()} SELECT hex(k) AS key, lsn, hex(v) AS value FROM live")
def _(s, d):
    with stored(s, d, scratch(s)) as store:
        store.compact([s["id"] for s in store.manifest["segments"]][:2])
        store.drain()
        return store.view("events").select(key(), "lsn", F.hex("v").alias("value"))


@query("kv_store_get_many", f"WITH {live_sql()}, {ASKED} SELECT pos, hex(asked.k) AS key, lsn, hex(v) AS value FROM asked LEFT JOIN live ON asked.k = live.k")
def _(s, d):
    with stored(s, d, scratch(s)) as store:
        keys = [be_bytes(u, 8) for u in MANY]
        return reads.get_many(store.view_of("events", keys), "events", asked(s)).select("pos", key(), "lsn", F.hex("v").alias("value"))


@query("kv_store_totals", f"WITH {live_sql()} SELECT count(*) AS n, CAST(coalesce(sum(len), 0) AS BIGINT) AS bytes, true AS agree, true AS freed FROM live")
def _(s, d):
    """Totals after all of the store was rewritten, and whether that gave back space."""
    with stored(s, d, scratch(s)) as store:
        before = store.actual_size_bytes()
        store.compact([s["id"] for s in store.manifest["segments"]])
        n, bytes_ = store.totals()
        return s.createDataFrame([(n, bytes_, store.counters_agree("events"), store.actual_size_bytes() < before)], "n long, bytes long, agree boolean, freed boolean")


@query("kv_store_range", f"WITH {live_sql()} SELECT hex(k) AS key, lsn, hex(v) AS value FROM live WHERE k >= unhex(lpad(printf('%X', 20), 16, '0')) AND k < unhex(lpad(printf('%X', 60), 16, '0'))")
def _(s, d):
    with stored(s, d, scratch(s)) as store:
        return store.view("events", Scope.range(be_bytes(20, 8), be_bytes(60, 8))).select(key(), "lsn", F.hex("v").alias("value"))


@query("kv_store_spans", "SELECT 'events' AS cf, 3 AS segments, count(*) AS records, CAST(max(event_id) + 1 AS BIGINT) AS max_lsn FROM events")
def _(s, d):
    """What the manifest says of the segments, held against their files."""
    where = scratch(s)
    with stored(s, d, where) as store:
        reader = Store(s, where, fx.REGISTRY.families, read_only=True)
        told = reader.rebuild()
        return s.createDataFrame([("events", len(store.manifest["segments"]), told["records"], told["highest_lsn"])], "cf string, segments int, records long, max_lsn long")


@query("kv_follow_stream", f"WITH {live_sql()} {SHOWN}")
def _(s, d):
    """The log, appended in batches and followed as a stream of manifests: the followed view is the batch view."""
    root = scratch(s)
    with stored(s, d, f"{root}/store", 2) as store:
        follower = Follower(s, store.root, f"{root}/state")
        follower.follow(f"{root}/offsets").awaitTermination()
        return shown(follower.view())


@query("kv_follow_compacted", f"WITH {live_sql()} {SHOWN}")
def _(s, d):
    """Followed before and after a compaction that retires what was followed first."""
    root = scratch(s)
    with stored(s, d, f"{root}/store") as store:
        follower = Follower(s, store.root, f"{root}/state")
        follower.follow(f"{root}/offsets").awaitTermination()
        store.compact([s["id"] for s in store.manifest["segments"]][:2])
        follower.follow(f"{root}/offsets").awaitTermination()
        return shown(follower.view())


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
