"""Queries of event handling and history on events and conversations, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import ranking
from ..streaming import events as E
from . import ORACLE_SQL, query, rows_of, spread, table
from .text_queries import quoted, sql_collapse


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""WITH RECURSIVE e AS (SELECT user_id AS page_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS timer, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS fired FROM e UNION ALL
SELECT page_id, i, CASE WHEN timer IS NULL OR due THEN ms + 7200000 ELSE timer END, CASE WHEN ok THEN timer ELSE last END, CASE WHEN ok THEN timer END
FROM (SELECT *, due AND (last IS NULL OR timer - last >= 54000000) AS ok FROM (SELECT s.page_id, e.i, timer, last, e.ms, coalesce(timer <= e.ms, false) AS due FROM s JOIN e ON s.page_id = e.page_id AND e.i = s.i + 1)))
SELECT page_id, fired AS scan_at FROM s WHERE fired IS NOT NULL UNION ALL SELECT page_id, timer FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i DESC) AS r FROM s) WHERE r = 1 AND timer IS NOT NULL AND (last IS NULL OR timer - last >= 54000000)""")
def r1_scan_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans that a page watcher makes: 2 time units after the first change, none within 15 of the last; hours here."""
    return E.scan_times(events(spark, sf_dir).select(F.col("user_id").alias("page_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at")), delay=2 * 3_600_000, pause=15 * 3_600_000)


@query("""SELECT user_id, session_start, n, last_event FROM (SELECT user_id, s, min(ts) AS session_start, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY user_id, s)""")
def r2_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.debounced(events(spark, sf_dir), "user_id", "30 minutes").select("user_id", "session_start", "n", "last_event")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IN ('view', 'purchase')) WHERE event_type = 'view' AND (before IS NULL OR before <> 'view')")
def r3_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (view) that start: none of the same key is still under way (ended by purchase)."""
    return E.started(events(spark, sf_dir), "user_id", "view", "purchase").select("event_id")


@query("""SELECT event_id, set_id FROM (SELECT event_id, event_type, ts, lag(event_type) OVER w AS bt, lag(event_id) OVER w AS set_id, lag(ts) OVER w AS bts FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'purchase' AND bt = 'signup' AND ts - bts <= INTERVAL 1 DAY""")
def r4_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read (purchase) with the value it takes: set (signup) before it, not read since, not older than the limit."""
    return E.continuations(events(spark, sf_dir), "user_id", "signup", "purchase", 86_400).select("event_id", "set_id")


@query("SELECT user_id, event_id, call FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call FROM events) WHERE call <= 7")
def r5_call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(events(spark, sf_dir).select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], 7, "call").select("user_id", "event_id", "call")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS at FROM events GROUP BY user_id")
def r8_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def k2_last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn").desc()], 4).select("conv_id", "turn", "role")


@query("SELECT event_type, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY event_type")
def k6_last_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.max_by("props", F.struct("ts", "event_id")).alias("props"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso, epoch_us(ts) // 1000 AS ms, epoch_us(TIMESTAMP '2024-03-01') // 1000 - epoch_us(ts) // 1000 > 120000 AS stale FROM events")
def f13_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events(spark, sf_dir).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), ms.alias("ms"), (F.unix_millis(F.lit("2024-03-01 00:00:00").cast("timestamp")) - ms > 120_000).alias("stale"))


LINE = sql_collapse("coalesce(line, '')")
BIRTH = "|".join(rules.LINE_BIRTH)
LINES = f"(SELECT doc_id, i, p, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, i, line, {LINE} AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'Rohan Mehta' || chr(10) || 'DOB: 12/03/1990' || chr(10) || '1234 5678 9012' || chr(10) || 'Address: 5 Long Lane' || chr(10) || 'Near Lake' || chr(10) || 'Town 560001' || chr(10) || 'End' || chr(10) || 'More'))))"
CLASS = f"CASE WHEN p = '' THEN NULL WHEN regexp_matches(p, {quoted(rules.re2(rules.LINE_GOVERNMENT[0]))}) OR regexp_matches(p, {quoted(rules.re2(rules.LINE_GOVERNMENT[1], True))}) THEN 'GOVERNMENT_ID' WHEN regexp_matches(lower(p), {quoted(rules.re2(rules.LINE_BIRTH[0]))}) OR regexp_matches(p, {quoted(rules.re2(rules.LINE_BIRTH[1]))}) THEN 'DATE_OF_BIRTH' WHEN regexp_matches(p, {quoted(rules.re2(rules.LINE_ADDRESS[0], True))}) OR regexp_matches(p, {quoted(rules.re2(rules.LINE_ADDRESS[1]))}) THEN 'ADDRESS' WHEN regexp_matches(p, {quoted(rules.re2(rules.LINE_PERSON))}) AND regexp_matches(coalesce(nxt, ''), {quoted(rules.re2(BIRTH, True))}) THEN 'PERSON' END"
SAMPLE = "Rohan Mehta\nDOB: 12/03/1990\n1234 5678 9012\nAddress: 5 Long Lane\nNear Lake\nTown 560001\nEnd\nMore"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, line, following: lines of documents, each with the next one."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).unionAll(rows_of(spark, "doc_id long, text string", [(-1, SAMPLE)]))
    parts = docs.select("doc_id", text.let(F.split("text", "\n", -1), lambda l: F.arrays_zip(l.alias("line"), F.slice(l, F.lit(2), F.size(l)).alias("following"))).alias("pairs"))
    return parts.select("doc_id", F.posexplode("pairs").alias("i", "p")).select("doc_id", "i", F.col("p")["line"].alias("line"), F.col("p")["following"].alias("following"))


@query(f"SELECT doc_id, CAST(i AS INT) AS i, {CLASS} AS class FROM {LINES} WHERE {CLASS} IS NOT NULL")
def t10_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "i", text.line_class(F.col("line"), F.col("following")).alias("class")).filter("class IS NOT NULL")


@query("SELECT doc_id, CAST(i AS INT) AS i, lead(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS next_length FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)")
def w6_look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter("doc_id >= 0").select("doc_id", "i", F.length("following").cast("long").alias("next_length"))


@query(f"SELECT doc_id, CAST(i + k AS INT) AS i, count(*) AS times FROM (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id) AS last, {CLASS} AS class FROM {LINES}) c, (VALUES (1), (2), (3)) AS s(k) WHERE class = 'ADDRESS' AND i + k <= last GROUP BY doc_id, i + k")
def w7_carry_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three lines after each address line, as often as addresses reach them."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).unionAll(rows_of(spark, "doc_id long, text string", [(-1, SAMPLE)]))
    n = docs.select("doc_id", (F.size(F.split("text", "\n", -1)) - 1).alias("last"))
    hits = lines(spark, sf_dir).filter(text.line_class(F.col("line"), F.col("following")) == "ADDRESS").select("doc_id", "i")
    reach = hits.join(n, "doc_id").filter("i < last").select("doc_id", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("i") + 3, F.col("last")))).alias("i"))
    return reach.groupBy("doc_id", "i").agg(F.count("*").alias("times"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(CAST(value AS INT)))), ',') AS numbers FROM events WHERE value < 10 GROUP BY user_id")
def o5_sorted_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.array_sort(F.collect_set(F.rint("value").cast("int")))
    return events(spark, sf_dir).filter("value < 10").groupBy("user_id").agg(F.array_join(numbers.cast("array<string>"), ",").alias("numbers"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0) DESC, event_id) AS rn FROM events WHERE event_type <> 'error') WHERE rn = 1")
def o6_most_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each key by one aggregation; missing values count as 0 and the first wins ties."""
    order = F.struct(F.coalesce("value", F.lit(0.0)).alias("v"), F.negative("event_id").alias("e"))
    best = events(spark, sf_dir).filter("event_type <> 'error'").groupBy("user_id").agg(F.max(order).alias("m"))
    return best.select("user_id", F.negative("m.e").alias("event_id"))


@query("SELECT user_id, count(*) <= 50 AS allowed FROM events GROUP BY user_id")
def o7_step_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg((F.count("*") <= 50).alias("allowed"))


@query("SELECT event_id, CAST(round(100 * (event_id % 7 + 1) / 7.0) AS BIGINT) AS percent FROM events")
def a10_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.round(100 * (F.col("event_id") % 7 + 1) / 7).cast("long").alias("percent"))


@query("SELECT event_id, to_base64(encode(props)) AS b64, decode(from_base64(to_base64(encode(props)))) AS back, regexp_replace('data:image/png;base64,' || to_base64(encode(props)), '^data:image/[a-z]+;base64,', '') = to_base64(encode(props)) AS stripped FROM events")
def f11_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.base64(F.col("props").cast("binary"))
    return events(spark, sf_dir).select("event_id", b.alias("b64"), F.unbase64(b).cast("string").alias("back"), (F.regexp_replace(F.concat(F.lit("data:image/png;base64,"), b), "^data:image/[a-z]+;base64,", "") == b).alias("stripped"))


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN NULL ELSE event_type END, ''), props) AS value FROM events")
def f12_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    v = F.when(k == 0, F.lit("")).when(k == 1, F.lit(None)).otherwise(F.col("event_type"))
    return events(spark, sf_dir).select("event_id", text.first_truthy(v, F.col("props")).alias("value"))


@query("SELECT conv_id, len(list_filter(t, lambda x: x % 2 = 0)) AS even, list_contains(t, 1) AS has_one, array_to_string(list_transform(t[1:3], lambda x: x * 10), '-') AS tens, CAST(list_sum(t) AS BIGINT) AS total, len(list_filter(t, lambda x: x < 0)) = 0 AS all_positive FROM (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)")
def f19_array_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return own.select(
        "conv_id", F.size(F.filter(t, lambda x: x % 2 == 0)).cast("long").alias("even"), F.array_contains(t, 1).alias("has_one"), F.array_join(F.transform(F.slice(t, 1, 3), lambda x: (x * 10).cast("string")), "-").alias("tens"),
        F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.forall(t, lambda x: x >= 0).alias("all_positive"),
    )


@query("SELECT conv_id, media, searched, site FROM (SELECT conv_id, regexp_extract(line, '(?i)\\b(play|watch|listen(?:\\s+to)?)\\s+(.+?)\\s*$', 2) AS media, regexp_extract(line, '(?i)\\b(?:search(?:\\s+for)?|find|look\\s+up|open)\\s+(.+?)\\s+(?:on|in|at)\\s+(youtube(?:\\s+music)?|yt|google|github|wikipedia|wiki|amazon)\\b', 1) AS searched, lower(regexp_extract(line, '(?i)\\b(?:search(?:\\s+for)?|find|look\\s+up|open)\\s+(.+?)\\s+(?:on|in|at)\\s+(youtube(?:\\s+music)?|yt|google|github|wikipedia|wiki|amazon)\\b', 2)) AS site FROM (SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'play ' WHEN 1 THEN 'Search for ' WHEN 2 THEN 'find ' ELSE 'open ' END || role || ' ' || turn || CASE conv_id % 3 WHEN 0 THEN ' on YouTube' WHEN 1 THEN ' in wiki ' ELSE '' END AS line FROM conversations))")
def f10_intent_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json_plans import MEDIA, SEARCH

    c, k = F.col("conv_id") % 4, F.col("conv_id") % 3
    line = F.concat(F.when(c == 0, "play ").when(c == 1, "Search for ").when(c == 2, "find ").otherwise("open "), "role", F.lit(" "), F.col("turn").cast("string"), F.when(k == 0, " on YouTube").when(k == 1, " in wiki ").otherwise(""))
    own = table(spark, sf_dir, "conversations").select("conv_id", line.alias("line"))
    return own.select("conv_id", F.regexp_extract("line", MEDIA, 2).alias("media"), F.regexp_extract("line", SEARCH, 1).alias("searched"), F.lower(F.regexp_extract("line", SEARCH, 2)).alias("site"))


@query("SELECT conv_id, turn, role FROM (SELECT *, max(CASE WHEN turn < 2 THEN turn END) OVER (PARTITION BY conv_id) AS seen FROM conversations) WHERE seen IS NULL OR turn > seen")
def r7_history_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that are new since the last seen state of each conversation."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    seen = own.filter("turn < 2").groupBy("conv_id").agg(F.max("turn").alias("seen"))
    return own.join(seen, "conv_id", "left").filter("seen IS NULL OR turn > seen").select("conv_id", "turn", "role")


def replayed(spark: SparkSession, sf_dir: str, run) -> DataFrame:
    """The rows that a streaming operator gives for the table of events, read from files as a stream and ended by one event far ahead, so
    that the watermark passes all others."""
    from ..sources.sinks import scratch

    path = scratch(spark)
    own = events(spark, sf_dir).select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    ahead = own.agg((F.max("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.lit("signup").alias("event_type"), "ts")
    for rows in (own, ahead):
        rows.write.mode("append").parquet(f"{path}/in")
    out = run(spark.readStream.schema(own.schema).parquet(f"{path}/in"))
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out").filter("user_id >= 0")


@query(ORACLE_SQL["r2_debounce"])
def r2_debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(spark, sf_dir, lambda rows: E.debounced(rows.withWatermark("ts", "1 hour"), "user_id", "30 minutes")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n", "last_event")


@query(ORACLE_SQL["r4_continuation"])
def r4_continuation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(spark, sf_dir, lambda rows: E.continuation_stream(rows, "signup", "purchase", 86_400)).select("event_id", "set_id")


@query(ORACLE_SQL["r1_scan_throttle"])
def r1_scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The throttle as a stream whose timers fire by event time."""
    run = lambda rows: E.scan_stream(rows, "user_id", 2 * 3_600_000, 15 * 3_600_000)
    return replayed(spark, sf_dir, run).select(F.col("user_id").alias("page_id"), "scan_at")


#: Clicks are changes, and a key is busy from a view to a purchase.
_FEED = """WITH e AS (SELECT user_id, event_id, event_type, ts, coalesce(last_value(CASE WHEN event_type IN ('view', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'view', false) AS busy,
count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS span FROM events WHERE event_type IN ('click', 'view', 'purchase'))
SELECT user_id, event_id, event_id AS told_by FROM e WHERE event_type = 'click' AND NOT busy"""
_HELD = """ UNION ALL SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'click' AND busy) AS event_id, max(event_id) FILTER (WHERE event_type = 'purchase') AS told_by
FROM e GROUP BY user_id, span HAVING count(*) FILTER (WHERE event_type = 'click' AND busy) > 0 AND count(*) FILTER (WHERE event_type = 'purchase') > 0"""


@query(_FEED)
def r7_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a key that is not busy; those in a busy time are ignored."""
    return E.change_feed(events(spark, sf_dir), "user_id", "click", "view", "purchase")


@query(_FEED + _HELD)
def r7_held_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but the last change of a busy time comes when it ends."""
    return E.change_feed(events(spark, sf_dir), "user_id", "click", "view", "purchase", hold=True)


@query(_FEED + _HELD)
def r7_held_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(spark, sf_dir, lambda rows: E.change_stream(rows, "user_id", "click", "view", "purchase", hold=True))
