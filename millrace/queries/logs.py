"""Queries over append-only logs and reviews: last writes, summaries, incremental work, OCR outcomes, streaming state."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import web
from millrace.operators import profiles
from millrace.plans.fixtures import table
from millrace.queries.registry import query
from millrace.sources import logtail, readers
from millrace.streaming import incremental, threads

_LAST = """last as (select user_id, arg_max(event_type, (ts, event_id)) as status, arg_max(value, (ts, event_id)) as value, max(event_id) as newest from events group by user_id)"""
_GOOD = ("click", "view", "purchase")


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), "value", "ts", "event_id")


def _last(spark, sf_dir):
    return profiles.last_written(_log(spark, sf_dir), "user_id", "ts", "event_id")


@query(f"with {_LAST} select user_id, status, round(value, 6) as value from last")
def q48_last_write_wins(spark, sf_dir):
    return _last(spark, sf_dir).select("user_id", "status", F.round("value", 6).alias("value"))


_SUMMARY = """select count(v) as profiled, round(coalesce(sum(v), 0), 6) as total, round(coalesce(min(v), 0), 6) as least, round(coalesce(median(v), 0), 6) as middle, round(coalesce(avg(v), 0), 6) as mean, round(coalesce(max(v), 0), 6) as most
from (select case when status in ('click', 'view', 'purchase') then coalesce(value, 0) end as v from last)"""


@query(f"with {_LAST} {_SUMMARY}")
def q49_profile_summary(spark, sf_dir):
    return profiles.summarise(_last(spark, sf_dir), "value", good=_GOOD, save=incremental.save_to(spark))


@query(f"with {_LAST} select coalesce(status, 'unknown') as status, count(*) as n from last group by 1")
def q50_status_counts(spark, sf_dir):
    return profiles.status_counts(_last(spark, sf_dir))


@query("""with files as (select doc_id::varchar as path, length(text)::bigint as size, doc_id * 7 % 13 as mtime from documents),
prior as (select doc_id::varchar as path, (length(text) + (doc_id % 6 = 0)::int)::bigint as size, doc_id * 7 % 13 as mtime, case when doc_id % 5 = 0 then 'failure' when doc_id % 5 = 1 then 'partial_success' else 'success' end as status from documents where doc_id % 4 <> 0)
select path, size, mtime from files f where not exists (select 1 from prior p where p.path = f.path and p.size = f.size and p.mtime = f.mtime and p.status in ('success', 'partial_success'))""")
def q51_incremental_todo(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    files = docs.select(d.cast("string").alias("path"), F.length("text").cast("long").alias("size"), (d * 7 % 13).alias("mtime"))
    status = F.when(d % 5 == 0, "failure").when(d % 5 == 1, "partial_success").otherwise("success")
    prior = docs.filter(d % 4 != 0).select(d.cast("string").alias("path"), (F.length("text") + (d % 6 == 0).cast("int")).cast("long").alias("size"), (d * 7 % 13).alias("mtime"), status.alias("status"))
    return profiles.to_do(files, prior)


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
b as (select doc_id, case when i % 4 = 0 then 'WORD' else 'LINE' end as kind, line, i, round_even((i * 37 % 101) / 1000.0, 2) as top, case when i % 7 = 0 then 0 else (i * 53 % 97) / 100.0 end as lft from l)
select doc_id, sha256(coalesce(string_agg(line, chr(10) order by top, lft, i) filter (kind = 'LINE'), '')) as digest from b group by doc_id""")
def q56_ocr_reading_order(spark, sf_dir):
    """Lines as OCR blocks with made-up boxes, some without a left edge, some of another type."""
    lines = F.split("text", "\n")

    def block(line, at):
        i = at + 1
        left = F.when(i % 7 != 0, (i * 53 % 97) / F.lit(100.0))
        box = F.struct(((i * 37 % 101) / F.lit(1000.0)).alias("Top"), left.alias("Left"))
        return F.struct(F.when(i % 4 == 0, "WORD").otherwise("LINE").alias("BlockType"), line.alias("Text"), F.struct(box.alias("BoundingBox")).alias("Geometry"))

    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(profiles.reading_order(F.transform(lines, block)), 256).alias("digest"))


_VERDICTS = (
    '{"equivalent": true, "issues": []}', '```json\n{"equivalent": false, "issues": ["a", "b"]}\n```', '{"equivalent": "true", "issues": []}',
    '{"equivalent": true}', '{"equivalent": true, "issues": ["a", 1]}', "not json", "[1]", ' {"equivalent": false, "issues": ["x"], "more": 1} ',
)


@query("""select item_id, case item_id % 8 when 0 then true when 1 then false when 7 then false end as equivalent, case item_id % 8 when 0 then 0 when 1 then 2 when 7 then 1 end::bigint as issues from benchmark""")
def q57_verdict_parse(spark, sf_dir):
    """Eight kinds of answers of a verifier, dealt over the benchmark's items."""
    kinds = F.array(*map(F.lit, _VERDICTS))
    v = web.verdict(F.get(kinds, (F.col("item_id") % 8).cast("int")))
    return table(spark, sf_dir, "benchmark").select("item_id", v.alias("v")).select("item_id", F.col("v.equivalent").alias("equivalent"), F.when(F.col("v").isNotNull(), F.size("v.issues")).cast("long").alias("issues"))


@query("""with a as (select page_id as page, unnest([0, 1, 2, 3, 4]) as revision from pages), t as (select page, revision, case when (page * 3 + revision * 5) % 11 < 7 then 0.9 else 0.996 end as coverage,
(page + revision) % 3 = 0 as equivalent, (page * revision) % 4 = 3 as issue, page % 17 = 5 and revision = 1 as failed from a),
o as (select page, min(revision) filter (equivalent and not issue and coverage >= 0.995 and revision <= 3) as revision, count(*) filter (failed) as errors, count(*) filter (revision <= 3) as attempts from t group by page)
select page, case when revision is not null then 'auto_pass' when errors > 0 then 'error' else 'review' end as status, revision::bigint as revision, attempts from o""")
def q58_revision_outcome(spark, sf_dir):
    p, r = F.col("page"), F.col("revision")
    tries = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("revision"))
    issues = F.when((p * r) % 4 == 3, F.array(F.lit("an issue"))).otherwise(F.expr("cast(array() as array<string>)"))
    tries = tries.select("page", "revision", F.when((p * 3 + r * 5) % 11 < 7, 0.9).otherwise(0.996).alias("coverage"), ((p + r) % 3 == 0).alias("equivalent"), issues.alias("issues"), F.when((p % 17 == 5) & (r == 1), "failed").alias("error"))
    return profiles.outcomes(tries)


@query(f"with {_LAST} {_SUMMARY}")
def q59_stream_incremental_profile(spark, sf_dir):
    """The log read as a stream into an append-only copy, then summarised: equal to the batch summary."""
    folder = incremental.shared_dir(spark)
    schema = table(spark, sf_dir, "events").schema
    pick = lambda s: s.select("user_id", F.col("event_type").alias("status"), "value", "ts", "event_id")
    incremental.append_stream(spark, f"{sf_dir}/events.parquet", schema, pick, f"{folder}/log", f"{folder}/state")
    return profiles.summarise(profiles.last_written(spark.read.parquet(f"{folder}/log"), "user_id", "ts", "event_id"), "value", good=_GOOD, save=incremental.save_to(spark))


@query("select conv_id, count(*) as turns, arg_max(text, turn) as last from conversations group by conv_id")
def q60_thread_state(spark, sf_dir):
    """Turns and the last message of each conversation, kept as streaming state."""
    folder = incremental.shared_dir(spark)
    schema = table(spark, sf_dir, "conversations").schema
    return threads.latest_state(spark, f"{sf_dir}/conversations.parquet", schema, "conv_id", "text", "turn", f"{folder}/state", f"{folder}/log")


@query("""with m as (select user_id, epoch_us(ts::timestamp) // 1000 as ms from events), g as (select *, ms - lag(ms) over (partition by user_id order by ms) > 7200000 as fresh from m),
s as (select user_id, ms, sum(coalesce(fresh, false)::int) over (partition by user_id order by ms rows unbounded preceding) as n from g),
r as (select user_id, n, min(ms) as began, max(ms) as ended, count(*) as turns from s group by all)
select user_id, began, ended, turns from r where ended + 7200001 <= (select max(ms) - 600000 from m) or exists (select 1 from r later where later.user_id = r.user_id and later.n > r.n)""")
def q107_thread_sessions(spark, sf_dir):
    """Users' events in sessions that end after two idle hours, by timers of keyed state; those that may still grow are not told."""
    folder = incremental.shared_dir(spark)
    schema = table(spark, sf_dir, "events").schema
    return threads.sessions(spark, f"{sf_dir}/events.parquet", schema, "user_id", "ts", 7_200_000, 600_000, f"{folder}/state", f"{folder}/log")


@query("""select user_id::varchar as relative_path, event_type as status, event_id as seq from events where event_id % 7 <> 0""")
def q108_log_tail(spark, sf_dir):
    """A log of JSON lines, some broken, followed as a stream by a source of lines: appended in two parts, each line is told once."""
    folder, e = incremental.shared_dir(spark), F.col("event_id")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("relative_path"), F.col("event_type").alias("status"), e.alias("event")))
    rows = table(spark, sf_dir, "events").select(F.when(e % 7 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value"), e.alias("seq"))
    logtail.register(spark)
    for part in (0, 1):
        rows.filter(f"seq % 2 = {part}").select("value").write.mode("append").text(f"{folder}/log")
        lines = spark.readStream.format("log_lines").option("range_bytes", 1 << 18).load(f"{folder}/log")
        copy = lines.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        copy.start(f"{folder}/copy").awaitTermination()
    told = spark.read.parquet(f"{folder}/copy").select("value", F.col("at").alias("seq"))
    return readers.tolerant_json_lines(told, "relative_path string, status string, event long", "relative_path").select("relative_path", "status", F.col("event").alias("seq"))
