"""Queries over steps that something outside does, here made-up functions: fetching, parsing, converting, reviewing, generating,
answering, encoding; and over the states that their runs leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking, crawl, evaluation, models, retrieval, services
from millrace.plans.fixtures import FULL, NORM, NORMAL, full_texts, normal_pages, table
from millrace.queries.ranking import _CHILDREN, _METRICS, _children, _hybrid, _ints, _parents, _questions, _round, _SAFE, grade_sql, workflow
from millrace.queries.registry import query
from millrace.streaming.incremental import remembered, save_to, shared_dir


def _fetch(url):
    if len(url) % 7 == 3:
        raise OSError("status 404")
    return url.lower(), "Text/HTML; charset=x" if len(url) % 2 else "application/pdf", b"%PDF-" + url.encode()


@query("""select distinct url, case when length(url) % 7 <> 3 then lower(url) end as final_url, case when length(url) % 7 = 3 then null when length(url) % 2 = 1 then 'text/html' else 'application/pdf' end as content_type,
case when length(url) % 7 <> 3 then octet_length(encode(url)) + 5 end::bigint as bytes, case when length(url) % 7 = 3 then 'OSError: status 404' end as error from pages where url is not null""")
def q95_fetch(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("url").filter("url is not null").distinct()
    return services.fetched(urls, _fetch).select("url", "final_url", "content_type", F.octet_length("body").cast("long").alias("bytes"), "error")


def _fetch_numbered(url):
    n = int(url[1:])
    if n % 5 == 0:
        raise OSError("status 500")
    return url, "text/html" if n % 3 == 0 else "application/octet-stream", b"<html>" if n % 3 == 0 else b"%PDF-" + b"x" * (n % 50)


@query("""select 'u' || page_id as url, 'p' || page_id as path, case when page_id % 4 = 0 then 10 when page_id % 5 = 0 or page_id % 3 = 0 then null else 5 + page_id % 50 end::bigint as bytes,
case when page_id % 4 = 0 then 'existing' when page_id % 5 = 0 or page_id % 3 = 0 then null else 'downloaded' end as status,
case when page_id % 4 = 0 then null when page_id % 5 = 0 then 'OSError: status 500' when page_id % 3 = 0 then 'ValueError: response is not a PDF' end as error from pages""")
def q96_downloads(spark, sf_dir):
    """Files that are there are kept, empty ones fetched again, and what is fetched must be a PDF."""
    p = F.col("page_id").cast("string")
    pages = table(spark, sf_dir, "pages")
    existing = pages.filter("page_id % 4 < 2").select(F.concat(F.lit("p"), p).alias("path"), F.when(F.col("page_id") % 4 == 0, 10).otherwise(0).alias("bytes"))
    return services.downloads(pages.select(F.concat(F.lit("u"), p).alias("url"), F.concat(F.lit("p"), p).alias("path")), existing.withColumn("bytes", F.col("bytes").cast("long")), _fetch_numbered)


def _partition(content):
    lines = content.decode().split("\n")
    if len(lines) % 11 == 5:
        raise ValueError("bad")
    return [(k // 3 + 1, line) for k, line in enumerate(lines)]


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i, len(string_split(text, chr(10))) as n from documents),
g as (select doc_id, (i - 1) // 3 + 1 as page_num, string_agg(line, chr(10) order by i) as text from l where n % 11 <> 5 group by all)
select doc_id::varchar as path, page_num::bigint as page_num, sha256({NORM}) as digest, null as error from g union all select distinct doc_id::varchar, null::bigint, null, 'ValueError: bad' from l where n % 11 = 5""")
def q97_element_loader(spark, sf_dir):
    """The second loader: elements of pages, joined and normalized."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    return services.element_pages(files, _partition).select("path", "page_num", F.sha2("text", 256).alias("digest"), "error")


def _convert(content):
    import time

    number, _, text = content.decode().partition("\n")
    if number == "7":
        time.sleep(3)
    return ("SUCCESS", "Partial_Success", "Skipped")[len(text) % 3], {"num_pages": text.count("\n") + 1, "num_texts": len(text)}


@query("""with s as (select doc_id, text, case when doc_id = 7 then 'TimeoutError: more than 0.4 s' when length(text) % 3 = 2 then 'RuntimeError: conversion status: skipped' end as error from documents)
select doc_id::varchar as path, case when error is not null then 'failure' when length(text) % 3 = 0 then 'success' else 'partial_success' end as status, error,
case when error is null then length(text) - length(replace(text, chr(10), '')) + 1 end::bigint as num_pages, case when error is null then length(text) end::bigint as num_texts, true as timed from s""")
def q98_structural_profile(spark, sf_dir):
    """Profiles by an outside converter: refused files, and one that takes too long, are failures with their errors."""
    content = F.concat(F.col("doc_id").cast("string"), F.lit("\n"), "text")
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(content, "utf-8").alias("content"))
    made = services.structural_profiles(files, _convert, ("num_pages", "num_texts"), 0.4)
    return made.select("path", "status", "error", "num_pages", "num_texts", (F.col("conversion_seconds") >= 0).alias("timed"))


def _ocr(content):
    if len(content) % 17 == 4:
        raise ValueError("unreadable")
    return content.split(" ")[:20]


def _write(content, words, issues):
    return words[: len(words) - (max(0, len(issues) - 2) if issues else len(content) % min(6, content.count(" ") + 1))]


def _verify(content, own):
    missing = len(content.split(" ")[:20]) - len(own)
    return missing == 0, ["a word is missing"] * missing


@query("""with c as (select page_id as page, length(html) as n, len(string_split(html, ' ')[1:20]) as w, length(html) % least(6, len(string_split(html, ' '))) as m from pages)
select page, case when n % 17 = 4 then 'error' when m > 4 then 'review' else 'auto_pass' end as status, case when n % 17 = 4 then 'ValueError: unreadable' when m > 4 then 'revisions exhausted' end as reason,
case when n % 17 = 4 then 0 else least(3, 1 + ceil(m / 2)) end::bigint as attempts, case when n % 17 = 4 then null when m > 4 then round((w - 1) / w, 9) else 1 end::double as coverage from c""")
def q99_review_loop(spark, sf_dir):
    """Pages written, verified and written again with the issues found, three times at most."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.col("html").alias("content"))
    return services.reviewed_pages(pages, _ocr, _write, _verify, max_revisions=2)


def _generate(text):
    words = text.split(" ")
    if len(words) % 6 == 1:
        raise RuntimeError("down")
    return [(f"Q{i}", words[0], text + "!" * (len(words) % 6 == 2)) for i in (1, 2, 3)]


@query(f"""with {NORMAL}, c as (select *, len(string_split(text, ' ')) as w, case when page_num <= 6 and text <> '' then (doc_id + page_num) % 4 else 0 end as n from normal_pages),
t as (select *, page_num between 2 and 8 and text <> '' and n <> 3 as tried from c)
select doc_id, page_num, case when tried and w % 6 > 2 or tried and w % 6 = 0 then 3 else n end::bigint as n,
case when tried and w % 6 = 1 then 'RuntimeError: down' when tried and w % 6 = 2 then 'ValueError: rows do not hold' when not tried and page_num < 3 then 'old' end as message from t""")
def q100_eval_generation(spark, sf_dir):
    """A resumed run: complete pages are left alone, good rows replace a page's, failures leave a message for the next run."""
    pages, d, p = normal_pages(spark, sf_dir), F.col("doc_id"), F.col("page_num")
    old = pages.filter("page_num <= 6 and text <> '' and (doc_id + page_num) % 4 > 0").select("doc_id", "page_num", F.explode(F.sequence(F.lit(1).cast("long"), (d + p) % 4)).alias("k"))
    old = old.select("doc_id", "page_num", F.concat(F.lit("old "), F.col("k").cast("string")).alias("query"), F.lit("a").alias("answer"), F.lit("a").alias("quote"))
    rows, errors = services.generated_evals(pages, _generate, old, pages.filter("page_num < 3").select("doc_id", "page_num", F.lit("old").alias("message")), 2, 8)
    counts = rows.groupBy("doc_id", "page_num").agg(F.count("*").alias("n"))
    return pages.select("doc_id", "page_num").join(counts, ["doc_id", "page_num"], "left").join(errors, ["doc_id", "page_num"], "left").select("doc_id", "page_num", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "message")


@query("select page_id as page, case when page_id < 7 then 1 else 2 end::int as run from pages")
def q101_crawl_resume(spark, sf_dir):
    """A tree of pages, with null links, crawled in batches: a run of seven pages, then one that goes on from its log."""
    save, p = save_to(spark), F.col("page_id")
    folder = f"{shared_dir(spark)}/crawl"
    pages = table(spark, sf_dir, "pages").select("page_id")
    edges = save(pages.select(F.when(p % 5 > 0, p).alias("dst"), F.floor((p - 1) / 2).alias("src")).filter("src >= 0").unionByName(pages.filter("page_id % 5 = 0 and page_id > 0").select(p.alias("dst"), F.floor((p - 1) / 2).alias("src"))))
    start = pages.filter("page_id = 0").select(p.alias("page"))
    first, _ = crawl.crawled(start, edges, folder, save, max_pages=7, batch=3)
    first = save(first)
    second, _ = crawl.crawled(start, edges, folder, save)
    return first.select("page", F.lit(1).alias("run")).unionByName(second.select("page", F.lit(2).alias("run")))


_STATES = """s as (select a0.qid, a0.query as first, r0.verified as v0, r1.verified as v1, r2.verified as v2, r0.enough as e0, r1.enough as e1, r2.enough as e2,
r0.share as c0, r1.share as c1, r2.share as c2, r0.parent_ids as p0, r1.parent_ids as p1, r2.parent_ids as p2, r0.answer as t0, r1.answer as t1, r2.answer as t2
from a0 join r0 using (qid) left join r1 using (qid) left join r2 using (qid))"""


@query(f"""with {_CHILDREN}, a0 as (select qid, {_SAFE} as query from questions), {_round(0, 'a0')}, {_round(1, 'a1')}, {_round(2, 'a2')}, {_STATES}
select qid::varchar as thread_id, v0 or coalesce(v1, false) or coalesce(v2, false) as verified, not (v0 or coalesce(v1, false) or coalesce(v2, false)) as needs_human_review,
sha256(case when v0 then t0 when v1 then t1 when v2 then t2 else '{workflow.ESCALATED}' end) as answer, round(coalesce(case when e2 then c2 end, case when e1 then c1 end, case when e0 then c0 end, 0), 9) as verification_coverage,
coalesce(case when e2 then p2 end, case when e1 then p1 end, case when e0 then p0 end, '') as citations,
(4 + 3 * e0::int + case when v0 then 0 else 3 + 3 * e1::int + case when v1 then 0 else 3 + 3 * e2::int + case when v2 then 0 else 1 end end end)::bigint as events from s""")
def q102_query_api(spark, sf_dir):
    """The seven fields of an answer, with the number of events in its trace."""
    children = _children(spark, sf_dir)
    asked = _questions(spark, sf_dir).select(F.col("qid").cast("string").alias("thread_id"), "query")
    made = services.ask(asked, children, _parents(children), save_to(spark))
    return made.select("thread_id", "verified", "needs_human_review", F.sha2("answer", 256).alias("answer"), F.round("verification_coverage", 9).alias("verification_coverage"), F.array_join("citations", ",").alias("citations"), F.size("trace").cast("long").alias("events"))


# A small corpus of its own: chunks (id, parent, text) and queries with their relevant chunk.
_CHUNKS = (
    (0, "kiln", "Kilns are fired twice a week, and a log names who opened the door."), (1, "kiln", "Glaze code G117 needs a slow ramp to cone six."),
    (2, "kiln", "Cooling takes a night; the door stays shut below two hundred degrees."), (3, "loom", "Looms are reserved by the half day at the front desk."),
    (4, "loom", "Warp threads left on a loom are cut off after ten days."), (5, "press", "The letterpress may be used by members with a safety card."),
    (6, "press", "Type cases go back to their drawers, sorted by face and size."),
)
_GOLDEN = ((0, "when is the kiln fired", 0), (1, "ramp for G117", 1), (2, "how long does cooling take", 2), (3, "reserve a loom", 3), (4, "what happens to warp threads", 4), (5, "who may use the letterpress", 5), (6, "where do type cases go", 6))
_VALUES = f"""chunks as (select * from (values {', '.join(f"({i}::bigint, '{p}', '{t}')" for i, p, t in _CHUNKS)}) v(idx, parent, text)),
golden as (select * from (values {', '.join(f"({i}::bigint, '{q}', {r}::bigint)" for i, q, r in _GOLDEN)}) v(qid, query, idx)), relevant as (select qid, idx from golden)"""


@query(f"with {_VALUES}, {_hybrid('chunks', 'golden')}, {grade_sql('hits', 'relevant', 'golden')} select count(*) as queries, " + ", ".join(f"round(avg({c}), 6) as {c}" for c in _METRICS) + " from graded")
def q103_static_corpus(spark, sf_dir):
    chunks = spark.createDataFrame(_CHUNKS, "idx long, parent string, text string")
    golden = spark.createDataFrame(_GOLDEN, "qid long, query string, idx long")
    hits = retrieval.hybrid(chunks.select("idx", "text"), golden.select("qid", "query"), save=save_to(spark))
    return evaluation.mean_metrics(evaluation.grade(hits, golden.select("qid", "idx"), golden.select("qid")), *_METRICS)


def _letters():
    return lambda texts: [[t.count(c) for c in "aen"] for t in texts]


_LETTER = lambda c: f"(length(text) - length(replace(text, '{c}', '')))"


@query(f"""with v as (select doc_id, {_LETTER('a')} as a, {_LETTER('e')} as e, {_LETTER('n')} as n from documents), w as (select *, sqrt((a * a + e * e + n * n)::double) as norm from v)
select doc_id, round(case when norm > 0 then a / norm else 0 end, 4) as a, round(case when norm > 0 then e / norm else 0 end, 4) as e, round(case when norm > 0 then n / norm else 0 end, 4) as n from w""")
def q104_encoder(spark, sf_dir):
    """Unit vectors of an outside encoder."""
    made = table(spark, sf_dir, "documents").select("doc_id", models.embed(F.col("text"), _letters).alias("v"))
    return made.select("doc_id", *[F.round(F.get("v", F.lit(k)).cast("double"), 4).alias(c) for k, c in enumerate("aen")])


@query("select lang, count(*) as n from documents group by lang")
def q105_remembered(spark, sf_dir):
    """A result kept under a name and its input's path, size and time: built once, then read."""
    folder = shared_dir(spark)
    build = lambda: table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    remembered(spark, folder, "languages", f"{sf_dir}/documents.parquet", build)

    def never():
        raise RuntimeError("built twice")

    return remembered(spark, folder, "languages", f"{sf_dir}/documents.parquet", never, seconds=3600)


@query(f"""with {FULL} select doc_id, length(text) - length(replace(text, ' ', '')) + 1 as words, true as whole, true as fitting, true as overlapping from full_texts where text <> ''""")
def q109_subword_chunks(spark, sf_dir):
    """Chunks of at most 128 tokens of a public tokenizer: each is its place in the text, counted anew by the tokenizer, and together
    they hold every word."""
    import public_tokenizers

    path, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return chunking.subword_audit(full_texts(spark, sf_dir), models.token_ids(path, ranks), 128, 13)


@query("""with a as (select item_id as qid, unnest(['c' || item_id, 'unknown', 'c' || (item_id * 7 + 3) % 100000]) as chunk_id, unnest([0, 1, 2]) as position from benchmark)
select qid, position::int as position, sha256(text) as digest from a join benchmark b on chunk_id = 'c' || b.item_id""")
def q110_citations(spark, sf_dir):
    """What the chunks hold that answers cite by id, in the answers' order; unknown ids go."""
    items, c = table(spark, sf_dir, "benchmark"), F.lit("c")
    ids = F.array(F.concat(c, F.col("item_id").cast("string")), F.lit("unknown"), F.concat(c, ((F.col("item_id") * 7 + 3) % 100000).cast("string")))
    chunks = items.select(F.concat(c, F.col("item_id").cast("string")).alias("chunk_id"), "text")
    return workflow.cited(items.select(F.col("item_id").alias("qid"), ids.alias("ids")), chunks).select("qid", "position", F.sha2("text", 256).alias("digest"))


class _Lines(list):
    def __getitem__(self, k):
        line = super().__getitem__(k)
        if len(line) % 13 == 7:
            raise ValueError("damaged page")
        return b"%PDF-" + line.encode(), line.upper().encode()


def _open(content):
    lines = content.decode().split("\n")
    if len(lines) % 11 == 5:
        raise ValueError("no document")
    return _Lines(lines)


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i, len(string_split(text, chr(10))) as n from documents)
select 'in/file ' || doc_id || '.v1.pdf' as path, i::bigint as page, 'processed/file ' || doc_id || '.v1/page_' || lpad(i::varchar, 4, '0') as key,
case when length(line) % 13 <> 7 then 5 + octet_length(encode(line)) end::bigint as pdf_bytes, case when length(line) % 13 <> 7 then sha256(encode(line)) end as pdf_digest,
case when length(line) % 13 = 7 then 'ValueError: damaged page' end as error from l where n % 11 <> 5 and i <= 6
union all select distinct 'in/file ' || doc_id || '.v1.pdf', null::bigint, null, null::bigint, null, 'ValueError: no document' from l where n % 11 = 5""")
def q113_page_assets(spark, sf_dir):
    """The first six pages of files, each on its own; damaged pages and files are rows with their errors."""
    path = F.concat(F.lit("in/file "), F.col("doc_id").cast("string"), F.lit(".v1.pdf"))
    files = table(spark, sf_dir, "documents").select(path.alias("path"), F.encode("text", "utf-8").alias("content"))
    made = services.page_assets(files, _open, max_pages=6)
    own = F.substring("pdf", 6, 1 << 30)
    return made.select("path", "page", "key", F.octet_length("pdf").cast("long").alias("pdf_bytes"), F.sha2(own, 256).alias("pdf_digest"), "error")
