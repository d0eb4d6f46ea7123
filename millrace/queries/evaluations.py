"""Queries over evidence and eval rows: offsets, relevance, overlaps, upserts, resumes, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import chunking, evaluation
from millrace.plans.fixtures import NORMAL, doc_pages, documents, normal_pages, table
from millrace.queries.documents import SPANS, chunk_sql
from millrace.queries.registry import query

# Evidence: six characters of every page's text of six and more, from a place that differs by page; they may occur more than once.
_EVIDENCE = SPANS + """,
evidence as (select doc_id * 100000 + page_num as eval_id, doc_id, page_num, substring(text, 1 + (doc_id + page_num) % (length(text) - 5), 6) as quote from page_spans where length(text) >= 6)"""
_OFFSETS = _EVIDENCE + """,
starts as (select eval_id, e.doc_id, e.page_num, quote, s.text, s.start, unnest(generate_series(1, length(s.text) - length(quote) + 1)) as i from evidence e join page_spans s using (doc_id, page_num)),
found as (select eval_id, doc_id, page_num, (start + i - 1)::bigint as lo, (start + i - 1 + length(quote))::bigint as hi from starts where substring(text, i, length(quote)) = quote)"""


def _documents(spark, sf_dir):
    return documents(spark, sf_dir).filter("doc_id is not null")


def _evidence(spark, sf_dir):
    own = _documents(spark, sf_dir)
    rows = chunking.unbound(own).filter("length(text) >= 6").select((F.col("doc_id") * 100000 + F.col("page_num")).alias("eval_id"), "doc_id", "page_num", F.substring("text", (1 + (F.col("doc_id") + F.col("page_num")) % (F.length("text") - 5)).cast("int"), F.lit(6)).alias("quote"))
    return evaluation.evidence_in(rows, own)


@query(f"with {_OFFSETS} select * from found")
def q22_evidence_offsets(spark, sf_dir):
    return _evidence(spark, sf_dir)


_CHUNKS = chunk_sql(128, 13).split("full_texts as", 1)[1]
_RELEVANT = f"{_OFFSETS}, full_texts as{_CHUNKS}, held as (select distinct eval_id, doc_id, chunk_id from found join chunks using (doc_id) where start_index >= 0 and start_index <= lo and hi <= start_index + length(chunks.text))"


def _chunks(spark, sf_dir):
    return chunking.token_spans(chunking.joined_pages(_documents(spark, sf_dir)), 128, 13)


@query(f"with {_RELEVANT} select * from held")
def q26_relevant_chunks(spark, sf_dir):
    return evaluation.relevant_chunks(_evidence(spark, sf_dir), _chunks(spark, sf_dir))


@query(f'with {SPANS}, full_texts as{_CHUNKS} select doc_id, page_num, chunk_id from page_spans s join chunks c using (doc_id) where start_index >= 0 and start_index < s."end" and start_index + length(c.text) > s.start')
def q27_page_chunk_overlap(spark, sf_dir):
    return evaluation.page_overlaps(chunking.page_spans(chunking.unbound(_documents(spark, sf_dir))), _chunks(spark, sf_dir))


@query(f"with {_RELEVANT} select doc_id, chunk_id, string_agg(eval_id, ',' order by eval_id) as evals from held group by all")
def q28_chunk_evidence_map(spark, sf_dir):
    held = evaluation.relevant_chunks(_evidence(spark, sf_dir), _chunks(spark, sf_dir))
    return held.groupBy("doc_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_list("eval_id")).cast("array<string>"), ",").alias("evals"))


@query("""with old as (select event_id, user_id, event_type as message from events), incoming as (select event_id + 1000000 as event_id, user_id, 'new' as message from events where user_id % 7 = 0 and event_type = 'click')
select * from old where user_id not in (select user_id from incoming) union all select * from incoming""")
def q52_eval_upsert(spark, sf_dir):
    """All rows of a key give way to the incoming rows of that key."""
    events = table(spark, sf_dir, "events")
    old = events.select("event_id", "user_id", F.col("event_type").alias("message"))
    incoming = events.filter("user_id % 7 = 0 and event_type = 'click'").select((F.col("event_id") + 1000000).alias("event_id"), "user_id", F.lit("new").alias("message"))
    return evaluation.upsert(old, incoming, "user_id")


_EVAL_ROWS = """
eval_rows as (select doc_id, page_num, unnest(generate_series(1, (1 + (doc_id + page_num) % 4)::bigint)) as k from doc_pages where page_num <= 6 and text <> '')"""


@query(f"""with {NORMAL}, {_EVAL_ROWS}, c as (select doc_id, page_num, count(*) as n from eval_rows group by all)
select doc_id, page_num, case when text = '' then 'skipped' when n = 3 then 'done' else 'todo' end as state from doc_pages left join c using (doc_id, page_num) where page_num between 2 and 8""")
def q53_resume_pages(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    rows = pages.filter("page_num <= 6 and text <> ''").select("doc_id", "page_num", F.explode(F.sequence(F.lit(1), (1 + (F.col("doc_id") + F.col("page_num")) % 4).cast("int"))))
    return evaluation.pages_to_do(pages, rows, 2, 8)


_CASES = """
base as (select doc_id, page_num, text, string_split(text, ' ') as w from normal_pages where text <> ''),
evals as (select doc_id, page_num, unnest([1, 2, 3]) as k, text, w from base),
cases as (select doc_id, page_num, 'Query ' || case when (doc_id + page_num) % 5 = 1 then 1 else k end as query, w[k] as answer,
  case when (doc_id + page_num) % 5 = 2 and k = 2 then 'not in ' || text when (doc_id + page_num) % 5 = 3 and k = 3 then '' else text end as quote, text from evals where not ((doc_id + page_num) % 5 = 4 and k = 3))"""


@query(f"""with {NORMAL}, {_CASES}, j as (select doc_id, page_num, bool_and(coalesce(query <> '' and coalesce(answer, '') <> '' and quote <> '' and contains(text, quote) and contains(lower(quote), lower(answer)), false)) as good, count(*) as n,
count(distinct lower(query)) as queries from cases group by all) select doc_id, page_num, good and n = 3 and queries = 3 as accepted from j""")
def q55_eval_validator(spark, sf_dir):
    """Eval rows of every page, with one defect on four of five pages."""
    pages = normal_pages(spark, sf_dir)
    k, d = F.col("k"), (F.col("doc_id") + F.col("page_num")) % 5
    rows = pages.filter("text <> ''").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).filter(~((d == 4) & (k == 3)))
    quote = F.when((d == 2) & (k == 2), F.concat(F.lit("not in "), F.col("text"))).when((d == 3) & (k == 3), "").otherwise(F.col("text"))
    answer = F.coalesce(F.get(F.split("text", " "), k - 1), F.lit(""))
    made = rows.select("doc_id", "page_num", F.concat(F.lit("Query "), F.when(d == 1, 1).otherwise(k).cast("string")).alias("query"), answer.alias("answer"), quote.alias("quote"))
    return evaluation.valid_pages(made, pages)
