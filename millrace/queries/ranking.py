"""Queries over rankings: lexical, fused and dense retrieval, its metrics, and the question workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import evaluation, retrieval, workflow
from millrace.plans.fixtures import NORMAL, QUERIES, eval_queries, normal_pages, table
from millrace.queries.registry import query
from millrace.streaming.incremental import save_to


def _lexical(corpus, queries, n="", digits=retrieval.DIGITS):
    """CTEs of scores: corpus (idx, text) and queries (qid, query) are names of earlier ones."""
    return f"""
d{n} as (select idx, tok, count(*) as tf from (select idx, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as tok from {corpus}) group by all),
q{n} as (select qid, tok, count(*) as qtf from (select qid, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) as tok from {queries}) group by all),
dl{n} as (select idx, sum(tf) as dl, sqrt(sum(tf * tf)::double) as norm from d{n} group by idx), ql{n} as (select qid, sqrt(sum(qtf * qtf)::double) as qnorm from q{n} group by qid),
df{n} as (select tok, count(*) as df from d{n} group by tok), facts{n} as (select (select count(*) from {corpus}) as n, greatest((select sum(dl) from dl{n}) / greatest((select count(*) from {corpus}), 1), 1) as avgdl),
scores{n} as materialized (select qid, idx, round(sum(qtf * tf)::double / (max(qnorm) * max(norm)), {digits}) as cosine,
  round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), {digits}) as bm25
  from d{n} join q{n} using (tok) join df{n} using (tok) join dl{n} using (idx) join ql{n} using (qid), facts{n} group by qid, idx)"""


def _hybrid(corpus, queries, n="", k=5):
    return _lexical(corpus, queries, n) + f""",
pairs{n} as (select q.qid, c.idx, coalesce(cosine, 0) as cosine, coalesce(bm25, 0) as bm25 from (select qid from {queries}) q cross join (select idx from {corpus}) c left join scores{n} s on s.qid = q.qid and s.idx = c.idx),
ranks{n} as (select qid, idx, row_number() over (partition by qid order by cosine desc, idx) as dense_rank, row_number() over (partition by qid order by bm25 desc, idx) as sparse_rank from pairs{n}),
fused{n} as (select *, round(1 / (60 + dense_rank) + 1 / (60 + sparse_rank), 12) as score from ranks{n}),
hits{n} as materialized (select * from (select *, row_number() over (partition by qid order by score desc, idx) as rk from fused{n}) where rk <= {k})"""


_DOCS = QUERIES + """,
corpus as (select doc_id as idx, text from documents), queries as (select item_id as qid, query from eval_queries)"""
_CHILDREN = """
children as (select item_id as idx, item_id // 4 as parent_id, text from benchmark), parents as (select parent_id, string_agg(text, ' ' order by idx) as text from children group by parent_id),
questions as (select conv_id * 1000 + turn as qid, text as query from conversations where role = 'user')"""


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text")


def _queries(spark, sf_dir):
    return eval_queries(spark, sf_dir).select(F.col("item_id").alias("qid"), "query")


def _children(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.expr("item_id div 4").alias("parent_id"), "text")


def _parents(children):
    own = children.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("c"))
    return own.select("parent_id", F.array_join(F.col("c.text"), " ").alias("text"))


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("query"))


def _top(score):
    return f"with {_DOCS}, {_lexical('corpus', 'queries')} select qid, idx, round({score}, 6) as score, rk from (select *, row_number() over (partition by qid order by {score} desc, idx) as rk from scores) where rk <= 5"


@query(_top("cosine"))
def q35_bow_cosine(spark, sf_dir):
    top = retrieval.lexical_top(_documents(spark, sf_dir), _queries(spark, sf_dir), 5, save_to(spark), "cosine")
    return top.select("qid", "idx", F.round("cosine", 6).alias("score"), F.col("rk").cast("long").alias("rk"))


@query(_top("bm25"))
def q36_bm25(spark, sf_dir):
    top = retrieval.lexical_top(_documents(spark, sf_dir), _queries(spark, sf_dir), 5, save_to(spark))
    return top.select("qid", "idx", F.round("bm25", 6).alias("score"), F.col("rk").cast("long").alias("rk"))


def _ints(df, *columns):
    return df.select(*[F.col(c).cast("long").alias(c) if c in columns else c for c in df.columns])


@query(f"with {_DOCS}, {_hybrid('corpus', 'queries')} select qid, idx, dense_rank, sparse_rank, round(score, 9) as score, rk from hits")
def q37_rrf_topk(spark, sf_dir):
    hits = retrieval.hybrid(_documents(spark, sf_dir), _queries(spark, sf_dir), save=save_to(spark))
    return _ints(hits.withColumn("score", F.round("score", 9)), "dense_rank", "sparse_rank", "rk")


_DENSE = """v as (select vec_id, label, embedding::double[] as e from embeddings), s as (select a.vec_id as qid, b.vec_id as idx,
  round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 9) as score from v a join v b on a.vec_id % 20 = 0),
top as (select *, row_number() over (partition by qid order by score desc, idx) as rk from s)"""


def _dense(spark, sf_dir, k):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    return retrieval.dense_top(v, v.filter("idx % 20 = 0").withColumnRenamed("idx", "qid"), k)


@query(f"with {_DENSE} select qid, idx, round(score, 6) as score, rk from top where rk <= 10")
def q38_dense_topk(spark, sf_dir):
    return _ints(_dense(spark, sf_dir, 10).withColumn("score", F.round("score", 6)), "rk")


def grade_sql(ranking, relevant, queries, k=3):
    recalls = ", ".join(f"coalesce((first <= {j})::int, 0)::bigint as recall_at_{j}" for j in range(1, k + 1))
    return f"""
hit as (select qid, min(rk) as first, sum(1 / log2(rk + 1.0)) as dcg from {ranking} join {relevant} using (qid, idx) where rk <= {k} group by qid), want as (select qid, count(*) as n from {relevant} group by qid),
graded as (select qid, {recalls}, coalesce(1 / first, 0)::double as mrr, coalesce(round(dcg / list_sum([1 / log2(i + 1.0) for i in generate_series(1, least(n, {k}))]), 9), 0)::double as ndcg,
  first as first_relevant_rank, n is not null as evidence_covered from (select qid from {queries}) left join hit using (qid) left join want using (qid))"""


_GRADED = f"""{_DENSE}, ranking as (select * from top where rk <= 4 and idx <> qid), others as (select qid, idx, row_number() over (partition by qid order by rk) as rk from ranking),
asked as (select vec_id as qid, label from embeddings where vec_id % 20 = 0), relevant as (select qid, vec_id as idx from asked join embeddings using (label) where vec_id <> qid and (qid + vec_id) % 3 = 0 and qid % 7 <> 3), {grade_sql('others', 'relevant', 'asked')}"""


def _graded(spark, sf_dir):
    """Every third vector of the same label is relevant, and none for every seventh query; a query is not its own hit."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label")
    relevant = asked.join(vectors, "label").filter("vec_id <> qid and (qid + vec_id) % 3 = 0 and qid % 7 <> 3").select("qid", F.col("vec_id").alias("idx"))
    ranking = _dense(spark, sf_dir, 4).filter("idx <> qid").withColumnRenamed("rk", "old")
    ranking = retrieval.ranked(ranking.withColumn("back", -F.col("old")), "back")
    return evaluation.grade(ranking, relevant, asked)


@query(f"with {_GRADED} select * from graded")
def q39_grade_metrics(spark, sf_dir):
    return _graded(spark, sf_dir)


_METRICS = ("recall_at_1", "recall_at_2", "recall_at_3", "mrr", "ndcg")


@query(f"with {_GRADED} select count(*) as queries, " + ", ".join(f"round(avg({c}), 6) as {c}" for c in _METRICS) + " from graded")
def q40_mean_metrics(spark, sf_dir):
    return evaluation.mean_metrics(_graded(spark, sf_dir), *_METRICS)


QRELS = "qrels as (select distinct item_id as qid, doc_id as idx from benchmark b join documents d on contains(d.text, b.text))"


def qrels(spark, sf_dir):
    """qid, idx: documents that hold a benchmark passage verbatim; met by the passages' first eight tokens, then confirmed."""
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    docs = _documents(spark, sf_dir)
    heads = retrieval.windows(passages, "qid", "passage", only_first=True)
    met = retrieval.windows(docs, "idx", "text").join(heads, "head").select("qid", "idx").distinct()
    # Only ids meet by heads; texts join the few pairs that do.
    confirmed = met.join(docs, "idx").join(passages.select("qid", "passage"), "qid")
    return confirmed.filter(F.contains("text", "passage")).select("qid", "idx")


@query(f"with {_DOCS}, {_hybrid('corpus', 'queries')}, {QRELS}, {grade_sql('hits', 'qrels', 'queries', 5)} select count(*) as queries, round(avg(recall_at_1), 6) as recall_at_1, round(avg(recall_at_3), 6) as recall_at_3, round(avg(mrr), 6) as mrr_at_5 from graded")
def q41_golden_metrics(spark, sf_dir):
    """Fused ranks of documents graded by the documents that hold each query's passage."""
    golden = _queries(spark, sf_dir)
    graded = evaluation.grade(retrieval.hybrid(_documents(spark, sf_dir), golden, save=save_to(spark)), qrels(spark, sf_dir), golden, 5)
    return evaluation.mean_metrics(graded, "recall_at_1", "recall_at_3", "mrr").withColumnRenamed("mrr", "mrr_at_5")


@query(f"with {QRELS} select * from qrels")
def q64_evidence_qrels(spark, sf_dir):
    return qrels(spark, sf_dir)


_PARENTS = f"""{NORMAL}, {_DOCS}, page_texts as (select doc_id * 100000 + page_num as idx, doc_id as parent_id, text from normal_pages where text <> ''), {_hybrid('page_texts', 'queries')},
up as (select qid, parent_id, min(rk) as rk from hits join page_texts using (idx) where rk <= 3 group by all), expanded as (select qid, row_number() over (partition by qid order by rk) as position, parent_id from up)"""


@query(f"with {_PARENTS} select qid, position, parent_id from expanded")
def q42_parent_expansion(spark, sf_dir):
    """Pages are ranked; what is read is their documents, each once."""
    children = normal_pages(spark, sf_dir).filter("text <> ''").select((F.col("doc_id") * 100000 + F.col("page_num")).alias("idx"), F.col("doc_id").alias("parent_id"), "text")
    hits = retrieval.hybrid(children.select("idx", "text"), _queries(spark, sf_dir), save=save_to(spark))
    parents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), "text")
    return _ints(retrieval.expand_parents(hits, children, parents).drop("text"), "position")


def _listed(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _tokens(c):
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


def _enough(query_column, evidence):
    q = f"list_filter({_tokens(query_column)}, lambda w: not list_contains({_listed(workflow.STOPWORDS)}, w))"
    subject = f"list_filter({q}, lambda w: not list_contains({_listed(workflow.GENERIC)}, w))"
    return f"coalesce(list_has_any({subject}, {_tokens(evidence)}) and len(list_intersect({q}, {_tokens(evidence)})) / greatest(len({q}), 1) >= {workflow.SUFFICIENT}, false)"


@query(f"with {_CHILDREN}, {_hybrid('children', 'questions')}, e as (select qid, string_agg(text, ' ' order by rk) as evidence from hits join children using (idx) where rk <= 3 group by qid) select qid, {_enough('query', 'evidence')} as sufficient from questions left join e using (qid)")
def q43_sufficiency(spark, sf_dir):
    children, questions = _children(spark, sf_dir), _questions(spark, sf_dir)
    evidence = workflow.evidence_of(retrieval.hybrid(children.select("idx", "text"), questions, save=save_to(spark)), children)
    return questions.join(evidence, "qid", "left").select("qid", workflow.sufficient(F.col("query"), F.col("evidence")).alias("sufficient"))


def _rewritten(c):
    out = f"lower({c})"
    for old, new in workflow.ALIASES:
        out = f"replace({out}, '{old}', '{new}')"
    return f"{out} || '{workflow.SUFFIX}'"


@query(f"with {_CHILDREN} select qid, {_rewritten('query')} as rewritten from questions")
def q44_rewrite(spark, sf_dir):
    return _questions(spark, sf_dir).select("qid", workflow.DeterministicModel().rewrite(F.col("query")).alias("rewritten"))


def _routed(c):
    return "case when " + " or ".join(f"contains(lower({c}), '{t}')" for t in workflow.STRUCTURED) + " then 'structured' else 'semantic' end"


@query(f"with {_CHILDREN}, x as (select qid, case when qid % 5 = 0 then query || ' Billing Code J9033' else query end as query from questions) select qid, {_routed('query')} as route from x")
def q45_route(spark, sf_dir):
    asked = F.when(F.col("qid") % 5 == 0, F.concat("query", F.lit(" Billing Code J9033"))).otherwise(F.col("query"))
    return _questions(spark, sf_dir).select("qid", workflow.route(asked).alias("route"))


_TERMS = f"list_filter({_tokens('answer')}, lambda w: not list_contains({_listed(workflow.BOILERPLATE)}, w))"


@query(f"""with a as (select item_id, case when item_id % 3 = 0 then '' else text end as context, case when item_id % 3 = 0 then '{workflow.NO_ANSWER}' when item_id % 3 = 1 then '{workflow.ANSWER}' || text else '{workflow.ANSWER}' || text || ' unsupported extra claim ' || reverse(text) end as answer from benchmark),
c as (select item_id, case when context = '' or starts_with(answer, 'Insufficient') then 0 else len(list_intersect({_TERMS}, {_tokens('context')})) / greatest(len({_TERMS}), 1) end as coverage from a)
select item_id, round(coverage, 9) as coverage, coverage >= {workflow.SUPPORTED} as supported from c""")
def q46_answer_verify(spark, sf_dir):
    """Quoted answers, answers with unsupported claims, and none."""
    model, k = workflow.DeterministicModel(), F.col("item_id") % 3
    rows = table(spark, sf_dir, "benchmark").withColumn("context", F.when(k == 0, "").otherwise(F.col("text")))
    extra = F.concat(F.lit(" unsupported extra claim "), F.reverse("text"))
    rows = rows.withColumn("answer", F.concat(model.answer(F.col("context")), F.when(k == 2, extra).otherwise("")))
    coverage = model.coverage(F.col("answer"), F.col("context"))
    return rows.select("item_id", F.round(coverage, 9).alias("coverage"), (coverage >= workflow.SUPPORTED).alias("supported"))


def _round(n, asked):
    up = f"""{_hybrid('children', asked, n)}, ev{n} as (select qid, string_agg(text, ' ' order by rk) as evidence from hits{n} join children using (idx) where rk <= 3 group by qid),
up{n} as (select qid, parent_id, min(rk) as rk from hits{n} join children using (idx) where rk <= 3 group by all),
cx{n} as (select qid, string_agg(parents.text, ' ' order by rk) as context, string_agg(parent_id::varchar, ',' order by rk) as parent_ids from up{n} join parents using (parent_id) group by qid),
g{n} as (select a.qid, a.query, parent_ids, context, '{workflow.ANSWER}' || context as answer, {_enough('a.query', 'evidence')} as enough from {asked} a left join ev{n} using (qid) left join cx{n} using (qid)),
r{n} as materialized (select *, len(list_intersect({_TERMS}, {_tokens('context')})) / greatest(len({_TERMS}), 1) as share, coalesce(enough and len(list_intersect({_TERMS}, {_tokens('context')})) / greatest(len({_TERMS}), 1) >= {workflow.SUPPORTED}, false) as verified from g{n})"""
    return up + (f", a{n + 1} as (select qid, {_rewritten('query')} as query from r{n} where not verified)" if n < 2 else "")


_SAFE = "query"
for _pattern, _mark in workflow.T.PII:
    _SAFE = f"regexp_replace({_SAFE}, '{_pattern}', '{_mark}', 'g')"


@query(f"""with {_CHILDREN}, a0 as (select qid, {_SAFE} as query from questions), {_round(0, 'a0')}, {_round(1, 'a1')}, {_round(2, 'a2')},
done as (select qid, verified, 0 as n, parent_ids from r0 where verified union all select qid, verified, 1, parent_ids from r1 where verified union all select qid, verified, 2, parent_ids from r2)
select qid, {_routed('a0.query')} as route, verified, not verified as needs_human_review, n::bigint as correction_count, case when verified then parent_ids end as parent_ids from done join a0 using (qid)""")
def q47_rag_workflow(spark, sf_dir):
    children = _children(spark, sf_dir)
    made = workflow.run(_questions(spark, sf_dir), children, _parents(children), save_to(spark))
    return made.select("qid", "route", "verified", "needs_human_review", "correction_count", "parent_ids")
