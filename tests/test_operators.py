"""The reference operators' numeric cases on small inline tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import web
from millrace.operators import chunking, crawl, evaluation, inventory, models, ordering, profiles, retrieval, workflow
from millrace.sources import commits, readers, writers
from millrace.streaming.incremental import save_to


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text(spark):
    r = one(
        spark, a=T.normalize(F.lit(" a \n b　")), b=T.word_count(F.lit("it's a semi-final, ok_1 -- é")), c=T.language(F.lit("안녕")), d=T.language(F.lit("漢字")), e=T.language(F.lit(" \n")),
        f=T.language(F.lit("la casa de")), g=T.table_estimate(F.lit("a|b|c\nd|e|f")), h=T.table_estimate(F.lit("a  b  c\n" * 3)), i=T.redact(F.lit("member id: A-12, a.b@c.org, 123-45-6789")),
        j=T.label(F.lit("num_list_items")), k=T.squeeze(F.lit("x \n" * 2000)), l=T.sane_limit(F.lit("512")), m=T.sane_limit(F.lit("1e30")), n=T.join_lines(F.lit("a\r\nb")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == ("a b", 5, "korean", "chinese", "none", "spanish", 1, 1)
    assert r.i == "[REDACTED_MEMBER_ID], [REDACTED_EMAIL], [REDACTED_SSN]"
    assert (r.j, len(r.k), r.l, r.m, r.n) == ("List Items", 1200, 512, None, "a  b")


def test_urls_and_html(spark):
    base = F.lit("https://Ex.com/a/b?q=1")
    cases = ["c", "/c//d", "//h.org", "?z=2", "#f", "ftp://x/y", "HTTP://A.b#f", "mailto:x"]
    got = [one(spark, v=web.canonical(F.lit(c), base)).v for c in cases]
    assert got == ["https://ex.com/a/c", "https://ex.com/c/d", "https://h.org/", "https://ex.com/a/b?z=2", "https://ex.com/a/b?q=1", None, "http://a.b/", None]
    r = one(spark, p=web.archive_path(F.lit("https://H.com/x/../y/f.PDF?v=1")), d=web.archive_path(F.lit("https://h.com")), pdf=web.is_pdf_url(F.lit("https://h/f.PDF?x#y")), links=web.links(F.lit("""<a href="/x?a=1&amp;b"><img SRC='i.png'><p data-url=u title="href='no'"><a href="">""")))
    assert r.p == f"pdfs/h.com/x/y/f-{hashlib.sha256(b'v=1').hexdigest()[:10]}.PDF" and r.d == "pdfs/h.com/document.pdf" and r.pdf
    assert r.links[:3] == ["/x?a=1&b", "i.png", "u"]
    problems = [one(spark, v=web.html_problem(web.unfence(F.lit(h), "html"))).v for h in ("```html\n<html>ok</html>\n```", "<p>", "<html><script></html>", "<html onload=x></html>")]
    assert problems == [None, "incomplete", "active content", "event handler"]
    verdicts = [one(spark, v=web.verdict(F.lit(v))).v for v in ('{"equivalent": true, "issues": []}', '{"equivalent": "true", "issues": []}', "no")]
    assert verdicts[0].equivalent is True and verdicts[1:] == [None, None]
    r = one(spark, a=web.s3_parts(F.lit("s3://b/k/x.pdf")), b=web.s3_parts(F.lit("/tmp/x")), c=web.output_prefix(F.lit("k/x.pdf"), F.lit(None).cast("string")), d=web.output_prefix(F.lit("k"), F.lit("a/../b")))
    assert (r.a.bucket, r.a.key, r.b, r.c, r.d) == ("b", "k/x.pdf", None, "processed/x", None)


def test_spans_evidence_and_containment(spark):
    pages = spark.createDataFrame([(1, 1, "same target"), (1, 2, "same target approved"), (1, 3, "")], "doc_id long, page_num long, text string")
    spans = chunking.page_spans(pages)
    assert [(r.page_num, r.start, r.end) for r in spans.orderBy("page_num").collect()] == [(1, 0, 11), (2, 12, 32)]
    ask = spark.createDataFrame([(7, 1, 2, "same target")], "eval_id long, doc_id long, page_num long, quote string")
    found = evaluation.evidence_spans(ask, spans)
    assert [(r.lo, r.hi) for r in found.collect()] == [(12, 23)]
    chunks = spark.createDataFrame([(1, 0, 0, "same target"), (1, 1, 12, "same"), (1, 2, 17, "target approved"), (1, 3, 12, "same target"), (1, 4, -1, "x" * 99)], "doc_id long, chunk_id long, start_index long, text string")
    assert [r.chunk_id for r in evaluation.relevant_chunks(found, chunks).collect()] == [3]
    assert one(spark, v=evaluation.occurrences(F.lit("aaaa"), F.lit("aa"))).v == [0, 1, 2]
    assert one(spark, v=evaluation.occurrences(F.lit("a"), F.lit("aaa"))).v == []


def test_metrics(spark):
    ranking = spark.createDataFrame([(q, i, k) for q in (1, 2) for k, i in enumerate((4, 2, 1), 1)], "qid long, idx long, rk int")
    graded = {r.qid: r for r in evaluation.grade(ranking, spark.createDataFrame([(1, 1)], "qid long, idx long"), spark.createDataFrame([(1,), (2,)], "qid long")).collect()}
    a, b = graded[1], graded[2]
    assert (a.recall_at_1, a.recall_at_2, a.recall_at_3, a.first_relevant_rank, a.evidence_covered) == (0, 0, 1, 3, True)
    assert (a.mrr, a.ndcg) == (pytest.approx(1 / 3), pytest.approx(0.5))
    assert (b.recall_at_3, b.ndcg, b.first_relevant_rank, b.evidence_covered) == (0, 0, None, False)


def test_dense_ranking(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "idx long, vector array<float>")
    q = spark.createDataFrame([(5, [0.0, 2.0])], "qid long, vector array<float>")
    assert [r.idx for r in retrieval.dense_top(v, q, 2).orderBy("rk").collect()] == [1, 0]
    assert retrieval.dense_top(v.limit(0), q, 2).count() == 0


def test_hybrid_ranks_cover_the_corpus(spark):
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue fox runs", "green tree", "a stone", "red red stone"])], "idx long, text string")
    hits = retrieval.hybrid(corpus, spark.createDataFrame([(1, "red stone"), (2, "nothing shared"), (3, "")], "qid long, query string"), save=save_to(spark)).collect()
    by = {q: [r.idx for r in sorted(hits, key=lambda r: r.rk) if r.qid == q] for q in (1, 2, 3)}
    assert by[1][0] == 4 and sorted(by[1]) == list(range(5)) and by[2] == by[3] == [0, 1, 2, 3, 4]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "page_num long, query string")
    new = spark.createDataFrame([(1, "z")], "page_num long, query string")
    assert sorted(map(tuple, evaluation.upsert(old, new, "page_num").collect())) == [(1, "z"), (2, "c")]
    errors = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y"), ("e", 3, "old")], "digest string, page_num long, message string")
    change = spark.createDataFrame([("d", 1, None), ("d", 4, " m \n n ")], "digest string, page_num long, message string")
    assert sorted(map(tuple, evaluation.set_errors(errors, change).collect())) == [("d", 2, "y"), ("d", 4, "m n")]
    rows = spark.createDataFrame([("d1",)], "pdf_sha256 string")
    assert evaluation.checked_evals(rows, "d1").count() == 1
    with pytest.raises(Exception, match="another file"):
        evaluation.checked_evals(rows, "d2").collect()


def test_coverage_and_outcomes(spark):
    words = lambda *w: spark.createDataFrame([(1, list(w))], "page long, words array<string>")
    assert profiles.word_coverage(words("a", "b", "b"), words("b", "a"), "page").first().coverage == pytest.approx(2 / 3)
    assert profiles.word_coverage(words("a"), words("a", "c"), "page").first().coverage == 1
    tries = spark.createDataFrame([(1, 0, 0.5, True, []), (1, 1, 1.0, True, []), (2, 0, 0.5, True, [])], "page long, revision long, coverage double, equivalent boolean, issues array<string>").withColumn("error", F.lit(None).cast("string"))
    got = {r.page: (r.status, r.attempts) for r in profiles.outcomes(tries).collect()}
    assert got == {1: ("auto_pass", 2), 2: ("review", 1)}


def test_character_chunks(spark):
    text = " ".join(f"word{i}" for i in range(900)) + " " + "x" * 3000 + " end"
    rows = sorted(chunking.character_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect(), key=lambda r: r.chunk_id)
    for a, b in zip(rows, rows[1:]):
        assert text[a.start_index : a.start_index + len(a.text)] == a.text and b.start_index > a.start_index
        assert len(a.text) <= 2500 or " " not in a.text
        assert a.start_index + len(a.text) - b.start_index <= 100 and b.start_index <= a.start_index + len(a.text) + 1
    assert rows[-1].text.endswith("end")


def test_workflow(spark):
    children = spark.createDataFrame([(0, 0, "continuous glucose monitor coverage for diabetes"), (1, 0, "insulin pump replacement"), (2, 1, "bendamustine chemotherapy dosing J9033")], "idx long, parent_id long, text string")
    parents = spark.createDataFrame([(0, "continuous glucose monitor coverage for diabetes insulin pump replacement"), (1, "bendamustine chemotherapy dosing J9033")], "parent_id long, text string")
    asked = spark.createDataFrame([(1, "What is the glucose monitor coverage, member id: AB-1?"), (2, "teleportation coverage policy"), (3, "code J9033"), (4, "chemo")], "qid long, query string")
    got = {r.qid: r for r in workflow.run(asked, children, parents, save_to(spark)).collect()}
    assert got[1].verified and got[1].correction_count == 0 and "REDACTED" in got[1].safe_query and got[1].answer.startswith("Based on")
    assert got[2].needs_human_review and got[2].correction_count == 2 and got[2].trace[-1].node == "human_review"
    assert got[3].route == "structured" and got[3].verified
    assert [t.node for t in got[1].trace] == ["protect", "route", "retrieve", "grade_retrieval", "expand_parent", "generate", "verify"]


def test_logs_and_files(spark, tmp_path):
    lines = spark.createDataFrame([('{"relative_path": "a", "n": 1}', 1), ("broken", 2), ("[1]", 3), ('{"relative_path": 5}', 4), ('{"relative_path": "a", "n": 2}', 5)], "value string, seq long")
    rows = readers.tolerant_json_lines(lines, "relative_path string, n long", "relative_path")
    assert [tuple(r) for r in profiles.last_written(rows, "relative_path", "seq").collect()] == [("a", 2, 5)]
    for name in ("x/A.PDF", "x/venv/b.pdf", "c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF-1")
    files = readers.find_pdfs(spark, f"{tmp_path}", readers.SKIPPED)
    assert [r.relative for r in files.collect()] == ["x/A.PDF"]
    pages = readers.pdf_pages(files, lambda content: ["one  page", None] if content else 1 / 0)
    assert [(r.page_num, r.text) for r in pages.collect()] == [(1, "one page"), (2, "")]
    good, bad = readers.complete_rows(spark.createDataFrame([(1, None), (2, "x")], "a long, b string"), ("a", "b"))
    assert good.count() == 1 and bad.first().lacks == ["b"]
    writers.append_log(spark.range(1), f"{tmp_path}/log")
    writers.append_log(spark.range(2), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 3
    assert writers.exit_status(spark.createDataFrame([("auto_pass",), ("review",)], "status string"), "status = 'auto_pass'") == 2


def test_crawl(spark):
    rules = [("/private", False), ("/private/ok", True)]
    r = one(spark, a=crawl.admitted(F.lit("https://me.org/private/x"), ("me.org",), rules), b=crawl.admitted(F.lit("https://me.org/private/ok"), ("me.org",), rules), c=crawl.admitted(F.lit("https://else.org/f.pdf"), ("me.org",), rules), d=crawl.admitted(F.lit("https://else.org/x"), ("me.org",), rules))
    assert (r.a, r.b, r.c, r.d) == (None, "page", "pdf", None)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = crawl.breadth_first(edges, spark.createDataFrame([("a",)], "node string"), save_to(spark)).collect()
    assert sorted((x.node, x.level) for x in got) == [("a", 0), ("b", 1), ("c", 2)]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "doc_id long, page_num long, text string")
    assert inventory.inventory(inventory.page_features(pages)).count() == 0
    assert inventory.corpus_totals(inventory.inventory(inventory.page_features(pages))).first().documents == 0
    assert chunking.token_chunks(chunking.concat_pages(pages), 128, 13).count() == 0
    empty = spark.createDataFrame([], "status string, value double")
    assert profiles.summarise(empty, "value", save=save_to(spark)).first().total == 0


def test_row_numbers_over_many_parts(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b")).repartition(13)
    got = ordering.row_numbers(rows, "a", F.col("b").desc(), save=save_to(spark)).collect()
    assert [(r.a, -r.b) for r in sorted(got, key=lambda r: r.rn)] == sorted((r.a, -r.b) for r in got)
    assert sorted(r.rn for r in got) == list(range(1, 1001)) and {r.total for r in got} == {1000}
    assert ordering.row_numbers(rows.limit(0), "a", save=save_to(spark)).count() == 0


def test_bands_are_slices(spark):
    for n in (3, 10, 27):
        files = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 4).alias("size"))
        got = chunking.size_bands(files, F.col("doc_id"), save_to(spark)).collect()
        want = {i + 1: b for b in range(10) for i in range(b * n // 10, (b + 1) * n // 10)}
        assert {r.rn: r.band for r in got} == want


def test_chunk_audit_flags(spark):
    pages = spark.createDataFrame([(1, 1, ""), (2, 1, "a b"), (2, 2, ""), (3, 1, "w " * 199 + "w")], "doc_id long, page_num long, text string")
    chunks = spark.createDataFrame([(2, 2)] + [(3, 20)] * 10, "doc_id long, n_tokens long")
    baseline = spark.createDataFrame([(2, 2), (3, 600), (3, 10)], "doc_id long, n_tokens long")
    got = {r.doc_id: r for r in chunking.chunk_audit(pages, chunks, baseline).collect()}
    assert got[1].flags == "no_extracted_text;very_short_document" and got[1].baseline_max == 0
    assert got[2].flags == "empty_pages;very_short_document;many_tiny_chunks" and got[2].extracted_tokens == 4
    assert got[3].flags == "baseline_over_embedding_limit;many_tiny_chunks;short_chunk_tail"
    assert (got[3].baseline_segments, got[3].baseline_median, got[3].baseline_p90, got[3].baseline_max) == (2, 307.0, 602, 602)


def test_models(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "i long, t string")
    load = lambda: lambda texts: [["<s>", *t.split(), "</s>"] for t in texts]
    assert {r.i: r.n for r in rows.select("i", models.count_tokens(F.col("t"), load).alias("n")).collect()} == {1: 4, 2: 0, 3: 0}
    lengths = lambda: lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts]
    got = {r.i: r.v for r in rows.select("i", models.embed(F.col("t"), lengths).alias("v")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == got[3] == [0.0, 0.0]


def test_sitemaps(spark):
    maps = [
        ("https://me.org/i.xml", "<?xml version='1.0'?><!-- c --><sm:sitemapindex><sm:loc>https://me.org/a.xml</sm:loc><loc>https://me.org/i.xml</loc></sm:sitemapindex>"),
        ("https://me.org/a.xml", "<urlset><loc> https://me.org/x?a=1&amp;b </loc><loc>/y#z</loc><loc>https://else.org/q</loc><loc>https://me.org/no/1</loc></urlset>"),
        ("https://me.org/lost.xml", "<urlset><loc>https://me.org/lost</loc></urlset>"),
    ]
    got = crawl.sitemap_pages(spark.createDataFrame(maps, "url string, xml string"), "https://me.org/i.xml", "https://me.org/", ("me.org",), [("/no", False)], save_to(spark))
    assert sorted(r.url for r in got.collect()) == ["https://me.org/", "https://me.org/x?a=1&b", "https://me.org/y"]


def test_more_files(spark, tmp_path):
    import time

    assert readers.json_lines(spark, f"{tmp_path}/none.jsonl", "a long").count() == 0
    errors = spark.createDataFrame([("d", 1, "x"), ("e", 2, "y"), ("d", None, "z")], "digest string, page_num long, message string")
    assert [tuple(r) for r in readers.page_errors(errors, "d").collect()] == [(1, "x")]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    files = readers.find_pdfs(spark, f"{tmp_path}")
    slow = readers.pdf_pages(files, lambda content: [time.sleep(5)], seconds=0.2).collect()
    assert [(r.page_num, r.error.split(":")[0]) for r in slow] == [(None, "TimeoutError")]
    writers.write_paths(files, f"{tmp_path}/paths")
    assert spark.read.json(f"{tmp_path}/paths").count() == 1
    summaries = spark.createDataFrame([("a", "low"), ("b", "error")], "path string, docling_risk string")
    writers.write_inventory(summaries, summaries, f"{tmp_path}/inventory")
    assert spark.read.json(commits.current(spark, f"{tmp_path}/inventory", "summaries")).filter("generated_at is not null").count() == 2
    assert [r.path for r in inventory.unscanned(spark.createDataFrame([("b",), ("c",)], "path string"), summaries).collect()] == ["c"]
    r = one(spark, s=T.slug(F.lit("policy")), u=T.under(F.lit("/a/b/c"), "/a/b/"), v=T.under(F.lit("/a/b/../c"), "/a/b"), w=T.under(F.lit("/a/bc"), "/a/b"))
    assert (r.s, r.u, r.v, r.w) == (hashlib.sha256(b"policy").hexdigest()[:12], True, False, False)
    answers = spark.createDataFrame([(1, ["c2", "no", "c1"])], "qid long, ids array<string>")
    cited = workflow.cited(answers, spark.createDataFrame([("c1", "T1"), ("c2", "T2")], "chunk_id string, title string"))
    assert [r.title for r in cited.orderBy("position").collect()] == ["T2", "T1"]


def test_dense_ranking_of_many_queries(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "idx long, vector array<double>").coalesce(1)
    queries = spark.range(4100).selectExpr("id as qid", "array(cast(id % 2 as double), cast(1 - id % 2 as double)) as vector")
    top = retrieval.dense_top(vectors, queries, 1).collect()
    assert sorted((r["qid"], r["idx"]) for r in top) == [(q, 1 if q % 2 else 2) for q in range(4100)]


def test_breadth_first_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(66)], "src long, dst long").coalesce(1)
    save = lambda df: spark.createDataFrame(df.collect(), df.schema).coalesce(1)
    found = crawl.breadth_first(edges, spark.createDataFrame([(0,)], "node long"), save).collect()
    assert sorted((r["node"], r["level"]) for r in found) == [(k, k) for k in range(67)]


def test_occurrences_and_chunks_of_a_long_text(spark):
    """Time follows the length of a text of ten million characters."""
    text = "a quick word " * 770_000
    rows = spark.createDataFrame([(1, text.strip())], "doc_id long, text string")
    assert rows.select(F.size(evaluation.occurrences(F.col("text"), F.lit("quick"))).alias("n")).first().n == 770_000
    made = chunking.token_chunks(rows, 480, 48).agg(F.count("*").alias("n"), F.max("start_index").alias("last"), F.sum("n_tokens").alias("t")).first()
    assert made.n == -(-(2_310_000 - 480) // 432) + 1 and text[made.last - 1] == " "


def test_fused_ranks_against_all_pairs(spark):
    """The k best and both their ranks, where most documents come late in one of the lists."""
    import math
    import random
    import re

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [" ".join(rnd.choices(words, k=rnd.choice((3, 30, 200)))) for _ in range(400)] + ["none"] * 5
    asked = [" ".join(rnd.sample(words, 3)) for _ in range(6)] + ["zzz", "w1 zzz none"]
    made = retrieval.hybrid(spark.createDataFrame(list(enumerate(docs)), "idx long, text string"), spark.createDataFrame(list(enumerate(asked)), "qid long, query string"), save=save_to(spark)).collect()
    toks = [re.findall("[a-z0-9]+", d) for d in docs]
    avgdl = sum(map(len, toks)) / len(toks)
    df = {w: sum(w in t for t in map(set, toks)) for w in {*words, "none"}}
    for qid, q in enumerate(asked):
        qt = re.findall("[a-z0-9]+", q)
        cos, bm = [], []
        for t in toks:
            tf = {w: t.count(w) for w in set(t)}
            cos.append(round(sum(qt.count(w) * tf.get(w, 0) for w in set(qt)) / (math.sqrt(sum(qt.count(w) ** 2 for w in set(qt))) * math.sqrt(sum(v * v for v in tf.values()))), 9))
            bm.append(round(sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in qt if tf.get(w)), 9))
        place = lambda v: {i: r for r, i in enumerate(sorted(range(len(v)), key=lambda i: (-v[i], i)), 1)}
        a, b = place(cos), place(bm)
        best = sorted(range(len(docs)), key=lambda i: (-round(1 / (60 + a[i]) + 1 / (60 + b[i]), 12), i))[:5]
        got = sorted((r for r in made if r.qid == qid), key=lambda r: r.rk)
        assert [(r.idx, r.dense_rank, r.sparse_rank) for r in got] == [(i, a[i], b[i]) for i in best]


def test_links_resolve_as_the_standard_library_does(spark):
    from urllib.parse import urljoin

    bases = ["https://h.x/a/b/c.html?q=1#f", "http://h.x", "http://h.x/", "https://H.x/a/b/", "http://h.x/a"]
    urls = ["d", "./d", "../d", "../../../d", "/d/../e", "/d/./", "e/..", "..", ".", "?x=1", "#y", "", "//o.y/z/../w", "https://o.y/a/../b", "d//e?u=../v", "a/b/../../c#.."]
    rows = spark.createDataFrame([(b, u) for b in bases for u in urls], "b string, u string")
    for r in rows.select("b", "u", web.resolve(F.col("u"), F.col("b")).alias("v")).collect():
        assert web_same(r.v, urljoin(r.b, r.u)), (r.b, r.u, r.v, urljoin(r.b, r.u))


def web_same(ours, theirs):
    """Equal, but for dots in links with a host of their own, which stay here, and a missing slash behind a host."""
    from urllib.parse import urlsplit

    a, b = urlsplit(ours), urlsplit(theirs)
    return (a.scheme, a.netloc, a.path or "/", a.query, a.fragment) == (b.scheme, b.netloc, b.path or "/", b.query, b.fragment)


def test_inventory_paths_are_no_columns(spark, tmp_path):
    """Paths of page details, also those that differ in case only, take no part in what is inferred."""
    import json

    from millrace.sources import readers

    page = lambda n: [{"page": 1, "has_text": True, "characters": n, "words": 2, "language": "english"}]
    lines = [{"summaries": [{"path": p, "pages": n}], "page_details": {p: page(n)}} for n, p in enumerate(("a.pdf", "A.pdf", "b c.pdf"))] + [{"page_details": {}}]
    (tmp_path / "inventory.json").write_text("\n".join(map(json.dumps, lines)))
    summaries, details = readers.inventory_json(spark, str(tmp_path / "inventory.json"), lines=True)
    assert sorted((r["path"], r["pages"]) for r in summaries.collect()) == [("A.pdf", 1), ("a.pdf", 0), ("b c.pdf", 2)]
    assert sorted((r["path"], r["pages"][0]["characters"]) for r in details.collect()) == [("A.pdf", 1), ("a.pdf", 0), ("b c.pdf", 2)]


def test_parts_are_found_at_their_places(spark):
    """Words before each start, also of one that falls back, and whether all parts stand where they are said to."""
    rows = [("aa b cc d", [0, 3, 5], ["aa b", "b", "cc d"]), ("aa b cc d", [5, 0], ["cc", "aa"]), ("aa b", [0, 2], ["aa", "b"]), (None, [0], ["a"])]
    df = spark.createDataFrame(rows, "t string, at array<long>, parts array<string>")
    found = df.select(chunking.words_before(F.col("t"), F.col("at")).alias("n"), chunking.stand(F.col("t"), F.col("at"), F.col("parts")).alias("there")).collect()
    assert [(r["n"], r["there"]) for r in found] == [([0, 1, 2], True), ([2, 0], True), ([0, 0], False), (None, None)]


def test_page_figures_by_definition(spark):
    """Stop words are whole runs of letters, in one pass; white space of any kind is no text and is stripped at the ends."""
    import re

    texts = ["el del la LAS política", "hola del_ de1 la", "the THE con con", "para_que por que", "\u00a0\u2003", "", "x", "\u3000 a b \x1f", "con,la;the-and of", "el ellos los", None]
    runs = lambda t: re.findall(r"\w+", t.lower())
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    found = df.select("t", T.words_of(t, T.SPANISH).alias("es"), T.words_of(t, T.ENGLISH).alias("en"), T.has_text(t).alias("has"), T.strip(t).alias("strip")).collect()
    for r in found:
        if r["t"] is None:
            assert r["es"] is None and r["has"] is None and r["strip"] is None
            continue
        assert (r["es"], r["en"]) == tuple(sum(w in words for w in runs(r["t"])) for words in (T.SPANISH, T.ENGLISH))
        assert r["strip"] == r["t"].strip() and r["has"] == bool(r["t"].strip())
    assert "lambda" not in df.select(T.language(t))._jdf.queryExecution().optimizedPlan().toString()
