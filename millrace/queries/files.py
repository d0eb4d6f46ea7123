"""Queries over files: discovery, manifests, audits, exports and their ways back, made of the documents and pages tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import web
from millrace.operators import crawl, evaluation, inventory, profiles
from millrace.plans.fixtures import PAGES, doc_pages, table
from millrace.queries.documents import FEATURES, SUMMARY, _features, _summary
from millrace.queries.registry import query
from millrace.sources import commits, readers, writers
from millrace.streaming.incremental import save_to, shared_dir

_FOLDERS = ("a", ".venv", "sub/node_modules", "crawl", "B")
_D = "documents"


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _paths(spark, sf_dir):
    d = F.col("doc_id")
    path = F.concat(F.lit("/root/site/"), _pick(_FOLDERS, d % 5), F.lit("/File "), d.cast("string"), _pick((".PDF", ".pdf", ".txt"), d % 3))
    return table(spark, sf_dir, _D).select("doc_id", path.alias("path"), F.length("text").cast("long").alias("length"))


_PATHS = f"files as (select doc_id, '/root/site/' || {_sql_list(_FOLDERS)}[doc_id % 5 + 1] || '/File ' || doc_id || {_sql_list(('.PDF', '.pdf', '.txt'))}[doc_id % 3 + 1] as path, length(text)::bigint as length from documents)"


@query(f"with {_PATHS} select replace(path, '/root/site/', '') as relative, 'File ' || doc_id || {_sql_list(('.PDF', '.pdf'))}[doc_id % 3 + 1] as name from files where doc_id % 3 < 2 and doc_id % 5 in (0, 4)")
def q65_discovery(spark, sf_dir):
    """PDFs in any case below a root, those in skipped folders left out (the profiler skips one more)."""
    return readers.discovered(_paths(spark, sf_dir), "/root/site", (*readers.SKIPPED, "crawl")).select("relative", "name")


@query(f"with {_PATHS} select path, row_number() over (order by path) as place from files")
def q66_path_manifest(spark, sf_dir):
    """The manifest of paths, read back in its order."""
    from millrace.operators.ordering import row_numbers

    folder = shared_dir(spark)
    writers.write_paths(_paths(spark, sf_dir), f"{folder}/paths")
    return row_numbers(spark.read.schema("path string").json(f"{folder}/paths"), "path", save=save_to(spark), name="place").select("path", "place")


_CRAWLED = """pdfs as (select url, 'p' || page_id as path, length(html)::bigint as bytes, case when page_id % 2 = 0 then 'existing' else 'downloaded' end as status from pages where page_id % 3 = 0),
errors as (select url, case when page_id % 2 = 0 then 'page' else 'pdf' end as stage, 'IOError: ' || page_id as error from pages where page_id % 5 = 2)"""


def _crawled(spark, sf_dir):
    pages, p = table(spark, sf_dir, "pages"), F.col("page_id")
    pdfs = pages.filter("page_id % 3 = 0").select("url", F.concat(F.lit("p"), p.cast("string")).alias("path"), F.length("html").cast("long").alias("bytes"), F.when(p % 2 == 0, "existing").otherwise("downloaded").alias("status"))
    errors = pages.filter("page_id % 5 = 2").select("url", F.when(p % 2 == 0, "page").otherwise("pdf").alias("stage"), T.error_text(F.lit("IOError"), p.cast("string")).alias("error"))
    return pdfs, errors


@query(f"with {_CRAWLED} select 'pdf' as kind, url, path, bytes, status from pdfs union all select 'error', url, stage, null, error from errors")
def q67_crawl_manifest(spark, sf_dir):
    """The manifest's CSV of PDFs and its errors, read back."""
    folder = shared_dir(spark)
    writers.write_manifest(*_crawled(spark, sf_dir), folder)
    pdfs = spark.read.schema("url string, path string, bytes long, status string").csv(f"{folder}/manifest_csv", header=True)
    errors = spark.read.schema("url string, stage string, error string").json(f"{folder}/errors")
    return pdfs.select(F.lit("pdf").alias("kind"), "*").unionByName(errors.select(F.lit("error").alias("kind"), "url", F.col("stage").alias("path"), F.lit(None).cast("long").alias("bytes"), F.col("error").alias("status")))


@query(f"with {_CRAWLED} select 'https://a.b/' as root, 7::bigint as pages, (select count(*) from pdfs) as pdf_count, (select count(*) from errors) as error_count")
def q68_manifest_counts(spark, sf_dir):
    return crawl.manifest(*_crawled(spark, sf_dir), "https://a.b/", 7).drop("generated_at")


_AUDITED = """audited as (select '/f/' || doc_id as full_path, case when doc_id % 5 > 3 then null when doc_id % 5 = 3 then 0 else 1 + doc_id % 9 end::bigint as page_count,
  case doc_id % 5 when 0 then 'not a PDF' when 1 then 'password' when 4 then 'unreadable' when 3 then 'no pages' end as error from documents)"""


def _audited(spark, sf_dir):
    d = F.col("doc_id")
    content = F.encode(F.when(d % 5 == 0, "PK").otherwise("%PDF-1.7"), "utf-8")
    pages = F.when(d % 5 == 3, 0).when(d % 5 < 3, 1 + d % 9).cast("long")
    rows = table(spark, sf_dir, _D).select(F.concat(F.lit("/f/"), d.cast("string")).alias("full_path"), pages.alias("page_count"), content.alias("content"), (d % 5 == 1).alias("locked"))
    return rows.select("full_path", "page_count", crawl.audit_reason(F.col("content"), F.col("page_count"), F.col("locked")).alias("error"))


@query(f"with {_AUDITED} select full_path, page_count, error from (select full_path, case when error is null then page_count end as page_count, error from audited)")
def q69_pdf_audit(spark, sf_dir):
    """Valid files with their pages and invalid ones with the reason, through two tab-separated tables."""
    folder = shared_dir(spark)
    writers.write_audit(_audited(spark, sf_dir), folder)
    good = spark.read.schema("full_path string, page_count long").csv(f"{folder}/pages", sep="\t", header=True)
    bad = spark.read.schema("full_path string, error string").csv(f"{folder}/errors", sep="\t", header=True)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad.select("full_path", F.lit(None).cast("long").alias("page_count"), "error"))


@query(f"with {_AUDITED} select count(*) filter (error is null) as valid, count(*) filter (error is not null) as invalid, (count(error) > 0)::bigint as exit_status from audited")
def q70_audit_counts(spark, sf_dir):
    return crawl.audit_counts(_audited(spark, sf_dir))


_KINDS = ("text/html; charset=utf-8", "Application/PDF ;x=1", "application/xhtml+xml", "image/png")


@query("""select page_id, case when page_id % 4 = 1 or page_id % 7 = 3 then 'pdf' when page_id % 4 in (0, 2) then 'html' else 'other' end as kind from pages""")
def q71_content_kind(spark, sf_dir):
    p = F.col("page_id")
    body = F.encode(F.when(p % 7 == 3, F.concat(F.lit("%PDF-"), "html")).otherwise(F.col("html")), "utf-8")
    return table(spark, sf_dir, "pages").select("page_id", crawl.content_kind(_pick(_KINDS, p % 4), body).alias("kind"))


_ROBOTS = "# rules\nUser-agent: *\nDisallow: /de/ # all\nAllow: /de/4\n\nUser-agent: OtherBot\nUser-agent: mill\nDisallow: /en/\nAllow: /en/1\nDisallow:\n"
_PARTS = r"'(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)'"
_P = f"p as (select page_id, lower(regexp_extract(url, {_PARTS}, 1)) as host, regexp_extract(url, {_PARTS}, 2) || case when page_id % 3 = 0 then '.PDF' else '' end as path from pages)"


@query(f"""with {_P} select page_id, not starts_with(path, '/de/') or starts_with(path, '/de/4') as anyone, not starts_with(path, '/en/') or starts_with(path, '/en/1') as own from p""")
def q72_robots(spark, sf_dir):
    """What a robots file allows an agent that it names, and one that it doesn't."""
    path = web.part(F.col("url"), "path")
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(path, F.lit(".PDF"))).otherwise(path).alias("path")).select(
        "page_id", crawl.robots_allowed(F.col("path"), crawl.robots_rules(_ROBOTS, "Visitor/1.0")).alias("anyone"), crawl.robots_allowed(F.col("path"), crawl.robots_rules(_ROBOTS, "Mill/2.0")).alias("own")
    )


@query(f"""with {_P}, a as (select page_id, host like '%.com' as own, not starts_with(path, '/de/') or starts_with(path, '/de/4') as allowed, ends_with(lower(path), '.pdf') as pdf from p)
select page_id, case when pdf and (not own or allowed) then 'pdf' when own and allowed then 'page' end as kind from a""")
def q73_link_admission(spark, sf_dir):
    """PDF links of other hosts always, links of own hosts as robots allow."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"(?s)[?#].*$", "").alias("url"))
    pages = pages.withColumn("url", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url")))
    own = F.lower(web.part(F.col("url"), "host")).endswith(".com")
    return pages.select("page_id", crawl.admission(F.col("url"), own, crawl.robots_rules(_ROBOTS, "Visitor")).alias("kind"))


@query(f"with {_CRAWLED} select url from pages where url not in (select url from pdfs) and url not in (select url from errors where stage = 'pdf')")
def q74_not_attempted(spark, sf_dir):
    pdfs, errors = _crawled(spark, sf_dir)
    return crawl.not_attempted(table(spark, sf_dir, "pages").select("url"), pdfs, errors.filter("stage = 'pdf'"))


@query(f"with {SUMMARY}, d as (select doc_id, count(*)::bigint as listed, sum(characters)::bigint as characters from features group by doc_id) select doc_id, pages, languages, listed, characters from summary join d using (doc_id)")
def q75_inventory_details(spark, sf_dir):
    """Summaries and page details through JSON, met again by document; the map of languages isn't exported."""
    folder = shared_dir(spark)
    maps = inventory.language_pages(_features(spark, sf_dir))
    writers.write_inventory(_summary(spark, sf_dir).join(maps, "doc_id").drop("language_pages"), _features(spark, sf_dir), folder)
    summaries = spark.read.schema("doc_id long, pages long, languages string").json(commits.current(spark, folder, "summaries"))
    details = spark.read.schema("doc_id long, page_num long, characters long").json(commits.current(spark, folder, "page_details"))
    met = inventory.with_details(summaries, details)
    return met.select("doc_id", "pages", "languages", F.size("details").cast("long").alias("listed"), F.aggregate("details", F.lit(0).cast("long"), lambda s, x: s + x["characters"]).alias("characters"))


@query("""with l as (select user_id::varchar as relative_path, event_type as status, event_id as seq from events where event_id % 7 <> 0 and event_id % 11 <> 0)
select relative_path, arg_max(status, seq) as status, max(seq) as seq from l group by relative_path""")
def q76_tolerant_log(spark, sf_dir):
    """A log of JSON lines, appended twice, with broken lines and lines whose key is a number: the last good line of a key wins."""
    folder, e = shared_dir(spark), F.col("event_id")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("relative_path"), F.col("event_type").alias("status")))
    line = F.when(e % 7 == 0, F.concat(F.lit("{"), line)).when(e % 11 == 0, F.concat(F.lit('{"relative_path": '), F.col("user_id").cast("string"), F.lit("}"))).otherwise(line)
    rows = table(spark, sf_dir, "events").select(line.alias("value"), e.alias("seq"))
    writers.append_log(rows.filter("seq % 2 = 0"), f"{folder}/log")
    writers.append_log(rows.filter("seq % 2 = 1"), f"{folder}/log")
    back = readers.json_lines(spark, f"{folder}/log", "value string, seq long")
    return profiles.last_written(readers.tolerant_json_lines(back, "relative_path string, status string", "relative_path"), "relative_path", "seq")


@query("select item_id, 'policy ' || item_id % 3 as chunk_policy, left(sha256('policy ' || item_id % 3), 12) as slug from benchmark")
def q77_scored_results(spark, sf_dir):
    """Results by policy: a folder each, replaced whole, and the part of a file's name that tells the policy."""
    folder = shared_dir(spark)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("policy "), (F.col("item_id") % 3).cast("string")).alias("chunk_policy"))
    writers.write_results(rows.limit(1), folder)
    writers.write_results(rows, folder)
    return spark.read.schema("item_id long, chunk_policy string").json(commits.current(spark, folder, "results")).withColumn("slug", T.slug(F.col("chunk_policy")))


@query("select doc_id, length(text)::bigint as b_size, lang as a_lang, 'a_lang,b_size,doc_id' as header, 7::bigint as seed, 'stratified' as method from documents")
def q78_audit_export(spark, sf_dir):
    """CSV with columns in alphabetical order, and what the export is about."""
    folder = shared_dir(spark)
    rows = table(spark, sf_dir, _D).select("doc_id", F.length("text").alias("b_size"), F.col("lang").alias("a_lang"))
    writers.write_rows(rows, folder, seed=7, method="stratified")
    about = spark.read.schema("seed long, method string").json(f"{folder}/about").first()
    back = spark.read.csv(f"{folder}/csv", header=True)
    made = back.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("b_size").cast("long").alias("b_size"), "a_lang", F.lit(",".join(back.columns)).alias("header"))
    return made.withColumns({"seed": F.lit(about["seed"]), "method": F.lit(about["method"])})


@query(f"""with {PAGES}, s as (select doc_id, page_num, '<section aria-label="Page ' || page_num || '">' || chr(10) || '<div id="page' || page_num || '">' || text || '</div><a id="page0"/>' || chr(10) || '</section>' || chr(10) as section from doc_pages),
b as (select doc_id, string_agg(section, '' order by page_num) as body from s group by doc_id)
select doc_id, sha256('<!doctype html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>&lt;' || doc_id || '&gt; &amp; co</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || body || '</body>' || chr(10) || '</html>' || chr(10)) as digest from b""")
def q79_html_export(spark, sf_dir):
    page = F.concat(F.lit('<div id="page0">'), "text", F.lit('</div><a id="page0"/>'))
    title = F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit("> & co"))
    return writers.html_export(doc_pages(spark, sf_dir).select("doc_id", "page_num", title.alias("title"), page.alias("html"))).select("doc_id", F.sha2("html", 256).alias("digest"))


@query("""with p as (select page_id // 10 as job, page_id as page, case when page_id % 13 = 5 then 'review' when page_id % 37 = 7 then 'error' else 'auto_pass' end as status from pages)
select job, string_agg(status, ',' order by page) as statuses, bool_and(status = 'auto_pass') as all_pass, case when bool_and(status = 'auto_pass') then 0 else 2 end::bigint as exit_status from p group by job""")
def q80_run_manifest(spark, sf_dir):
    p = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(F.expr("page_id div 10").alias("job"), p.alias("page"), F.when(p % 13 == 5, "review").when(p % 37 == 7, "error").otherwise("auto_pass").alias("status"))
    return profiles.run_manifest(pages).withColumn("statuses", F.array_join("statuses", ","))


@query(f"with {_PATHS} select replace(path, '/root/site/', '') as relative, round_even(length * 1000 / 1048576.0, 2) as mib from files where doc_id % 3 < 2")
def q81_size_inventory(spark, sf_dir):
    files = readers.discovered(_paths(spark, sf_dir), "/root/site").withColumn("length", F.col("length") * 1000)
    return readers.size_inventory(files)


@query(f"""with {_PATHS}, e as (select path, 'ValueError' as kind, 'bad ' || doc_id as message from files where doc_id % 7 = 3)
select path, 0::bigint as pages, 'unknown' as text_present, 'skipped_large' as languages, 'error' as docling_risk, null as error from files where length > 3000 union all
select path, 0, 'unknown', 'error', 'error', kind || ': ' || message from e""")
def q82_placeholders(spark, sf_dir):
    """Rows for files over the limit and for those that failed, with all columns of a summary."""
    files = _paths(spark, sf_dir)
    errors = files.filter("doc_id % 7 = 3").select("path", F.lit("ValueError").alias("kind"), F.concat(F.lit("bad "), F.col("doc_id").cast("string")).alias("message"))
    made = inventory.placeholders(files, errors, 3000)
    return made.select("path", "pages", "text_present", "languages", "docling_risk", "error")


_EVALS = """e as (select item_id, item_id % 4 as page_num, case when item_id % 5 = 0 then null else 'q' || item_id end as query, case when item_id % 3 = 0 then null else 0.5 end as recall_at_3 from benchmark)"""


@query(f"with {_EVALS} select item_id, page_num, query is null as broken, case when query is null then 'query' else '' end as lacks, page_num = 2 and query is not null and recall_at_3 is not null as scored_here from e")
def q83_eval_files(spark, sf_dir):
    """Eval rows through JSON lines: rows that lack a column apart, and the scored rows of one page."""
    folder, i = shared_dir(spark), F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select("item_id", (i % 4).alias("page_num"), F.when(i % 5 != 0, F.concat(F.lit("q"), i.cast("string"))).alias("query"), F.when(i % 3 != 0, 0.5).alias("recall_at_3"))
    writers.append_log(rows, f"{folder}/evals")
    back = readers.json_lines(spark, f"{folder}/evals", "item_id long, page_num long, query string, recall_at_3 double")
    good, bad = readers.complete_rows(back, ("query", "page_num"))
    here = evaluation.page_rows(good, 2).select("item_id", F.lit(True).alias("here"))
    both = good.select("item_id", "page_num", F.lit(False).alias("broken"), F.lit("").alias("lacks")).unionByName(bad.select("item_id", "page_num", F.lit(True).alias("broken"), F.array_join("lacks", ",").alias("lacks")))
    return both.join(here, "item_id", "left").select("item_id", "page_num", "broken", "lacks", F.coalesce("here", F.lit(False)).alias("scored_here"))


@query("""with m as (select 'd' || page_id % 3 as digest, page_id as page_num, 'old' as message from pages), u as (select 'd1' as digest, page_id as page_num, case when page_id % 2 = 0 then '  new  ' || page_id || repeat(' x', 700) end as message from pages where page_id % 5 = 1)
select digest, page_num, message from m where digest = 'd1' and page_num not in (select page_num from u) union all select digest, page_num, left(trim(regexp_replace(message, '\\s+', ' ', 'g')), 1200) from u where message is not null""")
def q84_page_errors(spark, sf_dir):
    """Messages set, cleared, and those of another file's digest dropped."""
    pages, p = table(spark, sf_dir, "pages"), F.col("page_id")
    old = pages.select(F.concat(F.lit("d"), (p % 3).cast("string")).alias("digest"), p.alias("page_num"), F.lit("old").alias("message"))
    new = pages.filter("page_id % 5 = 1").select(F.lit("d1").alias("digest"), p.alias("page_num"), F.when(p % 2 == 0, F.concat(F.lit("  new  "), p.cast("string"), F.repeat(F.lit(" x"), 700))).alias("message"))
    made = evaluation.set_errors(old, new)
    return readers.page_errors(made, "d1").select(F.lit("d1").alias("digest"), "page_num", "message")


_LIMITS = ("512", "oops", "1000001", "")


@query("""select doc_id, sha256(replace(replace(text, chr(10), ' '), chr(13), ' ')) as joined, ['List Items', 'Pictures For Ocr', 'Texts'][doc_id % 3 + 1] as label, case when doc_id % 4 = 0 then 512 end::bigint as most from documents""")
def q85_text_functions(spark, sf_dir):
    """Broken lines joined, counters' names shown, models' limits sane or unknown."""
    d = F.col("doc_id")
    return table(spark, sf_dir, _D).select("doc_id", F.sha2(T.join_lines(F.col("text")), 256).alias("joined"), T.label(_pick(("num_list_items", "num_pictures_for_ocr", "num_texts"), d % 3)).alias("label"), T.sane_limit(_pick(_LIMITS, d % 4)).alias("most"))


@query("select (select count(*) from documents where length(text) > 2000) as over_limit")
def q86_over_limit(spark, sf_dir):
    return inventory.over_limit(table(spark, sf_dir, _D).select(F.length("text").alias("n")), "n", T.sane_limit(F.lit("2000")))


@query("""select doc_id, case when doc_id % 3 = 0 then 'b' || doc_id % 10 end as bucket, case when doc_id % 3 = 0 then 'k/' || doc_id || '.v1.pdf' end as object_key,
case when doc_id % 4 = 0 then 'processed/' || doc_id || '.v1' when doc_id % 4 = 1 then 'out/x' end as prefix, doc_id % 3 <> 2 as inside from documents""")
def q87_names(spark, sf_dir):
    """Parts of object names, prefixes for output, and whether a path lies under a root."""
    d = F.col("doc_id")
    key = F.concat(F.lit("k/"), d.cast("string"), F.lit(".v1.pdf"))
    uri = F.when(d % 3 == 0, F.concat(F.lit("s3://b"), (d % 10).cast("string"), F.lit("/"), key)).when(d % 3 == 1, F.concat(F.lit("/local/"), key)).otherwise("s3://only")
    given = _pick((None, "/out/x/", "a/../b", "/"), d % 4)
    path = F.concat(F.lit("/root/"), F.when(d % 3 == 2, "../").otherwise("in/"), d.cast("string"))
    return table(spark, sf_dir, _D).select("doc_id", web.s3_parts(uri)["bucket"].alias("bucket"), web.s3_parts(uri)["key"].alias("object_key"), web.output_prefix(key, given).alias("prefix"), T.under(path, "/root").alias("inside"))


@query("""select item_id, case when item_id % 3 = 2 then null else '{"a": ' || item_id || ', "b": {}}' end as span, case when item_id % 3 = 2 then null else item_id end as a from benchmark""")
def q88_json_span(spark, sf_dir):
    """JSON in the midst of a model's words."""
    i = F.col("item_id").cast("string")
    said = F.concat(F.lit("Sure: "), F.when(F.col("item_id") % 3 == 2, "no braces").otherwise(F.concat(F.lit('{"a": '), i, F.lit(', "b": {}}'))), F.lit(" done."))
    span = web.json_span(said)
    return table(spark, sf_dir, "benchmark").select("item_id", span.alias("span"), F.get_json_object(span, "$.a").cast("long").alias("a"))


_FIELDS = ("num_pages", "num_tables", "num_pictures", "num_texts", "num_section_headers", "num_list_items", "num_code_items", "num_formulas", "num_pictures_for_ocr")


@query("with d as (select doc_id from documents where doc_id % 4 <> 0) select count(*) as profiled, " + ", ".join(f"sum(case when doc_id % {k + 2} = 0 then 0 else doc_id % {k + 5} end)::bigint as {f}" for k, f in enumerate(_FIELDS)) + " from d")
def q89_profile_totals(spark, sf_dir):
    """Nine sums over successful profiles, a missing count as 0."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, _D).select(_pick(("failure", "success", "partial_success", "success"), d % 4).alias("status"), *[F.when(d % (k + 2) != 0, d % (k + 5)).alias(f) for k, f in enumerate(_FIELDS)])
    return profiles.totals(rows, _FIELDS)


@query(f"with {FEATURES}, x as (select doc_id, page_num % 3 as images, page_num % 4 as text_blocks from features) select images as value, count(*) as documents from (select doc_id, sum(images)::bigint as images from x group by doc_id) group by images")
def q90_image_value_counts(spark, sf_dir):
    """Page features with a parser's counts of images and blocks, rolled up."""
    pages = doc_pages(spark, sf_dir).withColumns({"images": F.col("page_num") % 3, "text_blocks": F.col("page_num") % 4})
    return inventory.value_counts(inventory.inventory(inventory.page_features(pages)), "images")


@query("""select doc_id::varchar as path, case when doc_id % 9 <> 4 then length(text) end::bigint as size, doc_id % 9 <> 4 as scanned from documents""")
def q91_checkpointed_scan(spark, sf_dir):
    """A scan that breaks off after its first checkpoints and goes on from them; every ninth file gives no row, and is told apart.
    Then the rows replace a snapshot."""
    folder, save = shared_dir(spark), save_to(spark)
    files = table(spark, sf_dir, _D).select(F.col("doc_id").cast("string").alias("path"), F.length("text").cast("long").alias("size"))
    every, scan = max(1, files.count() // 3), lambda part: part.filter("cast(path as long) % 9 <> 4")
    inventory.scan_in_batches(files.orderBy("path").limit(every), scan, f"{folder}/scan", save, every)
    whole = inventory.scan_in_batches(files.unionByName(files.limit(1).select(F.lit(None).cast("string").alias("path"), "size")), scan, f"{folder}/scan", save, every)
    commits.replace(f"{folder}/summary", rows=whole.limit(1))
    commits.replace(f"{folder}/summary", rows=whole)
    there = spark.read.parquet(commits.current(spark, f"{folder}/summary", "rows")).withColumn("scanned", F.lit(True))
    none = inventory.without_summary(spark, f"{folder}/scan").select("path", F.lit(None).cast("long").alias("size"), F.lit(False).alias("scanned"))
    return there.unionByName(none)


@query("select item_id, sha256(text) as digest, octet_length(encode(text))::bigint as bytes from benchmark")
def q92_object_round_trip(spark, sf_dir):
    """Objects put under keys and read back as bytes."""
    folder = shared_dir(spark)
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.col("text").alias("value"))
    writers.put_objects(rows, folder)
    back = readers.read_object(spark, f"{folder}/bucket=*/part-*").select(F.explode(readers.objects_in(F.col("content"))).alias("o"))
    return back.select(F.col("o.key").cast("long").alias("item_id"), F.sha2("o.value", 256).alias("digest"), F.octet_length("o.value").cast("long").alias("bytes"))


@query("""with x as (select page_id, 100 + page_id * 37 % 3000 as w, 1 + page_id * 91 % 4000 as h from pages), s as (select *, least(900 / w, 1000 / h, 1) as f from x)
select page_id, greatest(1, round_even(w * f, 0))::int as width, greatest(1, round_even(h * f, 0))::int as height, least(9, greatest(1, page_id % 20 - 3)) as shown from s""")
def q93_thumbnails(spark, sf_dir):
    """Sizes of scaled images, and page numbers kept in range."""
    p = F.col("page_id")
    size = inventory.thumbnail(100 + p * 37 % 3000, 1 + p * 91 % 4000)
    return table(spark, sf_dir, "pages").select("page_id", size["width"].alias("width"), size["height"].alias("height"), inventory.clamped(p % 20 - 3, F.lit(9).cast("long")).alias("shown"))


@query("select event_id, round(value / 1000, 3) as seconds from (select event_id, event_id % 100000 as value from events)")
def q94_elapsed(spark, sf_dir):
    began = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", inventory.elapsed(began, F.timestamp_micros(F.unix_micros(began) + F.col("event_id") % 100000 * 1000)).alias("seconds"))


@query(f"with {FEATURES} select doc_id::varchar as path, count(*)::bigint as pages, sum(characters)::bigint as characters, sum(words)::bigint as words, count(*) filter (has_text)::bigint as with_text, true as stamped from features group by doc_id")
def q111_inventory_reader(spark, sf_dir):
    """Inventory files, one a document, with their pages by path and the time of writing, read back."""
    folder = shared_dir(spark)
    pages = _features(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.struct(F.col("page_num").cast("int").alias("page"), "has_text", "characters", "words", "language").alias("p"))
    own = pages.groupBy("path").agg(F.array_sort(F.collect_list("p")).alias("pages"))
    summary = F.array(F.struct("path", F.size("pages").cast("long").alias("pages"), T.utc_stamp().alias("generated_at")))
    line = F.to_json(F.struct(summary.alias("summaries"), F.map_from_arrays(F.array("path"), F.array("pages")).alias("page_details")))
    own.select(line.alias("value")).write.text(f"{folder}/inventory")
    summaries, details = readers.inventory_json(spark, f"{folder}/inventory", lines=True)
    total = lambda c: F.aggregate("pages", F.lit(0).cast("long"), lambda s, x: s + x[c])
    details = details.select("path", total("characters").alias("characters"), total("words").alias("words"), F.size(F.filter("pages", lambda x: x["has_text"])).cast("long").alias("with_text"))
    stamped = F.col("generated_at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")
    return summaries.select("path", "pages", stamped.alias("stamped")).join(details, "path").select("path", "pages", "characters", "words", "with_text", "stamped")


@query("select item_id, sha256('file ' || item_id % 3) as pdf_sha256, true as refused from benchmark where item_id % 3 = 1")
def q112_checked_evals(spark, sf_dir):
    """Eval rows that belong to a file by its digest; a log with rows of another file is refused as a whole."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.concat(F.lit("file "), (F.col("item_id") % 3).cast("string")), 256).alias("pdf_sha256"))
    import hashlib

    digest, refused = hashlib.sha256(b"file 1").hexdigest(), False
    try:
        evaluation.checked_evals(rows, digest).write.format("noop").mode("overwrite").save()
    except Exception as e:  # Spark's error of a failed assertion
        refused = "another file" in str(e)
    own = evaluation.checked_evals(rows.filter(F.col("pdf_sha256") == digest), digest)
    return own.withColumn("refused", F.lit(refused))


@query("""select item_id::varchar as path, unnest([item_id % 9, 4]) as page_num, unnest(['bad ' || item_id, '7']) as message from benchmark where item_id % 5 in (0, 1) and item_id % 9 <> 4""")
def q114_page_error_files(spark, sf_dir):
    """Files of page errors: broken ones, those of another digest, and those with a page that is no number have none."""
    i = F.col("item_id")
    text, page = i.cast("string"), (i % 9).cast("string")
    good = F.concat(F.lit('{"pdf_sha256": "d", "errors": {"'), page, F.lit('": "bad '), text, F.lit('", "4": 7}}'))
    value = F.when(i % 5 < 2, good).when(i % 5 == 2, F.replace(good, F.lit('"d"'), F.lit('"e"'))).when(i % 5 == 3, F.replace(good, F.lit('"4"'), F.lit('"four"'))).otherwise(F.concat(F.lit("["), good))
    files = table(spark, sf_dir, "benchmark").filter("item_id % 9 <> 4").select(text.alias("path"), value.alias("value"))
    return readers.page_error_files(files, F.lit("d"))
