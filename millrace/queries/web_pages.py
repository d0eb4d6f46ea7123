"""Queries over crawled pages: URLs, links, link graphs, archive paths, HTML stripping and gates, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import web
from millrace.operators import crawl, profiles
from millrace.plans.fixtures import table
from millrace.queries.registry import query
from millrace.streaming.incremental import save_to

_U = r"'(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"
_PARTS = f"lower(regexp_extract(url, {_U}, 1)) as scheme, regexp_extract(url, {_U}, 2) as host, regexp_extract(url, {_U}, 3) as path, regexp_extract(url, {_U}, 4) as query"
HOSTS = ("blog.tionsh.example.net", "thther.example.org", "blog.theres.example.com")


@query(rf"""with p as (select page_id, {_PARTS} from pages),
c as (select *, scheme || '://' || lower(host) || case when path = '' then '/' else regexp_replace(path, '/{{2,}}', '/', 'g') end as base from p)
select page_id, case when scheme in ('http', 'https') and host <> '' then base || case when query <> '' then '?' || query else '' end end as url,
  case when scheme in ('http', 'https') and host <> '' then base end as page_url, ends_with(lower(path), '.pdf') as is_pdf, lower(host) like '%.com' as own_host from c""")
def q13_canonical_urls(spark, sf_dir):
    u = F.col("url")
    host = F.lower(web.part(u, "host"))
    return table(spark, sf_dir, "pages").select("page_id", web.canonical(u).alias("url"), web.canonical(u, keep_query=False).alias("page_url"), web.is_pdf_url(u).alias("is_pdf"), host.endswith(".com").alias("own_host"))


_MADE = """l as (select page_id, url, unnest(regexp_extract_all(html, '[\\s"''/]href="(/[^"?#]*)"', 1)) as link from pages),
v as (select distinct page_id, url, link, case page_id % 4 when 0 then link when 1 then ltrim(link, '/') when 2 then '.././' || ltrim(link, '/') || '?q=1#f' else '/x/..' || link || '/.' end as href from l)"""


@query(rf"""with {_MADE}, p as (select v.*, lower(regexp_extract(url, {_U}, 1)) || '://' || lower(regexp_extract(url, {_U}, 2)) as site, string_split(regexp_extract(url, {_U}, 3), '/') as s from v where regexp_extract(url, {_U}, 2) <> ''),
f as (select *, list_filter(s[:len(s) - 1], lambda x: x <> '') as folder from p),
r as (select page_id, link, site, case page_id % 4 when 0 then link when 1 then '/' || array_to_string(list_concat(folder, [ltrim(link, '/')]), '/') when 2 then '/' || array_to_string(list_concat(folder[:greatest(len(folder) - 1, 0)], [ltrim(link, '/')]), '/') || '?q=1' else link || '/' end as path from f)
select page_id, link, site || regexp_replace(path, '/{{2,}}', '/', 'g') as url from r""")
def q106_resolved_links(spark, sf_dir):
    """Links of four relative forms, resolved on their pages and made canonical."""
    k, link = F.col("page_id") % 4, F.col("link")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""[\s"'/]href="(/[^"?#]*)\""""), F.lit(1)))).alias("link"))
    bare = F.ltrim(link, F.lit("/"))
    href = F.when(k == 0, link).when(k == 1, bare).when(k == 2, F.concat(F.lit(".././"), bare, F.lit("?q=1#f"))).otherwise(F.concat(F.lit("/x/.."), link, F.lit("/.")))
    own = pages.filter(web.part(F.col("url"), "host") != "")
    return own.select("page_id", "link", web.canonical(href, F.col("url")).alias("url"))


_LINKS = r"""regexp_extract_all(html, '[\s"''/]href="([^"]+)"', 1)"""


@query(f"with l as (select page_id, {_LINKS} as links from pages) select page_id, unnest(links) as link, generate_subscripts(links, 1)::bigint as place from l")
def q14_link_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(web.links(F.col("html"))).alias("at", "link")).select("page_id", "link", (F.col("at") + 1).cast("long").alias("place"))


@query(f"""with recursive l as (select distinct page_id, unnest({_LINKS}) as link from pages), e as materialized (select distinct a.page_id as src, b.page_id as dst from l a join l b using (link) where a.page_id <> b.page_id),
r(node, level) using key (node) as (select 0::bigint, 0::bigint union select e.dst, min(r.level + 1) from r join e on r.node = e.src where not exists (select 1 from recurring.r x where x.node = e.dst) group by e.dst)
select node, level from r""")
def q15_link_graph_bfs(spark, sf_dir):
    """Pages reached from page 0 over shared links."""
    pages = table(spark, sf_dir, "pages")
    own = pages.select("page_id", F.explode(F.array_distinct(web.links(F.col("html")))).alias("link"))
    save = save_to(spark)
    # Two-sided edges page - link - page keep the graph as small as the links themselves; a level is two steps.
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    half = own.select(node("p", "page_id").alias("src"), node("l", "link").alias("dst"))
    edges = save(half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    start = pages.filter("page_id = 0").select(F.lit("p0").alias("node"))
    found = crawl.breadth_first(edges, start, save)
    return found.filter(F.col("node").startswith("p")).select(F.substring("node", 2, 20).cast("long").alias("node"), (F.col("level") / 2).cast("long").alias("level"))


@query(rf"""with p as (select page_id, {_PARTS} from pages), a as (select *, list_filter(string_split(path, '/'), lambda x: x not in ('', '.', '..')) as parts from p),
b as (select *, case when len(parts) > 0 then parts[-1] else 'document.pdf' end as name from a), c as (select *, regexp_extract(name, '[^.](\.[^.]*)$', 1) as suffix from b)
select page_id, array_to_string(list_concat(['pdfs', lower(host)], parts[1:greatest(len(parts) - 1, 0)],
  [case when query <> '' then left(name, (length(name) - length(suffix))::bigint) || '-' || sha256(query)[1:10] || case when suffix = '' then '.pdf' else suffix end else name end]), '/') as path from c""")
def q16_safe_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.archive_path(F.col("url")).alias("path"))


_STRIPPED = r"regexp_replace(regexp_replace(html, '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g')"


@query(f"select page_id, length({_STRIPPED})::bigint as characters, len(regexp_extract_all(lower({_STRIPPED}), '[a-z0-9]+'))::bigint as tokens, sha256({_STRIPPED}) as digest from pages")
def q17_html_strip(spark, sf_dir):
    plain = web.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).cast("long").alias("characters"), F.size(T.tokens(plain)).cast("long").alias("tokens"), F.sha2(plain, 256).alias("digest"))


@query(r"""with h as (select page_id, lower(html) as h, regexp_replace(lower(html), '(?s)<script.*?</script>', '', 'g') as s from pages)
select page_id, case when not (contains(h, '<html') and contains(h, '</html>')) then 'incomplete' when regexp_matches(h, '<\s*(script|iframe|object|embed|form)\b') then 'active content'
  when regexp_matches(h, '\bon\w+\s*=') then 'event handler' end as problem, case when not (contains(s, '<html') and contains(s, '</html>')) then 'incomplete'
  when regexp_matches(s, '<\s*(script|iframe|object|embed|form)\b') then 'active content' when regexp_matches(s, '\bon\w+\s*=') then 'event handler' end as without_scripts from h""")
def q18_html_gate(spark, sf_dir):
    html = F.col("html")
    bare = F.regexp_replace(F.lower(html), "(?s)<script.*?</script>", "")
    return table(spark, sf_dir, "pages").select("page_id", web.html_problem(web.unfence(html, "html")).alias("problem"), web.html_problem(bare).alias("without_scripts"))


@query(rf"""with o as (select page_id, regexp_extract_all(lower(regexp_extract(html, '(?s)<body>(.*)</body>', 1)), '[a-z0-9]+') as words from pages),
h as (select page_id, regexp_extract_all(lower({_STRIPPED}), '[a-z0-9]+') as words from pages),
a as (select page_id, w, count(*) as n from (select page_id, unnest(words) as w from o) group by all), b as (select page_id, w, count(*) as m from (select page_id, unnest(words) as w from h) group by all),
c as (select page_id, sum(least(n, coalesce(m, 0))) / greatest(1, sum(n)) as coverage from a left join b using (page_id, w) group by page_id)
select page_id, round(coalesce(coverage, 0), 9) as coverage from pages left join c using (page_id)""")
def q19_word_coverage(spark, sf_dir):
    """How much of the words of a page's raw body its stripped HTML has."""
    pages = table(spark, sf_dir, "pages")
    raw = pages.select("page_id", T.tokens(F.regexp_extract("html", "(?s)<body>(.*)</body>", 1)).alias("words"))
    return profiles.word_coverage(raw, pages.select("page_id", web.html_tokens(F.col("html")).alias("words")), "page_id")


_ROBOTS = [("/de/", False), ("/de/4", True)]
_SITE = "https://example.com"


@query(rf"""with p as (select page_id, {_PARTS} from pages), c as (select *, case when path = '' then '/' else regexp_replace(path, '/{{2,}}', '/', 'g') end as clean from p),
u as (select page_id, scheme || '://' || lower(host) || clean || case when query <> '' then '?' || query else '' end as url from c
  where scheme in ('http', 'https') and lower(host) in {HOSTS} and (not starts_with(clean, '/de/') or starts_with(clean, '/de/4')))
select distinct url from u where (page_id // 100) % 3 <> 2 union select '{_SITE}/'""")
def q63_sitemap_pages(spark, sf_dir):
    """Sitemaps made of the pages: an index names an index for each hundred pages but every third, and those one sitemap a page."""
    pages = table(spark, sf_dir, "pages").select("url", "page_id", F.floor(F.col("page_id") / 100).alias("g"))
    at = lambda kind, c: F.concat(F.lit(f"{_SITE}/{kind}/"), F.col(c).cast("string"), F.lit(".xml"))
    loc = lambda c: F.concat(F.lit("<x><loc> "), c, F.lit(" </loc></x>"))
    nested = lambda c: F.concat(F.lit('<?xml version="1.0"?>\n<sitemapindex>'), F.array_join(F.collect_set(loc(c)), ""), F.lit("</sitemapindex>"))
    leaves = pages.select(at("s", "page_id").alias("url"), F.concat(F.lit("<urlset>"), loc(F.replace("url", F.lit("&"), F.lit("&amp;"))), F.lit("</urlset>")).alias("xml"))
    groups = pages.groupBy("g").agg(nested(at("s", "page_id")).alias("xml")).select(at("g", "g").alias("url"), "xml")
    top = pages.filter("g % 3 <> 2").agg(nested(at("g", "g")).alias("xml")).select(F.lit(f"{_SITE}/sitemap.xml").alias("url"), "xml")
    return crawl.sitemap_pages(leaves.unionByName(groups).unionByName(top), f"{_SITE}/sitemap.xml", f"{_SITE}/", HOSTS, _ROBOTS, save_to(spark))
