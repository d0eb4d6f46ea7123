"""URLs and HTML as Column functions: canonical form, links, archive paths, stripping, safety gates, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import WS, tokens

# The patterns of attributes, styles, active content and fenced answers that are looked for below.
_URL = r"^(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_ATTRIBUTE = r"""(?is)[\s"'/](?:href|src|data-href|data-url)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TAG = r"""(?s)<[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>"""


def part(url: Column, which: str) -> Column:
    at = {"scheme": 1, "host": 2, "path": 3, "query": 4}[which]
    return F.regexp_extract(url, _URL, at)


def without_dots(path: Column) -> Column:
    """A path that starts with a slash without empty inner segments, `.` and `..`; a step above the root stays at the root."""
    segments = F.split(path, "/")
    inner = F.filter(segments, lambda x, i: (x != "") | (i == 0) | (i == F.size(segments) - 1))
    step = lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(F.concat(held, F.array(x)))
    kept = F.aggregate(inner, F.expr("cast(array() as array<string>)"), step)
    kept = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(kept, "/")
    return F.when(joined == "", "/").otherwise(joined)


def resolve(url: Column, base: Column) -> Column:
    """An absolute URL from a link on the page `base`; dot segments of links without a host of their own are resolved."""
    scheme, host, path = part(base, "scheme"), part(base, "host"), part(base, "path")
    site = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(path, "[^/]*$", "")
    own = part(url, "path")
    rest = F.substring(url, F.length(own) + 1, F.length(url))
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    return (
        F.when(part(url, "scheme") != "", url)
        .when(url.startswith("//"), F.concat(scheme, F.lit(":"), url))
        .when(url.startswith("?"), F.concat(site, path, url))
        .when(url == "", base)
        .when(url.startswith("#"), F.concat(F.regexp_replace(base, "(?s)#.*$", ""), url))
        .otherwise(F.concat(site, without_dots(merged), rest))
    )


def canonical(url: Column, base: Column | None = None, keep_query: bool = True) -> Column:
    """http(s) with a host in lower case, no doubled slashes, no fragment; null for anything else."""
    whole = url if base is None else resolve(url, base)
    scheme, host = F.lower(part(whole, "scheme")), part(whole, "host")
    path = F.regexp_replace(part(whole, "path"), "/{2,}", "/")
    query = part(whole, "query")
    out = F.concat(scheme, F.lit("://"), F.lower(host), F.when(path == "", "/").otherwise(path))
    if keep_query:
        out = F.concat(out, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), out)


def is_pdf_url(url: Column) -> Column:
    return F.lower(part(url, "path")).endswith(".pdf")


def archive_path(url: Column) -> Column:
    """pdfs/host/parents/file; a query adds -digest to the stem."""
    parts = F.filter(F.split(part(url, "path"), "/"), lambda x: ~x.isin("", ".", ".."))
    name = F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(F.lit("document.pdf"))
    parents = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    suffix = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    stem = F.left(name, F.length(name) - F.length(suffix))
    digest = F.substring(F.sha2(part(url, "query"), 256), 1, 10)
    named = F.concat(stem, F.lit("-"), digest, F.when(suffix == "", ".pdf").otherwise(suffix))
    name = F.when(part(url, "query") != "", named).otherwise(name)
    return F.array_join(F.concat(F.array(F.lit("pdfs"), F.lower(part(url, "host"))), parents, F.array(name)), "/")


def unescape(text: Column) -> Column:
    for mark, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def links(html: Column) -> Column:
    """Values of href, src, data-href, data-url on start tags, in document order, empty ones dropped."""
    tags = F.regexp_extract_all(html, F.lit(_TAG), F.lit(0))
    found = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(0))))
    values = F.transform(found, lambda a: unescape(F.concat(*[F.regexp_extract(a, _ATTRIBUTE, i) for i in (1, 2, 3)])))
    return F.filter(values, lambda v: v != "")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<style\b[^>]*>.*?</style>", ""), "<[^>]+>", " ")


def unfence(response: Column, kind: str) -> Column:
    ends = F.regexp_replace(response, rf"^{WS}+|{WS}+$", "")
    return F.regexp_replace(F.regexp_replace(ends, rf"(?i)^```(?:{kind})?\s*|\s*```$", ""), rf"^{WS}+|{WS}+$", "")


def html_problem(html: Column) -> Column:
    """Why generated HTML is refused; null if it is accepted."""
    lower = F.lower(html)
    return (
        F.when(~(F.contains(lower, F.lit("<html")) & F.contains(lower, F.lit("</html>"))), "incomplete")
        .when(lower.rlike(r"<\s*(script|iframe|object|embed|form)\b"), "active content")
        .when(lower.rlike(r"\bon\w+\s*="), "event handler")
    )


def html_tokens(html: Column) -> Column:
    return tokens(strip_tags(html))


def verdict(response: Column) -> Column:
    """struct(equivalent, issues) of a strict JSON verdict, else null: equivalent must be a boolean, issues strings."""
    raw = F.try_parse_json(unfence(response, "json"))
    kind = F.schema_of_variant(raw)
    whole = kind.startswith("OBJECT<") & F.schema_of_variant(F.try_variant_get(raw, "$.equivalent", "variant")).eqNullSafe("BOOLEAN")
    issues = F.schema_of_variant(F.try_variant_get(raw, "$.issues", "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>")
    items = F.try_variant_get(raw, "$.issues", "array<string>")
    good = whole & issues & ~F.exists(items, lambda x: x.isNull())
    return F.when(good, F.struct(F.try_variant_get(raw, "$.equivalent", "boolean").alias("equivalent"), items.alias("issues")))


def json_span(text: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def s3_parts(uri: Column) -> Column:
    """struct(bucket, key) of an s3 URI, else null."""
    bucket, key = (F.regexp_extract(uri, "^s3://([^/]+)/(.+)$", i) for i in (1, 2))
    return F.when((bucket != "") & (key != ""), F.struct(bucket.alias("bucket"), key.alias("key")))


def output_prefix(key: Column, supplied: Column) -> Column:
    """A given prefix without slashes at its ends (null if empty or with ..), or processed/<stem>."""
    given = F.regexp_replace(supplied, "^/+|/+$", "")
    stem = F.regexp_replace(F.substring_index(key, "/", -1), r"(?<=[^.])\.[^.]*$", "")
    return F.when(supplied.isNull(), F.concat(F.lit("processed/"), stem)).when((given != "") & ~F.exists(F.split(given, "/"), lambda x: x == ".."), given)
