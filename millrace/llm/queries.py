"""The training-data operators as queries over whole tables, with DuckDB forms where SQL has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import alignment, bpe, divergence, fingerprints, mixing, packing, quality, sharding, simhash, tokens, toxicity, urls, warc
from millrace.llm.common import materialise, table, word_count

URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark, sf_dir):
    docs = materialise(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n_words"), F.md5(F.coalesce("text", F.lit(""))).alias("tie")), "sizes")
    mix = mixing.mix(docs, F.col("n_words"), tie=F.col("tie"))
    first = F.get("copies", F.lit(0))["position"]
    out = mix.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("copies"), F.round(first, 9).alias("position"))
    return out.orderBy("position", "doc_id")


def op2_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_quality(spark, sf_dir):
    found = quality.assess(table(spark, sf_dir, "documents"))
    passage = (F.col("longest_repeat") > quality.MAX_REPEAT).alias("repeats_passage")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", passage)


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_fingerprints(spark, sf_dir):
    made = fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprints.printed(F.col("sig_text")).alias("fingerprint"), fingerprints.printed(F.col("sig_edited")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sig_text"), F.col("sig_edited")).alias("near_edited"), fingerprints.likeness(F.col("sig_text"), F.col("sig_next")).alias("near_next"),
    )


def op6_warc(spark, sf_dir):
    back = warc.through_archives(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), ranks_path=tokenizer_file("byte_bpe_50k.tiktoken"))


def op8_tokens(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_sharding(spark, sf_dir):
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op11_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op12_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op13_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


LLM_QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_urls, op3_quality, op4_toxicity, op5_fingerprints, op6_warc, op7_packing, op8_tokens, op9_sharding, op10_simhash, op11_alignment, op12_bpe, op13_divergence)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LLM_ORACLES = {
    "op1_mixing": rf"""
with d as (select doc_id, source, len({_WORDS})::bigint as size, md5(coalesce(doc_id::varchar, '') || '/' || md5(coalesce(text, ''))) as o,
                  case when source is null then '' else '=' || source end as k from documents),
s as (select k, sum(size)::bigint as source_size from d group by k),
r as (select *, (row_number() over (order by (k = ''), k) - 1) % 3 as turn from s),
w as (select *, (turn + 1)::double as weight, 3 * source_size as cap from r),
v as (select *, cap / weight as per from w),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by per, k rows between unbounded preceding and 1 preceding), 0))::double
             / sum(weight) over (order by per, k rows between current row and unbounded following) as level from v),
t as (select k, turn, source_size, least(cap::double, weight * max(level) over ()) as target, cap from l),
p as (select *, least(cap, floor(target + 0.5))::bigint as demand from t),
b as (select d.*, turn, source_size, target, demand, case when source_size > 0 then demand // source_size else 0 end as full_copies,
             (sum(size) over (partition by k order by o, size rows unbounded preceding) - size)::bigint as before from d join p using (k)),
m as (select *, greatest(0, least(size, demand - full_copies * source_size - before))::bigint as part from b),
c as (select *, case when size > 0 then full_copies + (part > 0)::int else 0 end as copies,
             case turn when 0 then 1.5 when 1 then 1.0 else 0.5 end as w0, case turn when 0 then -1.0 when 1 then 0.0 else 1.0 end as slope,
             before / demand as share from m)
select doc_id, size, source_size, target, (size * full_copies + part)::bigint as taken, copies::bigint as copies,
       case when copies > 0 then round(2 * share / (w0 + sqrt(w0 * w0 + 2 * slope * share)), 9) end as position from c""",
    "op2_urls": r"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
r(verdict, h, q) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
n as (select *, row_number() over () as own from p),
f as (select n.own, arg_max(h || q, length(h || q)) as rule, arg_max(verdict, length(h || q)) as verdict
      from n join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by n.own)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from n left join f using (own)""",
    "op3_quality": r"""
with d as (select row_number() over () as own, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
x as (select own, unnest(words) as word, generate_subscripts(words, 1) as i, len(words) as n, words from w),
g as (select own, i, n, array_to_string(words[i:i+4], ' ') as w5, array_to_string(words[i:i+9], ' ') as w10, array_to_string(words[i:i+100], ' ') as w101 from x),
c as (select own, i, n, i + 4 <= n and count(*) over (partition by own, w5, i + 4 <= n) > 1 as r5,
             i + 9 <= n and count(*) over (partition by own, w10, i + 9 <= n) > 1 as r10,
             i + 100 <= n and count(*) over (partition by own, w101, i + 100 <= n) > 1 as r101 from g),
u as (select own, max(r5::int) over (partition by own order by i rows between 4 preceding and current row) as c5,
             max(r10::int) over (partition by own order by i rows between 9 preceding and current row) as c10, r101::int as r101 from c),
s as (select own, sum(c5) as n5, sum(c10) as n10, max(r101) as far from u group by own),
l as (select own, count(*) - count(distinct line) as dup from (select own, unnest(string_split(text, chr(10))) as line from d)
      where regexp_matches(line, '[^\x20\x09-\x0D]') group by own),
f as (select doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup, 0)::bigint as n_dup_lines,
             coalesce(n5, 0)::bigint as n_repeat_words, coalesce(n10, 0) as n10, coalesce(far, 0) as far
      from w left join s using (own) left join l using (own))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * n10 <= 15 * n_words and far = 0 as kept,
       n10::bigint as n_covered_words, far > 0 as repeats_passage from f""",
    "op6_warc": r"""
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha256(html) as payload_digest from p),
g as (select payload_digest, min(page_id) as least_id from h where payload_bytes >= 100 group by payload_digest),
j as (select h.*, least_id, least_id is not null and page_id is distinct from least_id as again from h left join g using (payload_digest))
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then least_id end as refers_to from j""",
    "op13_divergence": r"""
with d as (select row_number() over () as own, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select own, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*)::hugeint as total from w group by all having count(distinct own) >= 3),
c as (select w.lang, w.source, w.term, count(*)::hugeint as n from w semi join k using (lang, term) group by all),
g as (select lang, source, coalesce(sum(n), 0)::hugeint as size from (select distinct lang, source from d) left join c using (lang, source) group by all),
l as (select lang, sum(total)::hugeint as size, count(*)::hugeint as terms from k group by lang),
s as (select g.lang, g.source, term, coalesce(n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 1) // (g.size + terms) as p,
             1 + 1000000000::hugeint * (total + 1) // (l.size + terms) as q
      from g join l using (lang) join k using (lang) left join c using (lang, source, term)),
x as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
      from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
u as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source
      union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from s where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from u)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 200""",
}
