"""The training-data operators against brute force, and on nulls, empty and long texts, repeated rows and empty tables."""

import binascii
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, fingerprints, mixing, packing, quality, sharding, shingles, simhash, tokens, toxicity, urls, warc
from millrace.llm.common import word_count
from millrace.llm.queries import LLM_QUERIES, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, row string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=120, seed=1):
    """Documents with nulls, blanks, repeats, near copies, one long text and columns whose names clash."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeéß", k=rnd.randint(2, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rnd.choices(vocabulary, k=rnd.randint(12, 60)))
        rows.append([i * 3, text, "en", f"s{min(4, int(rnd.expovariate(1)))}"])
    rows[1][1], rows[2][1], rows[3][1], rows[4][3] = None, "", " \t\n", None
    rows[5][1] = rows[6][1] = rows[7][1]
    rows[8][1] = rows[9][1] + " X"
    rows[10][1] = "Same words again and again. " * 40
    rows[11][1] = " ".join(rnd.choices(vocabulary, k=6000))
    rows[12][1] = "a\u00a0b  c\n \n d\x1ce <|endoftext|> tail   \n"
    rows += [list(rows[13]), list(rows[13]), [None, "a text without a name", "en", "s1"]]
    return [(i, t, lang, s, len(t or ""), 7, "k", "r") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Mixing


def water_fill(sizes, weights, most=3):
    total, target, open_ = sum(sizes.values()), {}, dict(sizes)
    while open_:
        left, w = total - sum(target.values()), sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / w > most * open_[k]}
        if not over:
            return target | {k: left * weights[k] / w for k in open_}
        target |= {k: most * open_.pop(k) for k in over}
    return target


def test_mix_meets_targets(docs, rows):
    made = mixing.mix(docs, word_count(F.col("text"))).collect()
    assert len(made) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in made:
        assert r["size"] == len(WORDS.findall(r["row"]["text"] or ""))
        sizes[r["row"]["source"]] += r["size"]
        taken[r["row"]["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_fill(dict(sizes), {s: 1 + i % 3 for i, s in enumerate(order)})
    for r in made:
        assert r["target"] == pytest.approx(target[r["row"]["source"]])
        assert r["source_size"] == sizes[r["row"]["source"]]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5
    # Positions invert the schedule's integral: words of a source before time t follow it.
    knots = mixing.CURRICULUM[order.index("s0") % 3]
    own = [(c["position"], c["words"]) for r in made if r["row"]["source"] == "s0" for c in r["copies"]]
    for t in (0.25, 0.5, 0.75):
        (a, wa), (b, wb) = knots
        share = (wa * t + (wb - wa) * t * t / 2) / mixing.integral(knots)
        got = sum(w for p, w in own if p < t) / sum(w for _, w in own)
        assert abs(got - share) <= max(w for _, w in own) / sum(w for _, w in own) + 1e-9


def test_mixed_documents(docs, empty):
    again = [mixing.mixed_documents(docs, word_count(F.col("text"))).collect() for _ in range(2)]
    assert again[0] == again[1]
    assert again[0][0].asDict().keys() == set(docs.columns)
    by = {(r["row"]["doc_id"], r["size"]): r for r in mixing.mix(docs, word_count(F.col("text")), tie=F.md5(F.coalesce("text", F.lit("")))).collect()}
    for (i, size), r in by.items():
        if i is not None and i != 39 and r["row"]["text"]:
            out = [x for x in again[0] if x["doc_id"] == i]
            assert sum(len(WORDS.findall(x["text"])) for x in out) == r["taken"]
            assert all(x["n_chars"] == len(x["text"]) and r["row"]["text"].startswith(x["text"]) for x in out)
    assert mixing.mixed_documents(empty, word_count(F.col("text"))).count() == 0


def test_mix_of_many_sources_and_null_ids(spark):
    """As many sources as rows, half the ids null: targets follow the water level, and null ids spread over ranges."""
    n = 20_000
    docs = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("name"), F.concat(F.lit("s"), F.col("id")).alias("source"), (F.col("id") % 50 + 1).alias("n"), F.col("id").cast("string").alias("text"))
    made = mixing.mix(docs, F.col("n"), doc_id="name", tie=F.md5("text")).select("row.source", "size", "target", "taken", F.substring("order", 1, 1).alias("o"), "row.name").collect()
    sizes = {r["source"]: r["size"] for r in made}
    target = water_fill(sizes, {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))})
    assert len(made) == n and all(r["target"] == pytest.approx(target[r["source"]]) and abs(r["taken"] - r["target"]) <= 0.5 for r in made)
    assert len({r["o"] for r in made if r["name"] is None}) == 16
    out = mixing.mixed_documents(docs, F.col("n"), doc_id="name", n_chars="none")
    assert out.columns == docs.columns and out.agg(F.countDistinct("source")).first()[0] == sum(r["taken"] > 0 for r in made)


def test_schedule_with_several_knots(spark):
    knots = ((0.0, 0.0), (0.2, 3.0), (0.6, 3.0), (0.8, 0.0), (1.0, 0.0))
    grid = spark.range(0, 101).select((F.col("id") / 100).alias("q"))
    for r in grid.select("q", mixing.time_of(F.col("q"), mixing._segments(knots)).alias("t")).collect():
        t = np.linspace(0, r["t"], 20001)
        w = np.interp(t, [k[0] for k in knots], [k[1] for k in knots])
        assert np.trapezoid(w, t) / mixing.integral(knots) == pytest.approx(r["q"], abs=1e-6)


# URLs


def fits(host, path, rule_host, rule_path):
    return (host == rule_host or host.endswith("." + rule_host) or rule_host == "") and path.startswith(rule_path)


@pytest.mark.parametrize("unrolled", [urls.UNROLLED, 0])
def test_urls(spark, monkeypatch, unrolled):
    monkeypatch.setattr(urls, "UNROLLED", unrolled)
    rnd = random.Random(3)
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"), ("block", "a.b.net", ""), ("allow", "", "/never")]
    hosts = ["com", "Example.COM", "x.example.com", "badexample.com", "example.net", "a.b.net", "q.a.b.net", "org", "", "example.com:80", "u@example.com", "é.com"]
    paths = ["", "/en/", "/en/7", "/en/71/x", "/EN/7", "/de/8?x", "/de/9#y", "/es/é", "?q=/en/7", "/never/a"]
    urls_in = [f"{rnd.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in hosts for p in paths]
    urls_in += [None, "", "no scheme", "http:/x", "a://b://c/en/", "line\n://com/en/\nx", "http://com/en/1"] * 2
    pages = spark.createDataFrame([(i % 100, u, "x") for i, u in enumerate(urls_in)], "page_id long, url string, host string").repartition(3)

    def expected(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        own = [r for r in rules if fits(host, path, r[1], r[2])]
        best = max(own, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block"), default=None)
        return host, path, best and best[1] + best[2], best[0] if best else "allow"

    want = collections.Counter((i % 100, *expected(u)) for i, u in enumerate(urls_in))
    for limit in (100, 0):  # by broadcast and by the salted join
        assert collections.Counter(map(tuple, urls.judge(pages, rules, broadcast_rules=limit).collect())) == want
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}


def test_rules_of_the_query_by_its_contract(spark, tmp_path):
    """Each rule's word, and the longer rule of a host under it."""
    asked = {"a.net/de/1": "allow", "example.net/de/7": "allow", "example.net/de/8": "block", "x.com/en/7": "block", "example.com/en/7": "allow", "example.com/en/6": "block", "b.org/es/": "block", "c.net/en/": "allow"}
    spark.createDataFrame([(i, f"http://{u}", "") for i, u in enumerate(asked)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r["host"] + r["path"]: (r["rule"], r["verdict"]) for r in LLM_QUERIES["op2_urls"](spark, str(tmp_path)).collect()}
    assert {u: v for u, (_, v) in found.items()} == asked
    assert found["a.net/de/1"][0] == "net/de/" and found["c.net/en/"][0] is None


def test_urls_with_thousands_of_shapes(spark):
    rules = [("block", host, "/" + "p" * n) for n in range(2500) for host in ("com", "a.org")]
    asked = [("x.com", 0), ("com", 7), ("a.org", 2499), ("b.a.org", 1200), ("org", 5), ("com", 4000)]
    pages = spark.createDataFrame([(i, f"http://{h}/{'p' * n}/q") for i, (h, n) in enumerate(asked)], "page_id long, url string")
    found = {r["page_id"]: r["rule"] for r in urls.judge(pages, rules).collect()}
    assert found == {0: "com/", 1: "com/" + "p" * 7, 2: "a.org/" + "p" * 2499, 3: "a.org/" + "p" * 1200, 4: None, 5: "com/" + "p" * 2499}


# Quality


def brute_repeats(w, k):
    seen = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return len({j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})


def test_repeats_brute_force():
    rnd = random.Random(5)
    texts = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 60))] for _ in range(80)]
    texts += [[b"x"] * 300, [b"p", b"q"] * 40, [str(i).encode() for i in range(50)] * 2, []]
    five, ten, most = quality.repeats(texts)
    for i, w in enumerate(texts):
        assert five[i] == brute_repeats(w, 5) and ten[i] == brute_repeats(w, quality.MIN_WORDS)
        assert most[i] == max([k for k in range(1, len(w)) if brute_repeats(w, k)], default=0)


def test_quality(docs, rows, empty):
    found = quality.assess(docs, keep=("doc_id", "text")).collect()
    assert len(found) == len(rows)
    for r in found:
        t = r["text"] or ""
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        n5 = brute_repeats(w, 5)
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), n5)
        assert r["base_failed"] == (len(w) < 10 or 100 * n5 > 20 * len(w))
        longest = max([k for k in range(1, min(len(w), 130)) if brute_repeats(w, k)], default=0) if len(w) < 1000 else r["longest_repeat"]
        assert (r["n_covered_words"], min(129, r["longest_repeat"])) == (brute_repeats(w, 10), longest)
        assert r["kept"] == (not r["base_failed"] and 100 * r["n_covered_words"] <= 15 * len(w) and longest <= 100)
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)
    assert quality.assess(empty).count() == 0 and quality.accepted(empty).count() == 0


def test_longest_repeat_rejects():
    passage = " ".join(f"w{i}" for i in range(120))
    other = " ".join(f"v{i}" for i in range(1500))
    n_words, *_, most, failed, kept = quality.judge_texts([f"{passage} {other} {passage}", other])
    assert most.tolist() == [120, 0] and failed.tolist() == [False, False] and kept.tolist() == [False, True]


def test_covered_words_reject_what_the_base_rule_keeps():
    line = " ".join(f"w{i}" for i in range(12))
    other = " ".join(f"v{i}" for i in range(120))
    *_, windowed, long_ones, most, failed, kept = quality.judge_texts([f"{line} {other} {line}", f"{line} {other} {other[:3]}"])
    assert windowed.tolist() == [24, 0] and long_ones.tolist() == [24, 0] and most.tolist() == [12, 1]
    assert failed.tolist() == [False, False] and kept.tolist() == [False, True]


# Toxicity


def labelled(spark, n=600, seed=2):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(400)]
    bad = ["idiot", "trash", "scum", "moron", "pathetic"]
    rows = []
    for i in range(n):
        w = rnd.choices(vocabulary, k=rnd.randint(20, 200))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(2, len(w) // 40)):
                w[rnd.randrange(len(w))] = rnd.choice(bad) + rnd.choice(["", ".", "$$$"])
        rows.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth boolean").repartition(4)
    noisy = [(i, None if i % 14 == 0 else int(i % 3 > 0), int(t ^ (rnd.random() < 0.05))) for i, _, t in rows if i % 2 == 0]
    labels = spark.createDataFrame([*noisy, (None, 1, 1), (4, 1, None), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    chain = toxicity.train(docs, labels)
    found = toxicity.score(docs, chain, keep=("doc_id", "truth")).collect()
    held = [r for r in found if r["doc_id"] % 2]
    assert sum(r["is_toxic"] == r["truth"] for r in held) >= 0.97 * len(held)
    assert toxicity.accepted(docs, chain).count() == sum(not r["is_toxic"] for r in found)
    again = toxicity.score(docs, toxicity.train(docs, labels), keep=("doc_id", "truth")).collect()
    assert sorted(found) == sorted(again)


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, labels) is None and toxicity.train(docs, labels.limit(0)) is None
    assert not any(r["is_toxic"] for r in toxicity.score(docs, None).collect())
    a, b = labelled(spark, 100)
    chain = toxicity.train(a, b)
    assert len(toxicity.score(docs, chain).collect()) == docs.count() and toxicity.score(empty, chain).count() == 0
    assert toxicity.train(empty, b) is None


def newton(x, y, weight, decay):
    """Logistic regression with an intercept, solved exactly: weights, intercept last."""
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (weight * (p - y)) + decay * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(decay + 1e-12)
        w -= np.linalg.solve(hessian, grad)
    return w


def dense_chain(texts, labels, fold, new):
    """The chain's last probabilities of new texts, before the cut, by dense matrices and exact solutions."""

    def matrix(ts):
        out = np.zeros((len(ts), 1 << toxicity.BITS))
        for i, t in enumerate(ts):
            counts = collections.Counter()
            for w in re.findall("[a-z0-9]+", t.lower()):
                for f in (w, *("^" + w[:k] for k in toxicity.BEGINNINGS if len(w) > k)):
                    counts[toxicity.word_slot(f.encode())] += 1
            for f, n in counts.items():
                out[i, f] = 1 + np.log(n)
        return out / np.maximum(1e-300, np.linalg.norm(out, axis=1))[:, None]

    x, z = matrix(texts), matrix(new)
    used = np.flatnonzero((x > 0).any(axis=0))
    x, z = x[:, used], z[:, used]

    def fitted(held, y, use):
        share = use * np.where(y, 0.5 / (use * y).sum(), 0.5 / (use * ~y).sum())
        has = (x > 0) * use[:, None]
        pos, neg = (has * y[:, None]).sum(0), (has * ~y[:, None]).sum(0)
        ratio = np.log((pos + 1) / ((use * y).sum() + 2)) - np.log((neg + 1) / ((use * ~y).sum() + 2))
        ratio[pos + neg < toxicity.LEAST_DOCS] = 0
        kept = np.flatnonzero(ratio)
        w = newton(np.c_[x[:, kept] * ratio[kept], held], y, share, np.r_[np.full(len(kept), 1e-3), np.zeros(held.shape[1] + 1)])
        return lambda m, h: 1 / (1 + np.exp(-(np.c_[m[:, kept] * ratio[kept], h] @ w[:-1] + w[-1])))

    held, last = np.zeros((len(x), 0)), np.zeros((len(z), 0))
    for k in range(labels.shape[1]):
        y, known = labels[:, k] > 0, ~np.isnan(labels[:, k])
        out = np.zeros(len(x))
        for f in range(toxicity.FOLDS):
            out[fold == f] = fitted(held, y, (known & (fold != f)).astype(float))(x, held)[fold == f]
        last = np.c_[last, fitted(held, y, known.astype(float))(z, last)]
        held = np.c_[held, out]
    return held, last


def test_chain_against_exact_solutions():
    rnd = random.Random(8)
    texts, labels = [], []
    for i in range(150):
        w = rnd.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=rnd.randint(3, 12))
        good, toxic = rnd.random() < 0.6, rnd.random() < 0.4
        w += rnd.choices(["careful", "sources", "alpha"], k=3) * good + rnd.choices(["nastyness", "nastyish", "beta"], k=2) * toxic
        texts.append(" ".join(rnd.sample(w, len(w))))
        labels.append((float("nan") if i % 10 == 3 else float(good), float(toxic)))
    labels, fold = np.array(labels), np.arange(150) % toxicity.FOLDS
    chain = toxicity.fit_chain(*toxicity.features(texts), labels, fold)
    held, last = dense_chain(texts, labels, fold, texts)
    logit = lambda p: np.log(p / (1 - p))
    own = chain.probabilities(texts)
    cut = toxicity.best_cut(logit(held[:, -1]), labels[:, -1] > 0)
    assert abs(own[:, 0] - last[:, 0]).max() < 0.03
    assert abs(1 / (1 + np.exp(cut - logit(last[:, 1]))) - own[:, 1]).max() < 0.08


def test_best_cut():
    y = np.array([True, True, False, False])
    assert toxicity.best_cut(np.array([3.0, 2.0, 0.0, -1.0]), y) == 1.0
    assert toxicity.best_cut(np.array([3.0, -2.0, 0.0, -1.0]), y) == 1.5  # a clean one flagged is worse than a toxic one missed
    assert toxicity.best_cut(np.array([0.0, -2.0, 3.0, -1.0]), y) > 3.0


def test_later_models_use_earlier_probabilities(spark):
    docs, labels = labelled(spark)
    assert abs(toxicity.train(docs, labels).models[-1].dense).max() > 0


def test_sample_is_bounded(spark, monkeypatch):
    docs, labels = labelled(spark, 3000)
    few = toxicity.training_rows(docs, labels, per_class=20).collect()
    assert sorted(r["y1"] for r in few) == [0.0] * 20 + [1.0] * 20
    monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", 5)
    assert toxicity.train(docs, labels, per_class=200) is not None


# Fingerprints


def test_fingerprints(spark, docs, rows, empty):
    made = fingerprints.fingerprint_neighbours(docs, range_rows=20).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for a, b in zip(order, order[1:] + order[:1]):
        t, u = a[1] or "", b[1] or ""
        n = len(t) // 3
        want.append((a[0], len(t), hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest()))
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in made) == collections.Counter(want)
    by = {r["doc_id"]: r for r in made}
    assert by[15]["sig_text"] == by[18]["sig_text"] == by[21]["sig_text"] and by[6]["sig_text"] == by[9]["sig_text"]
    assert by[0]["sig_text"] != by[12]["sig_text"]
    after = {a[0]: b[0] for a, b in zip(order, order[1:] + order[:1])}
    assert all(by[i]["sig_next"] == by[j]["sig_text"] for i, j in after.items())
    assert fingerprints.fingerprint_neighbours(empty).count() == 0
    one = fingerprints.fingerprint_neighbours(docs.filter("doc_id = 0")).collect()
    assert len(one) == 1 and one[0]["sig_next"] == one[0]["sig_text"]
    assert fingerprints.fingerprint_neighbours(docs.filter("doc_id is null")).count() == 1


def drawn(text, lanes=fingerprints.LANES):
    """The signature of a text by the definition, term by term."""
    from xxhash import xxh64_intdigest

    signed = lambda x: x - (x >> 63 << 64)
    put = lambda x, size: (x % (1 << 8 * size)).to_bytes(size, "little")
    counts, out = collections.Counter(WORDS.findall(text or "")), []
    for lane in range(lanes):
        group, i = divmod(lane, fingerprints.GROUP)
        best = None
        for word, n in counts.items():
            term = signed(xxh64_intdigest(word.encode(), 42))
            x, y = (xxh64_intdigest(put(group * 2 * fingerprints.GROUP + 2 * i + k, 4), xxh64_intdigest(put(term, 8), 42)) for k in (0, 1))
            part = lambda bits, shift, width: (((bits >> shift) & ((1 << width) - 1)) + 0.5) * 2.0**-width
            r, b = -np.log(part(x, 0, 21) * part(x, 21, 21)), part(x, 42, 22)
            c = -np.log(part(y, 0, 32) * part(y, 32, 32))
            t = int(np.floor(np.log(n) / r + b))
            a = np.log(c) - r * (t - b + 1.0)
            code = xxh64_intdigest(put(t, 8), xxh64_intdigest(put(term, 8), 42)) & 0xFFFFFFFF
            best = min(best or (a, code), (a, code))
        out.append(best[1] if best else 0xFFFFFFFF)
    return out


def test_signatures_by_definition(docs, rows):
    made = {r["doc_id"]: r for r in fingerprints.fingerprint_neighbours(docs).collect()}
    for i, t, *_ in rows[:40]:
        assert list(made[i]["sig_text"]) == drawn(t)


def test_near_columns_of_the_query(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in LLM_QUERIES["op5_fingerprints"](spark, str(tmp_path)).collect() if r["doc_id"] != 39}
    order = sorted({r[0]: r for r in rows if r[0] is not None}.values(), key=lambda r: -r[0])
    for a, b in zip(order, order[1:]):
        if 39 in (a[0], b[0]):
            continue
        t, u = a[1] or "", b[1] or ""
        n = len(t) // 3
        own, edited, following = drawn(t), drawn(t[: len(t) - n] + u[:n]), drawn(u)
        share = lambda x, y: sum(i == j for i, j in zip(x, y)) / len(x)
        assert found[a[0]]["fingerprint"] == "".join(f"{c:08x}" for c in own)
        assert (found[a[0]]["near_edited"], found[a[0]]["near_next"]) == (share(own, edited), share(own, following))


def test_rows_without_ids_part_into_ranges(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    placed = fingerprints.with_next(docs, range_rows=100)
    assert placed.filter("not ghost").groupBy("range").count().agg(F.max("count")).first()[0] < 400
    made = placed.filter("not ghost").collect()
    assert len(made) == 4000 and {r["next_text"] for r in made} == {r["text"] for r in made}


def test_the_search_of_a_range_stays_on_its_side_of_the_join(spark):
    """Of what the optimizer knows of the rows that meet the heads, nothing equals their range with its search."""
    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    plan = fingerprints.with_next(docs, range_rows=100)._jdf.queryExecution().optimizedPlan()
    sides = [n.children().apply(0) for n in nodes(plan) if n.nodeName() == "Join"]
    assert sides and not any("lambda" in side.constraints().toString() for side in sides)


@pytest.mark.parametrize("n", [1, 2, 3, 100_000])
def test_ranges_of_many_splitters(spark, n):
    """Splitters are one literal, however many: a hundred thousand are found by binary search, and the plan has no node for each."""
    import bisect
    import time

    rnd = random.Random(n)
    cuts = sorted({rnd.randrange(-(10**15), 10**15) for _ in range(n)}, reverse=True)
    keys = [rnd.randrange(-(10**15), cuts[0] + 1) for _ in range(500)] + cuts[:50] + cuts[-50:]
    began = time.time()
    column = fingerprints.range_of(F.col("k"), cuts)
    assert time.time() - began < 5
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", column.alias("r"))
    falling = [-x for x in cuts]
    assert all(r["r"] == (bisect.bisect_right(falling, -r["k"]) - 1 if n > 1 else 0) for r in rows.collect())
    assert rows._jdf.queryExecution().analyzed().treeString().count("\n") < 10


@pytest.mark.parametrize("coarse", [1, 3, 1 << 14])
def test_ranges_in_two_steps(spark, rows, docs, monkeypatch, coarse):
    monkeypatch.setattr(fingerprints, "COARSE", coarse)
    monkeypatch.setattr(fingerprints, "BROADCAST_HEADS", 1 if coarse == 3 else 1 << 24)
    made = [r for r in fingerprints.with_next(docs, range_rows=10).collect() if not r["ghost"]]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = collections.Counter((a[0], a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1]))
    assert collections.Counter((r["doc_id"], r["text"], r["next_text"]) for r in made) == want
    sizes = collections.Counter(r["range"] for r in made)
    assert len(sizes) >= 11 and set(sizes) == set(range(len(sizes))) and max(sizes.values()) < 30


def test_collisions_follow_generalised_jaccard(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(40):
        base = collections.Counter(rnd.choices(range(30), k=120))
        other = collections.Counter(base)
        for _ in range(rnd.randint(0, 150)):
            other[rnd.randrange(40)] += 1
        rows.append((i, " ".join(f"w{x}" for x in base.elements()), " ".join(f"w{x}" for x in other.elements())))
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(2, "id")
    sig = fingerprints.signatures(df, ["id"], ["a", "b"], lanes=256).select("id", fingerprints.likeness(F.col("sig_a"), F.col("sig_b")).alias("j")).collect()
    error = []
    for r in sig:
        a, b = (collections.Counter(t.split()) for t in rows[r["id"]][1:])
        keys = a.keys() | b.keys()
        error.append(r["j"] - sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys))
    assert abs(np.mean(error)) < 0.02 and np.abs(error).max() < 0.15


# WARC


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200
    rows = [(i, f"http://h/{i} é\r\n", big + str(i % 7)) for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", "short"), (103, "u", "short"), (104, "u", "é" * 50), (105, "u", "é" * 50), (None, "u", big + "0"), (3, "again", big + "3"), (200, "long", "\r\n\r\nWARC/1.1" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    back = warc.through_archives(pages, archive_bytes=4000).collect()
    assert len(back) == len(rows)
    least = {}
    for i, _, t in rows:
        raw = (t or "").encode()
        if len(raw) >= 100 and i is not None:
            least[raw] = min(i, least.get(raw, i))
    want = collections.Counter()
    for i, u, t in rows:
        raw = (t or "").encode()
        again = raw in least and least[raw] != i
        want[i, u or "", "revisit" if again else "response", least[raw] if again else None, hashlib.sha256(raw).hexdigest(), len(raw), b"" if again else raw] += 1
    assert collections.Counter((*r[:6], bytes(r[6])) for r in back) == want
    assert warc.through_archives(pages.limit(0)).count() == 0


def test_members_stand_alone(spark):
    import gzip
    import io

    raw = [warc.record(i, "u", b"p" * i, i, "d", "response", None) for i in range(5)]
    for whole in (gzip.compress(b"".join(raw)), b"".join(map(gzip.compress, raw))):
        assert list(warc.split_records(warc.inflate(io.BytesIO(whole)))) == raw
    with pytest.raises(ValueError):
        list(warc.split_records([raw[3][:-2]]))


# Packing


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


def test_word_tokens_equal_whole_texts(bpe):
    rnd = random.Random(4)
    path, ranks = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")
    texts = ["", " ", "  ", "\n \n", " a", "a  b", "a \n b", "\x1c x", "don't <|endoftext|> stop", "é\u00a0 ß", "x" * 5000]
    texts += ["".join(rnd.choices([" ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "a", "é", "7", "'s", ".", "word", "日"], k=rnd.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(rnd.choices([" ", " ", "\n", "don't", "é", "ß7", "#$", "word", "ÿ", "\u00ad", "\u00a1", "_", "ǅ", "²", "1st"], k=rnd.randint(1, 40))) for _ in range(3000)]
    texts += ["\n".join([" a", "b ", "", "c"]), "tail ", "tail\n", "\nhead", "\u0085x", "a\tb"]
    both = [(t, ids) for own in (packing.WordTokens(path), packing.WordTokens(path, ranks)) for t, ids in zip(texts, own.ids(texts))]
    for t, ids in both:
        assert np.frombuffer(ids, "<u4").tolist() == bpe.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(docs, rows, empty, bpe):
    made = packing.pack(docs, tokenizer_file("byte_bpe_50k.json")).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = bpe.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            own = ids[start : first if k == 0 else start + 1024]
            want[i, k, start, len(own), binascii.crc32(np.array(own, "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in made) == want
    bins = collections.defaultdict(list)
    for r in made:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in made)
    assert len(bins) <= -(-total // 1024) + 1
    assert packing.pack(empty, tokenizer_file("byte_bpe_50k.json")).count() == 0


def fewest(items, capacity):
    """Fewest bins by trying all ways."""
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= items[i]:
                go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_local_search_ends_where_no_move_helps():
    rnd = random.Random(11)
    have = collections.Counter(min(1024, max(1, int(rnd.gauss(400, 80)))) for _ in range(20_000))
    bins = packing.local_search(packing.best_fit(have))
    assert sum((collections.Counter({k: n * p.count(k) for k in set(p)}) for p, n in bins.items()), collections.Counter()) == have
    fills = {p: (sum(p), {0, *p}, {0, *p, *(a + b for a, b in itertools.combinations(p, 2))}) for p in bins if sum(p) < 1024}
    for giver, taker in itertools.product(fills, fills):
        (give, mine, more), (fill, theirs, others) = fills[giver], fills[taker]
        if give <= fill and (giver != taker or bins[giver] > 1):
            gains = {x - y for x in mine for y in others} | {x - y for x in more for y in theirs}
            assert not any(0 < d <= 1024 - fill for d in gains)


def test_local_search_against_all_ways():
    rnd = random.Random(9)
    over = 0
    for _ in range(120):
        items = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 10))), reverse=True)
        start = packing.best_fit(collections.Counter(items), 20)
        bins = packing.local_search(start, 20)
        assert sorted(x for p, n in bins.items() for x in p * n) == sorted(items)
        assert all(sum(p) <= 20 for p in bins) and sum(bins.values()) <= sum(start.values())
        over += sum(bins.values()) - fewest(items, 20)
    assert over <= 2
    # Swaps mend what best fit leaves: 6+6+6 and 7+7+4... fill two bins less than one item a bin.
    poor = collections.Counter({(11, 5): 4, (9, 4): 4, (7,): 2})
    assert sum(packing.local_search(poor, 20).values()) < sum(poor.values())


# Token counts


def best_segmentation(word, vocabulary):
    best = {0: (0.0, 0)}
    for d in range(1, len(word) + 1):
        cost = len(word[d - 1].encode())
        ways = [(best[d - 1][0] + cost * vocabulary.byte, -(best[d - 1][1] + cost))]
        ways += [(best[s][0] + vocabulary.scores[word[s:d]], -(best[s][1] + 1)) for s in range(max(0, d - vocabulary.longest), d) if word[s:d] in vocabulary.scores]
        s, n = max(ways)
        best[d] = (s, -n)
    return best[len(word)][1]


def test_token_counts(docs, rows, empty):
    path = tokenizer_file("piece_bpe_32k.model")
    vocabulary = tokens.UnigramVocabulary(path)
    found = tokens.count_tokens(docs, path, keep=("doc_id", "text")).collect()
    assert len(found) == len(rows)
    memo = {}
    for r in found:
        words = WORDS.findall(r["text"] or "")
        for w in words:
            if w not in memo:
                memo[w] = best_segmentation(tokens.MARK + w, vocabulary)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(memo[w] for w in words))
    assert tokens.count_tokens(empty, path).count() == 0
    long = "the" * 2000 + "日"
    assert tokens.TokenCounter(path).counts([long])[1][0] == best_segmentation(tokens.MARK + long, vocabulary) == tokens.long_count(tokens.MARK + long, vocabulary)


def test_trie_shares_prefixes():
    trie = tokens.Trie()
    for w in ("▁walk", "▁walked", "▁walking", "▁w"):
        trie.add(w)
    assert trie.nodes == len("▁walking") + len("ed")


# Sharding


def test_sharding(docs, rows, empty):
    made = sharding.shard_by_bytes(docs, shards=6, ranges=64).collect()
    want = collections.Counter((i, len((t or "").encode()) + 8, binascii.crc32((t or "").encode())) for i, t, *_ in rows)
    assert collections.Counter(tuple(r)[:3] for r in made) == want
    load, at = collections.Counter(), collections.defaultdict(list)
    for r in made:
        load[r["shard"]] += r["size"]
        at[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in at.values()) and set(at) <= set(range(6))
    assert sharding.shard_by_bytes(empty).count() == 0


def test_sharding_query(spark, tmp_path, rows):
    """All columns of the query: its law is `bytes`, which names no grown shard."""
    many = [(9000 + i, f"text {i % 400} " * (40 + i % 7), "en", "s", 0, 7, "k", "r") for i in range(3000)]
    spark.createDataFrame(rows + many, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    made = LLM_QUERIES["op9_sharding"](spark, str(tmp_path)).collect()
    assert {(r["law"], r["grown_shard"]) for r in made} == {("bytes", None)}
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in made) == collections.Counter((r[0], len((r[1] or "").encode()) + 8, binascii.crc32((r[1] or "").encode())) for r in rows + many)
    load = collections.Counter()
    for r in made:
        load[r["shard"]] += r["size"]
    assert set(load) == set(range(24)) and max(load.values()) < 1.2 * min(load.values())


def test_overfull_ranges_of_several_keys_are_subdivided(spark, monkeypatch):
    """Splitters that miss a heavy part of the key space: its ranges are cut again until each holds its share or one text."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string"), F.repeat(F.lit("x"), 50)).alias("text"))
    rows = sharding.light_records(docs)
    drawn, asked = sharding.splitters, []

    def bad(rows, ranges, total):
        asked.append(ranges)
        return [] if len(asked) < 3 else drawn(rows, ranges, total)

    monkeypatch.setattr(sharding, "splitters", bad)
    _, sums, fine = sharding.ranges_of(rows, 64)
    assert len(asked) >= 3 and all(r["bytes"] <= sharding.OVERFULL * fine or r["hi"] == r["lo"] for r in sums)
    assert sum(r["bytes"] for r in sums) == rows.agg(F.sum("size")).first()[0]


def test_hot_text_is_subdivided(spark):
    rows = [(i, "the same text " * 20) for i in range(3000)] + [(3000 + i, f"text number {i} " * (1 + i % 9)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    one, two = (sharding.shard_by_bytes(docs, ranges=256).collect() for _ in range(2))
    load = collections.Counter()
    for r in one:
        load[r["shard"]] += r["size"]
    assert len(load) == 24 and max(load.values()) < 1.03 * min(load.values())
    assert collections.Counter(r["shard"] for r in one) == collections.Counter(r["shard"] for r in two)


# SimHash


def brute_simhash(text):
    from xxhash import xxh64_intdigest

    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """Smallest index reachable over links of at most 2 bits, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark, rows, docs, empty):
    found = simhash.near_duplicates(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [brute_simhash(r[1]) for r in ordered]
    want = collections.Counter((r[0], fp, ordered[c][0]) for r, fp, c in zip(ordered, fps, classes(fps)))
    assert collections.Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in found) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = collections.Counter(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert kept == collections.Counter({i for i, _, c in want if i == c} | {None})


@pytest.mark.parametrize("limit", [512, 4])
def test_links_of_dense_clusters(spark, limit):
    rnd = random.Random(limit)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for _ in range(6):  # chains and balls of near fingerprints
        x = rnd.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            for _ in range(rnd.choice([1, 2, 2, 3])):
                x ^= 1 << rnd.randrange(64)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), shard_limit=limit)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = classes(fps)
    by = collections.defaultdict(set)
    for x, c in zip(signed, want):
        by[c].add(roots.get(x, x))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_bk_tree():
    rnd = random.Random(1)
    values = list({rnd.getrandbits(12) for _ in range(500)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[::20]:
        assert sorted(tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_rows_without_ids_are_whole_at_any_bitmap_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i if i % 7 else None, f"text {i}") for i in range(400)] + [(5, "text 5")] * 2, "doc_id long, text string")
    gone = set(range(0, 400, 3)) | {5}
    expected = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in gone)
    ids = spark.createDataFrame([(i,) for i in sorted(gone)], "__gone long")
    for slots in (64, 1 << 10, 1 << 26):
        monkeypatch.setattr(common, "SLOTS", slots)
        kept = simhash.without_ids(docs, "doc_id", ids)
        assert kept.columns == docs.columns
        assert collections.Counter(map(tuple, kept.collect())) == expected
        assert simhash.without_ids(docs, "doc_id", ids.limit(0)).count() == docs.count()


def test_one_of_each_by_shingle_similarity(spark):
    """Near copies beyond two bits go; of 40 unlike texts around one passage each stays."""
    rnd = random.Random(5)
    draw = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows, passage = [], draw(200)
    for k in range(30):
        w = draw(300)
        rows.append((3 * k, " ".join(w)))
        for j, n in ((1, 1), (2, 4)):
            edited = list(w)
            for at in rnd.sample(range(5, 295, 10), n):  # n edits, each at most 5 shingles of 296
                edited[at] = "x"
            rows.append((3 * k + j, " ".join(edited)))
    rows += [(1000 + k, " ".join(passage + draw(60))) for k in range(40)] + [(2000, None), (2001, " "), (2002, "a b"), (2003, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(zip(*((t or "").lower().split()[k:] for k in range(5)))) for i, t in rows}
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert all(like(sets[3 * k], sets[3 * k + j]) for k in range(30) for j in (1, 2))
    assert not any(like(sets[1000 + a], sets[1000 + b]) for a in range(40) for b in range(a))
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs, shingle=5, similarity=0.8).collect())
    assert kept == [*range(0, 90, 3), *range(1000, 1040), 2000, 2002]
    assert len(simhash.one_of_each(docs).collect()) > len(kept)
    assert simhash.one_of_each(docs.limit(0), shingle=5, similarity=0.8).count() == 0


def test_pipeline_links_simhash_fingerprints(spark, monkeypatch):
    """Texts of equal fingerprints go, though their sets of five words are unlike; the trees are asked."""
    import corpus_pipeline

    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, *a: asked.append(distinct.count()) or links(distinct, *a))
    body = " ".join(f"w{i}" for i in range(11)) + " "
    rows = [(k, body * 60 + " ".join(f"t{k}x{i}" for i in range(8))) for k in range(3)] + [(3, " ".join(f"u{i}" for i in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    assert len(set(simhash.fingerprints([t for _, t in rows[:3]]))) == 1 and len(sets[0] & sets[1]) < 0.5 * len(sets[0] | sets[1])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates_stage(spark, docs, None).collect()) == [0, 3]
    assert asked == [2]


@pytest.mark.parametrize("small", [False, True])
def test_large_group_of_near_copies(spark, monkeypatch, small):
    """500 copies of one text with edits, most pairs under 0.8: exactly the classes of all pairs, in one block a bucket or in many."""
    if small:
        for name, value in {"SLICE": 60, "ASKED": 20, "BLOCK": 50, "BLOCK_BYTES": 16_384}.items():
            monkeypatch.setattr(shingles, name, value)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(500):
        w = list(base)
        for at in rnd.sample(range(150), rnd.randint(2, 9)):
            w[at] = rnd.choice("abcdefgh")
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    root = list(range(500))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and len(a & b) >= 0.8 * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    compared, confirmed = [], shingles.confirmed
    monkeypatch.setattr(shingles, "confirmed", lambda pairs, sets, similarity: compared.append(pairs.count()) or confirmed(pairs, sets, similarity))
    kept = {r["doc_id"] for r in simhash.one_of_each(docs, shingle=5, similarity=0.8).collect()}
    want = {i for i, r in enumerate(root) if r == i}
    assert kept == want
    assert sum(compared) < 500 * 2 * shingles.BANDS  # pairs that were rows


def test_joining_by_brute_force():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        nodes = []
        for k in range(int(rnd.integers(1, 30))):
            own = np.unique(rnd.integers(0, 14, int(rnd.integers(1, 14)))).astype(np.uint32)
            nodes.append((k, k if rnd.random() < 0.7 else 0, own))
        asked = [x for x in nodes if x[1]] or nodes
        classes = lambda links: joined_classes([x[:2] for x in nodes], links)
        every = [(a, b) for a, _, x in asked for b, _, y in nodes if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))]
        found = shingles.joining(asked, nodes, 0.8)
        assert set(found) <= set(every) and len(found) < len(nodes)
        assert classes(found) == classes(every)


def joined_classes(nodes, links):
    """The classes that nodes (id, class) and links make, as a set of sets."""
    root = {k: c for k, c in nodes}
    for a, b in links:
        x, y = root[a], root[b]
        root = {k: min(x, y) if c in (x, y) else c for k, c in root.items()}
    return {frozenset(k for k in root if root[k] == c) for c in root.values()}


@pytest.mark.parametrize("options", [{}, {"shingle": 5, "similarity": 0.8}])
def test_unlike_texts_of_one_id_stay(spark, options):
    rnd = random.Random(8)
    one, two, three = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(7, one, "b"), (7, one, "a"), (7, two, "a"), (7, three, "a"), (3, three, "a"), (8, two, "a"), (None, one, "a")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), **options).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(3, three, "a"), (7, one, "a"), (7, two, "a"), (None, one, "a")], key=str)
