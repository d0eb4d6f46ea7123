"""Work in threads under limits, and chunks by a tokenizer's offsets."""

import random
import threading
import time

import pytest

from millrace.operators import chunking, models, services


def test_limits_order_and_errors_of_concurrent_work():
    lock, now, most, begun = threading.Lock(), {}, {}, {}
    rnd = random.Random(1)
    items = [(rnd.choice("aaab" + chr(99 + k % 20)), k) for k in range(120)]

    def work(item):
        host, k = item
        with lock:
            begun.setdefault(host, []).append(k)
            for name in (host, "all"):
                now[name] = now.get(name, 0) + 1
                most[name] = max(most.get(name, 0), now[name])
        time.sleep(0.002 + 0.01 * (k % 7 == 0))
        with lock:
            for name in (host, "all"):
                now[name] -= 1
        if k % 11 == 0:
            raise ValueError(str(k))
        return k

    got = list(services.concurrently(items, work, lambda item: item[0], in_flight=6, per_host=1))
    assert [str(x) if isinstance(x, ValueError) else x for x in got] == [str(k) if k % 11 == 0 else k for k in range(120)]
    assert most.pop("all") == 6 and set(most.values()) == {1}
    assert all(x == sorted(x) for x in begun.values())


def test_slow_work_gives_its_place_back():
    began = time.monotonic()
    got = list(services.concurrently(range(8), lambda k: time.sleep(3 if k in (1, 2) else 0) or k, lambda k: "h", in_flight=2, per_host=2, seconds=0.3))
    assert time.monotonic() - began < 2.5
    assert [type(x).__name__ for x in got] == ["int", "TimeoutError", "TimeoutError"] + ["int"] * 5
    assert list(services.concurrently([], None, None)) == []
    assert list(services.concurrently(range(50), lambda k: k, lambda k: k % 3, window=4)) == list(range(50))


def test_fetches_of_a_host_are_bounded(spark):
    urls = [(f"https://h{k % 3}.org/{k:03}",) for k in range(60)] + [(None,), ("no url",), ("http://[bad/",)]

    def fetch(url):
        time.sleep(0.05)
        if url is None or "no" in url:
            raise OSError("no url")
        return url, "Text/HTML; x=1", url.encode()

    began = time.time()
    rows = services.fetched(spark.createDataFrame(urls, "url string"), fetch, in_flight=20, per_host=10).collect()
    assert sorted((r.url or "", r.content_type, r.error) for r in rows) == sorted((u or "", None if u is None or "no" in u else "text/html", "OSError: no url" if u is None or "no" in u else None) for (u,) in urls)
    assert time.time() - began < 60
    for host in "012":  # a host's rows are in the order of their urls
        own = [r.url for r in rows if r.url and r.url.startswith(f"https://h{host}.")]
        assert own == sorted(own)


@pytest.mark.parametrize("size, overlap", [(12, 4), (5, 0), (1, 0), (128, 13)])
def test_subword_chunks(spark, size, overlap):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rnd = random.Random(size)
    words = ["the", "café", "漢字", "don't", "x" * 40, "a", "Ünïcode,", "12345", "🎉"]
    texts = [(k, " ".join(rnd.choices(words, k=n))) for k, n in enumerate((1, 2, 30, 200))] + [(9, "")]
    model = tokenizers.Tokenizer.from_file(path)
    count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    rows = chunking.subword_chunks(spark.createDataFrame(texts, "doc_id long, text string"), models.token_offsets(path), size, overlap).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3}
    for doc, text in texts:
        own, at = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.chunk_id), 0
        for k, r in enumerate(own):
            assert text[r.start_index : r.start_index + len(r.text)] == r.text and r.n_tokens == count(r.text)
            assert r.n_tokens <= size or " " not in r.text
            shared = text[r.start_index : at].strip() if k else ""
            assert count(shared) <= overlap and (k == 0 or r.start_index <= at + 1)
            if k + 1 < len(own):  # the next word has no room
                end = r.start_index + len(r.text)
                assert count(text[r.start_index : (text + " ").find(" ", end + 1)]) > size
            at = r.start_index + len(r.text)
        assert at == len(text)
