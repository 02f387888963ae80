"""URL filters, WARC and chat formatting."""

import base64
import gzip
import hashlib
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from folioscope.llm import chat, queries, url_filter, warc


def test_url_rules(spark):
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://A.EXAMPLE.net/fr/1?x#y": ("a.example.net", "/fr/1", "net/", "block"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "https://x.org/FR/": ("x.org", "/FR/", None, "allow"),
        "https://x.org/fr/a/b": ("x.org", "/fr/a/b", "org/fr/", "allow"),
        "http://internet/": ("internet", "/", None, "allow"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://x.net?q=/": ("x.net", "", None, "allow"),
        "nothing": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://": ("", "", None, "allow"),
        "http://play.fr/casino/1": ("play.fr", "/casino/1", None, "block"),
        "http://adserver.fr/x": ("adserver.fr", "/x", None, "block"),
        "http://É.net/é\nx": ("É.net", "/é\nx", "net/", "block"),
        "http://a://b.net/": ("a:", "//b.net/", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == want
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES).collect() == []
    assert {r["verdict"] for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_url_blocks_and_index(spark, monkeypatch):
    rules = [url_filter.site_rule(f"s{i}.test/{p}", "block" if i % 2 else "allow") for i in range(30) for p in ("", "a/", "a/b", "a-")]
    urls = [f"http://x.s{i}.test/{p}" for i in range(30) for p in ("", "a/", "a/bc", "a-c", "q")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def brute(url):
        host, path = url[7:].split("/")[0], "/" + url[7:].split("/", 1)[1]
        fit = [r for r in rules if (host == r.text.split("/")[0] or host.endswith("." + r.text.split("/")[0])) and path.startswith("/" + r.text.split("/", 1)[1])]
        return max(fit, key=lambda r: len(r.text)).text

    want = [brute(u) for u in urls]
    get = lambda: [r["rule"] for r in url_filter.filter_urls(pages, rules).orderBy("page_id").collect()]
    assert get() == want
    monkeypatch.setattr(url_filter, "BLOCK", 7)
    assert get() == want
    counts = url_filter.token_counts(pages.select(*[c.alias(n) for c, n in zip(url_filter.host_and_path(F.col("url")), ("host", "path"))]), rules)
    assert counts["test"] == len(urls) and counts["s3"] == 5
    assert "test" not in url_filter.Index(rules, counts).by_token


def pages(spark):
    rows = [(5, "http://a/", "same é"), (3, "http://b/\r\nx", "same é"), (9, None, "same é"), (1, "u", None), (2, "u", ""), (4, "u", "big " * 5000), (6, "u", "big " * 5000), (7, "u", "alone\r\n\r\nx"), (None, "u", "same é"), (3, "twin", "same é"), (8, "u", "x" * 9999), (8, "u", "y" * 9998)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))


def test_warc_round_trip(spark):
    for chunk in (1 << 20, 512):
        got = sorted(((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["intact"]) for r in warc.read_archive(warc.write_archive(pages(spark), chunk_bytes=chunk)).collect()), key=str)
        want = []
        for i, t, k, refers in [(5, "same é", "revisit", 3), (3, "same é", "response", None), (9, "same é", "revisit", 3), (1, "", "response", None), (2, "", "revisit", 1), (4, "big " * 5000, "response", None), (6, "big " * 5000, "revisit", 4), (7, "alone\r\n\r\nx", "response", None), (-1, "same é", "response", None), (3, "same é", "response", None), (8, "x" * 9999, "response", None), (8, "y" * 9998, "response", None)]:
            raw = t.encode()
            want.append((i, k, refers, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), True))
        assert got == sorted(want, key=str)


def test_warc_min_bytes_empty_and_files(spark, tmp_path):
    kinds = {r["record_type"] for r in warc.read_archive(warc.write_archive(pages(spark), min_bytes=10**6)).collect()}
    assert kinds == {"response"}
    assert warc.read_archive(warc.write_archive(pages(spark).limit(0))).collect() == []
    files = warc.export_files(warc.write_archive(pages(spark), chunk_bytes=512), str(tmp_path / "out"))
    data = b"".join(Path(f).read_bytes() for f in files)
    assert data.count(b"WARC/1.1\r\n") == 12 and len(gzip.compress(data)) > 0
    seen, at = 0, 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:])
        at = end + 4 + int(head[b"Content-Length"])
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
        seen += 1
    assert seen == 12


def test_warc_repeated_ids_with_other_payloads(spark):
    rows = [(3, "u", "X"), (7, "u", "X"), (7, "u", "Y"), (4, "u", "Z"), (7, "u", "Z"), (7, "u", None), (1, "u", ""), (7, "u", "X")]
    got = warc.read_archive(warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    name = {base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(): t for t in ("X", "Y", "Z", "")}
    want = [(3, "X", None, 1), (7, "X", 3, 0), (7, "X", 3, 0), (7, "Y", None, 1), (4, "Z", None, 1), (7, "Z", 4, 0), (7, "", 1, 0), (1, "", None, 0)]
    assert sorted([(r["page_id"], name[r["payload_digest"]], r["refers_to"], r["stored_bytes"]) for r in got], key=str) == sorted(want, key=str)
    assert all(r["intact"] for r in got)


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "é🦊"), (1, 3, "ann", None), (1, None, None, "lost"), (2, 0, "system", "only"), (None, 0, "ann", "x"), (None, 0, "ann", "y"), (3, 0, "a<b>\n", "q"), (3, 0, "a<b>\n", "q")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("perspective", F.lit("x"))
    got = chat.rotate(c).collect()
    one = {r["perspective"]: r for r in got if r["conv_id"] == 1}
    assert set(one) == {"ann", "bob", "unknown"}
    ann = one["ann"]
    assert ann["text"] == "<|im_start|>user name=unknown\nlost<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\né🦊<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    for r in got:
        assert "".join(r["text"][m["start"] : m["start"] + m["length"]] for m in r["mask"]) == r["trained"]
        assert r["n_trained"] == len(r["trained"])
    assert sorted(r["trained"] for r in got if r["conv_id"] is None) == ["x<|im_end|>\n", "y<|im_end|>\n"]
    assert [r["n_turns"] for r in got if r["conv_id"] == 3] == [2] and not [r for r in got if r["conv_id"] == 2]
    assert chat.rotate(c.limit(0)).collect() == []
