"""Archives: an exact round trip, revisits against a plain grouping, and lookups through the index."""

import base64
import hashlib

import pytest

from tessera.llm import warc


def pages(n):
    rows = [(i, f"http://Host{i % 7}.example.com/p/{i % 50}?q={i}#f", "<p>same</p>" if i % 3 == 0 else f"<p>é {i // 2}\r\n\r\nx</p>") for i in range(n)]
    return [*rows, (n, None, None), (n + 1, "not a url at all", ""), (n + 2, "http://[bad", "z" * 300_000), (n + 3, "https://www.example.org:8443/A b\r\nc", "y"), (n + 3, "https://www.example.org:8443/A b\r\nc", "y")]


@pytest.fixture(scope="module")
def made(spark):
    rows = pages(120)
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    return rows, warc.archive(df)


def test_round_trip_and_revisits(made):
    rows, found = made
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", i), i)
    want, seen = [], set()
    for i, _, h in rows:
        raw = (h or "").encode()
        last = best[h or ""]
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = last == i and i not in seen  # of repeated rows one is the response
        seen.add(i)
        want.append((i, len(raw), sha, "response" if first else "revisit", None if first else last))
    assert sorted(map(str, (r[:5] for r in map(tuple, warc.read_back(found).collect())))) == sorted(map(str, want))


def test_lookup_through_small_blocks(spark):
    rows = pages(60)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = warc.new_path(spark, "warc")
    found = warc.Archive(root, warc.write_index(warc.write_archives(df, root), root, block_lines=4))
    for url in {u for _, u, _ in rows}:
        got = sorted(f["WARC-Record-ID"] for f, _ in found.lookup(url))
        assert got == sorted(f"<urn:tessera:page:{i}>" for i, u, _ in rows if warc.url_key(u) == warc.url_key(url))
    body = next(b for f, b in found.lookup("http://[bad"))
    assert body == b"z" * 300_000
    assert found.lookup("http://nowhere.example") == []


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "u", "same"), (None, "v", "same"), (None, "w", "other"), (7, "w", "other")], "page_id long, url string, html string")
    got = sorted(map(str, ((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.read_back(warc.archive(df)).collect())))
    assert got[0] == "(7, 'w', 'response', None)" and got[3] == "(None, 'w', 'revisit', 7)"
    assert sorted(g.split(", ")[2] for g in got[1:3]) == ["'response'", "'revisit'"] and all(g.endswith("None)") for g in got[1:3])


def test_keys_sort_by_domain():
    assert warc.url_key("HTTPS://www.Example.com/A?b#c") == "com,example)/a?b"
    assert warc.url_key("http://m.example.com:8080/") == "com,example,m:8080)/"


def test_min_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.read_back(warc.archive(df, min_bytes=3)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.read_back(warc.archive(df.limit(0))).count() == 0
