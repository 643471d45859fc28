"""WARC archives and URL lists."""

from __future__ import annotations

import datetime
import gzip
import hashlib
import random
import time
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textloom.llm import urls, warc

PAGES = "page_id long, url string, html string, digest int, payload string"


def _pages():
    big = "<p>" + "é" * 200
    rows = [(i, f"http://h/{i}", f"<p>{i}" * 40) for i in range(30)]
    rows += [(100 + i, "http://h/same", big) for i in range(20)] + [(90, "http://h/same", big)] * 2
    rows += [(200, None, None), (201, "", ""), (202, "a\r\nWARC-Type: x", "short"), (203, "x", "short"), (None, "n", big)]
    rows += [(300, "long", "word " * 400_000), (301, "crlf", "a\r\n\r\nb" * 50), (302, "z", "WARC/1.1\r\n" * 30)]
    return rows


def test_archives_round_trip(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rows = _pages()
    index, folder = warc.archive(frame(PAGES, [(*r, 1, "x") for r in rows]), f"file://{tmp_path}/w")
    kept = index.collect()
    assert len(kept) == len(rows)
    for r in kept:
        raw = Path(f"{tmp_path}/w/archives/{r.file}").read_bytes()[r.offset : r.offset + r.length]
        headers, payload = warc.parse(gzip.decompress(raw))
        assert headers["WARC-Type"] == r.record_type and headers["WARC-Payload-Digest"] == f"sha256:{r.digest}"
        assert int(headers["Content-Length"]) == len(payload)
        if r.record_type == "response":
            assert hashlib.sha256(payload).hexdigest() == r.digest
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in Path(f"{tmp_path}/w/archives").iterdir())
    assert whole.count(b"WARC-Record-ID") == len(rows)
    facts = warc.with_full_payload_facts(warc.read_records(index, folder)).collect()
    got = sorted(
        (r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in facts
    )
    expected = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html is not None and html.startswith("<p>é") and i is not None and i > 90
        kind = ("revisit", 90) if again else ("response", None)
        expected.append((-1 if i is None else i, len(raw), hashlib.sha256(raw).hexdigest(), *kind))
    assert got == sorted(expected, key=lambda r: r[:4])


def test_a_selection_is_read_alone(frame, tmp_path):
    index, folder = warc.archive(frame(PAGES, [(*r, 1, "x") for r in _pages()]), str(tmp_path / "w"))
    some = warc.read_records(index.where("page_id IN (3, 17, 301)"), folder).collect()
    assert {r.page_id: r.payload.decode() for r in some} == {3: "<p>3" * 40, 17: "<p>17" * 40, 301: "a\r\n\r\nb" * 50}


def test_no_pages(frame, tmp_path):
    index, folder = warc.archive(frame(PAGES, []), str(tmp_path / "w"))
    assert warc.read_records(index, folder).collect() == []


@pytest.mark.parametrize(
    "url, keys",
    [
        ("HTTP://User:pw@WWW.Shop.Example.COM.:8080/A/b/c?x=/y#z", ["www.shop.example.com", "shop.example.com", "example.com",
          "www.shop.example.com/A", "www.shop.example.com/A/b"]),
        ("//a.b", ["a.b"]),
        ("https://localhost//x//", ["localhost", "localhost/x"]),
        ("https://[::1]:80/x", ["[::1]", "[::1]/x"]),
        (" https://a.b.c.d.e.f.g/?q ", ["a.b.c.d.e.f.g", "b.c.d.e.f.g", "c.d.e.f.g", "d.e.f.g", "e.f.g"]),
        ("mailto:x@y", []), ("no host", []), ("", []), (None, []), ("http:///path", []),
    ],
)
def test_keys(spark, url, keys):
    row = spark.createDataFrame([(url,)], "u string")
    assert row.select(urls.keys_of("u")).first()[0] == keys
    every = row.select(urls.keys_of("u", None, None)).first()[0]
    assert set(every) >= set(keys)
    at = row.select(urls.keys_at("u", list(range(1, 40)), list(range(1, 40)))).first()[0]
    assert sorted(at or []) == sorted(every)


@pytest.mark.parametrize("url", ["http://h.com/" + "ab/" * 350_000, "http://" + "a." * 500_000 + "com/x"])
def test_a_long_url_takes_as_long_as_it_is(frame, url):
    captures = frame("page_id long, url string, fetched timestamp_ntz", [(i, url, datetime.datetime(2024, 1, 2)) for i in range(3)])
    listed = ["h.com/ab/ab", "h.com/" + "ab/" * 20_000 + "ab", "a.com", "a.a.a.com", "com", "x"]
    entries = frame("list string, entry string, since date, action string", [("l", e, DAY, "add") for e in listed])
    started = time.monotonic()
    got = [r.matches for r in urls.judge(captures, entries).collect()]
    assert time.monotonic() - started < 20
    expected = ["l:" + e for e in (listed[:2] if "h.com" in url else listed[2:4])]
    assert got == [sorted(expected)] * 3


def test_long_histories(frame):
    """Changes at random moments over years, against a search through all of them."""
    draw = random.Random(3)
    start = datetime.datetime(2019, 12, 30)
    moment = lambda: start + datetime.timedelta(seconds=draw.randrange(3 * 365 * 86400))
    entries = [(draw.choice("ab"), draw.choice(["x.com", "y.x.com", "y.x.com/p"]), moment(), draw.choice(["add", "remove"])) for _ in range(900)]
    rows = [(i, "http://y.x.com/p/q", draw.choice([moment(), draw.choice(entries)[2]])) for i in range(200)]
    got = urls.judge(frame("page_id long, url string, fetched timestamp_ntz", rows), frame("list string, entry string, since timestamp_ntz, action string", entries))
    for r in got.collect():
        latest = {}
        for name, entry, since, action in sorted(entries, key=lambda e: (e[2], e[3] == "add")):
            if since <= r.fetched:
                latest[name, entry] = action
        assert r.matches == sorted(f"{name}:{entry}" for (name, entry), action in latest.items() if action == "add")


def test_deep_hosts_and_paths_are_judged(frame):
    rows = [(1, "http://a.b.c.d.e.f.g/"), (2, "http://h.com/1/2/3/4"), (3, "http://h.com/1/2"), (4, "http://g"), (5, "//x")]
    rows += [(6, "http://" + "s." * 30 + "f.g"), (7, "http://h.com/" + "1/2/3/" * 40), (8, None), (9, "http://")]
    captures = frame("page_id long, url string, fetched timestamp_ntz", [(*r, datetime.datetime(2024, 1, 2)) for r in rows])
    added = ["f.g", "g", "h.com/1/2/3", "h.com/1/2/3/4", "h.com/" + "1/2/3/" * 39 + "1/2/3"]
    entries = frame("list string, entry string, since date, action string", [("l", e, DAY, "add") for e in added])
    got = {r.page_id: r.matches for r in urls.judge(captures, entries).collect()}
    assert got == {
        1: ["l:f.g"], 2: ["l:h.com/1/2/3", "l:h.com/1/2/3/4"], 3: [], 4: ["l:g"], 5: [], 6: ["l:f.g"],
        7: ["l:h.com/1/2/3", "l:" + added[4]], 8: [], 9: [],
    }


DAY = datetime.date(2024, 1, 1)


def _day(n):
    return DAY + datetime.timedelta(days=n)


def test_lists_as_of_the_fetch(frame):
    entries = [
        ("ads", "x.com", _day(1), "add"), ("ads", "x.com", _day(3), "remove"), ("ads", "x.com", _day(6), "add"),
        ("ads", "x.com", _day(6), "remove"), ("ads", "x.com", _day(7), "add"), ("bad", "a.x.com/p", _day(2), "add"),
        ("bad", "never.com", _day(4), "remove"), ("ads", None, _day(0), "add"), (None, "x.com", _day(0), "add"),
        ("ads", "x.com", None, "add"), ("ads", "x.com", _day(0), "other"), ("ads", "x.com", _day(2), "add"),
    ]
    intervals = urls.intervals(frame("list string, entry string, since date, action string", entries))
    assert sorted(tuple(r) for r in intervals.collect() if r.entry == "x.com") == [
        ("ads", "x.com", _day(1), _day(3)), ("ads", "x.com", _day(6), None)
    ]
    fetched = [(i, "http://a.x.com/p/q", datetime.datetime.combine(_day(i), datetime.time(12)), "clash") for i in range(9)]
    fetched += [(20, None, datetime.datetime(2024, 1, 8), "c"), (21, "http://x.com", None, "c"), (22, "http://y.com", fetched[8][2], "c")]
    fetched += [(23, "http://x.com", fetched[8][2], "c")] * 3
    captures = frame("page_id long, url string, fetched timestamp_ntz, matches string", fetched)
    table = frame("list string, entry string, since date, action string", entries)
    got = [(r.page_id, r.matches) for r in urls.judge(captures, table).collect()]
    both = ["ads:x.com", "bad:a.x.com/p"]
    expected = [(0, []), (1, both[:1]), (2, both), (3, both[1:]), (4, both[1:]), (5, both[1:]), (6, both), (7, both), (8, both)]
    expected += [(20, []), (21, []), (22, [])] + [(23, both[:1])] * 3
    assert sorted(got) == expected
    assert urls.judge(captures.limit(0), table).collect() == []
    assert all(r.matches == [] for r in urls.judge(captures, table.limit(0)).collect())


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "string"])
def test_entries_count_from_their_time_of_day(frame, kind):
    at = lambda hour: datetime.datetime(2024, 1, 1, hour)
    given = [("l", "x.com", at(9), "add"), ("l", "x.com", at(15), "remove"), ("l", "x.com", at(20), "remove"),
             ("l", "x.com", at(20), "add")]
    entries = frame(f"list string, entry string, since {kind}, action string", [
        (*r[:2], str(r[2]) if kind == "string" else r[2], r[3]) for r in given
    ])
    fetched = "timestamp_ntz" if kind == "string" else kind
    captures = frame(f"page_id long, url string, fetched {fetched}", [(h, "http://x.com/", at(h)) for h in range(24)])
    listed = sorted(r.page_id for r in urls.judge(captures, entries).collect() if r.matches)
    assert listed == [*range(9, 15), *range(20, 24)]


@pytest.mark.parametrize(
    "path, uri",
    [
        ("s3a://bucket/a b/c", "s3://bucket/a b/c"), ("s3n://bucket/x", "s3://bucket/x"), ("hdfs://nn:8020/x", "hdfs://nn:8020/x"),
        ("file:/tmp/x", "file:///tmp/x"), ("file:///tmp/x", "file:///tmp/x"), ("dbfs:/a/b", "file:///dbfs/a/b"),
        ("gs://bucket/x", "gs://bucket/x"), ("abfss://c@a.dfs.core.windows.net/x", "abfss://c@a.dfs.core.windows.net/x"),
    ],
)
def test_file_systems(path, uri):
    assert warc.arrow_uri(path) == uri


def test_folders_are_resolved_as_spark_does(spark, tmp_path):
    assert warc.resolved(spark, str(tmp_path)) == f"file:{tmp_path}"
    with pytest.raises(ValueError, match="ftp"):
        warc.arrow_uri("ftp://host/x")


def test_a_failing_task_closes_its_file(frame, tmp_path, monkeypatch):
    pages = [(i, f"http://h/{i}", "<p>" + "x" * 300 + str(i)) for i in range(20)]
    broken = F.when(F.col("page_id") == 13, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("html"))
    df = frame("page_id long, url string, html string", pages)
    with pytest.raises(PySparkException, match="broken"):
        warc.archive(df.withColumn("html", broken), str(tmp_path / "w"))
    index, folder = warc.archive(df, str(tmp_path / "again"))
    assert warc.read_records(index, folder).count() == 20
