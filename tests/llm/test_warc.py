import gzip
import hashlib
import io
import random

from stratakv.llm import warc
from tests.helpers import rows


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def archive():
    rng, out = random.Random(4), []
    for i in range(60):
        body = bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 3000])))
        if i % 5 == 0:  # payloads that hold magic, and whole members
            body = warc.MAGIC * 20 + gzip.compress(b"WARC/1.1 not a record") + body
        out.append(warc.record(i, f"http://x/{i}", body, hashlib.sha1(body).hexdigest(), None if i % 3 else 7))
    return out


def test_any_ranges_own_every_record_once():
    members = archive()
    data = b"".join(members)
    starts = [sum(map(len, members[:i])) for i in range(len(members))]
    for span in (1, 97, 1000, 5000, len(data) * 2):
        if span == 1:
            ranges = [(s, s + 1) for s in starts] + [(s + 1, s + 2) for s in starts]
        else:
            ranges = [(a, a + span) for a in range(0, len(data), span)]
        found = [at for a, b in ranges for at, _, _ in warc.scan(Source(data), a, b)]
        assert sorted(found) == starts, span


def test_reads_that_cut_the_magic(monkeypatch):
    monkeypatch.setattr(warc, "READ", 7)
    members = archive()[:12]
    found = list(warc.scan(Source(b"".join(members)), 0, 10**9))
    assert [at for at, _, _ in found] == [sum(map(len, members[:i])) for i in range(len(members))]
    assert all(head.startswith(b"WARC/1.1") for _, head, _ in found)


PAGES = "page_id long, url string, html string"


def test_round_trip_of_awkward_pages(spark):
    big, other = "<p>é</p>" * 300, "z" * 2000
    pages = [(1, "u", big), (2, None, big), (9, "u", big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (7, "a b\nc", other), (7, "u", other), (8, "u", other * 3)]
    df = spark.createDataFrame(pages, PAGES).selectExpr("*", "'x' AS digest", "1 AS size")
    found = sorted(rows(warc.round_trip(df), "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    refers = {1: 9, 2: 9}
    expect = [(i, "revisit" if i in refers else "response", refers.get(i), len((t or "").encode()), sha(t)) for i, _, t in pages]
    assert found == sorted(expect, key=str)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_payloads_come_back_whole_over_small_ranges(spark, tmp_path):
    pages = [(i, f"http://h/{i}", "é" * (i * 37 % 4000)) for i in range(200)]
    files = warc.write(warc.classify(spark.createDataFrame(pages, PAGES)), f"file://{tmp_path}/w")
    files = spark.createDataFrame(files.collect(), files.schema)
    back = warc.read(spark, files, span=1500)
    assert {int(r["record_id"]): bytes(r["payload"]).decode() for r in back.where("record_type = 'response'").collect()} == {i: t for i, _, t in pages}


def test_long_url_at_the_edge_of_a_read():
    rng = random.Random(5)
    page = warc.record(1, "http://x/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(200_000)), b"body", hashlib.sha1(b"body").hexdigest(), None)
    for left in (20, 60_000, len(page) - 10):
        body = bytes(rng.randrange(256) for _ in range(warc.READ - left))
        before = warc.record(0, "u", body, hashlib.sha1(body).hexdigest(), None)
        body = body[: len(body) - (len(before) - (warc.READ - left))]
        before = warc.record(0, "u", body, hashlib.sha1(body).hexdigest(), None)
        assert abs(warc.READ - left - len(before)) < 100
        found = [at for at, _, _ in warc.scan(Source(before + page), 0, 10**9)]
        assert found == [0, len(before)]
        assert [at for at, _, _ in warc.scan(Source(before + page), 1, 10**9)] == [len(before)]
