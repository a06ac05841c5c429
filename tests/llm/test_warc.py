"""Archives: byte-exact round trips, damaged legacy files, revisits."""

import base64
import gzip
import hashlib

from tidemark.llm import arc
from tidemark.llm.queries import op4_warc
from tidemark.llm.warc import archive_pages, parse_warc, timestamp


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(pages):
    best = {}
    for i, _, h in pages:
        b = (h or "").encode()
        best[b] = max(best.get(b, i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = best[b] == i
        out.append((i, len(b), sha(b), "response" if first else "revisit", None if first else best[b], True))
    return sorted(out)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(tuple(r) for r in op4_warc(spark, sf).collect()) == brute(pages)


def test_edges(spark, tmp_path):
    pages = [(1, "http://a b\tc\n/", "x"), (2, None, "x"), (3, "", "x"), (4, "u", None), (5, "u", ""), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"),
             (7, "http://é/", "é" * 3000), (8, "u", "y\n" * 100_000), (9, "u", "text 0.0.0.0 20240101000000 t 5\nabcde"), (-3, "u", "neg")]
    df = spark.createDataFrame([(*p, "n") for p in pages], "page_id long, url string, html string, record_type string")
    got = archive_pages(df, f"{tmp_path}/a", f"{tmp_path}/w").drop("record_id", "url", "date")
    assert sorted(tuple(r) for r in got.collect()) == brute(pages)
    twice = df.where("page_id IN (1, 7)").union(df.where("page_id = 7"))
    twice = twice.unionByName(spark.createDataFrame([(None, "u", "lone", "n")], df.schema))
    got = archive_pages(twice, f"{tmp_path}/a2", f"{tmp_path}/w2")
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got.collect())
    assert kinds == [("1", "response", None), ("7", "response", None), ("7", "revisit", 7), ("None", "response", None)]
    assert archive_pages(df.limit(0), f"{tmp_path}/a3", f"{tmp_path}/w3").count() == 0


def test_legacy_headers():
    one = arc.file_header("f", "20240101000000", "1") + b"\n" + arc.record("http://x/a b", "1.2.3.4", "20030405060708", "text/html", b"HTTP/1.0 200\r\n\r\nhi", "1") + b"\n"
    two = arc.file_header("f", "20240101000000", "2") + b"\n" + arc.record("http://y/", "1.2.3.4", "19990102", "image/gif", b"\n\nGIF\n", "2", "abc") + b"\n"
    for data, want in ((one, ("1", "http://x/a%20b", "20030405060708", b"HTTP/1.0 200\r\n\r\nhi")), (two, ("2", "http://y/", "19990102", b"\n\nGIF\n"))):
        for packed in (data, gzip.compress(data), gzip.compress(data[:70]) + gzip.compress(data[70:])):
            (r,) = arc.parse(arc.inflate(packed))
            assert (r.version, r.url, r.date, r.body) == want and r.whole
    damaged = one.replace(b"1.2.3.4 20030405060708", b"garbage line") + b"junk\n" + arc.record("http://z/", "1.1.1.1", "2003010203", "a/b", b"ok", "1") + b"\n"
    assert [r.body for r in arc.parse(damaged)] == [b"ok"]
    (short,) = arc.parse(arc.record("http://z/", "1.1.1.1", "20030102", "a/b", b"cut off", "1")[:-3])
    assert short.body == b"cut " and not short.whole
    spaced = b"http://old/a b c 1.1.1.1 20030102030405 text/html 2\nok\n"
    assert [(r.url, r.body) for r in arc.parse(spaced)] == [("http://old/a b c", b"ok")]
    assert timestamp("20030405060708") == "2003-04-05T06:07:08Z" and timestamp("19990102") == "1999-01-02T00:00:00Z"
    assert timestamp("1999010205") == "1999-01-02T05:00:00Z"


def test_warc_files_are_well_formed(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same")], "page_id long, url string, html string")
    archive_pages(df, f"{tmp_path}/a", f"{tmp_path}/w").collect()
    records = {}
    for f in tmp_path.glob("w/part-*"):
        data = gzip.decompress(f.read_bytes())
        for h, block in parse_warc(data):
            assert data.count(b"WARC/1.1\r\n") >= 1 and len(block) == int(h["content-length"])
            records[h["warc-page-id"]] = (h, block)
    assert records["2"][0]["warc-type"] == "response" and records["2"][1].endswith(b"\r\n\r\nsame")
    assert records["1"][0]["warc-refers-to"] == records["2"][0]["warc-record-id"]
    assert records["1"][0]["warc-refers-to-target-uri"] == "http://b/" and records["1"][1].endswith(b"\r\n\r\n")


def test_long_urls_and_urls_like_a_file_description(spark, tmp_path):
    long = "data:text/html," + "q" * 100_000
    pages = [(1, long, "x" * 50), (2, "filedesc://a/b.arc", "one"), (3, f"http://h/?{long}", "0.0.0.0 20240101000000 t 5\n" * 9),
             (4, "filedesc://1 0 URL", "1 0 tidemark\nURL IP-address Archive-date\n"), (5, f"filedesc://{long}", "x" * 50), (6, "http://u/", "u")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(1)
    got = archive_pages(df, f"{tmp_path}/a", f"{tmp_path}/w").collect()
    assert sorted(tuple(r)[:5] + (r.intact,) for r in got) == brute(pages)
    assert {r.page_id: r.url for r in got} == {i: u.replace(" ", "%20") for i, u, _ in pages}


def test_file_descriptions_in_joined_files():
    parts, want = [], []
    for version in "1212":
        urls = [f"filedesc://{version}", "http://h/?" + "q" * 200_000, "filedesc://last"]
        parts.append(arc.file_header("f", "20240101000000", version) + b"\n")
        parts += [arc.record(u, "0.0.0.0", "20240101000000", "text/html", b"HTTP/1.1 200 OK\r\n\r\n1 0 x\n", version) + b"\n" for u in urls]
        want += [(version, u) for u in urls]
    for packed in (b"".join(parts), b"".join(map(gzip.compress, parts))):
        assert [(r.version, r.url) for r in arc.parse(arc.inflate(packed))] == want
    (alone,) = arc.parse(parts[1])
    assert alone.url == "filedesc://1"


def test_files_of_many_members_take_linear_time():
    import gzip
    import random
    import time

    r = random.Random(1)
    members = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 30, 700]))) for _ in range(20_000)]
    packed = [gzip.compress(m, 1) for m in members]
    took = []
    for n in (2_000, 20_000):
        start = time.process_time()
        assert arc.inflate(b"".join(packed[:n])) == b"".join(members[:n])
        took.append(time.process_time() - start)
    assert took[1] < 25 * took[0] + 0.2
    long = bytes(r.randrange(256) for _ in range(300_000)) * 20
    both = gzip.compress(long) + gzip.compress(b"end")
    assert arc.inflate(both) == long + b"end" and arc.inflate(both + b"junk") == long + b"end"
    assert arc.inflate(gzip.compress(long)[:-5000]) == long[:len(arc.inflate(gzip.compress(long)[:-5000]))]
    assert arc.inflate(b"plain") == b"plain" and arc.inflate(b"") == b""


def test_archives_cost_little_time_and_leave_no_shuffle(spark, tmp_path):
    import random
    import time
    import zlib

    from tidemark.llm.warc import write_arc

    def shuffled():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        files = disk.getAllFiles()
        names = [files.apply(i) for i in range(files.size())]
        return {f.getName(): f.length() for f in names if f.getName().startswith("shuffle_")}

    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    pages = [(k, f"http://h/{k}", " ".join(r.choices(words, k=2000))) for k in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffled(), spark.conf.get(key, None)
    write_arc(df, f"{tmp_path}/a")
    assert spark.conf.get(key, None) == was
    for _ in range(50):
        left = sum(n for name, n in shuffled().items() if name not in before)
        if left < 100_000:
            break
        time.sleep(0.2)
    assert left < 100_000  # the payloads have 5 MB
    written = [f.read_bytes() for f in tmp_path.glob("a/part-*")]
    packed = {level: sum(len(zlib.compress(gzip.decompress(w), level)) for w in written) for level in (1, 4, 6)}
    assert packed[6] < packed[4] < packed[1]
    assert (packed[6] + packed[4]) / 2 < sum(map(len, written)) < packed[1]
