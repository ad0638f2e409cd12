import glob
import gzip
import hashlib
import tracemalloc
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quillmark.llm import archives as A

SCHEMA = "page_id long, url string, html string, digest string, rank int"


def wanted(rows):
    out, at = [], 0
    records = []
    for i, url, html in rows:
        body = (html or "").encode()
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Date: {A.DATE}\r\nWARC-Target-URI: {(url or '').replace(chr(10), '%20')}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
        records.append((i, head.encode() + body))
    records.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1]).hexdigest()))
    for rank, (i, r) in enumerate(records):
        out.append((i, rank, at, len(r), hashlib.sha256(r).hexdigest()))
        at += len(r) + 4
    return out


def brute_root(leaves):
    """The root from (id, digest) in order, by the definition: ranges are opened by keys that end in zeros."""
    seen, level = {}, []
    for i, digest in leaves:
        k = seen[i, digest] = seen.get((i, digest), -1) + 1
        key = hashlib.md5(f"{'' if i is None else i}|{digest}|{k}".encode()).hexdigest()
        level.append((len(key) - len(key.rstrip("0")), digest))
    for depth in range(1, A.DEPTH + 1):
        ranges = []
        for zeros, digest in level:
            if not ranges or zeros >= depth:
                ranges.append((zeros, []))
            ranges[-1][1].append(digest)
        level = [(zeros, hashlib.sha256("".join(own).encode()).hexdigest()) for zeros, own in ranges]
    return hashlib.sha256("".join(d for _, d in level).encode()).hexdigest()


ROWS = [(k, f"http://x/{k}", f"<p>é {k}</p>\r\n\r\nWARC/1.1\r\n" * (k % 5)) for k in range(60)] + [(None, None, None), (3, "u\nv", "y" * 100000), (3, "u\nv", "y" * 100000), (70, "", "")]


@pytest.fixture
def archive(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA)
    path = f"file://{tmp_path}/warc"
    A.write_archive(pages, path, files=3, compression="none")
    return pages, path, sorted(glob.glob(f"{tmp_path}/warc/part-*"))


def test_round_trip(archive):
    pages, path, files = archive
    expected = wanted(ROWS)
    got = sorted(map(tuple, A.audit(pages, path).collect()), key=lambda r: r[1])
    assert [r[:5] for r in got] == expected and {r[5] for r in got} == {"intact"}
    assert {r[6] for r in got} == {brute_root([(r[0], r[4]) for r in expected])}
    leaves = sorted(map(tuple, A.archive_leaves(pages.sparkSession, path).select("id", "rank", "offset", "length", F.lower(F.hex("digest"))).collect()), key=lambda r: r[1])
    assert [(r[0] and int(r[0]), *r[1:]) for r in leaves] == expected
    whole = b"".join(open(f, "rb").read() for f in files)
    assert len(files) > 1 and len(list(A.parse(iter([whole])))) == len(ROWS)
    for r in got:  # an offset can be sought
        assert hashlib.sha256(whole[r[2] : r[2] + r[3]]).hexdigest() == r[4]


def rewrite(path, data):
    with open(path, "wb") as f:
        f.write(data)
    os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))


def test_corruption_is_located(archive):
    pages, path, files = archive
    data = bytearray(open(files[1], "rb").read())
    bad = list(A.parse(iter([bytes(data)])))[4]
    data[bad[1] + bad[2] - 1] ^= 1
    rewrite(files[1], bytes(data))
    rows = A.audit(pages, path).collect()
    assert [(str(r.page_id), r.state) for r in rows if r.state != "intact"] == [(bad[0], "differs")] and len(rows) == len(ROWS)


def test_an_unreadable_header_loses_what_follows_in_its_file_alone(archive):
    pages, path, files = archive
    data = open(files[1], "rb").read()
    records = list(A.parse(iter([data])))
    rewrite(files[1], data[: records[-2][1]] + b"X" + data[records[-2][1] + 1 :])
    bad = sorted((str(r.page_id), r.state) for r in A.audit(pages, path).collect() if r.state != "intact")
    assert bad == sorted([("None", "extra"), (records[-2][0], "missing"), (records[-1][0], "missing")])


@pytest.mark.parametrize("gone", [10, 0, 59])
def test_a_lost_record_is_one_mismatch(spark, tmp_path, gone):
    pages = spark.createDataFrame([(k, f"u{k}", f"body {k}", "", 1) for k in range(200)], SCHEMA)
    A.write_archive(pages.where(f"page_id <> {gone}"), f"file://{tmp_path}/warc", files=4)
    rows = A.audit(pages, f"file://{tmp_path}/warc").collect()
    assert [(r.page_id, r.state) for r in rows if r.state != "intact"] == [(gone, "missing")] and len(rows) == 200


def test_missing_and_extra(spark, archive):
    pages, path, files = archive
    more = pages.unionByName(spark.createDataFrame([(1000, "u", "h", "", 1)], SCHEMA))
    assert [(r.page_id, r.state) for r in A.audit(more, path).collect() if r.state != "intact"] == [(1000, "missing")]
    fewer = pages.where("page_id is null or page_id not in (70, 3)")
    assert sorted((r.page_id, r.rank, r.state) for r in A.audit(fewer, path).collect() if r.state != "intact") == [(3, None, "extra")] * 3 + [(70, None, "extra")]


@pytest.mark.parametrize("seed", range(2))
def test_random_damage_equals_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(150), f"u{k}", rng.choice("abc") * 5, "", 1) for k in range(300)]
    other = [(i, u, "changed" if rng.random() < 0.05 else h, "", 1) for i, u, h, *_ in rows if rng.random() > 0.05] + [(500 + k, "u", "new", "", 1) for k in range(5)]
    A.write_archive(spark.createDataFrame(other, SCHEMA), f"file://{tmp_path}/warc", files=3)
    got = A.audit(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/warc").collect()
    count = lambda rs: Counter((i, d) for i, _, _, _, d in wanted([r[:3] for r in rs]))
    lost, new = count(rows) - count(other), count(other) - count(rows)
    states = Counter()
    for i in {i for i, _ in lost | new}:
        a, b = (sum(n for (j, _), n in side.items() if j == i) for side in (lost, new))
        states += Counter({(i, "differs"): min(a, b), (i, "missing"): max(0, a - b), (i, "extra"): max(0, b - a)})
    assert Counter((r.page_id, r.state) for r in got if r.state != "intact") == states and states


def test_only_mismatching_branches_are_read(spark, archive):
    pages, path, _ = archive
    leaves = A.expected_leaves(pages)
    bad, root = A.mismatches(leaves, leaves)
    assert bad.collect() == [] and root == A.root(A.tree(leaves))
    levels = A.tree(leaves)
    assert levels[0].count() > 1 and sum(r.after - r["first"] for r in levels[0].collect()) == max(r.after for r in levels[0].collect())


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], SCHEMA)
    A.write_archive(pages, f"file://{tmp_path}/none")
    assert A.audit(pages, f"file://{tmp_path}/none").collect() == []
    one = spark.createDataFrame([(1, "u", "h", "", 1)], SCHEMA)
    assert [(r.page_id, r.state) for r in A.audit(one, f"file://{tmp_path}/none").collect()] == [(1, "missing")]


def test_damaged_files():
    read = lambda data: b"".join(A.unpacked(memoryview(data)))
    assert read(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab" and read(b"WARC") == b"WARC" and read(b"") == b""
    long = bytes(range(256)) * 4000
    assert read(gzip.compress(long) + gzip.compress(long)) == long * 2 and read(gzip.compress(long)[:-900] + b"x" * 50).startswith(long[:1000])
    assert list(A.parse(iter([b"rubbish"]))) == [(None, 0, 7, hashlib.sha256(b"rubbish").hexdigest())]


def test_query_equals_its_sql(spark):
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
    import oracle
    from quillmark.llm import queries

    assert oracle.same(spark, queries.op6_merkle_audit, queries.oracle_sql()["op6_merkle_audit"], "/root/testdata/sf0.001") > 40


def test_records_come_in_pieces():
    """However the bytes are cut, records are the same, and a file that unpacks to much takes little."""
    def one(k, n):
        body = bytes([65 + k % 26]) * n
        return b"WARC/1.1\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (k, n) + body

    records = [one(k, n) for k, n in enumerate([0, 5, 70_000, 3, 200_000])]
    data = b"".join(r + b"\r\n\r\n" for r in records)
    at, want = 0, []
    for k, r in enumerate(records):
        want.append((str(k), at, len(r), hashlib.sha256(r).hexdigest()))
        at += len(r) + 4
    for step in (1_000, 4097, len(data)):
        assert list(A.parse(data[k : k + step] for k in range(0, len(data), step))) == want
    short = data[:-100]
    assert list(A.parse(iter([short])))[-1] == (None, want[4][1], len(short) - want[4][1], hashlib.sha256(short[want[4][1] :]).hexdigest())
    packed = gzip.compress(data * 200)
    tracemalloc.start()
    count = sum(1 for _ in A.parse(A.unpacked(memoryview(packed))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 1000 and peak < 4 << 20
