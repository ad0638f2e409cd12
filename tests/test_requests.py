import ipaddress
import random
import re

from pyspark.sql import functions as F
from quillmark import api
from quillmark.operators import extraction as E
from quillmark.operators import proposals as P
from quillmark.operators import requests as R


def parsed(address):
    try:
        return ipaddress.ip_address(address)
    except ValueError:
        return None


def test_addresses_as_the_library_reads_them(spark):
    rng = random.Random(1)
    some = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "", " 1.2.3.4", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", "::ffff:10.1.2.3", "::ffff:300.1.2.3", "g::1", "12345::", "fe80::1%eth0", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "ABCD::ef01", "x"]
    some += [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(50)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(50)]
    got = {r.a: r.b for r in spark.createDataFrame([(a,) for a in some], "a string").select("a", R.address_bits(F.col("a")).alias("b")).collect()}
    for a in some:
        ip = parsed(a)
        assert got[a] == (None if ip is None else format(int(ip), "b").zfill(ip.max_prefixlen)), a


def test_identity(spark):
    rng = random.Random(2)
    nets = ["10.0.0.0/8", "192.168.1.0/24", "172.16.0.1", "2001:db8::/32", "::1", "0.0.0.0/40", "what"]
    known = [ipaddress.ip_network(n, strict=False) for n in nets[:5]]

    def trusted(address):
        ip = parsed(address)
        return ip is not None and any(ip in n for n in known)

    def identity(peer, forwarded):
        hops = [h.strip() for h in (forwarded or "").split(",") if h.strip()]
        return peer if not trusted(peer) else next((h for h in reversed(hops) if not trusted(h)), hops[0] if hops else peer)

    pool = ["10.1.1.1", "192.168.1.9", "192.168.2.9", "172.16.0.1", "8.8.8.8", "2001:db8::5", "2001:db9::5", "::1", "junk", "9.9.9.9"]
    rows = [(k, rng.choice(pool), rng.choice([None, "", " , ", ", ".join(rng.choices(pool, k=rng.randrange(1, 5)))])) for k in range(300)]
    requests = spark.createDataFrame(rows, "request int, peer string, forwarded string")
    got = {r.request: r.identity for r in R.client_identity(requests, R.networks(spark.createDataFrame([(n,) for n in nets], "network string"))).collect()}
    assert got == {k: identity(p, f) for k, p, f in rows}
    assert {r.request: r.identity for r in R.client_identity(requests, R.networks(spark.createDataFrame([], "network string"))).collect()} == {k: p for k, p, _ in rows}


def brute_proposals(text, covered, markers):
    out, pos = [], 0
    words = lambda s: len(re.findall(r"[^\W_]+", s))
    for sentence in re.split(r"(?<=[.!?؟\n؛])\s+|\n+", text):
        if not sentence:
            continue
        start = text.index(sentence, pos)
        pos = start + len(sentence)
        if any(a < pos and start < b for a, b in covered) or not any(m in sentence for m in markers) or words(sentence) < 4:
            continue
        best = max((sentence.rfind(m) + len(m) for m in markers if m in sentence and words(sentence[sentence.rfind(m) + len(m) :]) >= 4), default=0)
        body = sentence[best:]
        at = start + best + len(body) - len(body.lstrip(" :،,-–\t"))
        body = body.strip(" :،,-–\t.")
        if body and text[at : at + len(body)] == body and words(body) >= 4:
            out.append((at, at + len(body)))
    return out


def test_proposals(spark):
    rng = random.Random(3)
    parts = ["he said", "it is told:", "one two", "three four five", "six", ". ", "! ", "\n", "\n\n ", " - ", ", ", " ", ".. "]
    texts = [(k, "".join(rng.choices(parts, k=rng.randrange(1, 30)))) for k in range(150)] + [(900, ""), (901, None)]
    covered = [(k, a, a + 10) for k, t in texts if t for a in range(0, len(t), 60) if rng.random() < 0.3]
    rows = spark.createDataFrame(texts, "id int, text string")
    got = {}
    for r in P.proposed(rows, spark.createDataFrame(covered, "id int, start int, end int"), ("said", "told"), arabic=False).collect():
        got.setdefault(r.id, []).append((r.start, r.end))
    want = {k: p for k, t in texts if t and (p := brute_proposals(t, [(a, b) for i, a, b in covered if i == k], ("said", "told")))}
    assert {k: sorted(v) for k, v in got.items()} == want and want


def test_proposals_feed_find_spans(spark):
    text = "كلام طويل هنا. رواه فلان: هذا كتاب جديد جدا في البيت. انتهى"
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    records = spark.createDataFrame([(1, "quran", "", "قلم وبيت")], "id long, corpus string, book string, text string")
    found = P.proposed(texts, E.bracketed(texts))
    spans = api.find_spans(texts, records, arabic=True, proposals=found).collect()
    assert any("هذا كتاب جديد جدا في البيت" in r.quoted for r in spans)
