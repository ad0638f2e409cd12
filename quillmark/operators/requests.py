"""Who sent a request: addresses against networks, by equality of prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def address_bits(address: Column) -> Column:
    """The bits of an address as text, 32 or 128 of them, or null if it is none.

    Version 4: four numbers up to 255 without leading zeros. Version 6: groups of up to four hexadecimal digits, ``::`` once
    for zeros, the last two groups also as a version 4 address; a zone after ``%`` counts for nothing.
    """
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    four = f"{octet}(?:\\.{octet}){{3}}"
    number = lambda text, width, base: F.lpad(F.conv(text, base, 2), width, "0")
    octets = F.array_join(F.transform(F.split(address, "\\."), lambda x: number(x, 8, 10)), "")
    plain = F.regexp_replace(address, "%[^%]+$", "")
    tail = F.regexp_extract(plain, f":({four})$", 1)
    pair = lambda i: F.lower(F.concat(*(F.lpad(F.hex(F.get(F.split(tail, "\\."), F.lit(i + k)).try_cast("long")), 2, "0") for k in (0, 1))))
    spelt = F.when(tail != "", F.concat(F.substring(plain, F.lit(1), F.length(plain) - F.length(tail)), pair(0), F.lit(":"), pair(2))).otherwise(plain)
    groups = lambda part: F.filter(F.split(part, ":"), lambda x: x != "")
    halves = F.split(spelt, "::", -1)
    head, rest = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    short = F.size(halves) == 2
    zeros = F.array_repeat(F.lit("0"), F.when(short, 8 - F.size(head) - F.size(rest)).otherwise(0))
    group = "[0-9a-fA-F]{1,4}"
    side = f"(?:{group}(?::{group})*)?"
    shaped = spelt.rlike(f"^{side}::{side}$") & (F.size(head) + F.size(rest) <= 7) | spelt.rlike(f"^{group}(?::{group}){{7}}$")
    six = F.array_join(F.transform(F.concat(head, zeros, rest), lambda x: number(x, 16, 16)), "")
    return F.when(address.rlike(f"^{four}$"), octets).when(shaped, six)


def networks(rows: DataFrame, network_col: str = "network") -> DataFrame:
    """(width, length, prefix) of networks as ``address/length``, or single addresses; those that aren't well formed are left out."""
    parts = F.split(F.trim(network_col), "/", 2)
    bits = rows.select(address_bits(F.get(parts, F.lit(0))).alias("bits"), F.get(parts, F.lit(1)).alias("n"))
    known = bits.where("bits is not null").select("bits", F.length("bits").alias("width"), F.when(F.col("n").isNull(), F.length("bits")).otherwise(F.when(F.col("n").rlike("^[0-9]+$"), F.col("n").try_cast("int"))).alias("length"))
    return known.where("length between 0 and width").select("width", "length", F.substring("bits", F.lit(1), F.col("length")).alias("prefix")).distinct()


def client_identity(requests: DataFrame, trusted: DataFrame) -> DataFrame:
    """(request, identity) of ``requests`` (request, peer, forwarded), request unique: the peer, unless it is trusted; then the last
    hop that isn't trusted of the forwarded ones, or the first hop, or the peer if there is none.

    ``trusted``: of ``networks``. An address meets the networks on its prefixes of the lengths that occur, 162 at most.
    """
    lengths = sorted((r.width, r.length) for r in trusted.select("width", "length").distinct().collect())
    hops = F.filter(F.transform(F.split(F.coalesce("forwarded", F.lit("")), ","), lambda h: F.trim(h)), lambda h: h != "")
    seen = requests.select("request", "peer", F.posexplode(F.concat(F.array("peer"), hops)).alias("k", "hop"))  # the peer is number 0
    addresses = seen.select("hop").distinct().select("hop", address_bits(F.col("hop")).alias("bits"))
    prefix = lambda w, n: F.when(F.length("bits") == w, F.struct(F.lit(w).alias("width"), F.lit(n).alias("length"), F.substring("bits", F.lit(1), F.lit(n)).alias("prefix")))
    prefixes = F.array_compact(F.array(*(prefix(w, n) for w, n in lengths))) if lengths else F.array().cast("array<struct<width:int,length:int,prefix:string>>")
    inside = addresses.select("hop", F.explode(prefixes).alias("p")).select("hop", "p.*").join(trusted, ["width", "length", "prefix"], "left_semi").select("hop").distinct()
    told = seen.join(inside.withColumn("known", F.lit(True)), "hop", "left")
    told = told.groupBy("request", "peer").agg(
        F.bool_or((F.col("k") == 0) & F.col("known").isNotNull()).alias("by_proxy"), F.max_by(F.when((F.col("k") > 0) & F.col("known").isNull(), F.col("hop")), F.when((F.col("k") > 0) & F.col("known").isNull(), F.col("k"))).alias("stranger"), F.max(F.when(F.col("k") == 1, F.col("hop"))).alias("first"),
    )
    return told.select("request", F.when(F.col("by_proxy"), F.coalesce("stranger", "first", "peer")).otherwise(F.col("peer")).alias("identity"))
