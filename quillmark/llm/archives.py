"""WARC archives and their Merkle fixity audit.

Records are written as WARC files in the order of their ids. Spark's writer compresses files as a whole, so offsets count
in the uncompressed files; without compression they can be sought. A record's digest is a leaf of a tree whose nodes cover ordered ranges of offsets. Where a range ends is told by the records
themselves: one whose key hashes to a number of trailing zero digits opens a range of as many levels, so ranges hold
FANOUT of the level below on average, and a lost, added or changed record moves the bounds next to it alone. Two replicas
are compared by their roots, and only below nodes that differ are children compared.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize

FANOUT, DEPTH = 16, 8
END = "\r\n\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)", re.IGNORECASE)

#: The capture date of pages that have none of their own.
DATE = "2024-01-01T00:00:00Z"

#: Bytes of a file, about, as written; bytes that are inflated at a time; and those of a record's head at most.
FILE_BYTES, PIECE, LONGEST_HEAD = 16 << 20, 1 << 16, 1 << 20


def record(id_: Column, url: Column, body: Column, date: Column | None = None) -> Column:
    """A WARC resource record, without the two line ends after it. Nulls count as empty; control characters of a URL become %20."""
    body, date = F.coalesce(body, F.lit("")), F.lit(DATE) if date is None else F.coalesce(date, F.lit(DATE))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">\r\nWARC-Date: "), date, F.lit("\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x1F]", "%20"), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END),
    )
    return F.concat(head, body)


def _records(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    text = record(F.col(id_col), F.col(url_col), F.col(body_col))
    return pages.select(F.col(id_col).alias("id"), text.alias("value")).withColumn("digest", F.unhex(F.sha2("value", 256)))


def write_archive(pages: DataFrame, path: str, files: int | None = None, compression: str = "gzip", id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Writes WARC files whose records follow each other by id (null first), then digest, from file to file.

    ``files``: how many, else as many as keep them near FILE_BYTES; an id that many rows share spans files.
    ``compression``: gzip, or none for files in which offsets can be sought.
    """
    if files is None:
        size = pages.agg(F.sum(F.coalesce(F.octet_length(body_col), F.lit(0)) + 256)).first()[0]
        files = max(1, -(-int(size or 0) // FILE_BYTES))
    rows = _records(pages, id_col, url_col, body_col)
    dealt = rows.repartitionByRange(files, F.col("id").asc_nulls_first(), "digest")
    dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), "digest").select("value").write.option("lineSep", END).option("compression", compression).text(path)


_NAMES = [f"name{k}" for k in range(1, DEPTH + 1)]


def _hex(digest: str | Column) -> Column:
    return F.lower(F.hex(digest))


def _numbered(rows: DataFrame, part: str, *order: Column) -> DataFrame:
    """Adds rank, offset, k and the names of the ranges over each row: parts in order, rows of a part by ``order``.

    ``k`` counts rows of the same id and digest in a part, where all such rows are neighbours. A range is named by the key that opens it, 0 before the first. Gathers a
    row per part at most.
    """
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(part, "id", "digest").orderBy(*order)) - 1)
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), _hex("digest"), F.col("k").cast("string")))
    level, name = F.length(F.regexp_extract(key, "0*$", 0)), F.conv(F.substring(key, 1, 15), 16, 10).cast("long")
    opened = [F.when(F.col("level") >= k + 1, F.col("name")) for k in range(DEPTH)]
    rows = rows.withColumns({"level": level, "name": name})
    inside = Window.partitionBy(part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.col("length") + len(END)
    own = rows.select("*", (F.row_number().over(inside) - 1).alias("r"), (F.sum(size).over(upto) - size).alias("o"), *(F.last(x, ignorenulls=True).over(upto).alias(n) for x, n in zip(opened, _NAMES, strict=True)))
    totals = own.groupBy(part).agg(F.count("*").alias("n"), F.sum(size).alias("size"), *(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("r"))).alias(n) for n in _NAMES))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over the parts, not the rows
    starts = totals.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("o0"), *(F.last(n, ignorenulls=True).over(before).alias("before_" + n) for n in _NAMES))
    names = [F.coalesce(n, "before_" + n, F.lit(0)).alias(n) for n in _NAMES]
    return own.join(starts, part).select("id", (F.col("n0") + F.col("r")).alias("rank"), (F.col("o0") + F.col("o")).alias("offset"), "length", "digest", "k", *names)


def expected_leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """The numbered records that an archive of ``pages`` holds; only digests are shuffled."""
    rows = _records(pages, id_col, url_col, body_col).select("id", F.octet_length("value").cast("long").alias("length"), "digest")
    rows = materialize(rows.repartitionByRange(F.col("id").asc_nulls_first(), "digest").withColumn("part", F.spark_partition_id()), "records")
    return _numbered(rows, "part", F.col("id").asc_nulls_first(), F.col("digest"))


class _Bytes:
    """A stream of pieces, of which no more than was asked for is held."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def take(self, n: int | None) -> Iterator[bytes]:
        """The next ``n`` bytes, or all, piece by piece; fewer at the end."""
        while (n is None or n > 0) and (self.held or self.more()):
            part, self.held = (self.held, b"") if n is None else (self.held[:n], self.held[n:])
            self.at += len(part)
            n = None if n is None else n - len(part)
            yield part

    def ahead(self, mark: bytes, most: int) -> int:
        """Where ``mark`` stands, from here; -1 if it doesn't within ``most`` bytes."""
        seen = 0
        while (found := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if seen > most or not self.more():
                return -1
        return found


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[str | None, int, int, str]]:
    """(id, offset, length, digest) of the records of a file; what can't be read as a record is one, without an id.

    The file comes in pieces and records are hashed as they pass, so a long record or a large file takes no more memory.
    """
    data = _Bytes(pieces)
    while data.held or data.more():
        at, digest, name = data.at, hashlib.sha256(), None
        end = data.ahead(END.encode(), LONGEST_HEAD)
        head = b"".join(data.take(end + len(END) if end >= 0 else 0))
        size = _LENGTH.search(head, 0, end) if head.startswith(b"WARC/") else None
        digest.update(head)
        if size:
            for part in data.take(int(size[1])):
                digest.update(part)
            length = data.at - at
            close = b"".join(data.take(len(END)))
            if length == end + 4 + int(size[1]) and close == END.encode():
                name = re.search(rb"\r\nWARC-Record-ID: <urn:page:([^>\r]*)>", head)
                yield (name[1].decode("utf-8", "replace") or None) if name else None, at, length, digest.hexdigest()
                continue
            digest.update(close)
        for part in data.take(None):
            digest.update(part)
        yield None, at, data.at - at, digest.hexdigest()
        return


def archive_leaves(spark: SparkSession, path: str) -> DataFrame:
    """The numbered records that stand in WARC files, in the order of the files. A task holds one file as it is stored, which
    Spark reads up to 2 GB of, and inflates it piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for rows in itertools.batched(parse(unpacked(memoryview(content.as_buffer()).cast("B"))), 1 << 14):
                    columns = [pa.array([name.as_py()] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([bytes.fromhex(r[3]) for r in rows], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "id", "at", "length", "digest"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = materialize(files.select("path", "content").mapInArrow(run, "part string, id string, at long, length long, digest binary"), "archive")
    return _numbered(rows, "part", F.col("at"))


def unpacked(data: memoryview) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces; of a damaged one what comes before the damage; other files as they are."""
    if data[:2] != b"\x1f\x8b":
        for k in range(0, len(data), PIECE):
            yield bytes(data[k : k + PIECE])
        return
    at, member = 0, zlib.decompressobj(31)
    try:
        while at < len(data) or member.unconsumed_tail:
            given = member.unconsumed_tail
            if not given:
                given, at = bytes(data[at : at + PIECE]), at + PIECE
            if out := member.decompress(given, PIECE):
                yield out
            if member.eof:
                at, member = min(at, len(data)) - len(member.unused_data), zlib.decompressobj(31)
        if out := member.flush():
            yield out
    except zlib.error:
        return


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels from 1 to DEPTH: (name1 .., first, after, digest), a node over each range of the level below.

    A node's own name is the first of its columns, the others name the ranges above it; ``first`` and ``after`` bound its
    offsets. A node gathers FANOUT children on average, some hundred at most by any likelihood, whatever the archive's size.
    """
    level, levels = leaves.select(_hex("digest").alias("digest"), F.col("offset").alias("first"), (F.col("offset") + F.col("length") + len(END)).alias("after"), *_NAMES), []
    for k in range(DEPTH):
        children = F.array_sort(F.collect_list(F.struct("first", "digest")))
        level = level.groupBy(*_NAMES[k:]).agg(F.min("first").alias("first"), F.max("after").alias("after"), F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256).alias("digest"))
        if k < 3:  # further ones are small
            level = materialize(level, "nodes")
        levels.append(level)
    return levels


def root(levels: list[DataFrame]) -> str | None:
    """The digest over the nodes of the last level; None for an empty archive."""
    children = F.array_sort(F.collect_list(F.struct("first", "digest")))
    row = levels[-1].agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256).alias("digest")).first()
    return row.digest if row.n else None


def mismatches(one: DataFrame, other: DataFrame) -> tuple[DataFrame, str | None]:
    """Leaves of two replicas that don't agree, and the first one's root: (state, one, other), structs of id, rank, offset, length and digest.

    From the roots down, only nodes below a node that differs are compared. State: differs (the same id, other content),
    missing or extra in ``other``.
    """
    spark, trees = one.sparkSession, [tree(one), tree(other)]
    roots = [root(t) for t in trees]
    leaf = lambda df: df.select(F.col("id").cast("string").alias("name"), "digest", F.struct("id", "rank", "offset", "length", "digest").alias("leaf"), "name1")
    sides = [leaf(one), leaf(other)]
    if roots[0] == roots[1]:
        return spark.createDataFrame([], f"state string, one {sides[0].schema['leaf'].dataType.simpleString()}, other {sides[1].schema['leaf'].dataType.simpleString()}"), roots[0]
    suspects: list[DataFrame | None] = [None, None]
    for k in reversed(range(DEPTH)):
        name = _NAMES[k]
        below = [t[k] if s is None else t[k].join(s, _NAMES[k + 1], "left_semi") for t, s in zip(trees, suspects, strict=True)]
        a, b = (x.select(F.col(name).alias("node"), F.col("digest").alias(n)) for x, n in zip(below, "ab", strict=True))
        bad = materialize(a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))), "suspects")
        suspects = [bad.where(f"{n} is not null").select(F.col("node").alias(name)) for n in "ab"]
    again = F.row_number().over(Window.partitionBy("name", "digest").orderBy("leaf.rank")).alias("k")
    held = [x.join(s, "name1", "left_semi").select("name", "digest", "leaf", again) for x, s in zip(sides, suspects, strict=True)]
    same = lambda a, b: a["name"].eqNullSafe(b["name"]) & (a["digest"] == b["digest"]) & (a["k"] == b["k"])
    alone = [a.join(b, same(a, b), "left_anti") for a, b in (held, held[::-1])]
    turn = Window.partitionBy("name").orderBy("leaf.rank")
    a, b = (x.select("name", F.when(F.col("name").isNotNull(), F.row_number().over(turn)).alias("turn"), F.col("leaf").alias(n)) for x, n in zip(alone, ("one", "other"), strict=True))
    pairs = a.join(b, ["name", "turn"], "full")
    state = F.when(F.col("other").isNull(), "missing").when(F.col("one").isNull(), "extra").otherwise("differs")
    return materialize(pairs.select(state.alias("state"), "one", "other"), "mismatches"), roots[0]


def audit(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Compares WARC files with the records that ``pages`` make; a row per expected record, and per extra one.

    Columns: id, rank, offset, length, digest, state (intact, differs, missing, extra) and root (of the expected tree). An
    extra record has no rank, and the id, offset, length and digest that it has in the files; its id is null where it can't
    be read. Null ids come first, repeated ids by digest; rows equal in id and content are told apart by their number; null
    URLs and pages count as empty; other columns play no part; no pages and no files, no rows.
    """
    leaves = materialize(expected_leaves(pages, id_col, url_col, body_col), "expected")
    found = materialize(archive_leaves(pages.sparkSession, path), "found")
    bad, digest = mismatches(leaves, found)
    kind = pages.schema[id_col].dataType
    states = bad.where("one is not null").select(F.col("one.rank").alias("rank"), "state")
    rows = leaves.join(states, "rank", "left").select(F.col("id").alias(id_col), "rank", "offset", "length", _hex("digest").alias("digest"), F.coalesce("state", F.lit("intact")).alias("state"))
    extra = bad.where("one is null").select(F.col("other.id").try_cast(kind).alias(id_col), F.lit(None).cast("long").alias("rank"), "other.offset", "other.length", _hex("other.digest").alias("digest"), "state")
    return rows.unionByName(extra).withColumn("root", F.lit(digest).cast("string"))
