"""Corpus files: readers with fixed schemas that refuse malformed input, checks against a manifest, index files."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import orthography as O

RECORD = T.StructType([T.StructField("id", T.LongType()), T.StructField("corpus", T.StringType()), T.StructField("ref_key", T.StringType()), T.StructField("text", T.StringType()), T.StructField("offset", T.IntegerType())])
VERSION = 1


def verse_lines(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, verse, text) of chapter|verse|text lines; blank lines and lines with # are no records."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    part = F.split("value", r"\|", 3)
    return lines.select(part[0].cast("int").alias("chapter"), part[1].cast("int").alias("verse"), part[2].alias("text"))


def numbered_csv(spark: SparkSession, path: str) -> DataFrame:
    """(num, text) of two-column CSV without a header; a malformed row fails the read."""
    return spark.read.schema("num int, text string").option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated values without quoting."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("sep", "\t").option("quote", "").csv(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str = RECORD) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def workbook(spark: SparkSession, path: str, header: list[str], sheet: str = "xl/worksheets/sheet1.xml") -> DataFrame:
    """Rows of a workbook's first sheet below a comment row and a header, which must be the one given. One task per file."""
    import pandas as pd

    def read(batches):
        import io
        import xml.etree.ElementTree as ET
        import zipfile

        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
                    rows = []
                    for row in ET.fromstring(z.read(sheet)).iter(f"{ns}row"):
                        cells = {}
                        for c in row.iter(f"{ns}c"):
                            column = 0
                            for letter in "".join(x for x in c.get("r", "") if x.isalpha()):
                                column = column * 26 + ord(letter) - 64
                            value = c.find(f"{ns}v")
                            text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else (value.text if value is not None else None)
                            cells[column - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                        rows.append([cells.get(k) for k in range(len(header))])
                if rows[1] != header:
                    raise ValueError(f"header {rows[1]} is not {header}")
                yield pd.DataFrame(rows[2:], columns=header)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, ", ".join(f"`{h}` string" for h in header))


def images(spark: SparkSession, path: str, most: int = 6_000_000) -> DataFrame:
    """(path, kind, ok): the kind that the first bytes tell (png, jpeg, webp or none) and whether size and kind are allowed."""
    files = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 12))
    kind = F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("52494646") & head.endswith("57454250"), "webp")
    return files.select("path", kind.alias("kind"), (kind.isNotNull() & (F.col("length") <= most)).alias("ok"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of whole files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verified(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files found (name, sha256, rows) against a manifest (name, sha256, rows): (name, state) ok, changed, short, missing or unknown."""
    rows = manifest.select("name", F.col("sha256").alias("pin"), F.col("rows").alias("expected")).join(found, "name", "full")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("pin").isNull(), "unknown").when(F.col("pin") != F.col("sha256"), "changed").when(F.col("expected") != F.col("rows"), "short").otherwise("ok")
    return rows.select("name", state.alias("state"))


def repinned(old: DataFrame, new: DataFrame) -> DataFrame:
    """The pins after an update: (name, sha256, change): kept, drifted, added or gone."""
    rows = old.select("name", F.col("sha256").alias("a")).join(new.select("name", F.col("sha256").alias("b")), "name", "full")
    change = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "drifted").otherwise("kept")
    return rows.select("name", F.coalesce("b", "a").alias("sha256"), change.alias("change"))


def aligned_editions(*editions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Editions (chapter, verse, text) side by side as text0, text1, ..., and the keys that not all of them have."""
    out = editions[0].withColumnRenamed("text", "text0")
    for k, e in enumerate(editions[1:], 1):
        out = out.join(e.withColumnRenamed("text", f"text{k}"), ["chapter", "verse"], "full")
    whole = [F.col(f"text{k}").isNotNull() for k in range(len(editions))]
    every = whole[0]
    for w in whole[1:]:
        every = every & w
    return out.where(every), out.where(~every).select("chapter", "verse")


def opening_offset(chapter: Column, verse: Column, tokens: int = 4, without: tuple[int, ...] = (1, 9)) -> Column:
    """Leading tokens of a chapter's first verse that are shown but not indexed."""
    return F.when((verse == 1) & ~chapter.isin(*without), tokens).otherwise(0)


def displayed(plain: DataFrame, display: DataFrame) -> DataFrame:
    """(num, text, mismatch): the display text, without direction marks, where its loose tokens are the plain text's; else the plain text."""
    clean = F.replace(F.col("shown"), F.lit("‏"), F.lit(""))
    rows = plain.join(display.withColumnRenamed("text", "shown"), "num", "left")
    same = F.coalesce(O.loose_tokens(clean) == O.loose_tokens(F.col("text")), F.lit(False))
    return rows.select("num", F.when(same, clean).otherwise(F.col("text")).alias("text"), (~same).alias("mismatch"))


def body_start(tokens: Column, markers: list[list[str]], least: int = 3) -> Column:
    """The token after the last marker phrase that has ``least`` tokens after it; 0 without one."""
    def after_last(marker: list[str]) -> Column:
        n, words = len(marker), F.array(*map(F.lit, marker))
        starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
        fits = F.filter(starts, lambda k: (F.slice(tokens, k + 1, n) == words) & (F.size(tokens) - (k + n) >= least))
        return F.coalesce(F.array_max(fits) + n, F.lit(0))

    ends = [after_last(m) for m in markers]
    return F.greatest(*ends) if len(ends) > 1 else ends[0]


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def missing(expected: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    return expected.join(rows, list(keys), "left_anti").select(*keys)


def fingerprint(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(n, digest): a digest of a corpus that neither order nor partitioning changes, from sums of row digests."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\x00", F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(digest).cast("string").alias("digest"))


def fixture(rows: DataFrame, by: str, order: str, most: int, pinned: list[int]) -> DataFrame:
    """The first ``most`` rows of each group and some pinned ones: a small corpus for tests."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where((F.col("k") <= most) | F.col(order).isin(pinned)).drop("k")


#: The pointer of an index folder: the name of the version that readers open.
CURRENT = "current"


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _pointed(spark: SparkSession, path: str) -> str | None:
    fs, target = _at(spark, f"{path}/{CURRENT}")
    return spark.read.text(f"{path}/{CURRENT}").first()[0] if fs.exists(target) else None


def save_index(tables: dict[str, DataFrame], path: str, digest: str, keep: int = 2) -> str:
    """Publishes index tables as a new version and returns its name.

    A version is a folder of its own, with a row that names the corpus and the format. Only when all of it is written is the
    pointer replaced, by one rename, so a writer that dies leaves readers on the version before, and readers never see half.
    Of older versions the ``keep`` - 1 last ones stay for readers that have them open; what a dead writer left goes too.
    """
    spark, name = next(iter(tables.values())).sparkSession, f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for table, df in tables.items():
        df.write.parquet(f"{path}/{name}/{table}")
    spark.createDataFrame([(digest, VERSION)], "digest string, version int").coalesce(1).write.parquet(f"{path}/{name}/_meta")
    fs, fresh = _at(spark, f"{path}/{CURRENT}-{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, hadoop.Path(f"{path}/{CURRENT}"), overwrite)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(hadoop.Path(path)) if s.isDirectory() and s.getPath().getName().startswith("v"))
    for old in [v for v in versions if v < name][: -(keep - 1) or None]:
        fs.delete(hadoop.Path(f"{path}/{old}"), True)
    return name


def load_index(spark: SparkSession, path: str, names: list[str], digest: str) -> dict[str, DataFrame] | None:
    """The tables of the current version; None if they were made from another corpus or in another format, or aren't there."""
    version = _pointed(spark, path)
    if version is None:
        return None
    meta = spark.read.parquet(f"{path}/{version}/_meta").first()
    return {n: spark.read.parquet(f"{path}/{version}/{n}") for n in names} if (meta.digest, meta.version) == (digest, VERSION) else None


def sources_markdown(sources: DataFrame) -> DataFrame:
    """(line) of a table of sources (name, license, url), in order of name."""
    line = F.format_string("| %s | %s | %s |", F.col("name"), F.coalesce("license", F.lit("-")), F.coalesce("url", F.lit("-")))
    return sources.orderBy("name").select(line.alias("line"))
