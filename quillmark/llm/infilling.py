"""Fill-in-the-middle examples by escaped marker injection, in native expressions only.

A control character that delimits units is escaped in the text; a regular expression then appends it after every unit,
so that units are counted by it and ranked parts are what substring_index finds before or after its n-th place. The parts
lose their delimiters, are unescaped and put together around the markers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands after each unit; it and the escape character are written as the escape character and a digit in texts.
DELIMITER, ESCAPE = "\x1f", "\x1e"

#: A unit of an escaped text: an escaped character or any other code point.
UNIT = f"(?s){ESCAPE}[01]|."


@dataclass(frozen=True)
class Markers:
    """What stands before the prefix, the suffix and the middle; no marker may begin within another."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def _plain(part: Column) -> Column:
    """A part of a marked text without delimiters and escapes."""
    return F.replace(F.replace(F.replace(part, F.lit(DELIMITER), F.lit("")), F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _first(marked: Column, n: Column) -> Column:
    return F.call_function("substring_index", marked, F.lit(DELIMITER), n.cast("int"))


def draws(key: Column, count: int = 4) -> list[Column]:
    """The first eight-digit groups of the key's hexadecimal SHA-256, as unsigned integers."""
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def fill_in_middle(docs: DataFrame, markers: Markers | None = None, plain_percent: int = 10, spm_percent: int = 20, salt: str = "1:", unit: str = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, text, output) of each row.

    The first two numbers drawn from the salted id choose two cuts among the text's ``n`` units, the third whether it
    stays plain, the fourth whether the suffix or the prefix comes first (spm, psm). A null text counts as empty, a null
    id as an empty one; rows of equal ids are cut at the same draws. Texts that are empty or hold a marker stay plain.
    ``unit``: a pattern over escaped texts that matches all of a text, unit by unit; an escaped character is one match or
    within one. Other columns are left out, so none can clash; an empty table gives an empty one.
    """
    m = markers or Markers()
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    holds = F.contains("text", F.lit(m.prefix)) | F.contains("text", F.lit(m.suffix)) | F.contains("text", F.lit(m.middle))
    rows = docs.select(F.col(id_col), text.alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    marked = rows.withColumn("marked", F.regexp_replace(_escaped(F.col("text")), unit, f"$0{DELIMITER}"))
    # A delimiter is one byte and stands nowhere else.
    counted = marked.withColumn("n", (F.octet_length("marked") - F.octet_length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    form = F.when((F.col("n") == 0) | holds | (F.col("h3") % 100 >= 100 - plain_percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    x, y = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = counted.select("*", form.alias("form"), F.least(x, y).alias("low"), F.greatest(x, y).alias("high"))
    to_low, to_high = _first(F.col("marked"), F.col("low")), _first(F.col("marked"), F.col("high"))
    # A marked text ends in a delimiter, so an empty part follows it: its last n - high + 1 parts are the suffix.
    parts = cut.withColumns({
        "p": _plain(to_low),
        "m": _plain(_first(to_high, F.col("low") - F.col("high"))),
        "s": _plain(_first(F.col("marked"), F.col("high") - F.col("n") - 1)),
    })
    around = F.when(F.col("form") == "psm", F.concat(F.lit(m.prefix), "p", F.lit(m.suffix), "s", F.lit(m.middle), "m"))
    output = around.when(F.col("form") == "spm", F.concat(F.lit(m.suffix), "s", F.lit(m.prefix), "p", F.lit(m.middle), "m")).otherwise(F.col("text"))
    shaped = F.col("form") != "plain"
    return parts.select(id_col, "n", "form", F.when(shaped, F.length("p").cast("long")).alias("prefix_chars"), F.when(shaped, F.length("m").cast("long")).alias("middle_chars"), "text", output.alias("output"))


def restored(output: Column, form: Column, markers: Markers | None = None) -> Column:
    """The text of an example, from the example and its form alone: no part holds a marker, so each stands once."""
    m = markers or Markers()

    def between(rest: Column, marker: str) -> tuple[Column, Column]:
        return F.substring_index(rest, marker, 1), F.substring_index(rest, marker, -1)

    ahead, middle = between(output, m.middle)
    prefix, suffix = between(F.call_function("substr", ahead, F.lit(len(m.prefix) + 1)), m.suffix)
    late_suffix, late_prefix = between(F.call_function("substr", ahead, F.lit(len(m.suffix) + 1)), m.prefix)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, middle, late_suffix)).otherwise(output)


def digests(examples: DataFrame, markers: Markers | None = None) -> DataFrame:
    """``examples`` with output_sha256 and restored_sha256 in place of the texts."""
    whole = examples.withColumn("back", restored(F.col("output"), F.col("form"), markers))
    return whole.withColumns({"output_sha256": F.sha2(F.col("output").cast("binary"), 256), "restored_sha256": F.sha2(F.col("back").cast("binary"), 256)}).drop("text", "output", "back")
