"""Format-preserving pseudonyms for personal data.

What a pattern finds and a check confirms (checksums, calendar, ranges) is written as a number within its format and
permuted by a keyed Feistel network. Equal values so get equal pseudonyms in all documents, different ones different
ones, and whoever has the key can turn them back.

Telephone numbers are found with a country code (+), in the grouped forms of North America, France, Spain, Germany and
Britain, and ungrouped after a word for telephone; other bare numbers are no evidence. IBANs are told by their country's
length and their checksum, in groups of four or in one.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
import secrets
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import small_batches

ROUNDS = 10

_KEY = "spark.quillmark.pseudonyms.key"
_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The secret named by spark.quillmark.pseudonyms.key; where it is unset, a random one that this application forgets at its end.

    Who wants to restore texts later, or the same pseudonyms from run to run, sets it.
    """
    app = spark.sparkContext.applicationId
    return spark.conf.get(_KEY, None) or _keys.setdefault(app, secrets.token_hex(32))


class Feistel:
    """Keyed permutations of the numbers under any bound."""

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()

    def _round(self, tweak: str, k: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        digest = hashlib.shake_256(self.key + f"{tweak}|{bits}|{k}|".encode() + half.to_bytes(size, "big")).digest(size)
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, tweak: str, back: bool) -> int:
        a, b = x >> bits, x & ((1 << bits) - 1)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ self._round(tweak, k, a, bits), a
            else:
                a, b = b, a ^ self._round(tweak, k, b, bits)
        return a << bits | b

    def permute(self, x: int, bound: int, tweak: str, ok: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """Where x goes among the numbers under ``bound`` that are ``ok``: on until one of them is met again."""
        bits = max(1, ((bound - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, bits, tweak, back)
            if x < bound and ok(x):
                return x


_HEX = "0123456789abcdef"
_ALPHABETS = (string.digits, string.ascii_lowercase, string.ascii_uppercase)


def _hexadecimal(text: str) -> bool:
    return len(text) >= 16 and all(c in _HEX for c in text) and not text.isdigit()


def _radices(text: str) -> list[str | None]:
    """The alphabet of each character; a hexadecimal string has one for all, other characters stay as they are."""
    if _hexadecimal(text):
        return [_HEX] * len(text)
    return [next((a for a in _ALPHABETS if c in a), None) for c in text]


def _characters(f: Feistel, text: str, tweak: str, back: bool) -> str:
    """Permutes a string within its characters' kinds."""
    kinds = _radices(text)
    x, bound = 0, 1
    for c, kind in zip(text, kinds, strict=True):
        if kind:
            x, bound = x * len(kind) + kind.index(c), bound * len(kind)
    if bound == 1:
        return text
    shape = "".join("." if k is None else "xdlu"[0 if k is _HEX else 1 + _ALPHABETS.index(k)] for k in kinds)
    hexadecimal = kinds[0] is _HEX

    def spelt(y: int) -> str:
        out = []
        for c, kind in zip(reversed(text), reversed(kinds), strict=True):
            if kind:
                y, r = divmod(y, len(kind))
                c = kind[r]
            out.append(c)
        return "".join(reversed(out))

    return spelt(f.permute(x, bound, f"{tweak}{shape}", lambda y: _hexadecimal(spelt(y)) == hexadecimal, back))


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced, one after the other."""
    rest = iter(digits)
    return "".join(next(rest) if c in string.digits else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in string.digits)


def _luhn(body: str) -> int:
    """The check digit that follows ``body``."""
    total = 0
    for k, c in enumerate(reversed(body)):
        v = int(c) * (2 - k % 2)
        total += v - 9 * (v > 9)
    return -total % 10


def _card(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = _digits(m[0])
    if _luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    allowed = lambda y: len(set(f"{y:0{n}d}{_luhn(f'{y:0{n}d}')}")) > 1
    body = f"{f.permute(int(digits[:-1]), 10**n, f'card{n}', allowed, back):0{n}d}"
    return _refill(m[0], body + str(_luhn(body)))


# Country codes of one and of two digits; all others have three.
COUNTRY_1, COUNTRY_2 = "1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _phone(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Digits after the country code are permuted, wherever spaces and signs stand."""
    digits, kept = _digits(m[0]), 0
    if m["country"]:
        kept = len(_digits(m["country"]))
    elif m[0].startswith("+"):
        kept = 1 if digits[0] in COUNTRY_1 else 2 if digits[:2] in COUNTRY_2 else 3
    elif m["national"]:
        kept = 1  # the zero, or the kind of number
    lead = m["word"] or ""
    if m["word"]:
        digits = _digits(m[0][len(lead) :])
    body = digits[kept:]
    new = f"{f.permute(int(body), 10 ** len(body), f'phone{len(body)}', back=back):0{len(body)}d}"
    return lead + _refill(m[0][len(lead) :], digits[:kept] + new)


def _address(f: Feistel, m: re.Match, back: bool) -> str | None:
    """An IPv4 address, without leading zeros, and every octet under 256."""
    parts = m[0].split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    y = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", back=back)
    return ".".join(map(str, y.to_bytes(4, "big")))


def _email(f: Feistel, m: re.Match, back: bool) -> str | None:
    local, _, domain = m[0].rpartition("@")
    name, _, last = domain.rpartition(".")
    return f"{_characters(f, local, 'local', back)}@{_characters(f, name, 'domain', back)}.{last}"


def _social(f: Feistel, m: re.Match, back: bool) -> str | None:
    def valid(x: int) -> bool:
        return 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10**4 % 100 > 0 and x % 10**4 > 0

    x = int(_digits(m[0]))
    return _refill(m[0], f"{f.permute(x, 10**9, 'social', valid, back):09d}") if valid(x) else None


# Lengths of IBANs by country.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 "
    "IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}


def _iban(f: Feistel, m: re.Match, back: bool) -> str | None:
    """Of what the pattern took as many characters as the country's numbers have; of an unlisted country all, if ungrouped."""
    length, taken = IBAN_LENGTHS.get(m[0][:2]), 0
    if length is None:
        taken = len(m[0]) if " " not in m[0] else 0
    else:
        places = [k for k, c in enumerate(m[0]) if c != " "]
        if len(places) >= length:
            taken = places[length - 1] + 1
    found, rest = m[0][:taken], m[0][taken:]
    if not taken or rest[:1].isalnum():
        return None
    bare = found.replace(" ", "")
    country, check, account = bare[:2], bare[2:4], bare[4:]

    def remainder(check: str, account: str) -> int:
        return int("".join(str(int(c, 36)) for c in account + country + check)) % 97

    if remainder(check, account) != 1 or not 2 <= int(check) <= 98:
        return None
    account = _characters(f, account, f"iban{country}", back)
    new = iter(f"{country}{98 - remainder('00', account):02d}{account}")
    return "".join(c if c == " " else next(new) for c in found) + rest


_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def _day(year: str, month: str, day: str) -> int | None:
    try:
        x = datetime.date(int(year), int(month), int(day)).toordinal() - _FIRST
    except ValueError:
        return None
    return x if 0 <= x < _DAYS else None


def _date(f: Feistel, m: re.Match, back: bool) -> str | None:
    """A date of 1900 to 2099, year first, or day first, or month first where the second number can only be a day."""
    if m["y"]:
        x = _day(m["y"], m["m"], m["d"])
        if x is None:
            return None
        new = datetime.date.fromordinal(_FIRST + f.permute(x, _DAYS, "date", back=back))
        return f"{new.year}{m['s']}{new.month:02d}{m['s']}{new.day:02d}"
    month_first = int(m["b"]) > 12
    x = _day(m["z"], m["a"], m["b"]) if month_first else _day(m["z"], m["b"], m["a"])
    if x is None:
        return None
    late = lambda y: not month_first or datetime.date.fromordinal(_FIRST + y).day > 12
    new = datetime.date.fromordinal(_FIRST + f.permute(x, _DAYS, "late" if month_first else "date", late, back))
    first, second = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{first:02d}{m['t']}{second:02d}{m['t']}{new.year}"


def _secret(f: Feistel, m: re.Match, back: bool) -> str | None:
    return m["name"] + _characters(f, m["value"], "secret", back)


#: Kinds in the order in which they are looked for; of overlapping finds the earlier kind keeps its place.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("email", r"(?<![\w.+%@-])[\w.+%-]*\w@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![^\W_]|@)", _email),
    ("secret", r"(?i:(?P<name>\b(?:api[_-]?key|access[_-]?key|secret|token|passwd|password)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?))(?P<value>[A-Za-z0-9_\-]{16,})", _secret),
    ("iban", r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", _iban),
    ("card", r"(?<![\w.])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?!\w)", _card),
    ("phone", r"(?:(?<![\w+])(?P<country>\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"  # North America
     r"|(?<![\w+])\+\d(?:[ .()/-]{0,2}\d){7,14}(?!\w)"  # with a country code
     r"|(?<![\w.,+/-])(?<!\d )(?P<national>0\d(?:[ .-]\d{2}){4}|[6789]\d{2}(?: \d{2}){3}|[6789]\d{2} \d{3} \d{3}|0\d{1,4}[ /-]\d{6,8}|0\d{1,4}[ /-]\d{3,4}[ -]\d{3,4})(?![\w/-])(?! \d)"  # France, Spain, Germany and Britain
     r"|(?P<word>(?i:\b(?:tele(?:ph|f)one?|t[ée]l[ée]phone|phone|fon|tel|t[ée]l|call|fax|mobile?|cell|handy|m[óo]vil)\b[.:]{0,2} {0,2}))\d{7,12}(?!\w))", _phone),
    ("social", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _social),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)", _address),
    ("date", r"(?<![\w/.-])(?:(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{2})(?P=s)(?P<d>\d{2})|(?P<a>\d{2})(?P<t>[-/.])(?P<b>\d{2})(?P=t)(?P<z>\d{4}))(?![\w/-])", _date),
)
_MAY = re.compile("[@0-9]|[A-Za-z0-9_-]{16}").search


class Pseudonyms:
    """Finds personal data in a text and puts pseudonyms in its place."""

    def __init__(self, key: str):
        self.feistel = Feistel(key)
        self.kinds = [(name, re.compile(pattern), how) for name, pattern, how in KINDS]

    def apply(self, text: str, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and what was replaced: (start, end, kind) in the given text."""
        if not _MAY(text):
            return text, []
        starts: list[int] = []
        found: list[tuple[int, int, str, str]] = []  # in order, apart from each other
        for name, pattern, how in self.kinds:
            for m in pattern.finditer(text):
                at = bisect.bisect_right(starts, m.start())
                free = (at == 0 or found[at - 1][1] <= m.start()) and (at == len(found) or m.end() <= found[at][0])
                if free and (new := how(self.feistel, m, back)) is not None:
                    starts.insert(at, m.start())
                    found.insert(at, (m.start(), m.end(), name, new))
        parts, at = [], 0
        for a, b, _, new in found:
            parts += [text[at:a], new]
            at = b
        return "".join([*parts, text[at:]]), [(a, b, name) for a, b, name, _ in found]


def pseudonymise(docs: DataFrame, key: str | None = None, back: bool = False, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with pseudonyms in the texts; ``back`` restores what the same key replaced.

    Without a ``key`` that of the session is taken (``session_key``). Null texts stay null, empty ones empty; null ids and
    other columns, whatever their names, pass through; rows stay where they are, one pass, no shuffle; repeated rows are
    treated alike; an empty table gives an empty one. Of overlapping finds the earlier kind of KINDS, then the earlier
    place counts. The work grows with a text's length and the logarithm of its finds.
    """
    key = key or session_key(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            new = [t if t is None else pseudonyms.apply(t, back)[0] for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.string()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def find_private(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: the id, the text with pseudonyms, n_found, kinds (distinct, sorted, comma-joined) and spans.

    Spans (first, after, kind) are code-point places in the given text. Null text: null text and nothing found. Null ids
    stay null, other columns are left out, an empty table gives an empty one; key, ties and long texts as in ``pseudonymise``.
    """
    key = key or session_key(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key)
        for batch in batches:
            rows = [(None, []) if t is None else pseudonyms.apply(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([t for t, _ in rows], pa.string()), pa.array([len(s) for _, s in rows], pa.int64()), pa.array([",".join(sorted({k for *_, k in s})) for _, s in rows])]
            columns.append(pa.array([[{"first": a, "after": b, "kind": k} for a, b, k in s] for _, s in rows], spans))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "text", "n_found", "kinds", "spans"])

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, text string, n_found long, kinds string, spans array<struct<first: long, after: long, kind: string>>")
