import datetime
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from quillmark.llm import privacy as P

SCHEMA = "doc_id long, text string, kinds string, n_found int"
ONE = P.Pseudonyms("k")


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 3000))
def test_feistel_is_a_permutation(bound):
    f = P.Feistel("key")
    assert sorted(f.permute(x, bound, "t") for x in range(bound)) == list(range(bound))
    assert all(f.permute(f.permute(x, bound, "t"), bound, "t", back=True) == x for x in range(0, bound, 37))


CASES = [
    ("email", "write to jo.Doe7@mail5.example.com."), ("email", "ésumé@x.org"), ("phone", "call +1 (743) 555-3824!"), ("phone", "743-555-3824"), ("card", "4111 1111 1111 1111"),
    ("card", "4111111111111111"), ("ip", "97.51.17.173 up"), ("social", "123-45-6789"), ("iban", "DE89370400440532013000"), ("date", "on 2023-02-28"), ("date", "31/12/1999"), ("date", "12/31/1999"),
    ("email", "joe@example.com-based"), ("email", "(joe@example.com--)"), ("email", "joe@example.com_x"), ("phone", "+33 1 23 45 67 89"), ("phone", "+49 30 1234567"), ("phone", "+44 20 7946 0958"), ("phone", "+15551234567"),
    ("phone", "tel. 5551234567"), ("phone", "Téléphone: 0123456789"), ("phone", "01 23 45 67 89"), ("phone", "030 1234567"), ("phone", "020 7946 0958"), ("phone", "612 345 678"), ("phone", "0171/1234567"), ("phone", "+351 21 123 4567"),
    ("card", "3782 822463 10005"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82 WEST 1234 5698 7654 32 AND MORE"), ("iban", "FR14 2004 1010 0505 0001 3M02 606 THE"), ("iban", "BE68 5390 0754 7034 WORD"),
    ("secret", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), ("secret", "API_KEY: AbCdEf0123456789xyz_"),
]
CLEAN = ["4111111111111112", "0000000000000000", "2023-02-30", "13/13/2000", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "000-12-3456", "DE89370400440532013001", "version 2.0", "a@b", "plain words", "9807915762804490", "1" * 30, "@" * 20, "", "5551234567", "DE89 3704 0044 0532 0130 01", "0 12 34", "page 123 456", "GB82 WEST"]


def test_finds_links_and_restores():
    for kind, text in CASES:
        new, found = ONE.apply(text)
        assert [k for *_, k in found] == [kind] and new != text and len(new) == len(text) or kind == "ip", text
        again, there = ONE.apply(new)
        assert [k for *_, k in there] == [kind] and ONE.apply(new, back=True)[0] == text, (text, new)
        a, b, _ = found[0]
        assert ONE.apply(f"é x {text[a:b]} y")[0] == f"é x {new[a : len(new) - len(text) + b]} y"  # the same in any document
        assert P.Pseudonyms("other").apply(text)[0] != new


def test_leaves_clean_text():
    for text in CLEAN:
        assert ONE.apply(text) == (text, []), text


def test_repeated_neighbours():
    new, found = ONE.apply("4111111111111111 4111111111111111")
    assert len(found) == 2 and len(set(new.split())) == 1


def test_dates_stay_dates():
    rng = random.Random(12)
    seen = {}
    for _ in range(400):
        d = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73000))
        new = ONE.apply(f"{d:%m/%d/%Y}")[0]
        order = "%m/%d/%Y" if d.day > 12 else "%d/%m/%Y"
        datetime.datetime.strptime(new, order)
        assert seen.setdefault(new, f"{d:%m/%d/%Y}") == f"{d:%m/%d/%Y}"


def test_tables(spark):
    rows = [(0, None, "clash", 1), (1, "", "", 1), (None, CASES[0][1], "", 1), (3, CASES[0][1], "", 1), (3, CASES[0][1], "", 1), (4, "x" * 200000 + " 97.51.17.173", "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = P.find_private(docs).collect()
    assert [(r.doc_id, r.n_found, r.kinds) for r in got] == [(0, 0, ""), (1, 0, ""), (None, 1, "email"), (3, 1, "email"), (3, 1, "email"), (4, 1, "ip")]
    new = P.pseudonymise(docs)
    assert new.schema == docs.schema and [r.text for r in new.collect()] == [r.text for r in got]
    assert P.pseudonymise(docs).collect() == new.collect()  # one key for a session
    assert P.pseudonymise(docs, "other").collect() != new.collect()
    assert P.pseudonymise(new, back=True).collect() == docs.collect()
    assert P.find_private(docs.limit(0)).collect() == []


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def planted(rng):
    """A valid datum of a random kind, by construction, and a test of its format."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.choice(["email", "card", "iban", "phone", "social", "ip", "date", "secret"])
    if kind == "card":
        body = "4" + digits(14)
        return kind, body + next(c for c in "0123456789" if luhn(body + c)), lambda x: len(x) == 16 and luhn(x)
    if kind == "iban":
        account = digits(18)
        check = 98 - int(account + "131400") % 97
        return kind, f"DE{check:02d}{account}", lambda x: len(x) == 22 and int(x[4:] + "1314" + x[2:4]) % 97 == 1
    return kind, *{
        "email": (f"{rng.choice(['ann', 'bob.x'])}{digits(2)}@mail{digits(1)}.org", lambda x: x.count("@") == 1 and x.endswith(".org")),
        "phone": (f"+1 (555) {digits(3)}-{digits(4)}", lambda x: x.startswith("+1 (") and len(x) == 17),
        "social": (f"{rng.randrange(1, 600):03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}", lambda x: x[:3] not in ("000", "666") and x[:1] != "9" and x[4:6] != "00" and x[7:] != "0000"),
        "ip": (".".join(str(rng.randrange(256)) for _ in range(4)), lambda x: all(int(p) < 256 for p in x.split("."))),
        "date": (str(datetime.date(1950, 1, 1) + datetime.timedelta(rng.randrange(30000))), lambda x: datetime.date.fromisoformat(x)),
        "secret": (f"password={rng.choice('abcdef')}{digits(10)}zzzzzz", lambda x: x.startswith("password=")),
    }[kind]


def test_equals_what_was_planted():
    rng = random.Random(21)
    for _ in range(300):
        text, wanted, gaps = "", [], []
        for _ in range(rng.randrange(12)):
            gap = rng.choice(["some words ", "é: ", "(x) ", "no. 17, ", "v2.0 of ", "12 apples; "])
            kind, datum, valid = planted(rng)
            wanted.append((len(text) + len(gap), len(text) + len(gap) + len(datum), kind, valid))
            text += gap + datum + rng.choice([" ", ", ", "; ", "\n"])
        new, found = ONE.apply(text)
        assert found == [w[:3] for w in wanted], text
        at = shift = 0
        for a, b, kind, valid in wanted:
            assert new[at + shift : a + shift] == text[at:a]  # what stands between stays
            rest = text[b:]
            end = len(new) - len(rest) if not rest else new.index(rest[0], a + shift) if kind == "ip" else b + shift
            assert valid(new[a + shift : end]) and (kind == "ip" or new[a + shift : end] != text[a:b])
            at, shift = b, end - b
        assert ONE.apply(new, back=True)[0] == text


def test_many_finds_in_one_text():
    text = " ".join(str(datetime.date(1950, 1, 1) + datetime.timedelta(k)) for k in range(20000))
    began = time.perf_counter()
    assert len(ONE.apply(text)[1]) == 20000 and time.perf_counter() - began < 20
