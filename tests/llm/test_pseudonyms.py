"""Pseudonyms against a version in plain Python, and what they keep."""

from __future__ import annotations

import datetime
import hashlib
import random
from collections import Counter

import pytest
import regex

from tidemark.llm.pseudonyms import KINDS, PATTERN, RUN, op10_feistel_pseudonyms, pseudonymise

KEY = "k"


def feistel(kind: str, left: int, right: int, a: int, b: int, key: str = KEY) -> tuple[int, int]:
    noise = lambda i, x: int(hashlib.sha256(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()[:15], 16)
    for i in range(1, 11):
        if i % 2:
            left = (left + noise(i, right)) % a
        else:
            right = (right + noise(i, left)) % b
    return left, right


def digits_of(kind: str, d: str, key: str = KEY) -> str:
    n = len(d) // 2
    x, y = feistel(kind, int(d[:n]), int(d[n:]), 10**n, 10 ** (len(d) - n), key)
    return f"{x:0{n}d}{y:0{len(d) - n}d}"


def refill(old: str, new: str) -> str:
    left = iter(new)
    return "".join(next(left) if "0" <= c <= "9" else c for c in old)


def luhn(payload: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def plain(m: str) -> str:
    return "".join(c for c in m if "0" <= c <= "9")


def email(m: str, key: str) -> str:
    return f"user-{hashlib.sha256(f'{key}|email|{m.lower()}'.encode()).hexdigest()[:32]}@example.invalid"


def iban(m: str, key: str) -> str | None:
    p = m.replace(" ", "")
    rest = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
    if rest(p) != 1 or not 15 <= len(p) <= 34 or len(plain(p[4:])) < 2:
        return None
    new = refill(p[4:], digits_of("iban", plain(p[4:]), key))
    return refill(m, f"{98 - rest(p[:2] + '00' + new):02d}{plain(new)}")


def ssn(m: str, key: str) -> str | None:
    area, group, serial = map(int, m.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    x, y = feistel("ssn", (area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key)
    n = x // 99
    return f"{n + (2 if n >= 665 else 1):03d}-{x % 99 + 1:02d}-{y + 1:04d}"


def date(m: str, key: str) -> str | None:
    def made(y: str, mo: str, d: str) -> datetime.date | None:
        try:
            return datetime.date(int(y), int(mo), int(d))
        except ValueError:
            return None

    first = datetime.date(1800, 1, 1)
    a, b, c = regex.split("[-/.]", m)
    if m[4] == "-":
        now, fields = made(a, b, c), None
    else:
        by_month = made(c, a, b) if "/" in m else None
        now = by_month or made(c, b, a)
        fields = (lambda x: (x.month, x.day)) if by_month else (lambda x: (x.day, x.month))
    if now is None or not 0 <= (now - first).days < 146097:
        return None
    while True:
        x, y = feistel("date", *divmod((now - first).days, 773), 189, 773, key)
        now = first + datetime.timedelta(x * 773 + y)
        if fields is None:
            return now.isoformat()
        p, q = fields(now)
        if (len(a) > 1 or p < 10) and (len(b) > 1 or q < 10) and ("/" not in m or by_month or now.day > 12):
            sign = "/" if "/" in m else "."
            return f"{p:0{len(a)}d}{sign}{q:0{len(b)}d}{sign}{now.year}"


def ip(m: str, key: str) -> str:
    o = list(map(int, m.split(".")))
    x, y = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key)
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def phone(m: str, key: str) -> str | None:
    d = plain(m)
    code = "" if m[0] != "+" else "1" if regex.match(r"\+1(?![0-9])", m) else regex.match(r"\+([0-9]{1,3})", m)[1]
    n = d[len(code) :]
    if code in ("", "1") and regex.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", n):
        x, y = feistel("nanp", int(n[:3]) - 200, int(n[3:]) - 2_000_000, 800, 8_000_000, key)
        return refill(m, f"{code}{x + 200:03d}{y + 2_000_000:07d}")
    return refill(m, code + digits_of("phone", n, key)) if 8 <= len(d) <= 15 and len(n) >= 4 else None


WRITERS = {"email": email, "iban": iban, "ssn": ssn, "date": date, "ip": ip, "phone": phone}


def carded(text: str, key: str, n: Counter) -> str:
    def run(m) -> str:
        parts, at, out = [(x.start(), x.end()) for x in regex.finditer("[0-9]*", m[0])], 0, []
        parts = [(a, b) for i, (a, b) in enumerate(parts) if b > a]
        i = 0
        while i < len(parts):
            found = None
            for j in range(min(len(parts), i + 19), i, -1):
                group = parts[i:j]
                d = "".join(m[0][a:b] for a, b in group)
                together = all(y[0] - x[1] == 1 for x, y in zip(group, group[1:]))
                if together and 13 <= len(d) <= 19 and all(b - a >= 4 for a, b in group[:-1]) and luhn(d[:-1]) == d[-1]:
                    found = j, d
                    break
            if found:
                j, d = found
                new = digits_of("card", d[:-1], key)
                a, b = parts[i][0], parts[j - 1][1]
                out += [m[0][at:a], refill(m[0][a:b], new + luhn(new))]
                at, i = b, j
                n["card"] += 1
            else:
                i += 1
        return "".join(out) + m[0][at:]

    return regex.sub(RUN, run, text)


def by_hand(text: str | None, key: str = KEY) -> tuple[str | None, Counter]:
    n: Counter = Counter()
    if text is None or not regex.search("[0-9@]", text):
        return text, n
    out, at = [], 0
    for m in regex.finditer(PATTERN.replace("++", "+"), text):
        out.append(carded(text[at : m.start()], key, n))
        at = m.end()
        for kind, shape in KINDS.items():
            if regex.fullmatch(shape, m[0]) and (new := WRITERS[kind](m[0], key)) is not None:
                n[kind] += 1
                out.append(new)
                break
        else:
            out.append(carded(m[0], key, n))
    return "".join(out) + carded(text[at:], key, n), n


CARD = "4111 1111 1111 1111"
#: A text, and what must be gone and what must stay.
BESIDE = [
    (f"{CARD} 123", [CARD], [" 123"]),
    ("4111111111111111 12/26", ["4111111111111111"], [" 12/26"]),
    (f"order 12 {CARD}", [CARD], ["order 12 "]),
    (f"12345 {CARD} 123 {CARD} 7", [CARD], ["12345 ", " 123 ", " 7"]),
    ("ES9121000418450200051332 US", ["ES9121000418450200051332"], [" US"]),
    ("DE89370400440532013000 2024", ["DE89370400440532013000"], [" 2024"]),
    ("DE89 3704 0044 0532 0130 00 ES91 2100 0418 4502 0005 1332", ["0532 0130", "4502 0005"], []),
    (f"+1 415 555 2671 {CARD}", ["415 555 2671", CARD], ["+1 "]),
    (f"+44 20 7946 0958 {CARD}", ["7946 0958", CARD], ["+44 "]),
    ("id 12345 123-45-6789", ["123-45-6789"], ["id 12345 "]),
    ("3782 822463 10005 x 4222222222222", ["822463", "4222222222222"], [" x "]),
    ("1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", [], ["1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0"]),
    ("4111  1111 1111 1111 and 4111 1111 1111 1112", [], ["4111  1111 1111 1111 and 4111 1111 1111 1112"]),
    ("000-12-3456 999.1.1.1 31/02/2024 GB00 1234", [], ["000-12-3456", "31/02/2024", "GB00 1234"]),
]


def test_values_beside_others(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(BESIDE)]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for i, (text, gone, stay) in enumerate(BESIDE):
        assert not any(x in got[i].text for x in gone) and all(x in got[i].text for x in stay), (text, got[i].text)
        want, n = by_hand(text)
        assert got[i].text == want and {k: v for k, v in got[i].n_pii.items() if v} == dict(n)


def test_same_as_by_hand(spark, sf_dir):
    rng = random.Random(5)
    pick = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = [lambda: (lambda p: p + luhn(p))(pick(rng.randint(12, 18))), lambda: f"{pick(3)}-{pick(2)}-{pick(4)}", lambda: f"{rng.randint(1, 31)}/{rng.randint(1, 13)}/{rng.randint(1790, 2210)}", lambda: f"{pick(2)}.{pick(2)}.20{pick(2)}", lambda: f"{rng.randint(0, 300)}.{rng.randint(0, 255)}.1.{rng.randint(0, 255)}", lambda: f"+{rng.randint(1, 99)} {pick(3)} {pick(4)} {pick(3)}", lambda: f"({pick(3)}) {pick(3)}-{pick(4)}", lambda: f"u{pick(2)}@mail{pick(1)}.example.org", lambda: f"19{pick(2)}-0{pick(1)}-1{pick(1)}", lambda: pick(rng.randint(1, 6)), lambda: "word", lambda: "DE89370400440532013000", lambda: " ".join(pick(4) for _ in range(rng.randint(1, 6)))]
    texts = [rng.choice([" ", "; ", "\n", " - "]).join(rng.choice(made)() for _ in range(rng.randint(1, 30))) for _ in range(300)] + [None, "", "é @ 1"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    for r in got:
        want, n = by_hand(texts[r.doc_id])
        assert r.text == want and {k: v for k, v in r.n_pii.items() if v} == dict(n), (texts[r.doc_id], r.text, want)


def test_query_is_the_same_as_by_hand(spark, sf_dir):
    texts = Counter((r.doc_id, by_hand(r.text, "tidemark-demo-key")[0]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert Counter((r.doc_id, r.text) for r in op10_feistel_pseudonyms(spark, sf_dir).collect()) == texts


@pytest.mark.parametrize("shape", ["yyyy-MM-dd", "M/d/yyyy", "dd/MM/yyyy", "d.M.yyyy"])
def test_every_day_keeps_its_shape_and_comes_back(spark, shape):
    days = spark.range(0, 146097, 1 if shape == "M/d/yyyy" else 5).selectExpr(  # all days of 400 years, or each fifth one
        "id as doc_id", f"date_format(date_add(date'1800-01-01', cast(id as int)), '{shape}') as text")
    new = pseudonymise(days, KEY).selectExpr("doc_id", "text as new")
    back = pseudonymise(new.selectExpr("doc_id", "new as text"), KEY, restore=True).selectExpr("doc_id", "text as back")
    both = days.join(new, "doc_id").join(back, "doc_id")
    found = both.selectExpr("count(*)", "count(distinct new)", "count(distinct text)", "count_if(text = back)", "count_if(regexp_replace(text, '[0-9]', '0') = regexp_replace(new, '[0-9]', '0'))").first()
    assert found[0] == found[3] == found[4] == days.count() and found[1] == found[2]
