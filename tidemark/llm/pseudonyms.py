r"""Personal data to format-preserving Feistel pseudonyms, in DataFrame functions alone.

A match of PATTERN is validated (mod 97, calendar, octets, numbering plan), turned into a point (l, r) of the product of
two ranges, and permuted by ten rounds of a keyed Feistel network: l takes a hash of r, then r one of l, each modulo its own
range, which is a permutation for any ranges. The point is written back into the places of the old digits, so a card number stays a
valid card number with its blanks, a date stays a date. Equal values get equal pseudonyms everywhere, as these depend on nothing but
key, kind and value; ``restore=True`` undoes them. An e-mail address has no fixed format and becomes a keyed digest of 128 bits with an ``.invalid`` domain,
which stays linked but can't be undone. A local part of more than 64 characters, which no valid address has, is taken whole where it begins a run of such characters.

Card numbers (13 to 19 digits, Luhn) are sought in every run of digit groups that no other kind took, and in matches that failed their
validation: from each group on, the longest valid sequence of groups of four digits or more (the last may be shorter) is taken, and the groups beside it (a security code, an expiry, another number)
stay. IBANs have the length of their country, so a word or a year behind one isn't taken along. Dates lie in the 400 years from 1800 and keep
their reading and the widths of their fields: d/m/y is read month first if it can be, else day first, and the permutation of days is walked on until it meets
a date of that reading and those widths.

Numbers that fail validation stay as they are. Restoring reads a text anew; beside a card another group of digits can make a longer valid number by chance, and
only then is that card not restored. Null texts stay null, empty ones empty; very long ones are rewritten whole. Repeated rows are told row by row, an empty table gives an
empty one. Columns are kept; ``n_pii``, ``n_chars`` and ``text`` are replaced where they exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import table

ROUNDS = 10
KEY = "tidemark-demo-key"  # a parameter: production passes a secret
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_shape() -> str:
    """Groups of four characters, with or without blanks, as many as the country has; two to seven groups and a rest for other countries."""
    shapes = []
    for n in sorted(set(IBAN_LENGTHS.values())):
        whole, rest = divmod(n - 4, 4)
        codes = "|".join(c for c, x in IBAN_LENGTHS.items() if x == n)
        shapes.append(f"(?:{codes})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{whole}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    shapes.append(f"(?!{'|'.join(IBAN_LENGTHS)})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?")
    return "(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(shapes) + ")"


# The groups of a phone number don't begin a card number: groups of four with no fifth one behind them, 4-6-5, or digits in a row.
_NO_CARD = r"(?![0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,4}(?![0-9])(?![ -][0-9]{4}(?![0-9]))|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|[0-9]{13,19}(?![0-9]))"
KINDS = {
    # From any letter a local part is sought over 64 characters, which is the most an address has, from the first one of a run over all of it: so a run is not read anew from each of its dots.
    "email": r"(?:(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+|[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+)@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})",
    "iban": _iban_shape(),
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})",
    "ip": r"(?<![0-9]\.)" + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\.[0-9])",
    "phone": r"(?:\+1[ .-]?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?" + _NO_CARD + r"[0-9]{2,4}(?:[ .-]?" + _NO_CARD + r"[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})",
}
PATTERN = r"(?<![A-Za-z0-9])(?:" + "|".join(KINDS.values()) + r")(?![A-Za-z0-9])"
CARD = "card"
RUN = r"(?<![A-Za-z0-9])[0-9][0-9 -]{11,}[0-9](?![A-Za-z0-9])"  # groups of digits, in which card numbers are sought
LEAST_DIGITS, MOST_DIGITS, GROUP = 13, 19, 4  # all groups of a card number but the last have GROUP digits or more
WALK = 256  # steps until a date of the same shape is met; a step fails in 78 of 100 cases at most
FIRST_DAY, DAYS = "1800-01-01", 146097  # 400 years of the calendar: 189 * 773 days


def _feistel(kind: str, left: Column, right: Column, a: Column, b: Column, key: str, restore: bool) -> Column:
    """struct(l, r) after ROUNDS rounds; left is below a, right below b."""
    def noise(i: Column, x: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")

    sign = -1 if restore else 1
    order = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if restore else F.sequence(F.lit(1), F.lit(ROUNDS))

    def step(p: Column, i: Column) -> Column:
        odd = i % 2 == 1
        n = noise(i, F.when(odd, p["r"]).otherwise(p["l"]))
        l = F.when(odd, F.pmod(p["l"] + sign * F.pmod(n, a), a)).otherwise(p["l"])
        r = F.when(odd, p["r"]).otherwise(F.pmod(p["r"] + sign * F.pmod(n, b), b))
        return F.struct(l.alias("l"), r.alias("r"))

    return F.aggregate(order, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _padded(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _permuted_digits(kind: str, d: Column, key: str, restore: bool) -> Column:
    """A string of two digits or more, permuted among those of its length."""
    half = (F.length(d) / 2).cast("int")
    rest = F.length(d) - half
    p = _feistel(kind, _long(d.substr(F.lit(1), half)), _long(d.substr(half + 1, rest)), _power(half), _power(rest), key, restore)
    return _let(p, lambda x: F.concat(_padded(x["l"], half), _padded(x["r"], rest)))


def _refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced one by one."""
    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["s"], F.when(is_digit, F.substring(acc["d"], 1, 1)).otherwise(c)).alias("s"), F.when(is_digit, F.expr("1")).otherwise(F.lit(0)).alias("n"), F.when(is_digit, acc["d"].substr(F.lit(2), F.length(acc["d"]))).otherwise(acc["d"]).alias("d"))

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), digits.alias("d")), step, lambda acc: acc["s"])


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes ``payload`` and itself pass Luhn's test."""
    ds = F.transform(F.reverse(F.split(payload, "")), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(10 - F.aggregate(ds, F.lit(0), lambda s, x: s + x) % 10, F.lit(10)).cast("string")


def mod97(iban: Column) -> Column:
    """The number that an IBAN without blanks stands for, modulo 97."""
    moved = F.concat(iban.substr(F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _cards(run: Column, key: str, restore: bool) -> Column:
    """struct(n, s): a run of digit groups with its card numbers replaced, and how many they are."""

    def in_groups(groups: Column) -> Column:
        def longest(i: Column) -> Column:
            """How many groups from ``i`` on (from 1) make the longest valid number; null: none."""
            def valid(j: Column) -> Column:
                part = F.slice(groups, i, j)
                return _let(F.array_join(part, ""), lambda d: F.length(d).between(LEAST_DIGITS, MOST_DIGITS) & (i + j - 1 <= F.size(groups)) & (F.length(F.element_at(part, -1)) > 0) & F.forall(F.slice(part, 1, j - 1), lambda g: F.length(g) >= GROUP) & (luhn_digit(d.substr(F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1)))

            return F.get(F.filter(F.sequence(F.lit(MOST_DIGITS), F.lit(1), F.lit(-1)), valid), F.lit(0))

        def taken(state: Column, i: Column) -> Column:
            return _let(F.when(i >= state["free"], longest(i)), lambda j: F.when(j.isNull(), state).otherwise(F.struct((i + j).alias("free"), F.concat(state["hits"], F.array(F.struct(i.alias("i"), j.alias("j")))).alias("hits"))))

        none = F.struct(F.lit(1).alias("free"), F.array().cast("array<struct<i:int,j:int>>").alias("hits"))
        hits = F.aggregate(F.sequence(F.lit(1), F.size(groups)), none, taken, lambda s: s["hits"])
        signs = F.concat(F.regexp_extract_all(run, F.lit("[ -]"), F.lit(0)), F.array(F.lit("")))

        def woven(pieces: Column) -> Column:
            """``pieces`` are the groups, each with the sign behind it."""
            def number(h: Column) -> Column:
                old = F.array_join(F.slice(pieces, h["i"], h["j"]), "")
                d = F.array_join(F.slice(groups, h["i"], h["j"]), "")
                payload = d.substr(F.lit(1), F.length(d) - 1)
                return _let(_permuted_digits(CARD, payload, key, restore), lambda x: _refill(old, F.concat(x, luhn_digit(x))))

            def add(acc: Column, h: Column) -> Column:
                return F.struct((h["i"] + h["j"]).alias("next"), F.concat(acc["s"], F.array_join(F.slice(pieces, acc["next"], h["i"] - acc["next"]), ""), number(h)).alias("s"))

            start = F.struct(F.lit(1).alias("next"), F.lit("").alias("s"))
            return _let(hits, lambda found: F.aggregate(found, start, add, lambda acc: F.struct(F.size(found).alias("n"), F.concat(acc["s"], F.array_join(F.slice(pieces, acc["next"], F.greatest(F.lit(0), F.size(pieces) - acc["next"] + 1)), "")).alias("s"))))

        return _let(F.zip_with(groups, signs, lambda g, x: F.concat(g, x)), woven)

    return _let(F.split(run, "[ -]"), in_groups)


def _carded(text: Column, key: str, restore: bool) -> Column:
    """struct(n, s): ``text`` with its card numbers replaced, and how many they are."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: _cards(r, key, restore))
    gaps = F.split(text, RUN, -1)

    def woven(found: Column) -> Column:
        return F.struct(F.aggregate(found, F.lit(0), lambda n, x: n + x["n"]).alias("n"), F.concat_ws("", F.zip_with(gaps, found, lambda g, x: F.concat(g, F.coalesce(x["s"], F.lit(""))))).alias("s"))

    return F.when(text.rlike(RUN), _let(runs, woven)).otherwise(F.struct(F.lit(0).alias("n"), text.alias("s")))


def _iban(m: Column, key: str, restore: bool) -> Column:
    def body(plain: Column) -> Column:
        bban = plain.substr(F.lit(5), F.length(plain))
        d = _digits(bban)
        new = _refill(bban, _permuted_digits("iban", d, key, restore))
        head = F.substring(plain, 1, 2)
        check = _let(new, lambda x: F.concat(F.lpad((98 - mod97(F.concat(head, F.lit("00"), x))).cast("string"), 2, "0"), _digits(x)))
        return F.when((mod97(plain) == 1) & F.length(plain).between(15, 34) & (F.length(d) >= 2), _refill(m, check))

    return _let(F.replace(m, F.lit(" "), F.lit("")), body)


def _ssn(m: Column, key: str, restore: bool) -> Column:
    area, group, serial = _long(F.substring(m, 1, 3)), _long(F.substring(m, 5, 2)), _long(F.substring(m, 8, 4))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1
    p = _feistel("ssn", left, serial - 1, F.lit(898 * 99), F.lit(9999), key, restore)

    def write(x: Column) -> Column:
        n = F.floor(x["l"] / 99)
        return F.concat_ws("-", _padded(F.when(n >= 665, n + 2).otherwise(n + 1), 3), _padded(x["l"] % 99 + 1, 2), _padded(x["r"] + 1, 4))

    return F.when(ok, _let(p, write))


def _date(m: Column, key: str, restore: bool) -> Column:
    def day(y: Column, month: Column, d: Column) -> Column:
        """Days since FIRST_DAY, null where there is no such date."""
        return F.datediff(F.try_to_date(F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))

    def in_parts(p: Column) -> Column:
        iso, slash = F.substring(m, 5, 1) == "-", F.contains(m, F.lit("/"))
        a, b, c = (F.element_at(p, i) for i in (1, 2, 3))
        month_first = F.when(slash, day(c, a, b))
        start = F.when(iso, day(a, b, c)).otherwise(F.coalesce(month_first, day(c, b, a)))
        by_day = ~iso & month_first.isNull()

        def written(state: Column) -> Column:
            date = _as_date(state["x"])
            first, second = F.when(by_day, F.day(date)).otherwise(F.month(date)), F.when(by_day, F.month(date)).otherwise(F.day(date))
            sign = F.when(slash, F.lit("/")).otherwise(F.lit("."))
            return F.when(iso, F.date_format(date, "yyyy-MM-dd")).otherwise(F.concat(F.lpad(first.cast("string"), F.length(a), F.lit("0")), sign, F.lpad(second.cast("string"), F.length(b), F.lit("0")), sign, F.year(date).cast("string")))

        def same_shape(x: Column) -> Column:
            date = _as_date(x)
            first, second = F.when(by_day, F.day(date)).otherwise(F.month(date)), F.when(by_day, F.month(date)).otherwise(F.day(date))
            narrow = ((F.length(a) > 1) | (first < 10)) & ((F.length(b) > 1) | (second < 10))
            return iso | (narrow & (~slash | ~by_day | (F.day(date) > 12)))

        def step(state: Column, i: Column) -> Column:
            moved = _let(_feistel("date", F.floor(state["x"] / 773), state["x"] % 773, F.lit(189), F.lit(773), key, restore), lambda q: (q["l"] * 773 + q["r"]).cast("int"))
            return F.when(state["ok"], state).otherwise(_let(moved, lambda x: F.struct(x.alias("x"), same_shape(x).alias("ok"))))

        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(start.alias("x"), F.lit(False).alias("ok")), step)
        return F.when(start.between(0, DAYS - 1), _let(walked, lambda s: F.when(s["ok"], written(s))))

    return _let(F.split(m, "[-/.]"), in_parts)


def _as_date(x: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))


def _ip(m: Column, key: str, restore: bool) -> Column:
    o = [F.element_at(F.split(m, r"\."), i).cast("long") for i in (1, 2, 3, 4)]
    p = _feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, restore)
    return _let(p, lambda x: F.concat_ws(".", *(y.cast("string") for y in (F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256))))


def _phone(m: Column, key: str, restore: bool) -> Column:
    """Ten digits of the North American plan stay in it; others keep their country code."""
    def body(d: Column) -> Column:
        code = F.when(~m.startswith("+"), F.lit("")).when(m.rlike(r"^\+1(?![0-9])"), F.lit("1")).otherwise(F.regexp_extract(m, r"^\+([0-9]{1,3})", 1))
        n = d.substr(F.length(code) + 1, F.length(d))
        american = (code.isin("", "1")) & n.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
        left = (_long(F.substring(n, 1, 3)) - 200) % 800
        right = F.pmod(_long(n.substr(F.lit(4), F.length(n))) - 2_000_000, F.lit(8_000_000))
        p = _feistel("nanp", F.pmod(left, F.lit(800)), right, F.lit(800), F.lit(8_000_000), key, restore)
        nanp = _let(p, lambda x: F.concat(_padded(x["l"] + 200, 3), _padded(x["r"] + 2_000_000, 7)))
        return F.when(american, _refill(m, F.concat(code, nanp))).when(F.length(d).between(8, 15) & (F.length(n) >= 4), _refill(m, F.concat(code, _permuted_digits("phone", n, key, restore))))

    return _let(_digits(m), body)


def _email(m: Column, key: str, restore: bool) -> Column:
    return F.lit(None).cast("string") if restore else F.concat(F.lit("user-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 32), F.lit("@example.invalid"))


_WRITERS = {"email": _email, "iban": _iban, "ssn": _ssn, "date": _date, "ip": _ip, "phone": _phone}


def _named(kind: str):
    return lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def _count(found: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(found, lambda p: p["kind"] == kind)), F.lit(0)).cast("long")


def _pseudonym(m: Column, key: str, restore: bool) -> Column:
    """struct(kind, value, n) of a match; where no kind validates it, kind is null and n card numbers in it are replaced."""
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for kind, shape in reversed(KINDS.items()):
        new = _let(_WRITERS[kind](m, key, restore), _named(kind))
        out = F.coalesce(F.when(m.rlike(f"^(?:{shape})$"), new), out)
    cards = _let(_carded(m, key, restore), lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x["s"].alias("value"), x["n"].alias("n")))
    return _let(out, lambda o: F.when(o.isNull(), cards).otherwise(F.struct(o["kind"].alias("kind"), o["value"].alias("value"), F.lit(0).alias("n"))))


def pseudonymise(documents: DataFrame, key: str = KEY, restore: bool = False) -> DataFrame:
    """``documents`` with pseudonyms in text, and n_pii: a map of how many values of each kind were replaced."""
    t = F.col("text")
    some = F.coalesce(t.rlike("[0-9@]"), F.lit(False))
    found = documents.withColumn("_matches", F.when(some, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    found = found.withColumn("_new", F.transform("_matches", lambda m: _pseudonym(m, key, restore)))
    found = found.withColumn("_gaps", F.when(some, F.transform(F.split("text", PATTERN, -1), lambda g: _carded(g, key, restore))))
    woven = F.concat_ws("", F.zip_with("_gaps", "_new", lambda g, p: F.concat(g["s"], F.coalesce(p["value"], F.lit("")))))
    cards = F.aggregate(F.concat(F.transform("_gaps", lambda g: g["n"]), F.transform("_new", lambda p: p["n"])), F.lit(0).cast("long"), lambda n, x: n + x)
    counts = [*(F.when(some, _count(F.col("_new"), k)) for k in KINDS), cards]
    kinds = F.map_from_arrays(F.array(*map(F.lit, [*KINDS, CARD])), F.array(*(F.coalesce(c, F.lit(0).cast("long")) for c in counts)))
    return found.withColumns({"text": F.when(some, woven).otherwise(t), "n_pii": kinds}).drop("_matches", "_new", "_gaps")


def scrub(documents: DataFrame, key: str = KEY) -> DataFrame:
    """``documents`` with pseudonyms in text; n_chars follows the text and other columns stay."""
    new = pseudonymise(documents, key)
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*documents.columns) if "n_chars" in documents.columns else new.select(*documents.columns)


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return new.select("doc_id", "text", *(F.col("n_pii")[k].alias(f"n_{k}") for k in [*KINDS, CARD]))
