"""Personal data replaced by format-preserving Feistel pseudonyms; SQL expressions only.

Found and validated: e-mail addresses, payment cards (Luhn), IBANs (mod 97),
IPv4 addresses, calendar dates of 1700-2099, phone numbers, and social security
numbers.  Each value is permuted with a key inside its own format:

* digits stay digits and letters stay letters of their case, in place; the two
  halves of the value shift each other's characters by keyed hashes;
* a card keeps its first digit and gets a right check digit, an IBAN keeps its
  country and gets right check digits, a phone its country code, an e-mail its
  domain;
* an address or date is a number below 2**32 or 189 * 773 (the days of 400
  years, exactly), permuted with moduli, so the result is again valid.

As these are permutations, equal values get equal pseudonyms in all documents
and different values different ones.  What does not validate stays as it is.

Cases: a null text stays null with no finding; texts without findings are
returned unchanged; values are found wherever they stand, in texts of any
length, the leftmost first; an IBAN has the length of its country, whatever
follows it, and an e-mail begins at its first letter or digit; repeated rows get the same answer; an empty table
gives an empty result; other columns are passed on by ``pseudonymize``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table

KEY = "codeloom"
ROUNDS = 4
_DAYS_A, _DAYS_B = 189, 773
_FIRST_DAY = "date'1700-01-01'"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_YEAR, _MONTH, _DAY = r"(?:1[7-9]\d\d|20\d\d)", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
#: Length of an IBAN, and the countries that have it.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_NO_MORE = r"(?![\d]|[.,/-]\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9][A-Za-z0-9-]{0,62})+",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}\d\d)(?:"
    + "|".join(rf"(?:{c.replace(' ', '|')})\d\d(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBANS.items())
    + r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    "date": "|".join(
        rf"(?<![\d./-])(?:{_YEAR}{s}{_MONTH}{s}{_DAY}|(?:{_MONTH}{s}{_DAY}|{_DAY}{s}{_MONTH}){s}{_YEAR}){_NO_MORE}" for s in ("-", "/", r"\.")
    ),
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w+.-])(?:\+?1[ .-])?\d{3}([.-])\d{3}[.-]\d{4}(?!\d|[.-]\d)"
    r"|(?<![\w+])\+\d{1,3}(?:[ -]?\(\d{1,4}\))?(?:[ -]?\d{2,4}){2,4}(?!\d|\.\d)",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)",
}
PATTERNS["phone"] = PATTERNS["phone"].replace("([.-])", "[.-]")
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


#: A value before its check digits are known.
ZEROS, LAST = "concat(y, substr(c, 1, 2), '00')", "concat(y, '0')"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _shift(c: str, k: str) -> str:
    def turn(low: int, size: int) -> str:
        return f"chr({low} + (ascii({c}) - {low} + {k}) % {size})"

    return f"case when {c} between '0' and '9' then {turn(48, 10)} when {c} between 'a' and 'z' then {turn(97, 26)} when {c} between 'A' and 'Z' then {turn(65, 26)} else {c} end"


def sql_characters(x: str, key: str) -> str:
    """SQL: the characters of ``x`` permuted within their classes; ``x`` has 1 or more."""
    stream = f"sha2(concat({_quoted(key)}, ':', r, ':', s.b), 512)"
    char, byte = "substr(s.a, i, 1)", "cast(conv(substr(z, 2 * ((i - 1) % 64) + 1, 2), 16, 10) as int)"
    moved = f"if(s.a = '', '', array_join(transform(array({stream}), z -> array_join(transform(sequence(1, length(s.a)), i -> {_shift(char, byte)}), '')), ''))"
    start = f"named_struct('a', substr({x}, 1, length({x}) div 2), 'b', substr({x}, length({x}) div 2 + 1))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> named_struct('a', s.b, 'b', {moved}), s -> concat(s.a, s.b))"


def sql_number(n: str, a: int, b: int, key: str) -> str:
    """SQL: the number ``n`` below a * b permuted."""

    def f(tag: str, v: str) -> str:
        return f"cast(conv(substr(md5(concat({_quoted(key)}, ':', r, '{tag}', {v})), 1, 12), 16, 10) as bigint)"

    left = f"(s.a + {f('a', 's.b')}) % {a}"
    both = f"transform(array({left}), v -> named_struct('a', v, 'b', (s.b + {f('b', 'v')}) % {b}))[0]"
    start = f"named_struct('a', cast({n} as bigint) div {b}, 'b', cast({n} as bigint) % {b})"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {both}, s -> s.a * {b} + s.b)"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _refill(x: str, digits: str) -> str:
    """SQL: the digits of ``x`` replaced by ``digits`` in turn."""
    put = "if(substr(m, i, 1) between '0' and '9', substr(d, length(regexp_replace(substr(m, 1, i), '[^0-9]', '')), 1), substr(m, i, 1))"
    inner = f"array_join(transform(sequence(1, length(m)), i -> {put}), '')"
    return f"array_join(zip_with(array({x}), array({digits}), (m, d) -> {inner}), '')"


def sql_luhn(d: str) -> str:
    """SQL: the Luhn sum of the digits ``d`` modulo 10, the last digit not doubled."""
    digit = f"cast(substr({d}, length({d}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, i) -> t + if(i % 2 = 0, {digit}, {digit} * 2 - if({digit} > 4, 9, 0))) % 10"


def sql_mod97(x: str) -> str:
    """SQL: upper-case letters count as 10..35, the whole number modulo 97."""
    c = f"substr({x}, i, 1)"
    return f"aggregate(sequence(1, length({x})), 0, (t, i) -> if({c} between '0' and '9', (t * 10 + ascii({c}) - 48) % 97, (t * 100 + ascii({c}) - 55) % 97))"


def _with(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sql_pseudonym(x: str, key: str = KEY) -> str:
    """SQL: the pseudonym of the found value ``x``, or ``x`` itself where it does not validate."""
    email = _with(f"substring_index({x}, '@', 1)", "u", f"concat({sql_characters('u', key + 'email')}, substr({x}, length(u) + 1))")

    octets = f"split({x}, '[.]')"
    number = f"aggregate({octets}, cast(0 as bigint), (t, o) -> t * 256 + cast(o as int))"
    ip = _with(sql_number(number, 65536, 65536, key + "ip"), "v", "concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256)")

    separator = f"regexp_extract({x}, '[-/.]', 0)"
    parts = f"split({x}, '[-/.]')"
    order = f"case when length({parts}[0]) = 4 then array(0, 1, 2) when {separator} = '.' or cast({parts}[0] as int) > 12 then if(cast({parts}[1] as int) > 12, array(2, 0, 1), array(2, 1, 0)) when cast({parts}[1] as int) > 12 or {separator} <> '.' then array(2, 0, 1) end"

    def pad(k: str) -> str:
        return f"if(p[{k}] like '0%' or length(p[{k}]) = 2, 2, 1)"

    new = "array(cast(year(n) as string), cast(month(n) as string), cast(day(n) as string))"
    field = "if(i = o[0], v[0], if(i = o[1], lpad(v[1], if(w[1] > length(v[1]), w[1], length(v[1])), '0'), lpad(v[2], if(w[2] > length(v[2]), w[2], length(v[2])), '0')))"
    written = _with(new, "v", _with(f"array(4, {pad('o[1]')}, {pad('o[2]')})", "w", f"array_join(transform(array(0, 1, 2), i -> {field}), {separator})"))
    given = "try_to_date(concat_ws('-', p[o[0]], p[o[1]], p[o[2]]), 'y-M-d')"
    moved = f"date_add({_FIRST_DAY}, cast({sql_number(f'datediff(g, {_FIRST_DAY})', _DAYS_A, _DAYS_B, key + 'date')} as int))"
    date = _with(parts, "p", _with(order, "o", _with(given, "g", f"if(g is null, {x}, {_with(moved, 'n', written)})")))

    bare = f"replace({x}, ' ', '')"
    check = _with(f"98 - {sql_mod97(ZEROS)}", "k", "concat(substr(c, 1, 2), lpad(cast(k as string), 2, '0'), y)")
    iban_new = _with(sql_characters("substr(c, 5)", key + "iban"), "y", check)
    spaced = f"array_join(transform(sequence(1, length({x})), i -> if(substr({x}, i, 1) = ' ', ' ', substr(q, length(replace(substr({x}, 1, i), ' ', '')), 1))), '')"
    iban = _with(bare, "c", f"if({sql_mod97('concat(substr(c, 5), substr(c, 1, 4))')} = 1, {_with(iban_new, 'q', spaced)}, {x})")

    code = f"if({x} like '+%', length({_digits(f'regexp_extract({x}, {_quoted(chr(92) + '+' + chr(92) + 'd{1,3}')}, 0)')}), 0)"
    phone = _with(
        _digits(x), "e", _with(code, "k", _refill(x, f"concat(substr(e, 1, k), {sql_characters('substr(e, k + 1)', key + 'phone')})"))
    )

    ssn = _refill(x, sql_characters(_digits(x), key + "ssn"))

    inner = sql_characters("substr(e, 2, length(e) - 2)", key + "card")
    fresh = _with(
        f"concat(substr(e, 1, 1), {inner})", "y", f"concat(y, cast((10 - {sql_luhn(LAST)}) % 10 as string))"
    )
    card = _with(_digits(x), "e", f"if({sql_luhn('e')} = 0, {_refill(x, fresh)}, {x})")

    whole = {k: _quoted(f"^(?:{p})$") for k, p in PATTERNS.items()}
    cases = {"ip": ip, "date": date, "iban": iban, "ssn": ssn, "card": card, "phone": phone}
    chain = " ".join(f"when {x} rlike {whole[k]} then {v}" for k, v in cases.items())
    return f"case when contains({x}, '@') then {email} {chain} else {x} end"


def pseudonymize(docs: DataFrame, key: str = KEY, count: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; ``count`` names a column for their number.

    A map without exchange.  n_chars, if there, follows the text.
    """
    quick = "coalesce(text, '') rlike '[0-9]{2}|@|([0-9][.]){3}[0-9]'"
    found = f"if({quick}, regexp_extract_all(text, {_quoted(ANY)}, 0), array())"
    old, new = spare(docs, "found", "new")
    out = docs.withColumn(old, F.expr(found)).withColumn(new, F.expr(f"transform({old}, x -> {sql_pseudonym('x', key)})"))
    joined = f"array_join(zip_with(split(text, {_quoted(ANY)}, -1), concat({new}, array('')), (l, m) -> concat(l, m)), '')"
    out = out.withColumn("text", F.expr(f"if(size({old}) = 0, text, {joined})"))
    names = list(docs.columns)
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.expr(f"if(size({old}) = 0, n_chars, cast(length(text) as {kind}))"))
    if count:
        out = out.withColumn(count, F.expr(f"cast(size(filter(zip_with({old}, {new}, (o, n) -> o <> n), x -> x)) as bigint)"))
        names.append(count)
    return out.select(*names)


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, count="n_replaced")
