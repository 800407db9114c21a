"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

One pattern finds the candidates in a whole text; each is validated (card numbers
by the Luhn test, account numbers by mod 97, addresses by octets, social security
numbers by their ranges, dates by the calendar; telephone numbers have no check
digits, so any number of that shape is one) and its payload is permuted inside its
own format:

* character payloads (digits; letters and digits of mail names, accounts and keys) by an
  alternating Feistel network over the two halves of the string, each character
  shifted in its own class (0-9, a-z, A-Z) by keyed hash digits;
* four-part network addresses as 8 hex digits, in the same way;
* dates as day numbers by a Feistel network over a 271 x 270 grid, repeated
  while outside 1900..2099 (cycle walking); social security numbers are walked too,
  until they lie in the issued ranges.

A date with separators is read day first, and month first where that is no date; the
latter are walked to days above 12, so that they are read in the same way again.

Check digits are computed anew, separators stay, and the network depends only on
key, kind and payload: equal values stay linked across documents, whatever their
separators.  With the key ``reveal`` restores the text.

The key is never a constant of the query, whose text is shown and logged: it comes in by
a scalar subquery over a table of one row.

Only DataFrame and SQL functions.  Defined results: null stays null; texts
without a valid value are unchanged, byte for byte; candidates that fail their
test stay; texts of any length are processed whole; equal texts, and so repeated rows,
get equal results; ids aren't looked at; an empty table stays empty; other columns are
kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the kinds, most specific first.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9./])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])(?:[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{6}\2[0-9]{5}))(?![0-9])"
CLOUD_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?<=(?:password|token|secret|api_key) ?[=:] ?\x22?)[A-Za-z0-9]{12,128}(?![A-Za-z0-9])"
KINDS = {"email": EMAIL, "ipv4": IPV4, "iban": IBAN, "iso_date": ISO_DATE, "day_date": DAY_DATE, "ssn": SSN, "phone": PHONE, "card": CARD, "cloud_key": CLOUD_KEY, "secret": SECRET}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31, and the sides of the grid that holds them.
FIRST_DAY, DAYS, GRID_A, GRID_B = -25567, 73049, 271, 270
WALKS, LONG_WALKS = 16, 64


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _shift(target: str, other: str, i: str, key: str, kind: str, sign: int, alphabet: str | None = None) -> str:
    """SQL: each character of ``target`` moved within its class by hash digits of key, kind, round and ``other``."""
    digest = f"sha2(concat_ws('|', {key}, {_quoted(kind)}, {i}, length({target}), {other}), 256)"
    step = f"{sign} * cast(conv(substr(h, 1 + 3 * ((p - 1) % 21), 3), 16, 10) as int)"
    c = f"substr({target}, p, 1)"
    if alphabet:
        moved = f"substr('{alphabet}', 1 + pmod(instr('{alphabet}', {c}) - 1 + {step}, {len(alphabet)}), 1)"
    else:
        moved = f"""case when {c} between '0' and '9' then chr(48 + pmod(ascii({c}) - 48 + {step}, 10))
          when {c} between 'a' and 'z' then chr(97 + pmod(ascii({c}) - 97 + {step}, 26))
          when {c} between 'A' and 'Z' then chr(65 + pmod(ascii({c}) - 65 + {step}, 26)) else {c} end"""
    # the digest is bound once per half
    return f"""case when length({target}) = 0 then '' else element_at(transform(array({digest}),
      h -> array_join(transform(sequence(1, length({target})), p -> {moved}), '')), 1) end"""


def permuted(payload: str, key: str, kind: str, forward: bool = True, alphabet: str | None = None) -> str:
    """SQL: the payload under the keyed Feistel network, or under its inverse."""
    half = f"cast(length({payload}) / 2 as int)"
    start = f"named_struct('l', substr({payload}, 1, {half}), 'r', substr({payload}, 1 + {half}))"
    order = f"sequence(0, {ROUNDS - 1})" if forward else f"sequence({ROUNDS - 1}, 0, -1)"
    sign = 1 if forward else -1
    left, right = _shift("s.l", "s.r", "i", key, kind, sign, alphabet), _shift("s.r", "s.l", "i", key, kind, sign, alphabet)
    step = f"if(i % 2 = 0, named_struct('l', {left}, 'r', s.r), named_struct('l', s.l, 'r', {right}))"
    return f"aggregate({order}, {start}, (s, i) -> {step}, s -> concat(s.l, s.r))"


def _day_permuted(day: str, key: str, kind: str, forward: bool, late: bool = False) -> str:
    """SQL: day number since 1900-01-01 to another one, inside the 200 years (with ``late`` also after the 12th of a month)."""
    sign = 1 if forward else -1
    order = f"sequence(0, {ROUNDS - 1})" if forward else f"sequence({ROUNDS - 1}, 0, -1)"
    f = lambda side: f"{sign} * cast(conv(substr(sha2(concat_ws('|', {key}, {_quoted(kind)}, i, {side}), 256), 1, 12), 16, 10) as bigint)"
    step = f"""if(i % 2 = 0, named_struct('a', pmod(s.a + {f('s.b')}, {GRID_A}L), 'b', s.b),
               named_struct('a', s.a, 'b', pmod(s.b + {f('s.a')}, {GRID_B}L)))"""
    once = f"aggregate({order}, named_struct('a', cast(x div {GRID_B} as bigint), 'b', cast(x % {GRID_B} as bigint)), (s, i) -> {step}, s -> s.a * {GRID_B} + s.b)"
    there = f"x < {DAYS}" + (f" and day(date_from_unix_date(cast(x as int) + {FIRST_DAY})) > 12" if late else "")
    return f"aggregate(sequence(1, {LONG_WALKS if late else WALKS}), cast({day} as bigint), (x, w) -> if(w > 1 and {there}, x, {once}))"


def issued(ssn: str) -> str:
    """SQL: whether nine digits can be a social security number."""
    return f"(substr({ssn}, 1, 3) not in ('000', '666') and {ssn} < '9' and substr({ssn}, 4, 2) <> '00' and substr({ssn}, 6, 4) <> '0000')"


def _refilled(token: str, digits: str, pattern: str = "0-9") -> str:
    """SQL: ``token`` with its digits taken from ``digits`` in turn, all else in place."""
    return f"""array_join(transform(sequence(1, length({token})), q -> if(substr({token}, q, 1) rlike '[{pattern}]',
      substr({digits}, length(regexp_replace(substr({token}, 1, q), '[^{pattern}]', '')), 1), substr({token}, q, 1))), '')"""


def _luhn_digit(body: str) -> str:
    """SQL: the digit that completes ``body`` to a number that passes the Luhn test."""
    return f"""cast(pmod(10 - aggregate(sequence(1, length({body})), 0, (a, q) -> a + if((length({body}) - q) % 2 = 0,
      2 * cast(substr({body}, q, 1) as int) - if(substr({body}, q, 1) >= '5', 9, 0), cast(substr({body}, q, 1) as int))) % 10, 10) as string)"""


def _mod97(text: str) -> str:
    """SQL: the remainder by 97 of digits and letters, a letter being two digits from 10 on."""
    return f"""aggregate(split({text}, ''), 0, (m, c) -> case when c between '0' and '9' then (m * 10 + ascii(c) - 48) % 97 when c between 'A' and 'Z' then (m * 100 + ascii(c) - 55) % 97 else m end)"""


def _bind(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def pseudonym(token: str, key: str, forward: bool = True) -> str:
    """SQL: the pseudonym of a candidate; the candidate itself if it fails its test."""
    whole = lambda kind: _quoted(f"^(?:{KINDS[kind]})$")
    p = lambda s, kind, alphabet=None: permuted(s, key, kind, forward, alphabet)
    email = f"concat({p(f'substring_index({token}, {_quoted(chr(64))}, 1)', 'email')}, '@', substring_index({token}, '@', -1))"
    octets = f"transform(split({token}, '[.]'), o -> cast(o as int))"
    as_hex = f"array_join(transform({octets}, o -> lower(lpad(hex(o), 2, '0'))), '')"
    from_hex = f"array_join(transform(sequence(0, 3), o -> cast(cast(conv(substr(y, 1 + 2 * o, 2), 16, 10) as int) as string)), '.')"
    ipv4 = _bind(p("x0", "ipv4", "0123456789abcdef"), "y", from_hex)
    ipv4 = _bind(as_hex, "x0", ipv4)
    canonical_octets = f"array_join(transform({octets}, o -> cast(o as string)), '.') = {token}"
    country = f"substr({token}, 1, 2)"
    plain = f"regexp_replace({token}, '[^0-9A-Z]', '')"
    check = f"lpad(cast(98 - {_mod97(f'concat(y, {country}, {_quoted(chr(48) * 2)})')} as string), 2, '0')"
    iban = _bind(f"substr({plain}, 5)", "x0", _bind(p("x0", "iban"), "y", _refilled(token, f"concat({country}, {check}, y)", "0-9A-Z")))
    iban_ok = f"length({plain}) between 15 and 34 and {_mod97(f'concat(substr({plain}, 5), substr({plain}, 1, 4))')} = 1"
    day = lambda d: f"(unix_date({d}) - {FIRST_DAY})"
    iso = f"try_to_date({token}, 'yyyy-MM-dd')"
    iso_new = f"cast(date_from_unix_date(cast({_day_permuted(day(iso), key, 'date', forward)} as int) + {FIRST_DAY}) as string)"
    dmy = f"try_to_date(concat(substr({token}, 7, 4), '-', substr({token}, 4, 2), '-', substr({token}, 1, 2)), 'yyyy-MM-dd')"
    dmy_new = _bind(
        f"date_from_unix_date(cast({_day_permuted(day(dmy), key, 'date', forward)} as int) + {FIRST_DAY})",
        "d",
        f"concat(lpad(day(d), 2, '0'), substr({token}, 3, 1), lpad(month(d), 2, '0'), substr({token}, 3, 1), lpad(year(d), 4, '0'))",
    )
    mdy = f"try_to_date(concat(substr({token}, 7, 4), '-', substr({token}, 1, 2), '-', substr({token}, 4, 2)), 'yyyy-MM-dd')"
    mdy_new = _bind(
        f"date_from_unix_date(cast({_day_permuted(day(mdy), key, 'late date', forward, late=True)} as int) + {FIRST_DAY})",
        "d",
        f"concat(lpad(month(d), 2, '0'), substr({token}, 3, 1), lpad(day(d), 2, '0'), substr({token}, 3, 1), lpad(year(d), 4, '0'))",
    )
    in_years = lambda d: f"{d} between date'1900-01-01' and date'2099-12-31'"
    walked = f"aggregate(sequence(1, {WALKS}), x0, (x, w) -> if(w > 1 and {issued('x')}, x, {p('x', 'ssn')}))"
    ssn_new = _bind(_digits(token), "x0", f"if({issued('x0')}, {_bind(walked, 'y', _refilled(token, 'y'))}, {token})")
    tail = f"right({_digits(token)}, 10)"
    phone = _bind(tail, "x0", _bind(p("x0", "phone"), "y", _refilled(token, f"concat(substr({_digits(token)}, 1, length({_digits(token)}) - 10), y)")))
    head = f"left({_digits(token)}, length({_digits(token)}) - 1)"
    card = _bind(head, "x0", _bind(p("x0", "card"), "y", _refilled(token, f"concat(y, {_luhn_digit('y')})")))
    return f"""case
      when {token} rlike {whole('email')} then {email}
      when {token} rlike {whole('ipv4')} then if(forall({octets}, o -> o <= 255) and {canonical_octets}, {ipv4}, {token})
      when {token} rlike {whole('iban')} then if({iban_ok}, {iban}, {token})
      when {token} rlike {whole('iso_date')} then if({in_years(iso)}, {iso_new}, {token})
      when {token} rlike {whole('day_date')} then case when {in_years(dmy)} then {dmy_new} when {dmy} is null and {in_years(mdy)} then {mdy_new} else {token} end
      when {token} rlike {whole('ssn')} then {ssn_new}
      when {token} rlike {whole('phone')} then {phone}
      when {token} rlike '^[0-9](?:[ -]?[0-9]){{12,18}}$' then if(luhn_check({_digits(token)}), {card}, {token})
      when {token} rlike '^AKIA[A-Z0-9]{{16}}$' then concat('AKIA', {p(f'substr({token}, 5)', 'cloud_key')})
      when {token} rlike '^[0-9a-f]+$' then {p(token, 'secret', '0123456789abcdef')}
      else {p(token, 'secret')} end"""


def _rewritten(text: str, key: str, forward: bool) -> Column:
    found = f"regexp_extract_all({text}, {_quoted(ANY)}, 0)"
    between = f"split({text}, {_quoted(ANY)}, -1)"
    new = f"transform({found}, t -> {pseudonym('t', key, forward)})"
    return F.expr(f"array_join(zip_with({between}, {new}, (a, b) -> concat(a, coalesce(b, ''))), '')")


def _changed(docs: DataFrame, text: str, key: str, forward: bool) -> DataFrame:
    """A text without a digit or an at sign can't hold a candidate, and one without a candidate is passed through."""
    name = "pii_key"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    held = docs.sparkSession.createDataFrame([(key,)], "k string").scalar()
    new = _rewritten(f"`{text}`", f"`{name}`", forward)
    col = F.col(f"`{text}`")
    keyed = docs.select("*", held.alias(name))
    return keyed.withColumn(text, F.when(col.rlike("[0-9@]|(?:password|token|secret|api_key) ?[=:]") & col.rlike(ANY), new).otherwise(col)).drop(name)


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the values in ``text`` replaced by their pseudonyms."""
    return _changed(docs, text, key, True)


def reveal(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Inverse of ``pseudonymize`` for texts that it made, given the key."""
    return _changed(docs, text, key, False)
