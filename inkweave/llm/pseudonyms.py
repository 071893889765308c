"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Numbers that pass their own check (card and account numbers by their check digits, addresses by their octets, dates by
the calendar, telephone numbers by their length) and other identifiers of a fixed shape are permuted by a keyed Feistel network within their format: digits stay digits
and letters letters, a card number stays a valid card number, a date a date. A permutation is one to one, so equal values
get equal pseudonyms in all documents and different values different ones, without a table of values. Credentials have no
use to anybody and become a keyed mark. A document is changed where something was found and nowhere else; the work is one
narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is looked for, in order of precedence. Repeats are bounded or begin at a boundary, so that a search takes time in
# proportion to the text however long its runs are.
# The countries whose accounts have an IBAN.
_COUNTRIES = (
    "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|BY|CH|CR|CY|CZ|DE|DK|DO|EE|EG|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|JO|KW|KZ|LB|LC|LI|LT|LU|LV|"
    "LY|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SC|SD|SE|SI|SK|SM|ST|SV|TL|TN|TR|UA|VA|VG|XK"
)
_BEFORE, _AFTER = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
PATTERNS = {
    "credential": _BEFORE + r"AKIA[0-9A-Z]{16}" + _AFTER
    + r"|(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}(?:\"[^\"\s]{6,256}\"|[^\"\s]{6,256})",
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+@(?:[\p{L}0-9-]{1,63}\.){1,8}\p{L}{2,24}(?!\p{L})",
    "iban": _BEFORE + f"(?:{_COUNTRIES})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?" + _AFTER,
    "date": r"(?<![0-9A-Za-z/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-])",
    "card": _BEFORE + "(?:" + "|".join(
        f"[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{1,7}}|[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{5}}" for s in " -"
    ) + "|[0-9]{13,19})" + _AFTER,
    "social": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "address6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _AFTER,
    "abroad": r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,12}\)?){1,6}" + _AFTER,
    "national": r"(?<![0-9A-Za-z+])(?<![0-9][ .-])0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})(?![0-9A-Za-z])(?![ .-][0-9])",
    "address": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z])(?!\.[0-9])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8
_FIRST_DAY, _DAYS = "1800-01-01", (627, 233)  # 400 years are 146097 = 627 * 233 days


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _permuted(value: str, key: str, kind: str) -> str:
    """SQL: a string's letters and digits permuted within their kinds. Case is kept, and takes no part in the choice."""
    half = f"(char_length({value}) div 2)"
    step = "cast(conv(substring(k, 1 + 2 * (i % 32), 2), 16, 10) as int)"

    def moved(first: int, last: int, size: int) -> str:
        if kind == "address6":  # hexadecimal digits, in lower case
            digit = f"(instr('0123456789abcdef', lower(c)) - 1)"
            return f"when lower(c) between '0' and '9' or lower(c) between 'a' and 'f' then substring('0123456789abcdef', ({digit} + {step}) % 16 + 1, 1)"
        return f"when ascii(c) between {first} and {last} then chr({first} + (ascii(c) - {first} + {step}) % {size})"

    def shifted(side: str, other: str) -> str:
        drawn = f"sha2(concat({_q(key)}, ':{kind}:', r, ':', lower({other})), 256)"
        chars = f"split({side}, '')"
        # the drawn key travels as a one-element array, so that it is drawn once and not for every character
        cases = f"case {moved(48, 57, 10)} {moved(97, 122, 26)} {moved(65, 90, 26)} else c end"
        return f"transform(array({drawn}), k -> array_join(transform({chars}, (c, i) -> {cases}), ''))[0]"

    turn = (
        f"if(r % 2 = 0, named_struct('a', {shifted('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {shifted('s.b', 's.a')}))"
    )
    start = f"named_struct('a', substring({value}, 1, {half}), 'b', substring({value}, {half} + 1))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, r) -> {turn}, s -> concat(s.a, s.b))"


def _permuted_pair(a: str, b: str, sizes: tuple[int, int], key: str, kind: str, done: str) -> str:
    """SQL: the number pair (a, b) permuted among all pairs of these sizes; ``done`` reads it as s.a and s.b."""

    def drawn(other: str) -> str:
        return f"cast(conv(substring(sha2(concat({_q(key)}, ':{kind}:', r, ':', {other}), 256), 1, 15), 16, 10) as bigint)"

    turn = (
        f"if(r % 2 = 0, named_struct('a', (s.a + {drawn('s.b')}) % {sizes[0]}, 'b', s.b),"
        f" named_struct('a', s.a, 'b', (s.b + {drawn('s.a')}) % {sizes[1]}))"
    )
    start = f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, r) -> {turn}, s -> {done})"


def _luhn(digits: str, first: int) -> str:
    """SQL: the check sum of digits; every second one counts double, from the right, the last one if ``first`` is 1."""
    one = "cast(c as int)"
    return (
        f"aggregate(transform(reverse(filter(split({digits}, ''), c -> c <> '')), (c, i) ->"
        f" if(i % 2 = {1 - first}, if({one} > 4, 2 * {one} - 9, 2 * {one}), {one})), 0, (t, x) -> t + x)"
    )


def _refilled(value: str, digits: str) -> str:
    """SQL: the value with its digits replaced in order."""
    turn = (
        f"if(c between '0' and '9', named_struct('out', concat(s.out, substring(d, s.k, 1)), 'k', s.k + 1),"
        " named_struct('out', concat(s.out, c), 'k', s.k))"
    )
    return (
        f"transform(array({digits}), d -> aggregate(filter(split({value}, ''), c -> c <> ''),"
        f" named_struct('out', '', 'k', 1), (s, c) -> {turn}, s -> s.out))[0]"
    )


def _respaced(value: str, marks: str) -> str:
    """SQL: the value with its characters other than spaces replaced in order."""
    turn = "if(c = ' ', named_struct('out', concat(s.out, c), 'k', s.k), named_struct('out', concat(s.out, substring(d, s.k, 1)), 'k', s.k + 1))"
    return (
        f"transform(array({marks}), d -> aggregate(filter(split({value}, ''), c -> c <> ''),"
        f" named_struct('out', '', 'k', 1), (s, c) -> {turn}, s -> s.out))[0]"
    )


def _account_check(account: str, country: str) -> str:
    """SQL: the two check digits of an account in a country: 98 less the remainder by 97 of all, letters being 10 to 35."""
    number = f"array_join(transform(filter(split(concat({account}, {country}, '00'), ''), c -> c <> ''), c -> if(c between '0' and '9', c, ascii(c) - 55)), '')"
    rest = f"aggregate(filter(split({number}, ''), c -> c <> ''), 0, (t, c) -> (t * 10 + cast(c as int)) % 97)"
    return f"lpad(98 - {rest}, 2, '0')"


def _pseudonym(m: str, key: str) -> str:
    """SQL: the pseudonym of a match, or the match itself if it fails its own check."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    is_a = {kind: f"{m} rlike {_q('^(?:' + p + ')$')}" for kind, p in PATTERNS.items()}
    body = f"substring({digits}, 1, char_length({digits}) - 1)"
    new_body = _permuted("b", key, "card")
    card = f"transform(array({body}), b -> transform(array({new_body}), n -> concat(n, (10 - {_luhn('n', 1)} % 10) % 10))[0])[0]"
    national = _permuted("n", key, "phone")
    phone = (
        f"transform(array({digits}), p -> concat(substring(p, 1, char_length(p) - 10),"
        f" transform(array(right(p, 10)), n -> {national})[0]))[0]"
    )
    # the country's number, or what stands for it, is the first two digits; the rest is permuted
    abroad = f"transform(array({digits}), p -> concat(left(p, 2), transform(array(substring(p, 3)), n -> {_permuted('n', key, 'abroad')})[0]))[0]"
    plain = f"replace({m}, ' ', '')"
    country, check, account = f"left({plain}, 2)", f"substring({plain}, 3, 2)", f"substring({plain}, 5)"
    valid = f"char_length({plain}) between 15 and 34 and {check} = {_account_check(account, country)}"
    moved = f"transform(array({account}), n -> {_permuted('n', key, 'iban')})[0]"
    iban = f"transform(array({moved}), b -> concat({country}, {_account_check('b', country)}, b))[0]"
    address6 = f"transform(array({m}), n -> {_permuted('n', key, 'address6')})[0]"
    groups = f"char_length(regexp_replace({m}, '[^:]', ''))"
    octets = f"transform(split({m}, '[.]'), x -> cast(x as int))"
    address = (
        f"transform(array({octets}), o -> "
        + _permuted_pair(
            "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", (65536, 65536), key, "address",
            "concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256)",
        )
        + ")[0]"
    )
    shape = f"if({m} like '%/%', 'MM/dd/yyyy', 'yyyy-MM-dd')"
    day = f"datediff(try_to_timestamp({m}, {shape}), date'{_FIRST_DAY}')"
    date = (
        f"transform(array({day}), t -> "
        + _permuted_pair(
            f"t div {_DAYS[1]}", f"t % {_DAYS[1]}", _DAYS, key, "date",
            f"date_format(date_add(date'{_FIRST_DAY}', cast(s.a * {_DAYS[1]} + s.b as int)), {shape})",
        )
        + ")[0]"
    )
    local = f"substring_index({m}, '@', 1)"
    email = f"concat(transform(array({local}), n -> {_permuted('n', key, 'email')})[0], '@', substring_index({m}, '@', -1))"
    social = f"transform(array({digits}), n -> {_permuted('n', key, 'social')})[0]"
    secret = f"regexp_replace({m}, '^.*?[=:][ \\\\t]*', '')"
    label = f"substring({m}, 1, char_length({m}) - char_length({secret}))"
    marked = f"concat({label}, '[credential:', substring(sha2(concat({_q(key)}, ':credential:', regexp_replace({secret}, '\"', '')), 256), 1, 16), ']')"
    return f"""case
        when {is_a['credential']} then {marked}
        when {is_a['email']} then {email}
        when {is_a['iban']} then if({valid}, {_respaced(m, iban)}, {m})
        when {is_a['date']} then if({day} between 0 and {_DAYS[0] * _DAYS[1] - 1}, {date}, {m})
        when {is_a['card']} then if({_luhn(digits, 0)} % 10 = 0, {_refilled(m, card)}, {m})
        when {is_a['social']} then if({m} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)', {_refilled(m, social)}, {m})
        when {is_a['address6']} then if({groups} between 3 and 7, {address6}, {m})
        when {is_a['phone']} then {_refilled(m, phone)}
        when {is_a['abroad']} then if(char_length({digits}) between 8 and 15, {_refilled(m, abroad)}, {m})
        when {is_a['national']} then {_refilled(m, abroad)}
        when {is_a['address']} then if(forall({octets}, x -> x <= 255), {address}, {m})
        else {m} end"""


def _kind(m: str) -> str:
    return "case " + " ".join(f"when {m} rlike {_q('^(?:' + p + ')$')} then '{k}'" for k, p in PATTERNS.items()) + " end"


def pseudonymise(documents: DataFrame, *, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """The same rows and columns, personal data in the text replaced; ``found_col`` adds an array of (kind, pseudonym).

    Looks for the kinds of PATTERNS; what fails its own check is left alone, so 16 digits that are no card number stay.
    ``key`` is the secret that the permutation depends on. Null texts stay null and empty texts empty, with nothing
    found. Repeated rows get the same result. All other columns, whatever their names, are handed through as they are;
    an empty table stays empty.
    """
    names = documents.columns
    text = F.col(f"`{text_col}`").cast("string")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text.alias("t"))
    # most texts hold nothing: what every kind begins with or holds is cheap to look for
    may = F.col("t").rlike(r"[0-9@]|::|AKIA|(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[ \t]{0,3}[=:]")
    rows = rows.withColumn("m", F.when(may, F.expr(f"regexp_extract_all(t, {_q(_ANY)}, 0)")))
    rows = rows.withColumn("p", F.when(F.size("m") > 0, F.expr(f"transform(m, x -> named_struct('old', x, 'kind', {_kind('x')}, 'new', {_pseudonym('x', key)}))")))
    pieces = F.expr(f"split(t, {_q(_ANY)}, -1)")
    whole = F.expr("array_join(flatten(zip_with(pieces, p, (a, b) -> array(a, coalesce(b.new, '')))), '')")
    rows = rows.withColumn("pieces", F.when(F.col("p").isNotNull(), pieces))
    rows = rows.withColumn("new_text", F.when(F.col("p").isNotNull(), whole).otherwise(F.col("t")))
    found = F.expr("transform(filter(coalesce(p, array()), x -> x.old <> x.new), x -> named_struct('kind', x.kind, 'pseudonym', x.new))")
    columns = [(F.col("new_text") if c == text_col else F.col("row")[c]).alias(c) for c in names]
    extra: list[Column] = [found.alias(found_col)] if found_col else []
    return rows.select(*columns, *extra)
