"""Format-preserving Feistel pseudonyms for personal data, in SQL functions only.

Found and validated: payment cards (Luhn sum and a payment network's first digits, which stay), phone numbers, IPv4 addresses (octets), US social security numbers (area),
dates (calendar, 1900 to 2099), and, letter for letter, e-mail names, access keys and secrets in an assignment.  Each
is permuted within its own format by an 8-round keyed Feistel network over Z_a x Z_b (letters: over the halves of the
string), so a pseudonym is valid where its original was, and equal values stay equal in all documents.  What fails
validation stays as it is.

The key is the caller's; it reaches the plan as the value of a scalar sub-query over a local row, so neither EXPLAIN
nor the plan's description holds it.

Null text stays null with 0 found; empty text stays empty.  A null doc_id is kept.  Repeated rows yield repeated rows.
All columns are kept; the text is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare

ROUNDS = 8
#: The days from 1900-01-01 to 2099-12-31 are 229 * 319; valid areas and groups, and serials, of a SSN.
DAYS_A, DAYS_B, SSN_A, SSN_B = 229, 319, 898 * 99, 9999
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
SECRET = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\x22\x27]?[A-Za-z0-9_\-]{12,})"
BEFORE_SECRET = r"^.*[=:]\s*[\x22\x27]?(?=[A-Za-z0-9_-]{12,}$)"
NUMBER = "|".join((
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.]*\d)",
    r"\d{4}-\d{2}-\d{2}(?![\d-])",
    r"\d{2}/\d{2}/\d{4}(?![\d/])",
    r"\d{2}\.\d{2}\.\d{4}(?![\d.]*\d)",
    r"\d{3}-\d{2}-\d{4}(?![\d-])",
    r"\d{4} \d{4} \d{4} \d{4}(?!\d)",
    r"\d{4}-\d{4}-\d{4}-\d{4}(?!\d)",
    r"\d{4}[ -]\d{6}[ -]\d{5}(?!\d)",
    r"\d{13,19}(?!\d)",
    r"\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)",
    r"\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])",
    r"\d{3} \d{3} \d{4}(?!\d)",
))
#: The first digits of payment networks' cards.
NETWORK = r"^(?:3[04-9]|4|5|6|222[1-9]|22[3-9]|2[3-6]|27[01]|2720)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,5}(?:[ .-]?\d{3,5})?(?!\d)|(?<![\w+])\+\d{8,15}(?!\d)"
FOUND = f"{EMAIL}|{SECRET}|{PHONE}|(?<![\\w.-])(?:{NUMBER})"


def _q(s: str) -> str:
    """A raw SQL string literal."""
    return 'r"' + s.replace('"', r"\x22") + '"'


def _hash(key: str, tweak: str, i: str, x: str) -> str:
    return f"cast(conv(substr(sha2(concat({key}, '|{tweak}|', {i}, '|', {x}), 256), 1, 15), 16, 10) as bigint)"


def _permuted(left: str, right: str, a: str, b: str, key: str, tweak: str, finish: str) -> str:
    """SQL of `finish` (over s.l and s.r) once (left, right) in Z_a x Z_b is permuted."""
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> if(i % 2 = 1,"
        f" named_struct('l', (s.l + {_hash(key, tweak, 'i', 's.r')}) % cast({a} as bigint), 'r', s.r),"
        f" named_struct('l', s.l, 'r', (s.r + {_hash(key, tweak, 'i', 's.l')}) % cast({b} as bigint))), s -> {finish})"
    )


def _power(n: str) -> str:
    return f"cast(pow(10, {n}) as bigint)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _laid_out(m: str, digits: str) -> str:
    """The digits in the places of m's digits."""
    return (
        f"aggregate(split({m}, ''), named_struct('o', '', 'd', {digits}), (t, c) -> if(c between '0' and '9' and length(c) = 1,"
        f" named_struct('o', concat(t.o, substr(t.d, 1, 1)), 'd', substr(t.d, 2)), named_struct('o', concat(t.o, c), 'd', t.d)), t -> t.o)"
    )


def _luhn(d: str, double_last: int) -> str:
    """Sum of a digit string's Luhn terms; double_last: 1 if its last digit is doubled (a payload), 0 if not (a whole number)."""
    one = f"cast(substr({d}, length({d}) - j, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, j) -> t + if(j % 2 = {1 - double_last}, 2 * {one} - if({one} > 4, 9, 0), {one}))"


def _number(m: str, key: str, tweak: str, keep: str) -> str:
    """All digits of m after the first `keep` permuted."""
    d, n = _digits(m), f"(length({_digits(m)}) - {keep})"
    low = f"({n} div 2)"
    return _laid_out(m, f"concat(substr({d}, 1, {keep}), " + _permuted(f"substr({d}, {keep} + 1, {n} - {low})", f"substr({d}, {keep} + 1 + {n} - {low})", _power(f"{n} - {low}"), _power(low), key, tweak, f"concat(lpad(cast(s.l as string), {n} - {low}, '0'), lpad(cast(s.r as string), {low}, '0'))") + ")")


def _card(m: str, key: str) -> str:
    d, n = _digits(m), f"(length({_digits(m)}) - 5)"
    low = f"({n} div 2)"
    body = _permuted(f"substr({d}, 5, {n} - {low})", f"substr({d}, 5 + {n} - {low}, {low})", _power(f"{n} - {low}"), _power(low), key, "card", f"concat(substr({d}, 1, 4), lpad(cast(s.l as string), {n} - {low}, '0'), lpad(cast(s.r as string), {low}, '0'))")
    return _laid_out(m, f"element_at(transform(array({body}), b -> concat(b, cast(pmod(-{_luhn('b', 1)}, 10) as string))), 1)")


def _ip(m: str, key: str) -> str:
    part = [f"cast(split({m}, '[.]')[{k}] as bigint)" for k in range(4)]
    return _permuted(f"{part[0]} * 256 + {part[1]}", f"{part[2]} * 256 + {part[3]}", "65536", "65536", key, "ip", "concat_ws('.', cast(s.l div 256 as string), cast(s.l % 256 as string), cast(s.r div 256 as string), cast(s.r % 256 as string))")


def _ssn(m: str, key: str) -> str:
    area = f"(cast(substr({m}, 1, 3) as bigint) - if(cast(substr({m}, 1, 3) as int) > 666, 2, 1))"
    back = "s.l div 99 + if(s.l div 99 >= 665, 2, 1)"
    return _permuted(f"{area} * 99 + cast(substr({m}, 5, 2) as bigint) - 1", f"cast(substr({m}, 8, 4) as bigint) - 1", str(SSN_A), str(SSN_B), key, "ssn", f"concat(lpad(cast({back} as string), 3, '0'), '-', lpad(cast(s.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(s.r + 1 as string), 4, '0'))")


def _day(m: str) -> str:
    """The date that m spells, or null; with slashes the month comes first where it can."""
    return f"coalesce(try_to_date({m}, 'yyyy-MM-dd'), try_to_date({m}, 'MM/dd/yyyy'), try_to_date({m}, 'dd/MM/yyyy'), try_to_date({m}, 'dd.MM.yyyy'))"


def _date(m: str, key: str) -> str:
    n = f"datediff({_day(m)}, date'1900-01-01')"
    form = f"if(instr({m}, '-') > 0, 'yyyy-MM-dd', if(instr({m}, '.') > 0, 'dd.MM.yyyy', if(try_to_date({m}, 'MM/dd/yyyy') is null, 'dd/MM/yyyy', 'MM/dd/yyyy')))"
    return _permuted(f"{n} div {DAYS_B}", f"{n} % {DAYS_B}", str(DAYS_A), str(DAYS_B), key, "date", f"date_format(date_add(date'1900-01-01', cast(s.l * {DAYS_B} + s.r as int)), {form})")


def _shifted(mine: str, other: str, i: str, key: str) -> str:
    """Each letter or digit of `mine` moved within its kind by a stream keyed by the other half."""
    move = "cast(conv(substr(h, 1 + 2 * (k % 32), 2), 16, 10) as int)"
    turn = lambda lo, n: f"chr(ascii('{lo}') + (ascii(c) - ascii('{lo}') + {move}) % {n})"
    kinds = f"case when c between '0' and '9' then {turn('0', 10)} when c between 'a' and 'z' then {turn('a', 26)} when c between 'A' and 'Z' then {turn('A', 26)} else c end"
    return f"element_at(transform(array(sha2(concat({key}, '|text|', {i}, '|', length({mine}), '|', {other}), 256)), h -> array_join(transform(filter(split({mine}, ''), e -> e <> ''), (c, k) -> {kinds}), '')), 1)"


def _text(m: str, key: str) -> str:
    half = f"(length({m}) div 2)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', substr({m}, 1, length({m}) - {half}), 'r', substr({m}, 1 + length({m}) - {half})), (s, i) -> if(i % 2 = 1,"
        f" named_struct('l', {_shifted('s.l', 's.r', 'i', key)}, 'r', s.r), named_struct('l', s.l, 'r', {_shifted('s.r', 's.l', 'i', key)})), s -> concat(s.l, s.r))"
    )


def pseudonym_sql(m: str, key: str) -> str:
    """SQL of the pseudonym of m, a string that FOUND matched, under the SQL expression `key`; m itself if it isn't valid."""
    octets = " and ".join(f"cast(split({m}, '[.]')[{k}] as int) <= 255" for k in range(4))
    digits = f"length({_digits(m)})"
    return f"""case
      when instr({m}, '@') > 0 then concat({_text(f"split({m}, '@')[0]", key)}, '@', split({m}, '@')[1])
      when {m} rlike {_q(r'^(AKIA|ASIA)[A-Z0-9]{16}$')} then concat(substr({m}, 1, 4), {_text(f'substr({m}, 5)', key)})
      when {m} rlike '[=:]' then concat(regexp_extract({m}, {_q(BEFORE_SECRET)}, 0), {_text(f"regexp_extract({m}, '[A-Za-z0-9_-]+$', 0)", key)})
      when {m} rlike {_q(r'^\d+[.]\d+[.]\d+[.]\d+$')} then if({octets}, {_ip(m, key)}, {m})
      when {m} rlike {_q(r'^(\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d[.]\d\d[.]\d{4})$')} then
        if({_day(m)} between date'1900-01-01' and date'2099-12-31', {_date(m, key)}, {m})
      when {m} rlike {_q(r'^\d{3}-\d\d-\d{4}$')} then
        if(substr({m}, 1, 3) not in ('000', '666') and substr({m}, 1, 1) <> '9' and substr({m}, 5, 2) <> '00' and substr({m}, 8) <> '0000', {_ssn(m, key)}, {m})
      when substr({m}, 1, 1) = '+' then {_number(m, key, 'phone', f"greatest(1, least(3, {digits} - 10))")}
      when {digits} = 10 then {_number(m, key, 'phone', '0')}
      when {_digits(m)} rlike {_q(NETWORK)} and {_luhn(_digits(m), 0)} % 10 = 0 then {_card(m, key)}
      else {m} end"""


def pseudonymize(documents: DataFrame, key: str, count: str | None = "n_found") -> DataFrame:
    """The documents with personal data replaced by pseudonyms; `count` names a column for the number of replaced values (it replaces one of that name)."""
    if not key:
        raise ValueError("a key is needed")
    found, names, secret = spare(documents, "_found", "_names", "_secret")
    held = documents.sparkSession.sql("SELECT col1 FROM VALUES (:key), (null)", args={"key": key})  # two rows: one would be folded into the plan
    docs = documents.withColumn(secret, held.agg(F.max("col1")).scalar())
    docs = docs.withColumn(found, F.when(F.col("text").rlike("[0-9@]|[=:]|AKIA|ASIA"), F.expr(f"regexp_extract_all(text, {_q(FOUND)}, 0)")))
    docs = docs.withColumn(names, F.expr(f"transform({found}, m -> {pseudonym_sql('m', f'`{secret}`')})"))
    joined = F.expr(f"array_join(zip_with(split(text, {_q(FOUND)}, -1), {names}, (a, b) -> concat(a, coalesce(b, ''))), '')")
    docs = docs.withColumn("text", F.when(F.size(found) > 0, joined).otherwise(F.col("text")))
    if count:
        docs = docs.withColumn(count, F.coalesce(F.expr(f"size(filter(zip_with({found}, {names}, (a, b) -> a <> b), c -> c))"), F.lit(0)).cast("int"))
        docs = docs.withColumn(count, F.greatest(F.col(count), F.lit(0)))
    return docs.drop(found, names, secret)


def session_key(spark: SparkSession, default: str) -> str:
    """The key that the session names in spark.basaltql.pii.key, or a default for tests and checks."""
    return spark.conf.get("spark.basaltql.pii.key", None) or spark.sparkContext.getConf().get("spark.basaltql.pii.key") or default
