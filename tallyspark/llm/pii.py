"""Personal data in texts, by DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for card numbers, mod 97 for IBANs, the range
of an address's parts, the digits of a phone number, the blocks of a social security number) and words before a span
raise its score. The four base kinds count whatever their score; the others (IBAN, social security number, secret) need
``LEAST_SCORE``: a long run of letters and digits is a secret only after a word like token or key. Positions are code points, ends exclusive. A span's place follows from the pieces between matches and the matches' lengths,
so no row-at-a-time code is needed. Every pattern is written so that Java's engine takes time in proportion to
the text and needs no deep stack (possessive groups; a match starts where a run starts or the last match ended).

Null texts count as empty; null ids and extra columns are carried or ignored; repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import columns, fresh, text_or_empty

#: Fixed patterns of the kinds: what they match is what the plain forms in ORACLE match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
RUN, SECRET = r"[0-9-]{11,}+", r"[A-Za-z0-9_+/-]{32,}+"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a text without a match of this cheap pattern has no span
    check: str  # SQL over v, the matched text
    score: float
    near: str  # words that raise the score
    bonus: float = 0.1


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 1, cast(substring(d, -i, 1) as int), "
    "cast(substring(d, -i, 1) as int) * 2 - if(cast(substring(d, -i, 1) as int) > 4, 9, 0))) % 10 = 0"
)
_MOD97 = (
    "aggregate(split(concat(substring(d, 5), substring(d, 1, 4)), ''), 0, (a, c) -> case when c = '' then a "
    "when c between '0' and '9' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"
)


def _let(value: str, body: str) -> str:
    """body over d, a value computed once."""
    return f"exists(array({value}), d -> {body})"


KINDS = (
    Kind("email", EMAIL, "@", "true", 0.9, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", IP, r"[0-9]\.[0-9]", r"forall(split(v, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)", 0.6, "ip|host|server|address"),
    Kind("card", CARD, r"[0-9]{2}|[0-9][\x20-][0-9]", _let(_digits("v"), f"length(d) between 16 and 19 and {_LUHN}"), 0.8, "card|visa|karte|carte|tarjeta"),
    Kind("phone", PHONE, r"\+[0-9]", f"length({_digits('v')}) between 8 and 15", 0.6, "phone|call|tel|mobil|fax"),
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", _let("replace(v, ' ', '')", f"length(d) between 15 and 34 and {_MOD97}"), 0.9, "iban|account|konto|compte|cuenta"),
    Kind("ssn", RUN, r"[0-9]{3}-[0-9]{2}-[0-9]", r"v rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' and left(v, 1) <> '9' and left(v, 3) not in ('000', '666') and substring(v, 5, 2) <> '00' and right(v, 4) <> '0000'", 0.3, "ssn|social security|sozialversicherung", 0.4),
    Kind("secret", SECRET, r"[A-Za-z0-9_+/-]{32}", "v rlike '[0-9]' and v rlike '[A-Za-z]'", 0.3, "token|secret|passw|bearer|credential|api.?key|private.?key|access.?key", 0.4),
)
BASE_KINDS = ("email", "ip", "card", "phone")
#: Characters before a span in which its kind's words are looked for, and the score that an added kind needs.
NEAR_CHARS, LEAST_SCORE = 40, 0.5

#: What a text has if it has a span of any kind here.
ANY = "[0-9@]"
_SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _spans(kind: Kind, text: str = "text") -> Column:
    """array of spans of one kind, in order."""
    p = _quoted(kind.pattern)
    none = f"cast(array() as array<{_SPAN}>)"
    walk = (
        f"aggregate(transform(arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0)), z -> struct(z.`0` as p, z.`1` as h)), "
        f"struct(0 as at, {none} as found), (s, x) -> if(x.h is null, s, struct("
        "s.at + length(x.p) + length(x.h) as at, concat(s.found, array(struct("
        f"'{kind.name}' as kind, s.at + length(x.p) as start, s.at + length(x.p) + length(x.h) as end, x.h as value, "
        f"{kind.score}D + if(lower(right(x.p, {NEAR_CHARS})) rlike '{kind.near}', {kind.bonus}D, 0D) as score))) as found)), s -> s.found)"
    )
    tests = [] if kind.name in BASE_KINDS else [f"y.score >= {LEAST_SCORE}D"]
    tests += [] if kind.check == "true" else [f"exists(array(y.value), v -> {kind.check})"]
    checked = f"filter({walk}, y -> {' and '.join(tests)})" if tests else walk
    return F.expr(f"case when {text} rlike {_quoted(kind.hint)} then {checked} else {none} end")


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, into: str = "spans") -> DataFrame:
    """``docs`` with a column of spans: kind, start, end, value and score, by kind as listed, then start.

    Spans of the base kinds stay whatever their score; one of an added kind needs LEAST_SCORE, so that a weak pattern
    counts only where the words before it speak for it.
    """
    name = fresh(docs)
    text = name("text")
    found = docs.withColumn(text, text_or_empty())
    spans = F.concat(*[_spans(k, text) for k in kinds])
    return found.withColumn(into, F.when(F.col(text).rlike(ANY), spans).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))).drop(text)


def _listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, cast(x.start as string), cast(x.end as string))), ',')")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, all spans as text, and their scores in percent in the same order."""
    named = ", ".join(f"'{k}'" for k in BASE_KINDS)
    found = find_pii(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    base = found.withColumn("base", F.expr(f"filter(spans, x -> x.kind in ({named}))"))
    scores = F.expr("array_join(transform(spans, x -> cast(cast(round(x.score * 100) as int) as string)), ',')")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE_KINDS]
    return base.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one."""
    spans = fresh(docs)("spans")
    walk = (
        f"aggregate(array_sort(transform({spans}, x -> struct(x.start as start, x.end as end, x.kind as kind))), "
        "struct(0 as at, '' as out), (s, x) -> case when x.end <= s.at then s when x.start < s.at then struct(x.end as at, s.out as out) "
        "else struct(x.end as at, concat(s.out, substring(text, s.at + 1, x.start - s.at), '<', upper(x.kind), '>') as out) end, "
        "s -> concat(s.out, substring(text, s.at + 1)))"
    )
    found = find_pii(docs, into=spans)
    return found.withColumn("text", F.expr(f"if(size({spans}) = 0, text, {walk})")).select(*columns(docs))


def oracle_sql() -> str:
    """The report in DuckDB's dialect, from the plain patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": IBAN,
        "ssn": "[0-9-]{11,}",
        "secret": "[A-Za-z0-9_+/-]{32,}",
    }
    luhn = (
        "length({d}) between 16 and 19 and list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
        "case when i % 2 = 1 then cast({d}[-i] as int) else cast({d}[-i] as int) * 2 - case when cast({d}[-i] as int) > 4 then 9 else 0 end end)) % 10 = 0"
    ).format(d="regexp_replace(v, '[^0-9]', '', 'g')")
    rotated = "(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4))"
    mod97 = (
        f"length(replace(v, ' ', '')) between 15 and 34 and list_reduce(list_prepend(0, list_transform(string_split({rotated}, ''), lambda c: "
        "case when c between '0' and '9' then cast(c as int) else ascii(c) - 55 end)), lambda a, x: (a * case when x > 9 then 100 else 10 end + x) % 97) = 1"
    )
    checks = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 and cast('0' || left(ltrim(p, '0'), 3) as int) <= 255))",
        "card": luhn,
        "phone": "length(regexp_replace(v, '[^0-9]', '', 'g')) between 8 and 15",
        "iban": mod97,
        "ssn": "regexp_matches(v, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') and left(v, 1) <> '9' and left(v, 3) not in ('000', '666') and substr(v, 5, 2) <> '00' and right(v, 4) <> '0000'",
        "secret": "regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')",
    }
    of = {k.name: k for k in KINDS}
    score = lambda k: f"{round(of[k].score * 100)} + case when regexp_matches(lower(right(p, {NEAR_CHARS})), '{of[k].near}') then {round(of[k].bonus * 100)} else 0 end"
    parts = []
    for n, (kind, pattern) in enumerate(plain.items()):
        parts.append(
            f"select doc_id, {n} as k, '{kind}' as kind, s, e, score from (select doc_id, v, {score(kind)} as score, cast(sum(length(p) + length(v)) over (partition by r order by i) as bigint) as e, e - length(v) as s from "
            f"(select doc_id, r, unnest(h) as v, unnest(p[1:len(h)]) as p, generate_subscripts(h, 1) as i from (select doc_id, r, regexp_extract_all(t, '{pattern}') as h, "
            f"regexp_split_to_array(t, '{pattern}') as p from d))) where {checks[kind]}" + ("" if kind in BASE_KINDS else f" and score >= {round(LEAST_SCORE * 100)}")
        )
    return (
        "with d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents), spans as (" + " union all ".join(parts) + "), "
        "g as (select doc_id, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip, count(*) filter (where kind = 'card') as n_card, "
        "count(*) filter (where kind = 'phone') as n_phone, string_agg(kind || ':' || s || ':' || e, ',' order by k, s) filter (where k < 4) as b, "
        "string_agg(kind || ':' || s || ':' || e, ',' order by k, s) as a, string_agg(score, ',' order by k, s) as scores from spans group by doc_id) "
        "select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, "
        "sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans, coalesce(scores, '') as scores from d left join g using (doc_id)"
    )
