"""Personal data: anchors found by one Aho-Corasick automaton, expanded and validated by small local parsers.

The automaton reads a text once and stops at what every piece of personal data contains: an at-sign, a plus before a
digit, two digits (alone, or with a blank, a dash or a dot between them), ``scheme://``, the name of an identifier.  The parser of the
anchor's kind then looks at the characters around it only:

* ``email``: the name to the left of the at-sign, two labels or more to its right;
* ``ip``: a chain of numbers and dots, taken four by four, no part over 255;
* ``card``: a chain of digits with single blanks or dashes, 13 to 19 of them, Luhn's sum right;
* ``phone``: a plus and 9 to 15 digits with blanks, dots, dashes and brackets;
* ``login``: an address with a user, ``scheme://user[:password]@host``;
* ``account``: the number that follows an identifier's name (account, passport and the like), 6 to 20 digits;
* ``iban``: country, check digits and account, remainder modulo 97 right.

The first four are what a leftmost scan with the patterns of ``PATTERNS`` finds: an anchor within a chain that was read is
passed over, and what fails its check is dropped, not tried again.  Spans of different kinds may overlap.  Positions are code points, ends exclusive.

Edge cases: a null text is an empty one; texts without personal data have no spans; null and repeated ids are answered row by
row, equal texts alike (ties); very long texts are read whole, in time linear in their length; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: What the spans of each kind are, before they are checked.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(PATTERNS)
KINDS = (*BASE, "login", "account", "iban")
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh", "git", "smtp", "imap", "postgres", "mysql", "mongodb", "redis", "amqp")
#: Identifier names; each also with a capital first letter and in capitals.
CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "patient", "customer", "insurance", "licence", "license")

_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN_TAIL = r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]*[A-Za-z0-9]"
ACCOUNT_TAIL = r"(?: ?(?:no|No|NO|nr|Nr|number|Number|id|ID))?[.:#]? ?#?"
_LOGIN, _ACCOUNT, _NOT_DIGIT = re.compile(LOGIN_TAIL), re.compile(ACCOUNT_TAIL), re.compile("[^0-9]")
IBAN_TAIL = r"(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
_IBAN_TAIL = re.compile(IBAN_TAIL)

Span = tuple[str, int, int]


@cache
def automaton() -> ahocorasick.Automaton:
    """Anchor -> (parser, its length)."""
    a = ahocorasick.Automaton()
    digits = sorted(_DIGITS)
    a.add_word("@", ("email", 1))
    for x in digits:
        a.add_word("+" + x, ("phone", 2))
        for y in digits:
            a.add_word(f"{x}.{y}", ("ip", 3))
            for between in ("", " ", "-"):
                a.add_word(x + between + y, ("card", 2 + len(between)))
    for scheme in SCHEMES:
        a.add_word(scheme + "://", ("login", len(scheme) + 3))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            a.add_word(form, ("account", len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * 10 + ord(c) - 48 if c <= "9" else rest * 100 + ord(c) - 55) % 97
    return rest == 1


def spans_of(text: str) -> list[Span]:
    """(kind, start, end) by kind as in ``KINDS``, then start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where a kind's last stretch ended
    for last, (kind, size) in automaton().iter(text):
        start = last + 1 - size
        if start < past[kind]:
            continue
        if kind == "card":
            end = _CHAIN.match(text, start).end()
            past["card"] = end
            digits = _NOT_DIGIT.sub("", text[start:end])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(("card", start, end))
            # check digits of an IBAN are two digits after two capitals; the country's letters are no anchor of their own
            if start > 1 and text[start - 2 : start].isascii() and text[start - 2 : start].isupper() and text[start - 2 : start].isalpha() and text[start + 1 : start + 2] in _DIGITS:
                _iban(text, start - 2, found, past)
        elif kind == "email":
            left = start
            while left > past["email"] and text[left - 1] in _NAME:
                left -= 1
            domain = _DOMAIN.match(text, start + 1) if left < start else None
            if domain:
                found["email"].append(("email", left, domain.end()))
                past["email"] = domain.end()
        elif kind == "ip":
            left = start
            while left > past["ip"] and text[left - 1] in _DIGITS:
                left -= 1
            end = _DOTTED.match(text, left).end()
            past["ip"] = end
            parts, at = text[left:end].split("."), left
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                stop = at + sum(map(len, four)) + 3
                if all(map(octet, four)):
                    found["ip"].append(("ip", at, stop))
                at = stop + 1
        elif kind == "phone":
            match = _PHONE.match(text, start)
            if match:
                past["phone"] = match.end()
                if 9 <= len(_NOT_DIGIT.sub("", match.group())) <= 15:
                    found["phone"].append(("phone", start, match.end()))
        elif kind == "login":
            match = _LOGIN.match(text, last + 1)
            if match:
                past["login"] = match.end()
                found["login"].append(("login", start, match.end()))
        else:
            first = _ACCOUNT.match(text, last + 1).end()
            number = _CHAIN.match(text, first)
            if number:
                past["account"] = number.end()
                if 6 <= len(_NOT_DIGIT.sub("", number.group())) <= 20:
                    found["account"].append(("account", first, number.end()))
    return [s for k in KINDS for s in found[k]]


def _iban(text: str, start: int, found: dict, past: dict) -> None:
    tail = _IBAN_TAIL.match(text, start + 4)
    if start < past["iban"] or not tail:
        return
    past["iban"] = tail.end()
    # words in capitals may follow: the longest account whose check digits are right
    for end in range(tail.end(), start + 14, -1):
        if text[end - 1] != " " and mod97(text[start:end].replace(" ", "")):
            found["iban"].append(("iban", start, end))
            return


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_personal(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """doc_id, spans (array of kind, start, end, by kind as in ``KINDS``, then start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t.as_py() or "") if k in kinds] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def masked(text: str, spans: list[Span]) -> str:
    """A text with each stretch of overlapping spans replaced by ``[kind]`` of its first, and longest, span."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_personal(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """doc_id, text with personal data masked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            out = [masked(t, [s for s in spans_of(t) if s[0] in kinds]) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string")


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_CUES = "|".join(form for cue in CUES for form in (cue, cue.capitalize(), cue.upper()))
_SQL_PATTERNS = PATTERNS | {"login": f"(?:{'|'.join(SCHEMES)})://{LOGIN_TAIL}", "account": f"(?:{_CUES}){ACCOUNT_TAIL}[0-9](?:[ -]?[0-9])+", "iban": "[A-Z][A-Z][0-9][0-9]" + IBAN_TAIL}
#: Matches are set off by a character that texts do not hold then; every second piece is a match, and lengths before it are its place.
OP11_SQL = f"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
p AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, string_split(regexp_replace(t, '({_quoted(v)})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM d" for k, v in _SQL_PATTERNS.items())}),
u AS (SELECT doc_id, kind, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p WHERE len(parts) > 1),
s AS (SELECT doc_id, kind, part, i, sum(length(part)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM u),
m AS (SELECT doc_id, kind, CASE WHEN kind = 'account' THEN regexp_extract(part, '[0-9][0-9 -]*$') ELSE part END AS part, stop FROM s WHERE i % 2 = 0),
g AS (SELECT doc_id, kind, part, stop, regexp_replace(part, '[^0-9]', '', 'g') AS digits, reverse(regexp_replace(part, '[^0-9]', '', 'g')) AS back FROM m),
w AS (SELECT doc_id, kind, part, stop, digits, back, CASE WHEN kind <> 'iban' THEN [length(part)]
      ELSE list_filter(list_reverse(range(15, length(part) + 1)), lambda n: part[n] <> ' ' AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(replace(part[5:n] || part[1:4], ' ', ''), ''), lambda c: (ord(c) - CASE WHEN c <= '9' THEN 48 ELSE 55 END)::BIGINT)), lambda r, v: (CASE WHEN v < 10 THEN r * 10 + v ELSE r * 100 + v END) % 97) = 1) END AS ends FROM g),
k AS (SELECT doc_id, kind, stop - length(part) AS a, stop - length(part) + ends[1] AS b FROM w WHERE CASE kind
      WHEN 'ip' THEN len(list_filter(string_split(part, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(right(x, 3) AS INT), 0) > 255)) = 0
      WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN back[i]::INT ELSE back[i]::INT * 2 - 9 * (back[i]::INT > 4)::INT END)) % 10 = 0
      WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 WHEN 'account' THEN length(digits) BETWEEN 6 AND 20 WHEN 'iban' THEN len(ends) > 0 ELSE true END),
j AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
      coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY list_position({list(KINDS)}, kind), a) FILTER (kind IN {BASE}), '') AS base,
      string_agg(kind || ':' || a || ':' || b, ',' ORDER BY list_position({list(KINDS)}, kind), a) AS spans FROM (SELECT doc_id, kind, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM k) GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN j USING (doc_id)
"""
