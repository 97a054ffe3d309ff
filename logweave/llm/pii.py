"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs,
digits, URL schemes and cue words.  At each anchor a small parser expands to the
left and right, validates what it found, and yields a span.  Parsers keep, for
their kind, the place where the last match ended, so matches are leftmost and do
not overlap, and the work is linear in the text.

Kinds: email, ip, card, phone (the base), then account (a cue word and an
identifier, IBANs by their check digits), address (house number and street) and
url.  An identifier has eight letters and digits at least, four of them digits,
and goes on to its end, however long: groups joined by dashes, underscores or a
full stop, or by a space where a digit follows.  Offsets are code points, ends
exclusive.

Defined results: a null or empty text has no spans; equal texts have equal
spans; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as K

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address", "url")

#: Cue words, street words and schemes.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "token", "api_key", "secret")
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane", "straße", "strasse", "allee", "calle", "avenida")
SCHEMES = ("http://", "https://", "ftp://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Za-z0-9]+(?:[ -]?[A-Za-z0-9]+)*")
_GAP = re.compile(r"""[\s:=#"'.]{1,8}(?=[A-Za-z0-9])""")
_IDENT = re.compile(r"[A-Za-z0-9]+(?:(?:[_-]+|\.| (?=[0-9]))[A-Za-z0-9]+)*")
_URL = re.compile(r"""[^\s<>"'`{}|\\^]+""")
_TAIL = re.compile(r"(?: [^\W\d_]+)?,? ([0-9]{1,5})(?![\w])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.upper()
    return 15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for kind, cues in (("account", ACCOUNT_CUES), ("address", STREET_CUES), ("url", SCHEMES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _account(text: str, start: int, end: int, dull: int) -> tuple[tuple[int, int] | None, int]:
    """The span, and where the last identifier without enough digits ends.

    An identifier that starts before ``dull`` is the rest of one that failed, so it fails too.
    """
    if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        return None, dull
    gap = _GAP.match(text, end)
    if not gap:
        return None, dull
    at = gap.end()
    m = _IBAN.match(text, at, at + 72)
    words = m[0].replace("-", " ").split(" ")
    for k in range(len(words), 0, -1):  # the longest reading that validates
        joined = "".join(words[:k])
        if not iban_ok(joined):
            continue
        size = len(m[0]) if k == len(words) else sum(map(len, words[:k])) + k - 1
        return (at, at + size), dull
    if at < dull:
        return None, dull
    m = _IDENT.match(text, at)
    if sum(c.isalnum() for c in m[0]) >= 8 and sum(c.isdigit() for c in m[0]) >= 4:
        return m.span(), dull
    return None, m.end()


def _house(text: str, at: int) -> int | None:
    """Where the number of one to five digits begins that stands before ``at`` and up to three words."""
    for _ in range(4):
        gap = at
        while gap and text[gap - 1] in " ,":
            gap -= 1
        low = gap
        while low and gap - low < 6 and text[low - 1] in "0123456789":
            low -= 1
        if low < gap < at:
            return low if gap - low <= 5 and not (low and (text[low - 1].isalnum() or text[low - 1] == "_")) else None
        if text[gap:at] != " " * bool(at - gap):  # words are parted by one blank
            return None
        low = gap
        while low and text[low - 1].isalpha():
            low -= 1
        if low == gap:
            return None
        at = low
    return None


def _address(text: str, start: int, end: int) -> tuple[int, int] | None:
    if end < len(text) and text[end].isalpha():  # a cue ends its word, so each word is looked at once
        return None
    name = start
    while name and text[name - 1].isalpha():
        name -= 1
    if name == start and (low := _house(text, name)) is not None:  # number before the name
        return low, end
    if m := _TAIL.match(text, end):  # name before the number
        return name, m.end(1)
    return None


def find(text: str, auto) -> list[tuple[int, int, int]]:
    """(kind number, start, end), sorted."""
    out: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    dull = 0
    for last, (what, size) in auto.iter(text):
        at = last + 1 - size
        if what == "digit":
            if at >= done["ip"]:
                if m := _IP.match(text, at):
                    done["ip"] = m.end()
                    # a long run of digits is never turned into a number
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        out.append((1, at, m.end()))
                else:  # no start in this run of digits can match
                    done["ip"] = _DIGITS.match(text, at).end()
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, at, m.end()))
        elif what == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                out.append((0, start, m.end()))
        elif what == "plus":
            if m := _PHONE.match(text, at):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, at, m.end()))
        elif at >= done[what]:
            if what == "url":
                m = _URL.match(text, last + 1)
                got = (at, m.start() + len(m[0].rstrip(".,;:!?)"))) if m else None
                if got and got[1] <= last + 1:
                    got = None
            elif what == "account":
                got, dull = _account(text, at, last + 1, dull)
            else:
                got = _address(text, at, last + 1)
            if got and got[0] >= done[what]:
                done[what] = got[1]
                out.append((KINDS.index(what), *got))
    return sorted(set(out))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but the text, with found: array<struct<kind, start, end, value>>.

    ``found`` replaces a column of that name.
    """
    K.prepare(docs.sparkSession)
    docs = docs.select(*K.but(docs, "text", "found"), "text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in batches:
            found = []
            for v in b.column(b.num_columns - 1):
                t = v.as_py()
                found.append([{"kind": KINDS[k], "start": a, "end": e, "value": t[a:e]} for k, a, e in find(t, auto)] if t else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], [*b.schema.names[:-1], "found"])

    return K.map_arrow(docs, run, "found array<struct<kind:string,start:long,end:long,value:string>>", ("text",))
