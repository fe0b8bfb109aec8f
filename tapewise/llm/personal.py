"""Personal data by anchors: an Aho-Corasick automaton finds at-signs, schemes, identifier cues and digits that meet, local parsers widen and check them.

Base kinds, leftmost and without overlaps within a kind:

    email    [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip       four groups of digits joined by points, none above 255
    card     16 to 19 digits, one space or hyphen allowed between two, that pass the Luhn check
    phone    +, a digit, more of digits, spaces, points, brackets, hyphens, a digit: 8 to 15 digits

Kinds that anchors add, each from its cue on:

    login    scheme://user@host or scheme://user:password@host
    tel      tel: and 7 to 15 digits
    iban     "iban" and an account number of its country's length that passes the check of 97
    account  a word for account, "number" or "no" or a colon or hash, and 6 to 20 digits
    ssn      "ssn" or "social security number" and ddd-dd-dddd of a range that is given out
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "login", "tel", "iban", "account", "ssn")
BASE = KINDS[:4]

#: The characters of a mail name, lengths of account numbers by country.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "XK": 20,
}
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh")
ACCOUNT_WORDS = ("account", "acct", "konto", "cuenta", "compte", "conto")

# what follows an anchor, matched from the anchor on; none of these can go back over what it has read
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_GROUP = re.compile(r"[0-9]+")
_POINTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]*")
_LOGIN = re.compile(r"[A-Za-z0-9._~%+-]+(?::[^\s/?#@]*)?@[A-Za-z0-9.-]+")
_TEL = re.compile(r"\+?[0-9][0-9().-]*")
_IBAN = re.compile(r"[:\x20]{1,3}([A-Za-z]{2}[0-9]{2})")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no|nr)\b\.?[:#\x20]*|\x20?[:#]\x20?)([0-9](?:[ -]?[0-9])*)", re.IGNORECASE | re.ASCII)
_SSN = re.compile(r"(?:\x20number)?[:#\x20]{1,3}([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9])", re.IGNORECASE | re.ASCII)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    """Whether a number's digits pass the Luhn check."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def _email(text: str, at: int, done: int) -> tuple[list[tuple[int, int]], int]:
    """Mail name before an at-sign, from ``done`` on, and domain after it."""
    start = done + len(text[done:at].rstrip(LOCAL))
    if start == at or not (domain := _DOMAIN.match(text, at + 1)):
        return [], at + 1  # no mail name reaches over an at-sign
    return [(start, domain.end())], domain.end()


def _ip(text: str, at: int, done: int) -> tuple[list[tuple[int, int]], int]:
    """Groups of digits joined by points around an anchor, four at a time from the first."""
    start = done + len(text[done:at].rstrip("0123456789"))
    end = _POINTS.match(text, start).end()
    groups, found = [g.span() for g in _GROUP.finditer(text, start, end)], []
    for k in range(0, len(groups) - 3, 4):
        parts = (text[s:e].lstrip("0") for s, e in groups[k : k + 4])
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((groups[k][0], groups[k + 3][1]))
    return found, end


def _card(text: str, at: int, done: int) -> tuple[list[tuple[int, int]], int]:
    """All digits that follow each other with at most one space or hyphen between."""
    whole = _DIGITS.match(text, at)
    number = _digits(whole.group())
    return ([whole.span()] if 16 <= len(number) <= 19 and luhn(number) else []), whole.end()


def _phone(text: str, at: int, done: int) -> tuple[list[tuple[int, int]], int]:
    """From a plus sign to the last digit of what may stand in a number."""
    whole = _PHONE.match(text, at).group().rstrip(" ().-")
    good = len(whole) > 3 and 8 <= len(_digits(whole)) <= 15
    return ([(at, at + len(whole))] if good else []), at + len(whole)


def _login(text: str, at: int, done: int) -> tuple[list[tuple[int, int]], int]:
    """User and host after a scheme; the span begins with the scheme."""
    after = text.index("://", at) + 3
    rest = _LOGIN.match(text, after)
    return ([(at, rest.end())], rest.end()) if rest else ([], after)


def _tel(text: str, at: int, done: int) -> tuple[list[tuple[int, int]], int]:
    rest = _TEL.match(text, at + 4)
    number = rest.group().rstrip("().-") if rest else ""
    good = 7 <= len(_digits(number)) <= 15
    return ([(at, at + 4 + len(number))] if good else []), at + 4 + len(number)


def _iban(text: str, at: int, done: int) -> tuple[list[tuple[int, int]], int]:
    """Country, check digits and as many letters and digits as the country's numbers have, single spaces between."""
    head = _IBAN.match(text, at + 4)
    length = IBAN_LENGTH.get(head[1][:2].upper()) if head else None
    if not length:
        return [], at + 4
    number, k = "", head.start(1)
    while k < len(text) and len(number) < length:
        c = text[k]
        if c.isascii() and c.isalnum():
            number += c
        elif c != " " or text[k - 1] == " ":
            break
        k += 1
    ends = k == len(text) or not text[k].isalnum()
    good = len(number) == length and ends and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1
    return ([(head.start(1), k)], k) if good else ([], at + 4)


def _account(text: str, at: int, done: int) -> tuple[list[tuple[int, int]], int]:
    word = next(w for w in ACCOUNT_WORDS if text[at : at + len(w)].lower() == w)
    rest = _ACCOUNT.match(text, at + len(word))
    good = rest and 6 <= len(_digits(rest[1])) <= 20
    return ([rest.span(1)], rest.end()) if good else ([], at + len(word))


def _ssn(text: str, at: int, done: int) -> tuple[list[tuple[int, int]], int]:
    cue = 3 if text[at : at + 3].lower() == "ssn" else len("social security")
    rest = _SSN.match(text, at + cue)
    good = rest and rest[1] not in ("000", "666") and rest[1] < "900" and rest[2] != "00" and rest[3] != "0000"
    return ([(rest.start(1), rest.end(3))], rest.end(3)) if good else ([], at + cue)


_PARSERS: dict[str, Callable] = dict(zip(KINDS, (_email, _ip, _card, _phone, _login, _tel, _iban, _account, _ssn)))


@cache
def _automaton() -> ahocorasick.Automaton:
    """Anchors with the kinds that they may begin and their length."""
    anchors: dict[str, list[str]] = {"@": ["email"]}
    for a in "0123456789":
        anchors[f"+{a}"] = ["phone"]
        for b in "0123456789":
            anchors[f"{a}.{b}"] = ["ip"]
            for between in ("", " ", "-"):
                anchors[f"{a}{between}{b}"] = ["card"]
    words = {f"{s}://": "login" for s in SCHEMES} | {"tel:": "tel", "iban": "iban", "ssn": "ssn", "social security": "ssn"} | dict.fromkeys(ACCOUNT_WORDS, "account")
    for word, kind in words.items():
        for form in {word, word.upper(), word.capitalize(), word.title()}:
            anchors.setdefault(form, []).append(kind)
    found = ahocorasick.Automaton()
    for anchor, kinds in anchors.items():
        found.add_word(anchor, (len(anchor), kinds))
    found.make_automaton()
    return found


#: Cues that must not be the end of a longer word.
_WORDS = ("login", "tel", "iban", "account", "ssn")


def find_personal(text: str) -> list[Span]:
    """Spans of personal data in a text by kind as in KINDS, then start; code points, end exclusive."""
    spans: dict[str, list[Span]] = {}
    done = dict.fromkeys(KINDS, 0)  # per kind, up to where the text is settled
    for last, (length, kinds) in _automaton().iter(text):
        start = last - length + 1
        for kind in kinds:
            if start < done[kind] or (kind in _WORDS and start and text[start - 1].isalnum()):
                continue
            found, done[kind] = _PARSERS[kind](text, start, done[kind])
            if found:
                spans.setdefault(kind, []).extend(Span(kind, s, e) for s, e in found)
    return [span for kind in KINDS for span in spans.get(kind, ())]


def _spans(text: pd.Series) -> pd.DataFrame:
    found = [tuple(zip(*find_personal(t))) or ((), (), ()) for t in text.fillna("")]
    return pd.DataFrame([[list(part) for part in f] for f in found], columns=["kinds", "starts", "ends"])


def _masked(text: pd.Series) -> pd.Series:
    def masked(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for kind, start, end in sorted(find_personal(t), key=lambda s: (s.start, -s.end)):
            if start >= at:
                out += [t[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        return "".join([*out, t[at:]])

    return pd.Series([masked(None if pd.isna(t) else t) for t in text], dtype=object)


def personal_spans(text: Column) -> Column:
    """struct<kinds, starts, ends> of arrays: the spans of whole texts, however long, by kind as in KINDS, then start.

    Positions are code points, ends exclusive. Null and empty texts have none; equal texts get equal spans. Spans of different kinds may overlap. Rows are handled on
    their own, so repeated rows and other columns don't matter.
    """
    return F.pandas_udf(_spans, "kinds array<string>, starts array<int>, ends array<int>")(text)


def masked(text: Column) -> Column:
    """Texts with their personal data replaced by <KIND>; of spans that overlap, the first (then the longest) names what stands for all of them. Null stays null."""
    return F.pandas_udf(_masked, "string")(text)


def span_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The spans of some kinds as text: kind:start:end, comma-joined."""
    zipped = F.arrays_zip(spans["kinds"].alias("kinds"), spans["starts"].alias("starts"), spans["ends"].alias("ends"))
    chosen = F.filter(zipped, lambda s: s["kinds"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")
