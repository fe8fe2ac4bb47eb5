"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Base kinds (``email``, ``ip``, ``card``, ``phone``) follow fixed patterns and always
stand; card numbers pass Luhn.  The method adds ``iban`` (mod-97 confirms), ``ssn`` and
``phone_local``, which need a score of at least THRESHOLD: a proposal starts at its
pattern's score, a passed checksum raises it, and whole words of its kind (or of other
number kinds, which lower it) within CONTEXT code points adjust it.  An account number ends at its
country's length; what begins with no country of IBAN_LENGTHS is none.  Added spans never remove or change base spans.

Defined results: a null text counts as empty (no span); rows that repeat are searched
each on their own; an empty table gives an empty result.  Texts are searched whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

from fleetlens.llm.common import add_columns, free_name

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "ssn", "phone_local")
CONTEXT = 40
THRESHOLD = 0.6

Span = tuple[int, int, str]  # start, end (exclusive), kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the look-behinds only keep a failed run of digits from being tried again at each of its digits
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+.(-])\(?[0-9]{3,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")

# fixed values: characters of an account number by country (registry of ISO 13616)
IBAN_LENGTHS = {k: int(n) for k, n in (x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 "
    "EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 "
    "JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 "
    "NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 "
    "TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20").split())}
_IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}


def _whole(words: str) -> re.Pattern:
    """Any of ``words`` (between bars) that no letter or digit touches."""
    return re.compile(rf"(?<![^\W_])(?:{words})(?![^\W_])", re.I)


#: kind -> its own score, and words that speak for it
_ADDED = {
    "iban": (0.3, _whole("ibans?|accounts?|banks?|konto|kontonummer|bankverbindung|comptes?|cuentas?")),
    "ssn": (0.4, _whole("ssn|social security|tax|steuer|steuernummer|nif")),
    "phone_local": (0.4, _whole("phones?|telephone|tel|calls?|mobile|fax|telefon|telefonnummer|teléfono|llame")),
}
_AGAINST = _whole("isbn|orders?|invoices?|versions?|serial|article no")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    rest = 0
    for c in turned:
        n = int(c, 36)
        rest = (rest * (100 if n > 9 else 10) + n) % 97
    return rest == 1


def _emails(text: str) -> list[Span]:
    # from each @ the local part is taken leftwards, so a long run without @ costs nothing
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            free = found.end()
        at = text.find("@", max(at + 1, free))
        if not found:
            free = max(free, 0)
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds, leftmost and non-overlapping per kind; a match that
    fails its check is dropped without another try inside it."""
    out = _emails(text)
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers whose checksum holds, each cut at its country's length; a number that fails is searched again inside."""
    free = 0
    for m in _IBAN_HEAD.finditer(text):
        if m.start() < free or (n := IBAN_LENGTHS.get(m.group()[:2])) is None:
            continue
        rest = _IBAN_REST[n].match(text, m.end())
        if rest and mod97(text[m.start():rest.end()].replace(" ", "")):
            free = rest.end()
            yield m.start(), free


def _proposed(text: str) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, score) of every number that an added kind's pattern and checksum let through."""
    for start, end in _ibans(text):
        yield start, end, "iban", _ADDED["iban"][0] + 0.4
    for kind, pattern in (("ssn", _SSN), ("phone_local", _PHONE_LOCAL)):
        for m in pattern.finditer(text):
            yield m.start(), m.end(), kind, _ADDED[kind][0]


def _near(text: str, start: int, end: int, words: re.Pattern) -> bool:
    """Whether one of ``words`` lies within CONTEXT code points of [start, end); words that the window's edge cuts don't."""
    lo, hi = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    first = max(0, lo - 1)
    return any(m.end() <= hi - first for m in words.finditer(text[first:hi + 1], lo - first))


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of the other kinds whose score reaches THRESHOLD and that no base span holds."""
    starts = sorted(b[0] for b in base)
    reach = list(accumulate((end for _, end in sorted(b[:2] for b in base)), max))  # furthest end of the first k + 1 base spans
    out = []
    for start, end, kind, score in _proposed(text):
        k = bisect_right(starts, start)
        if k and reach[k - 1] >= end:
            continue
        score += 0.3 * _near(text, start, end, _ADDED[kind][1]) - 0.2 * _near(text, start, end, _AGAINST)
        if score >= THRESHOLD:
            out.append((start, end, kind))
    return out


def _order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a whole text, each by start and kind."""
    text = text or ""
    base = base_spans(text)
    return _order(base), _order(base + added_spans(text, base))


def span_string(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with every run of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for start, end, kind in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def detect(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``base_spans``, ``spans`` (as ``kind:start:end`` joined by commas, code points, end
    exclusive) and a count per base kind; the second value names those columns."""
    names = {k: free_name(docs, k) for k in ("base_spans", "spans", *(f"n_{k}" for k in BASE_KINDS))}

    def work(texts: list) -> list[list]:
        rows = []
        for t in texts:
            base, every = find_spans(t)
            rows.append((span_string(base), span_string(every),
                         *(sum(s[2] == k for s in base) for k in BASE_KINDS)))
        return [list(c) for c in zip(*rows)] or [[] for _ in names]

    kinds = ["string", "string", "long", "long", "long", "long"]
    return add_columns(docs, text, dict(zip(names.values(), kinds)), lambda: work), names


def redacted(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the text freed of personal data (null stays null); the second value names the column."""
    name = free_name(docs, "redacted")

    def work(texts: list) -> list[list]:
        return [[None if t is None else redact(t, find_spans(t)[1]) for t in texts]]

    return add_columns(docs, text, {name: "string"}, lambda: work), name
