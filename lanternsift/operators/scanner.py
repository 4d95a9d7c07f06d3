r"""The scan as one Arrow pass: all detectors, person names and overlap resolution of a batch of texts in one worker call.

Offsets of matches have no built-in, and twenty detectors as nested column lambdas take longer to plan than a small
table takes to scan. So the text column alone goes to Python, once, and a column of entities comes back; nothing is
shuffled and the other columns stay on the JVM.

No pattern is run over a whole text. Every detector has anchors, found by substring search: a literal that each of its
matches starts with, a character it must hold, or a run of digits that several detectors share. A pattern is tried at
its anchors only, with the context that its lookarounds need, so a text without anchors costs a few substring searches
and the result is that of a search of the whole (tests compare it with the column form in detectors.py).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternsift.functions import names as N
from lanternsift.functions import taxonomy as X
from lanternsift.functions import validators as V
from lanternsift.functions.spans import SPAN
from lanternsift.operators import detectors as D

Hit = tuple[str, int, int, str, float, str]  # type, start, end, text, confidence, detector
#: Code points of a URL that are read after its first six.
URL_CLIP = 2048
#: Code points after a birth cue in which a date may start, and that a date may have.
CUE_REACH, DATE_LENGTH = 40, 200
_HEX = frozenset("0123456789abcdefABCDEF")
_LOCAL = frozenset("%+-.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_WORD = re.compile("[a-z]+")


def python_pattern(pattern: str) -> re.Pattern:
    """A detector's pattern for Python: str patterns cover Unicode as (?U) does; without it case folds in ASCII only."""
    head = re.match(r"\(\?(i?)(U?)\)", pattern)
    bare = re.sub(r"\(\?i?U?\)", "", pattern)
    flags = 0
    if head and head[1]:
        flags = re.IGNORECASE if head[2] else re.IGNORECASE | re.ASCII
    return re.compile(bare, flags)


# --- checks of one identifier


def digits_of(hit: str) -> str:
    return "".join(c for c in hit if "0" <= c <= "9")


def luhn(number: str) -> bool:
    if not number.isascii() or not number.isdigit():
        return False
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iin_known(number: str) -> bool:
    two, four = number[:2], number[:4]
    return number[:1] == "4" or "51" <= two <= "55" or "2221" <= four <= "2720" or two in ("34", "37", "65") or four == "6011"


def _sum(values: list[int], weights: list[int]) -> int:
    return sum(v * w for v, w in zip(values, weights))


def aba(number: str) -> bool:
    return len(number) == 9 and number.isascii() and _sum(list(map(int, number)), [3, 7, 1] * 3) % 10 == 0


_VIN = {c: int(v) for c, v in zip("ABCDEFGHJKLMNPRSTUVWXYZ0123456789", "123456781234579234567890123456789")}
_VIN_WEIGHTS = [*range(8, 1, -1), 10, 0, *range(9, 1, -1)]


def vin(number: str) -> bool:
    up = number.upper()
    if len(up) != 17 or any(c not in _VIN for c in up):
        return False
    rest = _sum([_VIN[c] for c in up], _VIN_WEIGHTS) % 11
    return up[8] == ("X" if rest == 10 else str(rest))


_OCTET = re.compile(r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:[.](?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}")
_GROUPS = re.compile(rf"[{V.HEX}]{{1,4}}(?::[{V.HEX}]{{1,4}})*")


def ipv6(hit: str) -> bool:
    parts = hit.split("::")
    if len(parts) > 2 or ":::" in hit:
        return False
    if not all(p == "" or _GROUPS.fullmatch(p) for p in parts):
        return False
    n = sum(1 for g in hit.split(":") if g)
    return n == 8 and len(parts) == 1 or n <= 7 and len(parts) == 2


def nanp(bare: str) -> bool:
    core = bare[1:11] if len(bare) == 11 else bare
    return len(core) == 10 and core[0] in "23456789" and core[3] in "23456789"


def ein(bare: str) -> bool:
    return len(bare) == 9 and int(bare[:2]) not in V.EIN_UNISSUED


_SWIFT = re.compile("[A-Za-z]{6}[A-Za-z0-9]{2}(?:[A-Za-z0-9]{3})?")
_REFERENCE, _VERSION, _BIRTH, _FAX = (python_pattern(p) for p in (D.REFERENCE_CUE, D.VERSION_CUE, D.BIRTH_CUE, r"(?iU)\b(?:tele)?fax\b|\bfacsimile\b"))
_NUMBER = re.compile("[0-9]+")
_MONTH_NAME = re.compile("[a-z]{3}")
_ISO = re.compile("[0-9]{4}-")


def born(hit: str, last_year: int) -> bool:
    """A calendar date from 1900 to last_year, in one of the four written forms."""
    from datetime import date

    h = hit.lower()
    n = _NUMBER.findall(h)
    name = _MONTH_NAME.search(h)
    try:
        if name:
            month = next(i for i, m in enumerate(D._LONG_MONTHS, 1) if m[:3] == name[0])
            year, day = int(n[1]), int(n[0])
        elif _ISO.match(h):
            year, month, day = int(n[0]), int(n[1]), int(n[2])
        else:
            year, month, day = int(n[2]), int(n[0]), int(n[1])
        date(year, month, day)
    except (ValueError, IndexError, StopIteration):
        return False
    return 1900 <= year <= last_year


# --- anchors


class Text:
    """A text with what several detectors share, computed when first asked for."""

    __slots__ = ("s", "low", "same", "_runs", "_phones")

    def __init__(self, s: str):
        self.s = s
        self.low = s.lower()
        self.same = len(self.low) == len(s)  # else places in the two differ
        self._runs = self._phones = None

    @property
    def runs(self) -> list[tuple[int, int]]:
        if self._runs is None:
            self._runs = [m.span() for m in _RUN.finditer(self.s)]
        return self._runs

    @property
    def phones(self) -> list[re.Match]:
        if self._phones is None:
            self._phones = list(_in_runs(self, _PATTERNS["phone_us"], 2, 10))
        return self._phones


_RUN = re.compile(r"\d[\d(). +-]{5,}\d")


def _in_runs(t: Text, pattern: re.Pattern, lead: int, least: int) -> Iterator[re.Match]:
    """Matches whose digits and separators all lie in one run; the lookaheads see two characters beyond it."""
    for a, b in t.runs:
        if b - a >= least:
            yield from pattern.finditer(t.s, max(0, a - lead), min(len(t.s), b + 2))


def _at_words(*words: str) -> Callable[[Text, re.Pattern], Iterator[re.Match]]:
    """Matches that start with one of the words, in any case."""

    def find(t: Text, pattern: re.Pattern) -> Iterator[re.Match]:
        if not any(w in t.low for w in words):
            return
        if not t.same:
            yield from pattern.finditer(t.s)
            return
        at = []
        for w in words:
            i = t.low.find(w)
            while i >= 0:
                at.append(i)
                i = t.low.find(w, i + 1)
        end = 0
        for i in sorted(set(at)):
            if i >= end and (m := pattern.match(t.s, i)):
                end = m.end()
                yield m

    return find


def _emails(t: Text, pattern: re.Pattern) -> Iterator[re.Match]:
    end, at = 0, t.s.find("@")
    while at >= 0:
        start = at
        while start > end and t.s[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := pattern.match(t.s, start)):
            end = m.end()
            yield m
        at = t.s.find("@", max(at + 1, end))


def _colons(t: Text, pattern: re.Pattern) -> Iterator[re.Match]:
    """A match is a whole run of hexadecimal digits and colons."""
    s, at = t.s, t.s.find(":")
    while at >= 0:
        start, end = at, at + 1
        while start > 0 and s[start - 1] in _HEX:
            start -= 1
        colons = 1
        while end < len(s) and (s[end] == ":" or s[end] in _HEX):
            colons += s[end] == ":"
            end += 1
        if colons > 1 and at - start <= 4 and (m := pattern.match(s, start)):
            yield m
        at = s.find(":", end)


def _macs(t: Text, pattern: re.Pattern) -> Iterator[re.Match]:
    found = []
    for mark in ":-":
        end, at = 0, t.s.find(mark)
        while at >= 0:
            if at - 2 >= end and t.s[at + 3 : at + 4] == mark and (m := pattern.match(t.s, at - 2)):
                found.append(m)
                end = m.end()
            at = t.s.find(mark, at + 1)
    yield from sorted(found, key=lambda m: m.start())


_LETTER_DIGIT = re.compile("(?<=[A-Za-z])[0-9]")


def _codes(t: Text, pattern: re.Pattern) -> Iterator[re.Match]:
    """Words of six letters and more that hold a digit."""
    end = 0
    for d in _LETTER_DIGIT.finditer(t.s):
        start = d.start()
        if start < end:
            continue
        while start > 0 and d.start() - start < 11 and t.s[start - 1] in _LETTERS:
            start -= 1
        if d.start() - start >= 6 and (m := pattern.match(t.s, start)):
            end = m.end()
            yield m


def _births(t: Text, pattern: re.Pattern) -> Iterator[re.Match]:
    if not ("birth" in t.low or "born" in t.low or "dob" in t.low):
        return
    end = 0
    for cue in _BIRTH.finditer(t.s):
        for m in pattern.finditer(t.s, max(end, cue.end()), min(len(t.s), cue.end() + CUE_REACH + DATE_LENGTH)):
            if m.start() > cue.start() + CUE_REACH:
                break
            end = m.end()
            yield m


_NUMBERED = re.compile(r"\d\s+[A-Z]")


def _addresses(t: Text, pattern: re.Pattern) -> Iterator[re.Match]:
    end = 0
    for seed in _NUMBERED.finditer(t.s):
        start = seed.start()
        while start > 0 and seed.start() - start < 6 and t.s[start - 1].isdigit():
            start -= 1
        if start >= end and (m := pattern.match(t.s, start)):
            end = m.end()
            yield m


def _urls(t: Text, pattern: re.Pattern) -> Iterator[re.Match]:
    if not ("http" in t.low or "www." in t.low):
        return
    at = sorted({m.start() for m in _URL_START.finditer(t.s)})
    end = 0
    for i in at:
        if i >= end and (m := pattern.match(t.s, i, min(len(t.s), i + 6 + URL_CLIP))):
            end = m.end()
            yield m


_URL_START = re.compile(r"\b(?:www[.]|https?://)", re.IGNORECASE)


def _vins(t: Text, pattern: re.Pattern) -> Iterator[re.Match]:
    return pattern.finditer(t.s)


ANCHORS: dict[str, Callable[[Text, re.Pattern], Iterator[re.Match]]] = {
    "email": _emails,
    "phone_us": lambda t, p: t.phones,
    "ssn": lambda t, p: _in_runs(t, p, 0, 11),
    "us_driver_license": _at_words("dl", "driver"),
    "credit_card": lambda t, p: _in_runs(t, p, 0, 13),
    "account_number": _at_words("account", "acct"),
    "ip_address": lambda t, p: _in_runs(t, p, 0, 7),
    "ipv6": _colons,
    "url": _urls,
    "date_dob": _births,
    "health_plan_id": _at_words("beneficiary", "dental", "health", "insurance", "medicaid", "medical", "medicare", "vision"),
    "mrn": _at_words("chart", "medical", "mrn"),
    "bank_routing": _at_words("aba", "routing", "rtn", "transit"),
    "vehicle_id": _vins,
    "swift_bic": _at_words("bic", "swift"),
    "swift_bic_bare": _codes,
    "mac_address": _macs,
    "fax": lambda t, p: t.phones if "fax" in t.low or "facsimile" in t.low else (),
    "tax_id": _at_words("ein", "employer", "tax", "tin"),
    "gazetteer": _addresses,
}


# --- confidence


def _bare_reference(t: str, m: re.Match) -> bool:
    return m[0].isdigit() and _REFERENCE.search(t[max(0, m.start() - 32) : m.start()]) is not None


def _phone(t: str, m: re.Match, year: int) -> float | None:
    return 0.85 if nanp(digits_of(m[0])) and not _bare_reference(t, m) else None


def _fax(t: str, m: re.Match, year: int) -> float | None:
    return 0.90 if nanp(digits_of(m[0])) and _FAX.search(t[max(0, m.start() - 40) : m.start()]) and not _bare_reference_in(t, m, 40) else None


def _bare_reference_in(t: str, m: re.Match, reach: int) -> bool:
    return m[0].isdigit() and _REFERENCE.search(t[max(0, m.start() - reach) : m.start()]) is not None


def _card(t: str, m: re.Match, year: int) -> float | None:
    if " " in m[0] and "-" in m[0]:
        return None
    raw = m[0].replace(" ", "").replace("-", "")
    return (0.95 if iin_known(raw) else 0.80) if 13 <= len(raw) <= 19 and luhn(raw) else None


def _ssn(t: str, m: re.Match, year: int) -> float | None:
    h = m[0]
    area, group, serial = h[:3], h[4:6], h[7:11]
    if area in ("000", "666") or not area < "900" or group == "00" or serial == "0000":
        return None
    return 0.70 if " " in h else 0.90


def _ipv4(t: str, m: re.Match, year: int) -> float | None:
    return 0.70 if _OCTET.fullmatch(m[0]) and not _VERSION.search(t[max(0, m.start() - 24) : m.start()]) else None


def _dob(t: str, m: re.Match, year: int) -> float | None:
    return 0.90 if born(m[0], year) and _BIRTH.search(t[max(0, m.start() - 40) : m.start()]) else None


def _if(confidence: float, ok: Callable[[str], bool], group: int = 0) -> Callable[[str, re.Match, int], float | None]:
    return lambda t, m, year: confidence if ok(m[group]) else None


def _enough(k: int) -> Callable[[str], bool]:
    return lambda h: sum(c.isdecimal() for c in h) >= k


def _street(h: str) -> bool:
    kept = re.sub(r"^\d+\s+|\s*\S+$", "", re.sub(r",\s+[A-Z][A-Za-z]+$", "", h))
    return kept.rstrip(" ").lower() not in D.SUFFIXES


CHECKS: dict[str, Callable[[str, re.Match, int], float | None]] = {
    "email": _if(0.95, lambda h: h[0] != "." and h[h.find("@") - 1] != "."),
    "phone_us": _phone, "ssn": _ssn, "credit_card": _card, "ip_address": _ipv4, "date_dob": _dob, "fax": _fax,
    "us_driver_license": _if(0.80, _enough(3), 1), "account_number": _if(0.80, _enough(5), 1), "health_plan_id": _if(0.80, _enough(3), 1), "mrn": _if(0.85, _enough(3), 1),
    "ipv6": _if(0.70, lambda h: not _HEX.isdisjoint(h) and ipv6(h)),
    "url": _if(0.85, lambda h: True),
    "bank_routing": _if(0.90, aba, 1), "vehicle_id": _if(0.90, vin), "swift_bic": _if(0.85, lambda h: _SWIFT.fullmatch(h) is not None, 1),
    "swift_bic_bare": _if(0.85, lambda h: any("0" <= c <= "9" for c in h)), "mac_address": _if(0.90, lambda h: True), "tax_id": _if(0.85, lambda h: ein(digits_of(h)), 1),
    "gazetteer": _if(0.85, _street),
}


def _keyed() -> dict[str, D.Detector]:
    out: dict[str, D.Detector] = {}
    for d in D.registry():
        out[d.name + "_bare" * (d.name in out)] = d
    return out


REGISTRY = _keyed()
_PATTERNS = {k: python_pattern(d.pattern) for k, d in REGISTRY.items()}
_SHAPE = {k: (d.type, f"regex/{d.name}", d.group) for k, d in REGISTRY.items()}

# --- names

_NAME_TOKEN = re.compile(N.TOKEN.replace("(?U)", ""))
_CAPITAL = re.compile("[A-Z]")
_INITIAL = re.compile("[A-Z][.]")
_NAMES = N.FIRST | N.TITLES
_KNOWN = N.FIRST | N.LAST


def _next_tokens(s: str, at: int, n: int) -> list[re.Match]:
    out = []
    while len(out) < n and (m := _NAME_TOKEN.search(s, at)):
        out.append(m)
        at = m.end()
    return out


def person_names(t: Text) -> Iterator[Hit]:
    """Names begin at a first name or a title; only these words and the two tokens after them are looked at."""
    s, low = t.s, t.low if t.same else "".join(c.lower() if len(c.lower()) == 1 else c for c in t.s)
    at = []
    for w in _NAMES.intersection(_WORD.findall(low)):
        i = low.find(w)
        while i >= 0:
            if (i == 0 or not "a" <= low[i - 1] <= "z") and not "a" <= low[i + len(w) : i + len(w) + 1] <= "z":
                at.append(i)
            i = low.find(w, i + 1)
    done = 0
    for i in sorted(at):
        if i < done:
            continue
        # White space is in no token, so tokens can be cut from the last one on.
        start = _cut(s, i)
        for x in _NAME_TOKEN.finditer(s, start):
            if x.end() > i:
                break
        if x.start() != i:
            continue
        x, n, z = (*_next_tokens(s, i, 3), None, None, None)[:3]
        word = x[0].lower().removesuffix(".").rstrip(" ")
        blank = lambda a, b: b.start() > a.end() and s[a.end() : b.start()].isspace()
        end = first = None
        if word in N.TITLES:
            if n and _CAPITAL.match(n[0]) and n[0].lower() in _KNOWN:
                full = z and _CAPITAL.match(z[0]) and z[0].lower() in N.LAST and blank(n, z)
                first, end = n.start(), z.end() if full else n.end()
        elif _CAPITAL.match(x[0]) and word in N.FIRST and n and blank(x, n):
            if z and _INITIAL.fullmatch(n[0]) and _CAPITAL.match(z[0]) and z[0].lower() not in N.NOT_LAST | N.TITLES and blank(n, z):
                first, end = x.start(), z.end()
            elif _CAPITAL.match(n[0]) and n[0].lower() in N.LAST:
                first, end = x.start(), n.end()
        if end is not None:
            done = end
            yield "PERSON_NAME", first, end, s[first:end], N.CONFIDENCE, "regex/gazetteer"


def _cut(s: str, i: int) -> int:
    """The place after the last white space before i."""
    while i > 0 and not s[i - 1].isspace():
        i -= 1
    return i


# --- resolution


def _tier(h: Hit, models: list[Hit]) -> int:
    if not models:
        return 0
    if h[5].startswith("onnx/"):
        return 1
    meets = [m for m in models if m[1] < h[2] and h[1] < m[2]]
    cuts = any(m[0] == h[0] and m[2] - m[1] < h[2] - h[1] for m in meets)
    health = h[0] in X.PHI_SPECIFIC and not any(m[0] in X.PHI_SPECIFIC for m in meets)
    return 0 if h[0] in X.CHECKSUMMED or cuts or health else 2


def resolve(hits: list[Hit]) -> list[Hit]:
    """As operators.resolve.resolve; accepted spans are kept in order of place, so a check is a binary search."""
    models = [h for h in hits if h[5].startswith("onnx/")]
    starts: list[int] = []
    kept: list[Hit] = []
    for h in sorted(set(hits), key=lambda h: (_tier(h, models), -h[4], h[1] - h[2], h[1], h[5], h[2], h[0])):
        at = bisect_left(starts, h[2])  # accepted spans that start before this one ends
        if at and kept[at - 1][2] > h[1]:
            continue
        at = bisect_left(starts, h[1])
        starts.insert(at, h[1])
        kept.insert(at, h)
    return kept


def find(s: str, keys: list[str], with_names: bool, year: int) -> list[Hit]:
    """All detectors' hits in registry order, names last."""
    t, out = Text(s), []
    for k in keys:
        kind, source, group = _SHAPE[k]
        check = CHECKS[k]
        for m in ANCHORS[k](t, _PATTERNS[k]):
            c = check(s, m, year)
            if c is not None:
                out.append((kind, m.start(group), m.end(group), m[group], c, source))
    if with_names:
        out.extend(person_names(t))
    return out


_FIELDS = [("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()), ("detector", pa.string())]


def _array(rows: Iterable[list[Hit]]) -> pa.ListArray:
    offsets, flat = [0], []
    for r in rows:
        flat += r
        offsets.append(len(flat))
    columns = list(zip(*flat)) if flat else [()] * len(_FIELDS)
    items = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [n for n, _ in _FIELDS])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def _each(one: Callable[..., list[Hit]], *columns: pa.Array) -> pa.ListArray:
    """The hits of a batch, a row at a time: only one text is a Python string at once."""
    return _array(one(*(x.as_py() for x in row)) for row in zip(*columns))


def keys_of(chosen: list[D.Detector]) -> list[str] | None:
    """Keys of registered detectors, or None where one isn't registered or was changed."""
    keys = [next((k for k, r in REGISTRY.items() if (r.name, r.type, r.pattern, r.group) == (d.name, d.type, d.pattern, d.group)), None) for d in chosen]
    return None if None in keys else keys


def entities(text: Column, year: Column, keys: list[str] | None = None, with_names: bool = True, extra: Column | None = None, resolved: bool = True) -> Column:
    """The spans of each text, resolved or as found. year: the last year of birth; extra: spans to be fused in."""
    chosen = list(REGISTRY) if keys is None else keys

    def one(s: str | None, y: int, more: list[dict] | None = None) -> list[Hit]:
        hits = find(s, chosen, with_names, y) if s else []
        hits += [tuple(m[n] for n, _ in _FIELDS) for m in more or ()]
        return resolve(hits) if resolved else list(dict.fromkeys(hits))

    if extra is None:

        @F.arrow_udf(f"array<{SPAN}>")
        def scan(texts: pa.Array, years: pa.Array) -> pa.Array:
            return _each(one, texts, years)

        return scan(text, year)

    @F.arrow_udf(f"array<{SPAN}>")
    def fused(texts: pa.Array, years: pa.Array, spans: pa.Array) -> pa.Array:
        return _each(one, texts, years, spans)

    return fused(text, year, extra)
