"""Personal data by anchor expansion (operator 2).

An Aho-Corasick automaton walks each whole text once and reports anchors: at-signs, digits, plus signs,
``://`` and ``mailto:``/``tel:`` schemes, and identifier cues (IBAN, account and street words). Around an
anchor a small deterministic parser finds where the item begins and ends and checks it. The base kinds give
exactly the leftmost non-overlapping matches of their patterns; the added kinds are

* ``link``: a URL (scheme of at most ten characters) that carries a user name, or a ``mailto:``/``tel:`` target;
* ``iban``: a cue followed by an account number whose check digits are right;
* ``account``: a cue followed by 6 to 17 digits;
* ``address``: a house number (up to five digits and a letter) and a street of one to three capitalised names, in any
  letters: number, names, street word (221 Baker St.); number, street word, names (12 bis, rue de l'Église); street word,
  names, number (Calle de Alcalá, 42); or one capitalised word that ends in a street word, and a number (Hauptstraße 5).
  The words are those of ``_STREETS``, ``_RUES``, ``_CALLES`` and ``_STREETS_BEFORE_NUMBER``. Names may be of any length.

Defined results: a null text is an empty one (no spans); a null ``doc_id`` is kept; repeated rows give
repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "link", "iban", "account", "address")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_RUN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,9}\Z")
_USERINFO = re.compile(r"[^\s/?#@<>\"']+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s<>\"']*")
_TARGET = re.compile(r"[^\s<>\"',;]*[A-Za-z0-9]")
_IBAN = re.compile(r"[\s:#.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[\s.]{0,2}(?:number|num|no|nr))?[\s.:#=]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.IGNORECASE)
_HOUSE = re.compile(r"(?:\A|(?<=[\s,;(]))[0-9]{1,5}[A-Za-z]?(?: (?:bis|ter|quater))?,? \Z")
_HOUSE_CHARS = 17  # of the longest house number that _HOUSE takes: five digits, a letter, " quater", a comma, a space
_HOUSE_AFTER = re.compile(r"[a-z]{0,12} [0-9]{1,5}[A-Za-z]?(?![0-9A-Za-z])")

_NAME = r"\p{Lu}[\p{L}\p{M}'’-]*+"
_LINKS = r"(?:(?:de|du|des|la|le|les|del|los|las|el|y) |[dl]['’]){0,3}"
_NAMES = rf" {_LINKS}{_NAME}(?: {_LINKS}{_NAME}){{0,2}}"
_RUE_NAMES = regex.compile(_NAMES)
_CALLE_NAMES = regex.compile(rf"{_NAMES}(?:,| n\.?[º°])? [0-9]{{1,5}}[A-Za-z]?(?![\p{{L}}0-9])")

# A street word after the names may be cut short with a point, the last two only with it ("St" alone is a saint).
_STREETS = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Ave", "Rd", "Blvd", "Drive", "St.", "Ln.")
_RUES = ("rue", "avenue", "boulevard", "place", "chemin", "allée", "quai", "impasse", "cours", "passage")
_CALLES = ("calle", "avenida", "plaza", "paseo", "carretera", "travesía", "glorieta")
_STREETS_BEFORE_NUMBER = ("straße", "strasse")
_ACCOUNTS = ("account", "acct", "konto", "compte", "cuenta")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for word, what in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("mailto:", "target"), ("tel:", "target"), ("IBAN", "iban")):
        a.add_word(word, (what, len(word)))
    for word in _ACCOUNTS:
        for form in (word, word.capitalize(), word.upper()):
            a.add_word(form, ("account", len(form)))
    for word in (w for word in _RUES for w in (word, word.capitalize())):
        a.add_word(word, ("rue", len(word)))
    for word in (w for word in _CALLES for w in (word, word.capitalize())):
        a.add_word(word, ("calle", len(word)))
    for word in _STREETS:  # Avenue and Boulevard stand on either side of the names
        a.add_word(word, ("street", len(word)))
    for word in _STREETS_BEFORE_NUMBER:
        a.add_word(word, ("strasse", len(word)))
    a.make_automaton()
    return a


class Finder:
    """Spans of one text: a list of (start, kind index, end), end exclusive, in code points."""

    def __init__(self):
        self._anchors = _automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        free = [0] * len(KINDS)  # per kind: where the next match may begin
        for last, (what, length) in self._anchors.iter(text):
            at = last - length + 1
            if what == "digit":
                if at >= free[1]:
                    if m := _IP.match(text, at):
                        free[1] = m.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                            found.append((at, 1, m.end()))
                    else:  # every other start in this run of digits meets the same dots
                        free[1] = _RUN.match(text, at).end()
                if at >= free[2]:
                    if m := _CARD.match(text, at):
                        free[2] = m.end()
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            found.append((at, 2, m.end()))
                    else:
                        free[2] = at + 1
            elif what == "at":
                start = at
                while start > free[0] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    free[0] = m.end()
                    found.append((start, 0, m.end()))
            elif what == "plus":
                if at >= free[3] and (m := _PHONE.match(text, at)):
                    free[3] = m.end()
                    if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                        found.append((at, 3, m.end()))
            elif what == "scheme":
                if at >= free[4] and (m := _SCHEME.search(text, max(free[4], at - 10), at)) and (u := _USERINFO.match(text, last + 1)):
                    self._add(found, free, 4, m.start(), u.end())
            elif what == "target":
                if at >= free[4] and not (at and text[at - 1].isalnum()) and (m := _TARGET.match(text, last + 1)):
                    self._add(found, free, 4, at, m.end())
            elif what == "iban":
                if m := _IBAN.match(text, last + 1):
                    if m.start(1) >= free[5] and iban_valid(m[1]):
                        self._add(found, free, 5, m.start(1), m.end(1))
            elif what == "account":
                if not (at and text[at - 1].isalpha()) and (m := _ACCOUNT.match(text, last + 1)) and m.start(1) >= free[6]:
                    self._add(found, free, 6, m.start(1), m.end(1))
            elif what in ("street", "rue", "calle"):
                if span := self._address(text, what, at, last + 1, free[7]):
                    self._add(found, free, 7, *span)
            elif m := _HOUSE_AFTER.match(text, last + 1):
                start = at
                while start > free[7] and text[start - 1].isalpha():
                    start -= 1
                if text[start].isupper():
                    self._add(found, free, 7, start, m.end())
        found.sort()
        return found

    @staticmethod
    def _house(text: str, at: int, free: int) -> int | None:
        """Where the house number that ends right before ``at`` begins."""
        m = _HOUSE.search(text, max(free, at - _HOUSE_CHARS), at)
        return m.start() if m else None

    def _address(self, text: str, what: str, at: int, end: int, free: int) -> tuple[int, int] | None:
        """The address around the street word text[at:end], not before ``free``."""
        if at and text[at - 1].isalnum() or text[end - 1] != "." and end < len(text) and text[end].isalnum():
            return None
        if what == "calle":
            m = _CALLE_NAMES.match(text, end)
            return (at, m.end()) if m else None
        if what == "street":
            word, names = at, 0
            while names < 3 and word > free and text[word - 1] == " ":  # one name further to the left
                begin = word - 1
                while begin > free and (text[begin - 1].isalpha() or text[begin - 1] in "'’-"):
                    begin -= 1
                if word - 1 - begin < 2 or not text[begin].isupper():
                    break
                word, names = begin, names + 1
                if (start := self._house(text, word, free)) is not None:
                    point = text[at:end] in ("Ave", "Rd", "Blvd") and text.startswith(".", end)
                    return start, end + point
        if (what == "rue" or text[at:end].lower() in _RUES) and (start := self._house(text, at, free)) is not None:
            m = _RUE_NAMES.match(text, end)
            return (start, m.end()) if m else None
        return None

    @staticmethod
    def _add(found: list, free: list[int], kind: int, start: int, end: int) -> None:
        found.append((start, kind, end))
        free[kind] = end


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every run of overlapping spans replaced by the name of the first one's kind in brackets."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i < len(spans) and (spans[i][0] < end or spans[i][0] == start):
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans (an array of kind, start, end in order of start, then kind)."""
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, kind = Finder(), pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in finder.spans(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def digest(docs: DataFrame) -> DataFrame:
    """Query form: counts of the base kinds, their digest, and all spans as text."""
    found = find(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [_count("spans", kind).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(text: Column) -> Column:
    """The text with personal data replaced (null stays null)."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder()
        for part in parts:
            yield pa.array([None if (t := x.as_py()) is None else redact_text(t, finder.spans(t)) for x in part], pa.string())

    return run(text)
