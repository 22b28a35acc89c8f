"""Personal data: plain patterns, and the same patterns after an offset-preserving deobfuscation.

A transducer rewrites disguises (homoglyphs and full-width forms, zero-width characters, spelled digits, "at" and "dot") and keeps, for every
character it writes, the source characters it stands for. "dot" is rewritten between digits in any text, between other words only in a text with an
"@". Four numbers, in digits or spelled, joined by three "dot" or "point" are rewritten as a whole. Identifiers found in the rewritten text are mapped back to spans of the source. A span so
found is added if it overlaps none of its kind that the plain patterns have found.

Null and empty texts have no spans. Offsets are code points, end exclusive. Every search is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame

from .kernels import map_texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_HINT = re.compile(r"[0-9]\.[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(s: str) -> list[tuple[int, int]]:
    """One match can hold one @ only: its local part is the run of local characters before it, after the last match."""
    out, last, at = [], 0, s.find("@")
    while at >= 0:
        a = at
        while a > last and s[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(s, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = s.find("@", last)
    return out


def ips(s: str) -> list[tuple[int, int]]:
    if not IP_HINT.search(s):
        return []
    return [m.span() for m in IP.finditer(s) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(s: str) -> list[tuple[int, int]]:
    return [m.span() for m in CARD.finditer(s) if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(s: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(s) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15] if "+" in s else []


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def plain(s: str) -> dict[str, list[tuple[int, int]]]:
    return {k: f(s) for k, f in FINDERS.items()}


#: Letters that look like ASCII ones.
LOOKALIKES = dict(zip("АВЕКМНОРСТХавекмнорстхуіјѕԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν", "ABEKMHOPCTXabekmhopctxyijsdABEZHIKMNOPTYXoiv", strict=True))
LOOKALIKES |= dict.fromkeys("‐‑‒–—−﹣", "-") | dict.fromkeys("․。．｡", ".") | dict.fromkeys("﹫＠", "@") | dict.fromkeys("    ", " ")
REMOVED = "​‌‍⁠﻿­"


def _ascii_form(c: str) -> str | None:
    """The ASCII character that c disguises; '' to drop c; None to keep it."""
    if c in REMOVED:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if 0xFF01 <= ord(c) <= 0xFF5E:
        return chr(ord(c) - 0xFEE0)
    d = unicodedata.decimal(c, None)
    return str(d) if d is not None else None


DISGUISED = re.compile("[^\x00-\x7fÀ-ɏ]")
#: Spelled digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_D = "(?:" + "|".join(DIGITS) + ")"
SPELLED = re.compile(rf"(?:\bplus[\s-]{{0,3}})?\b{_D}(?:[\s,-]{{1,3}}(?:{_D}|dot|point))+\b", re.I)
SPELLED_HINT = re.compile(rf"\b{_D}[\s,-]{{1,3}}(?:{_D}|dot|point)\b", re.I)
TOKEN = re.compile(rf"plus|{_D}|dot|point", re.I)
NUMBER_TOKEN = re.compile(rf"[0-9]+|{_D}|dot|point", re.I)
ASCII_DIGITS = frozenset("0123456789")
BRACKETED = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(at|dot)[ \t]{0,3}[\])}>][ \t]{0,3}", re.I)
WORDED = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,3}at[ \t]{1,3}(?=[A-Za-z0-9-]{1,63}(?:[ \t]{1,3}dot[ \t]{1,3}[A-Za-z0-9-]{1,63}){1,8}\b)", re.I)
DOTTED = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,3}dot[ \t]{1,3}(?=[A-Za-z0-9])", re.I)
_N = rf"(?:[0-9]{{1,9}}|{_D}(?:[\s,-]{{1,3}}{_D}){{0,2}})"
NUMBERS = re.compile(rf"\b{_N}(?:[\s,-]{{1,3}}(?:dot|point)[\s,-]{{1,3}}{_N}){{3}}\b(?![\s,-]{{1,3}}{_D}\b)", re.I)
NUMBERS_HINT = re.compile(rf"[\s,-](?:dot|point)[\s,-]{{1,3}}(?:[0-9]|{_D})", re.I)

Piece = tuple[str, int, int]


class Tape:
    """Text with, for each character, the source span that it stands for."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None) -> None:
        self.text = text
        self.start = start if start is not None else list(range(len(text)))
        self.end = end if end is not None else list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """edits: ascending, disjoint (from, to, new text); the new characters all stand for the whole replaced part."""
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a]
            end += self.end[at:a]
            if b > a:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Tape("".join(text), start + self.start[at:], end + self.end[at:])


def _joined(m: re.Match, words: list[re.Match]) -> list[tuple[int, int, str]]:
    """The words of the run as digits, each written over its own word, so that spans keep their exact ends."""
    out, at = [], 0
    for w in words:
        new = w[0] if w[0].isdigit() else DIGITS.get(w[0].lower()) or ("+" if w[0].lower() == "plus" else ".")
        if w.start() > at:
            out.append((m.start() + at, m.start() + w.start(), ""))
        if new != w[0]:
            out.append((m.start() + w.start(), m.start() + w.end(), new))
        at = w.end()
    return out


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    words = list(TOKEN.finditer(m[0]))
    return _joined(m, words) if sum(w[0].lower() in DIGITS for w in words) >= 3 else []


def _numbers(m: re.Match) -> list[tuple[int, int, str]]:
    """Only runs with a number in digits; those wholly spelled are left to _spelled, which knows their surroundings."""
    words = list(NUMBER_TOKEN.finditer(m[0]))
    return _joined(m, words) if any(w[0].isdigit() for w in words) else []


def _dots(t: str) -> list[tuple[int, int, str]]:
    everywhere = "@" in t
    return [(m.start(), m.end(), ".") for m in DOTTED.finditer(t) if everywhere or (t[m.start() - 1] in ASCII_DIGITS and t[m.end()] in ASCII_DIGITS)]


def deobfuscate(s: str) -> Tape | None:
    """s rewritten, or None if it holds no disguise."""
    tape = None
    if not s.isascii() and DISGUISED.search(s):
        edits = [(m.start(), m.end(), f) for m in DISGUISED.finditer(s) if (f := _ascii_form(m[0])) is not None]
        if "­" in s:
            edits = sorted(edits + [(m.start(), m.end(), "") for m in re.finditer("­", s) if not any(e[0] == m.start() for e in edits)])
        tape = Tape(s).rewrite(edits) if edits else None
    now = tape.text if tape else s
    for hint, edits_of in (
        (NUMBERS_HINT, lambda t: [e for m in NUMBERS.finditer(t) for e in _numbers(m)]),
        (SPELLED_HINT, lambda t: [e for m in SPELLED.finditer(t) for e in _spelled(m)]),
        (BRACKETED, lambda t: [(m.start(), m.end(), "@" if m[1].lower() == "at" else ".") for m in BRACKETED.finditer(t)]),
        (DOTTED, lambda t: [(m.start(), m.end(), "@") for m in WORDED.finditer(t)]),
        (DOTTED, _dots),
    ):
        if hint.search(now):
            edits = edits_of(now)
            if edits:
                tape = (tape or Tape(s)).rewrite(edits)
                now = tape.text
    return tape


def spans(s: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans, and those that deobfuscation adds, by kind."""
    base = plain(s)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    tape = deobfuscate(s)
    if tape:
        for kind, found in plain(tape.text).items():
            old = sorted(base[kind])
            i = 0
            for a, b in found:
                x, y = tape.start[a], tape.end[b - 1]
                while i < len(old) and old[i][1] <= x:
                    i += 1
                if i == len(old) or old[i][0] >= y:
                    added[kind].append((x, y))
    return base, added


def _written(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(found[k]))


COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan_texts(texts: list[bytes]) -> dict[str, list]:
    out: dict[str, list] = {c.split()[0]: [] for c in COLUMNS.split(", ")}
    for t in texts:
        base, added = spans(t.decode("utf-8", "replace"))
        for k in KINDS:
            out[f"n_{k}"].append(len(base[k]))
        out["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
        out["spans"].append(_written({k: base[k] + added[k] for k in KINDS}))
        out["n_added"].append(sum(map(len, added.values())))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and COLUMNS (counts are of the plain spans)."""
    return map_texts(docs, scan_texts, COLUMNS, id_col, text_col)
