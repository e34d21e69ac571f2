"""MARC-8 to Unicode and back.

Sets: ASCII, ANSEL, Greek symbols, sub- and superscripts, Basic Greek and Hebrew, Basic and Extended
Cyrillic and Arabic.  The East Asian set has some 16,000 characters, so its table is a parameter: the
file of code tables that the Library of Congress publishes (:func:`codetable`).  Without it East Asian
characters decode to U+FFFD and are written as character references.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

ESC = 0x1B

# The ANSEL graphics at A1-C8 and combining marks at E0-FE.
_ANSEL = dict(zip([*range(0xA1, 0xAF), *range(0xB0, 0xBB), 0xBC, 0xBD, *range(0xC0, 0xC9)], "ŁØĐÞÆŒʹ·♭®±ƠƯʼʻłøđþæœʺı£ðơư°ℓ℗©♯¿¡ß€", strict=True))
_MARKS = dict(zip([*range(0xE0, 0xFC), 0xFE], map(chr, [0x309, 0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x30C, 0x30A, 0xFE20, 0xFE21, 0x315, 0x30B, 0x310, 0x327, 0x328, 0x323, 0x324, 0x325, 0x333, 0x332, 0x326, 0x31C, 0x32E, 0xFE22, 0xFE23, 0x313]), strict=True))

_COMMON = {c: chr(c) for c in range(0x20, 0x40)}


def _runs(*runs: tuple[int, str]) -> dict[int, str]:
    """Runs of characters by the code of their first."""
    return {first + k: c for first, text in runs for k, c in enumerate(text)}


# Basic Greek, Extended Cyrillic and Extended Arabic in the order of their codes.
_GREEK = _runs((0x21, "\u0300\u0301\u0308\u0342\u0313\u0314\u0345"), (0x30, "«»“”\u0374͵"), (0x3B, "\u0387"), (0x3F, "\u037e"), (0x41, "ΑΒ"), (0x44, "ΓΔΕϚϜΖΗΘΙΚΛΜΝΞΟΠϞΡΣ"), (0x58, "ΤΥΦΧΨΩϠ"), (0x61, "αβϐγδεϛϝζηθικλμνξοπϟρσςτυφχψωϡ"))
_MORE_CYRILLIC = _runs((0x40, "ґђѓєёѕіїјљњћќўџ"), (0x50, "ѣѳѵѫ"), (0x5B, "["), (0x5D, "]"), (0x5F, "_ҐЂЃЄЁЅІЇЈЉЊЋЌЎЏЪѢѲѴѪ"))
_MORE_ARABIC = _runs((0x21, "۽ٲٳٹٺٻټٽپٿڀځڂڃڄڅچڿڇڈډڊڋڌڍڎڏڐڑڒړڔڕږڗژڙښڛڜۺڝڞۻڟڠۼڡڢڣڤڥڦڧڨکڪګڬڭڮگڰڱڲڳڴڵڶڷڸںڻڼڽڹھۀۄۅۆۊۋۍێېےۓ"), (0x7D, "\u0306\u030c"))
SETS: dict[int, dict[int, str]] = {
    0x42: {c: chr(c) for c in range(0x20, 0x7F)},
    0x45: {c & 0x7F: v for c, v in (_ANSEL | _MARKS).items()},
    0x67: dict(zip(b"abc", "αβγ", strict=True)),
    0x62: dict(zip(b"()+-0123456789", "₍₎₊₋₀₁₂₃₄₅₆₇₈₉", strict=True)),
    0x70: dict(zip(b"()+-0123456789", "⁽⁾⁺⁻⁰¹²³⁴⁵⁶⁷⁸⁹", strict=True)),
    0x32: _COMMON | {0x60 + k: chr(0x5D0 + k) for k in range(27)},
    0x4E: _COMMON | {0x40 + k: bytes([0xC0 + k]).decode("koi8_r") for k in range(0x3F)},
    0x53: _GREEK | {0x20: " "},
    0x51: _MORE_CYRILLIC | {0x20: " "},
    0x34: _MORE_ARABIC | {0x20: " "},
    0x33: _COMMON | {0x2C: "،", 0x3B: "؛", 0x3F: "؟"} | {0x30 + k: chr(0x660 + k) for k in range(10)} | {0x41 + k: chr(0x621 + k) for k in range(26)} | {0x60 + k: chr(0x640 + k) for k in range(19)},
}
_PLACES = {}
for _final in (0x34, 0x51, 0x53, 0x33, 0x32, 0x4E, 0x70, 0x62, 0x67, 0x45, 0x42):
    _PLACES |= {v: (_final, c) for c, v in SETS[_final].items()}
_ESCAPES = re.compile(rb"\x1b(?:([gbps])|([(,])(?:!?)(.)|([)\-])(?:!?)(.)|\$[,(]?(.)|\$[)\-](.))", re.DOTALL)


# Marks over two letters: halves before either letter here, one mark between them in Unicode.
_HALVES = [("\ufe20", "\ufe21", "\u0361"), ("\ufe22", "\ufe23", "\u0360")]
_LETTER = "[^\u0300-\u036f\ufe20-\ufe23][\u0300-\u036f]*"


@cache
def codetable(path: str) -> dict[int, str]:
    """East Asian codes (three bytes as one number) of a code table file: XML with ``marc`` and ``ucs``
    elements, or lines of two hexadecimal numbers."""
    from ..sources.datasource import read_bytes

    text = read_bytes(path).decode("utf-8", "replace")
    found = re.findall(r"<marc>\s*([0-9A-Fa-f]{6})\s*</marc>(?:(?!</code>).)*?<ucs>\s*([0-9A-Fa-f]{4,6})\s*</ucs>", text, re.DOTALL)
    found = found or re.findall(r"(?m)^\s*([0-9A-Fa-f]{6})[\s,;]+(?:U\+)?([0-9A-Fa-f]{4,6})\b", text)
    return {int(code, 16): chr(int(char, 16)) for code, char in found}


@cache
def _east_places(path: str) -> dict[str, int]:
    return {char: code for code, char in sorted(codetable(path).items(), reverse=True)}


def decode(raw: bytes, table: str | None = None) -> str:
    """Never fails; marks, which precede their letter, end up after it, in composed form."""
    g0, g1, out, marks, at = 0x42, 0x45, [], [], 0
    while at < len(raw):
        b = raw[at]
        if b == ESC and (m := _ESCAPES.match(raw, at)):
            if m[1]:
                g0 = 0x42 if m[1] == b"s" else m[1][0]
            elif m[2] or m[6]:
                g0 = (m[3] or m[6])[0]
            else:
                g1 = (m[5] or m[7])[0]
            at = m.end()
            continue
        at += 1
        if b < 0x20:
            out += [chr(b), *marks]
            marks = []
            continue
        final = g1 if b & 0x80 else g0
        if final == 0x31 and b != 0x20:
            code = int.from_bytes(bytes(x & 0x7F for x in raw[at - 1 : at + 2]))
            char, at = codetable(table).get(code, "�") if table else "�", at + 2
        else:
            char = " " if final == 0x31 else SETS.get(final, {}).get(b & 0x7F, "�")
        if unicodedata.combining(char):
            marks.append(char)
        else:
            out += [char, *marks]
            marks = []
    text = unicodedata.normalize("NFC", "".join(out + marks))
    for left, right, whole in _HALVES:
        if left in text:
            text = re.sub(f"{left}([\u0300-\u036f]*{_LETTER}){right}", rf"{whole}\1", text)
    return text


def encode(text: str, table: str | None = None) -> bytes:
    """MARC-8 bytes; characters of no set become ``&#xHHHH;`` and G0 ends as ASCII."""
    out, g0 = bytearray(), 0x42
    for left, right, whole in _HALVES:
        if whole in text:
            text = re.sub(f"{whole}([\u0300-\u036f]*{_LETTER})", rf"{left}\1{right}", text)
    east = _east_places(table) if table else {}
    pieces = re.findall(r"(?s)[^̀-ͯ︠-︣][̀-ͯ︠-︣]*|[̀-ͯ︠-︣]+", unicodedata.normalize("NFD", text))

    def put(char: str) -> None:
        nonlocal g0
        if ord(char) < 0x20:
            out.append(ord(char))
            return
        final, code = _PLACES.get(char, (None, 0))
        if final == 0x45:
            out.append(code | 0x80)
            return
        if final is not None and g0 != final and code in SETS.get(g0, {}) and SETS[g0][code] == char:
            final = g0
        if final is None and char in east:
            if g0 != 0x31:
                out.extend(b"\x1bs" if g0 in (0x62, 0x67, 0x70) else b"")
                out.extend(b"\x1b$1")
                g0 = 0x31
            out.extend(east[char].to_bytes(3))
            return
        if final is None:
            for c in f"&#x{ord(char):04X};":
                put(c)
            return
        if final != g0:
            out.extend(b"\x1bs" if final == 0x42 and g0 in (0x62, 0x67, 0x70) else bytes([ESC, final]) if final in (0x62, 0x67, 0x70) else bytes([ESC, 0x28, final]))
            g0 = final
        out.append(code)

    for piece in pieces:
        known = [m for m in piece[1:] if _PLACES.get(m, (0,))[0] == 0x45]
        if len(known) < len(piece) - 1 and unicodedata.normalize("NFC", piece) in _PLACES:
            known, piece = [], unicodedata.normalize("NFC", piece)
        for m in known:
            put(m)
        put(piece[0])
        for m in piece[1:]:
            if m not in known:
                put(m)
    if g0 != 0x42:
        out.extend(b"\x1bs" if g0 in (0x62, 0x67, 0x70) else b"\x1b(B")
    return bytes(out)
