"""The full name key in SQL, for an engine without compatibility normalisation."""

from __future__ import annotations

import unicodedata

RANGES = ((0xA0, 0x250), (0x2100, 0x2190), (0x2460, 0x2500), (0x2E80, 0x2FE0), (0x3000, 0x3001), (0x3131, 0x3190), (0x3200, 0x3400), (0xF900, 0xFB07), (0xFE30, 0xFE70), (0xFF01, 0xFFEF), (0x1D400, 0x1D800))


def _forms() -> tuple[str, str, dict[str, str]]:
    one, many = {}, {}
    for lo, hi in RANGES:
        for c in map(chr, range(lo, hi)):
            form = unicodedata.normalize("NFKC", c).casefold()
            if len(form) == 1 and form != c:
                one[c] = form
            elif form != c and (0x2160 <= ord(c) < 0x2190 or 0xFB00 <= ord(c) < 0xFB07 or c == "ß"):
                many[c] = form
    return "".join(one), "".join(one.values()), dict(sorted(many.items(), key=lambda kv: -len(kv[1])))


def name_key_sql(expression: str) -> str:
    """Compatibility forms of one character by a table, numerals and ligatures one by one, composed marks, lower case, letters and digits alone."""
    one, to, many = _forms()
    out = f"translate({expression}, '{one}', '{to.replace(chr(39), chr(39) * 2)}')"
    for c, form in many.items():
        out = f"replace({out}, '{c}', '{form}')"
    return rf"regexp_replace(lower(nfc_normalize({out})), '[\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', '', 'g')"
