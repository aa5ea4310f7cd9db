"""Texts that look alike as SQL for DuckDB: by one letter for each group of look-alikes, not by paths."""

from __future__ import annotations

import unicodedata

from .lookalike import _WIDTHS, ALIKE


def _stand_ins() -> tuple[str, str]:
    """Letters, accented ones too, and the letters that stand for their groups."""
    stand = {c: g[0] for g in ALIKE for c in g}
    of, to = [], []
    for o in [*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFD", chr(o))
        if base[0] in stand and stand[base[0]] != base[0]:
            other = unicodedata.normalize("NFC", stand[base[0]] + base[1:])
            if len(other) == 1:
                of.append(chr(o)), to.append(other)
    return "".join(of), "".join(to)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _look() -> str:
    """An expression of ``text``: equal for texts that look the same."""
    one = {c: to for c, to in _WIDTHS.items() if len(to) == 1}
    out = f"translate(text, {_quoted(''.join(map(chr, one)))}, {_quoted(''.join(one.values()))})"
    for c, to in _WIDTHS.items():
        if len(to) > 1:
            out = f"replace({out}, {_quoted(chr(c))}, {_quoted(to)})"
    gone = r"[\x{00ad}\x{034f}\x{061c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}\x{fff9}-\x{fffb}]"
    out = f"regexp_replace({out}, '{gone}', '', 'g')"
    # joiners and selectors stay where they shape: after letters of such scripts, between pictures
    shaped = r"\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Malayalam}\p{Kannada}\p{Telugu}\p{Tamil}\p{Sinhala}"
    picture = r"\x{00a9}\x{00ae}\x{203c}\x{2049}\x{2122}\x{2139}\x{2190}-\x{21ff}\x{2300}-\x{23ff}\x{25a0}-\x{27bf}\x{2900}-\x{297f}\x{2b00}-\x{2bff}\x{1f000}-\x{1faff}"
    for _ in range(2):  # neighbours overlap
        out = f"regexp_replace({out}, '(^|[^{shaped}])\\x{{200c}}+', '\\1', 'g')"
        out = f"regexp_replace({out}, '(^|[^{shaped}{picture}\\x{{fe0f}}])\\x{{200d}}+', '\\1', 'g')"
        out = f"regexp_replace({out}, '\\x{{200d}}+($|[^\\p{{L}}\\p{{M}}{picture}])', '\\1', 'g')"
        out = f"regexp_replace({out}, '(^|[^{picture}])[\\x{{fe00}}-\\x{{fe0f}}]+', '\\1', 'g')"
    of, to = _stand_ins()
    return f"nfc_normalize(translate(nfc_normalize({out}), {_quoted(of)}, {_quoted(to)}))"


_LOOKS = rf"""WITH looks AS (SELECT doc_id, text, {_look()} AS look FROM documents WHERE text IS NOT NULL),
seen AS (SELECT * FROM looks WHERE regexp_matches(look, '[^\s\p{{C}}\p{{Z}}\p{{Mn}}\x{{115f}}\x{{1160}}\x{{3164}}\x{{ffa0}}\x{{2800}}]')),
several AS (SELECT look, min(doc_id) AS class, count(*) AS n_rows, count(DISTINCT text) AS n_texts FROM seen GROUP BY look HAVING count(DISTINCT text) > 1)"""

ORACLE = {
    "p10_found": f"{_LOOKS} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM seen a JOIN several USING (look) JOIN seen b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_classes": f"{_LOOKS} SELECT doc_id, class, min(doc_id) OVER (PARTITION BY look, text) AS text, n_rows, n_texts FROM seen JOIN several USING (look)",
}
