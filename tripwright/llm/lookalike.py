"""Texts that look alike in different characters, brought to one form so that they compare as equal.

Widths, ligatures and spaces are unified, ignorable characters deleted and accents composed; then each word is a
lattice of the letters that look like each of its letters, in Latin, Greek and Cyrillic, and Viterbi takes
the path that letter pairs of the corpus make likeliest and that changes script least. The lattice
depends on the look of the word alone, so words that look alike get the same path.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import _texts

# Letters that look alike, one group a word: Latin, then Greek and Cyrillic.
ALIKE = """
aа cϲс dԁ eе hһ iі jј lӏ oοо pр qԛ sѕ vνѵ wԝ xх yу
AΑА BΒВ CϹС EΕЕ GԌ HΗН IΙІӀ JЈ KΚК MΜМ NΝ OΟО PΡР QԚ SЅ TΤТ WԜ XΧХ YΥҮ ZΖ
""".split()

#: A change of script within a word costs as much as so many nats of letter pairs.
SWITCH = 12.0
#: Counts added to every letter pair.
SMOOTH = 0.5
#: Words kept per worker before the memory of them starts afresh.
REMEMBERED = 200_000

_GROUP = {c: g for g in ALIKE for c in g}
_EDGE = "\u0000"  # before the first and after the last letter of a word


def _widths() -> dict[int, str]:
    """Characters with a compatibility form that looks the same, to that form; spaces to the space."""
    spans = [(0xFF01, 0xFFEF), (0xFB00, 0xFB07), (0x2160, 0x2180), (0x0132, 0x0134), (0x01C4, 0x01CD), (0x01F1, 0x01F4), (0xB5, 0xB6)]
    table = {}
    for a, b in spans:
        for c in range(a, b):
            to = unicodedata.normalize("NFKC", chr(c))
            if to != chr(c):
                table[c] = to
    table[0xFF9E], table[0xFF9F] = "\u3099", "\u309a"  # half-width voicing marks combine
    for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]:
        table[c] = " "
    table[0x2010] = table[0x2011] = "-"
    return table


_WIDTHS = _widths()
# joiners shape letters of these scripts and join pictures; selectors choose the form of pictures
_IGNORED = regex.compile(
    r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200e\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb]"
    r"|(?<![\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Malayalam}\p{Kannada}\p{Telugu}\p{Tamil}\p{Sinhala}])\u200c"
    r"|(?<![\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Malayalam}\p{Kannada}\p{Telugu}\p{Tamil}\p{Sinhala}\p{Extended_Pictographic}\p{Emoji_Modifier}\ufe0f])\u200d"
    r"|\u200d(?![\p{L}\p{M}\p{Extended_Pictographic}])"
    r"|(?<!\p{Extended_Pictographic})[\ufe00-\ufe0f]"
)
# characters that _IGNORED or _WIDTHS may touch: most texts have none
_MAY_GO = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb]")
_MAY_CHANGE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_WIDTHS)) + "]")
# The blocks of letters (Latin, marks, Greek, Cyrillic) of which words consist, as one class for both engines.
_LETTERS = "A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u1d00-\u1dbf\u1e00-\u1eff\u0300-\u036f\u0370-\u03ff\u1f00-\u1fff\u0400-\u052f"
_WORD = re.compile(f"[{_LETTERS}]+")
_BETWEEN = f"[^{_LETTERS}]+"
_VISIBLE = regex.compile(r"[^\s\p{C}\p{Z}\p{Mn}\u115f\u1160\u3164\uffa0\u2800]")


def prepared(text: str) -> str:
    """Compatibility forms unified, ignorable characters deleted, accents apart (NFD)."""
    if text.isascii():
        return text
    if _MAY_CHANGE.search(text):
        text = _MAY_CHANGE.sub(lambda m: _WIDTHS[ord(m[0])], text)
    if _MAY_GO.search(text):
        text = _IGNORED.sub("", text)
    return unicodedata.normalize("NFD", text)


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """Words of prepared texts one after another, and where those of each text begin; without blank ones."""
    lists = pc.split_pattern_regex(pa.array(texts, pa.large_string()), _BETWEEN)
    flat, offsets = lists.values, lists.offsets.to_numpy()
    full = np.asarray(pc.not_equal(flat, ""))
    return flat.filter(pa.array(full)), np.r_[0, np.cumsum(full)][offsets]


def visible(text: str) -> bool:
    """Whether ``text`` has a character that can be seen."""
    return _VISIBLE.search(text) is not None


def script(c: str) -> int:
    """0 Latin, 1 Greek, 2 Cyrillic, by block."""
    o = ord(c)
    return 1 if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else 2 if 0x400 <= o < 0x530 else 0


def pair_counts(word: str, into: Counter) -> None:
    """Count the letter pairs of a prepared word that touch a letter with look-alikes; accents don't count."""
    letters = [c for c in word if not unicodedata.combining(c)]
    for a, b in zip([_EDGE, *letters], [*letters, _EDGE]):
        if a in _GROUP or b in _GROUP:
            into[a + b] += 1


class Model:
    """Letter-pair scores and the paths of words seen so far."""

    def __init__(self, counts: dict[str, int]) -> None:
        first: Counter = Counter()
        for k, n in counts.items():
            first[k[0]] += n
        letters = len({k[0] for k in counts}) + 1
        self.score = {k: math.log((n + SMOOTH) / (first[k[0]] + SMOOTH * letters)) for k, n in counts.items()}
        self.least = {c: math.log(SMOOTH / (n + SMOOTH * letters)) for c, n in first.items()}
        self.floor = math.log(1 / letters)
        self.known: dict[str, str] = {}

    def pair(self, a: str, b: str) -> float:
        s = self.score.get(a + b)
        return s if s is not None else self.least.get(a, self.floor)

    def word(self, word: str) -> str:
        """The one form of all words that look like ``word`` (prepared); composed accents."""
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            out = self.known[word] = unicodedata.normalize("NFC", self._search(word))
        return out

    def _search(self, word: str) -> str:
        places = [i for i, c in enumerate(word) if not unicodedata.combining(c)]
        if not any(word[i] in _GROUP for i in places):
            return word
        prev: list[tuple[float, str]] = [(0.0, _EDGE)]
        back: list[list[int]] = []
        for i in places:
            now, via = [], []
            for c in _GROUP.get(word[i], word[i]):
                best, at = -math.inf, 0
                for j, (s, p) in enumerate(prev):
                    s += self.pair(p, c) - (SWITCH if p != _EDGE and script(p) != script(c) else 0.0)
                    if s > best:
                        best, at = s, j
                now.append((best, c))
                via.append(at)
            back.append(via)
            prev = now
        ends = [s + self.pair(c, _EDGE) for s, c in prev]
        j = max(range(len(ends)), key=lambda k: (ends[k], -k))
        chars = list(word)
        for i, via in zip(reversed(places), reversed(back)):
            chars[i] = _GROUP.get(word[i], word[i])[j]
            j = via[j]
        return "".join(chars)

    def text(self, text: str) -> str:
        """``text`` in the one form of all texts that look like it."""
        return self.texts([text])[0]

    def texts(self, texts: list[str | None]) -> list[str | None]:
        """The one form of each of ``texts``. Each distinct word is searched once; texts none of whose words change keep them."""
        ready = [None if t is None else prepared(t) for t in texts]
        flat, first = words_of(ready)
        codes = flat.dictionary_encode()
        names = codes.dictionary.to_pylist()
        changed = np.array([self.word(w) != unicodedata.normalize("NFC", w) for w in names], dtype=bool)
        touched = np.r_[0, np.cumsum(changed[np.asarray(codes.indices)])] if len(flat) else np.zeros(1, np.int64)
        touched = touched[first[1:]] > touched[first[:-1]]
        out = [t if t is None or not hit else _WORD.sub(lambda m: self.word(m[0]), t) for t, hit in zip(ready, touched)]
        return [t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in out]


#: Distinct words counted in a task before their letter pairs are handed on.
COUNTED = 500_000


def learn(docs: DataFrame, text: str) -> Model:
    """Letter-pair scores counted over all of ``docs``.

    Only pairs that touch a letter of ALIKE are counted, so the collected table is bounded by those letters times the
    letters of three scripts (under 300,000 entries), whatever the corpus. Null texts count nothing.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def pairs() -> pa.RecordBatch:
            found: Counter = Counter()
            for w, n in words.items():
                own: Counter = Counter()
                pair_counts(w, own)
                for k, m in own.items():
                    found[k] += n * m
            words.clear()
            return pa.RecordBatch.from_pydict({"pair": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        for b in batches:
            flat, _ = words_of([t and prepared(t) for t in _texts(b.column(0))])
            seen = flat.value_counts()
            for w, n in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist()):
                words[w] += n
            if len(words) > COUNTED:
                yield pairs()
        yield pairs()

    counts = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(kernel, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return Model({r.pair: r.n for r in counts.collect()})


def unified(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, unified string, look string, raw string): the one form, and digests of it and of the text as it is.

    Null texts have a null form, texts without visible characters a form and no digests; whole texts count.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    score, least, floor = model.score, model.least, model.floor

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model({})
        m.score, m.least, m.floor = score, least, floor
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        for b in batches:
            texts = _texts(b.column("text"))
            forms = m.texts(texts)
            seen = [f is not None and visible(f) for f in forms]
            raw = [digest(t) if s else None for t, s in zip(texts, seen)]
            look = [None if not s else r if f == t else digest(f) for f, t, r, s in zip(forms, texts, raw, seen)]
            yield pa.RecordBatch.from_pydict({key: b.column("key"), "unified": pa.array(forms, pa.string()), "look": pa.array(look, pa.string()), "raw": pa.array(raw, pa.string())})

    return rows.mapInArrow(kernel, f"`{key}` {kind}, unified string, look string, raw string")


def _several(forms: DataFrame, key: str) -> DataFrame:
    """(k, look, raw) of the rows of ``forms`` whose look has several texts.

    Looks with one text only fall out first, by an aggregate that shrinks where the rows lie.
    """
    f = forms.where("look is not null").select(F.col(key).alias("k"), "look", "raw")
    several = f.groupBy("look").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("look")
    return f.join(several, "look", "left_semi")


def alike_classes(forms: DataFrame, key: str) -> DataFrame:
    """(key, class, text, n_rows, n_texts): rows of ``forms`` that look like others written differently.

    class and text are the smallest keys of the look and of the very text; the counts are those of the class. As many
    rows come out as go in at most, however many copies a look has.
    """
    own = _several(forms, key)
    texts = own.groupBy("look", "raw").agg(F.min("k").alias("text"), F.count("*").alias("n"))
    looks = texts.groupBy("look").agg(F.min("text").alias("class"), F.sum("n").alias("n_rows"), F.count("*").alias("n_texts"))
    out = own.join(texts.select("look", "raw", "text"), ["look", "raw"]).join(looks, "look")
    return out.select(F.col("k").alias(key), "class", "text", "n_rows", "n_texts")


def alike_pairs(forms: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b), smaller first: rows of ``forms`` with one look and different texts.

    Texts of a look are paired as texts, and each pair of texts with its rows: the work follows the rows that come out.
    Where a look has many copies ``alike_classes`` says the same in one row each.
    """
    own = _several(forms, key)
    texts = own.select("look", "raw").distinct()
    other = texts.select("look", F.col("raw").alias("raw_b"))
    pairs = texts.join(other, "look").where("raw < raw_b").select(F.col("raw").alias("raw_a"), "raw_b")
    rows_a, rows_b = own.select(F.col("raw").alias("raw_a"), F.col("k").alias("x")), own.select(F.col("raw").alias("raw_b"), F.col("k").alias("y"))
    out = pairs.join(rows_a, "raw_a").join(rows_b, "raw_b")
    return out.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
