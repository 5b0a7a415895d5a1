"""Quality rules by tokeniser fertility.

A public vocabulary measures each text: word characters per token, tokens per word, the share of tokens that fall
back to single bytes, and the entropy of its tokens. Texts outside the bands of their script, narrowed for some
languages, are rejected: too few characters per token and too many tokens per word are symbol noise, shouting or
a script that the vocabulary hardly knows, a large byte share is damaged encoding, a low entropy is repetition.
A base rule comes first: at least MIN_WORDS words, at most half of them in repeated three-word windows.

Defined results: null and empty texts have no words and fail the base rule; texts without letters use the bands of
"other"; repeated rows get equal results; very long texts are measured whole, in blocks cut at spaces; an empty
table gives an empty result; an unknown or null language uses its script's bands; other columns pass `keep_good`.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, keep_rows, map_rows

MIN_WORDS = 50
#: Characters of a block that is tokenised at once.
BLOCK = 1 << 16
#: Lowest characters per token, most tokens per word, most byte share, lowest entropy in bits.
BANDS = {
    "latin": (1.5, 5.0, 0.15, 5.3),
    "vietnamese": (0.9, 4.5, 0.15, 4.8),
    "greek": (0.7, 9.0, 0.6, 3.8),
    "cyrillic": (1.2, 6.0, 0.3, 5.0),
    "hebrew": (0.65, 9.0, 0.6, 3.8),
    "arabic": (0.7, 9.0, 0.6, 3.8),
    "indic": (0.4, 16.0, 0.9, 4.0),
    "cjk": (0.4, 1e9, 0.8, 5.0),
    "other": (0.3, 1e9, 0.9, 4.0),
}
#: Narrower bands of single languages.
LANGUAGE_BANDS = {
    "en": (1.8, 3.2, 0.1, 5.3),
    "de": (1.8, 3.2, 0.12, 5.3),
    "fr": (1.7, 3.2, 0.12, 5.3),
    "es": (1.7, 3.35, 0.12, 5.3),
}
#: Code point ranges by script.
SCRIPTS = {
    "latin": "A-Za-z\u00c0-\u024f\u1e00-\u1eff",
    "greek": "\u0370-\u03ff\u1f00-\u1fff",
    "cyrillic": "\u0400-\u052f",
    "hebrew": "\u0590-\u05ff\ufb1d-\ufb4f",
    "arabic": "\u0600-\u06ff\u0750-\u077f",
    "indic": "\u0900-\u0dff",
    "cjk": "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af",
}
_SCRIPT = {name: re.compile(f"[{chars}]+") for name, chars in SCRIPTS.items()}
#: Latin letters of Vietnamese only; a Latin text with this share of them has its bands.
_VIETNAMESE, VIETNAMESE_SHARE = re.compile("[ăđơưẠ-ỹ]", re.I), 0.08
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[str], window: int = 3) -> int:
    """Words inside windows that occur twice or more, each word once."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    key = number[:n]
    for k in range(1, window):
        _, key = np.unique(key * len(known) + number[k : k + n], return_inverse=True)
    again = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= again
    return int(covered.sum())


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words = WORD_RE.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif WORD_RE.search(line):
            seen.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), again, repeated_words(words)


def script_of(text: str) -> str:
    """The script of most letters; ties go to the first in the list. Vietnamese counts as one of its own."""
    size = {name: sum(map(len, chars.findall(text))) for name, chars in _SCRIPT.items()}
    best = max(size, key=size.get)
    if not size[best]:
        return "other"
    if best == "latin" and len(_VIETNAMESE.findall(text)) >= VIETNAMESE_SHARE * size[best]:
        return "vietnamese"
    return best


def blocks(text: str, most: int = BLOCK):
    """text in pieces of about most characters, cut before a space where there is one."""
    start = 0
    while start < len(text):
        end = start + most
        if end < len(text):
            space = text.rfind(" ", start + most // 2, end)
            end = space if space > start else end
        yield text[start:end]
        start = end


class Fertility:
    """Measures by a sentencepiece vocabulary with byte pieces."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.size = self.model.get_piece_size()
        self.bytes = np.array([self.model.is_byte(i) for i in range(self.size)], bool)

    def __call__(self, text: str) -> tuple[int, float, float]:
        """(tokens, byte share, entropy)"""
        count = np.zeros(self.size, np.int64)
        for part in blocks(text):
            count += np.bincount(np.array(self.model.encode(part), np.int64), minlength=self.size)
        n = int(count.sum())
        if not n:
            return 0, 0.0, 0.0
        share = count[count > 0] / n
        return n, float(count[self.bytes].sum() / n), float(-(share * np.log2(share)).sum())


def within(lang: str | None, script: str, n_words: int, word_chars: int, tokens: int, bytes_share: float, entropy: float) -> bool:
    band = LANGUAGE_BANDS.get(lang or "") if script == "latin" else None
    chars, fertility, most_bytes, least = band or BANDS[script]
    return bool(tokens) and word_chars >= chars * tokens and tokens <= fertility * n_words and bytes_share <= most_bytes and entropy >= least


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, tokens long, chars_per_token double, byte_share double, token_entropy double"


def _measure(vocabulary: str | None):
    fertility = Fertility(vocabulary)

    def measure(text: str | None, lang: str | None) -> tuple:
        words, chars, symbols, lines, repeats = base_measures(text)
        failed = words < MIN_WORDS or 100 * repeats > 50 * words
        tokens, share, entropy = fertility(text or "")
        kept = not failed and within(lang, script_of(text or ""), words, chars, tokens, share, entropy)
        return words, chars, symbols, lines, repeats, failed, kept, tokens, chars / tokens if tokens else 0.0, share, entropy

    return measure


def assess(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and the MEASURES of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang")

    def make():
        measure = _measure(vocabulary)
        return lambda batch: [(i, *measure(text, lang)) for i, text, lang in batch]

    return map_rows(rows, make, f"doc_id long, {MEASURES}", 256)


def keep_good(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The rows of docs that the rules keep; its columns go through unchanged."""

    def make():
        measure, kept = _measure(vocabulary), 6
        return lambda text, lang: measure(text, lang)[kept]

    return keep_rows(docs, ["text", "lang"], make)
