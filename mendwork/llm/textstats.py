"""Surface statistics of one text, shared by the quality operators.

Works on UTF-8 bytes: ``bytes.split`` cuts exactly at space and \\x09-\\x0D,
and code points are the bytes that are not continuation bytes.
"""

from __future__ import annotations

from collections import Counter

NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_bytes", "n_lines", "n_upper", "n_lower", "n_digits", "n_stops", "n_commas", "n_marks",
    "n_distinct", "n_double", "longest_word", "n_caps_words", "n_high_bytes", "n_bare_words",
)

_SPACE = b" \t\n\x0b\x0c\r"
_NOT_IN_WORDS = _SPACE + bytes(range(0x80, 0xC0))
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_HIGH = bytes(range(0x80, 0x100))
_HIGH_AS_LETTERS = bytes(range(0x80)) + b"a" * 0x80


def _count(b: bytes, chars: bytes) -> int:
    return len(b) - len(b.translate(None, chars))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words covered by windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(width))))
    if len(set(grams)) == n:
        return 0
    counts = Counter(grams)
    covered, end = 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def text_stats(b: bytes | None) -> tuple[int, ...]:
    """Counts in the order of NAMES; null and empty texts give zeros."""
    if not b:
        return (0,) * len(NAMES)
    words = b.split()
    lines = b.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    n = len(words)
    return (
        n,
        len(b.translate(None, _NOT_IN_WORDS)),
        _count(b, _SYMBOLS),
        dup,
        repeated_words(words),
        len(b),
        len(lines),
        _count(b, _UPPER),
        _count(b, _LOWER),
        _count(b, _DIGITS),
        _count(b, b".?"),
        _count(b, b",;:"),
        _count(b, b"!"),
        len(set(words)),
        sum(map(bytes.__eq__, words, words[1:])),
        max(map(len, words), default=0),
        sum(map(bytes.isupper, words)),
        _count(b, _HIGH),
        sum(map(bytes.isalpha, b.translate(_HIGH_AS_LETTERS, b".,").split())) if n else 0,
    )
