"""Dense features of whole texts, computed in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import text
from .text import NOT_ALNUM, SPACE, U64, Words, buffers, mix, shingles, words

# Frequent function words, and words that address the reader.
STOPWORDS = (
    "the of and to in a is that it was for on are as with be this by from or an at not have"
    " der die das und in zu den ein eine ist von mit sich des auf für im dem nicht es als auch an"
    " de la le les et des en un une du que qui dans pour par sur pas au il est avec ce se"
    " el los las y que en un una por con no del su es lo para al como"
).split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deiner deinem deinen ihr euch euer eure"
    " tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros vuestro vuestra"
).split()

SEPARATORS = NOT_ALNUM | SPACE
_is = lambda chars: np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8))
UPPER, LOWER, DIGIT = (np.array([lo <= b <= hi for b in range(256)]) for lo, hi in ((65, 90), (97, 122), (48, 57)))
CLASSES = [
    UPPER, LOWER, DIGIT, _is(" "), _is("\n"), _is("."), _is(","), _is("!"), _is("?"), _is(";:'\"()-"), _is("|"), _is("#$%&*@~^+=<>{}[]\\/_`"),
    np.arange(256) >= 128,
]


def lower(column) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document, how many of flags are set."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def byte_shares(column) -> np.ndarray:
    """Share of bytes of each class, of letters inside symbols, and of runs of three; per document."""
    raw, offsets = buffers(column)
    data, offs = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    out = np.zeros((len(offs) - 1, len(CLASSES) + 2))
    step = 64
    for lo in range(0, len(offs) - 1, step):
        part = data[offs[lo] : offs[min(lo + step, len(offs) - 1)]]
        o = offs[lo : lo + step + 1] - offs[lo]
        n = np.maximum(np.diff(o), 1)
        for k, table in enumerate(CLASSES):
            out[lo : lo + step, k] = counts(table[part], o) / n
        letter, space = (UPPER | LOWER | (np.arange(256) >= 128))[part], SPACE[part]
        odd = ~letter & ~space
        inside, same = np.zeros(len(part), bool), np.zeros(len(part), bool)
        if len(part) > 2:
            inside[1:-1] = letter[:-2] & odd[1:-1] & letter[2:]
            same[2:] = (part[2:] == part[1:-1]) & (part[1:-1] == part[:-2]) & letter[2:]
        out[lo : lo + step, -2] = counts(inside, o) / n
        out[lo : lo + step, -1] = counts(same, o) / n
    return out


def lowered_words(column) -> Iterator[Words]:
    return text.lowered_words(column, SEPARATORS)


def known(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted table."""
    if not len(table):
        return np.zeros(len(hashes), bool)
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


def hash_words(those: list[str]) -> np.ndarray:
    return np.sort(np.concatenate([w.hashes for w in lowered_words(pa.array(those))]))


def distinct_share(w: Words, k: int) -> np.ndarray:
    """Distinct k-word shingles by words, per document."""
    n = np.diff(w.bounds)
    _, at = shingles(w, k)
    return np.diff(at) / np.maximum(1, n - k + 1)


def top_share(w: Words) -> np.ndarray:
    """Share of the most frequent word, per document."""
    n = np.diff(w.bounds)
    doc = np.repeat(np.arange(len(n)), n)
    code = mix(w.hashes) & U64((1 << 40) - 1) | doc.astype(U64) << U64(40)
    code.sort()
    begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    run = np.diff(np.append(begin, len(code)))
    best = np.zeros(len(n))
    np.maximum.at(best, (code[begin] >> U64(40)).astype(np.int64), run)
    return best / np.maximum(1, n)


def line_features(column) -> np.ndarray:
    """Lines, mean and longest line, share of short lines, and share of distinct lines; per document."""
    only_newline = np.zeros(256, bool)
    only_newline[10] = True
    out = []
    for w in words(column, separators=only_newline):
        n = np.diff(w.bounds)
        doc = np.repeat(np.arange(len(n)), n)
        size = w.ends - w.starts
        longest = np.zeros(len(n))
        np.maximum.at(longest, doc, size)
        total = np.bincount(doc, size, len(n))
        short = np.bincount(doc, size < 40, len(n))
        least = np.maximum(1, n)
        out.append(np.stack([np.log1p(n), np.log1p(total / least), np.log1p(longest), short / least, distinct_share(w, 1)], 1))
    return np.concatenate(out) if out else np.zeros((0, 5))
