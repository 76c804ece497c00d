"""Characters as a small alphabet of codes, and n-grams of them as integers, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: a to z, eight buckets of other letters, and one code for each other class.
LETTER, OTHER_LETTER, SPACE, UPPER, DIGIT, STOP, COMMA, MARK, SYMBOL, OTHER, EDGE = 0, 26, 34, 35, 36, 37, 38, 39, 40, 41, 42
SIZE = 43
ORDER = 4


@lru_cache(maxsize=1)
def code_table() -> np.ndarray:
    """Code of each code point of the basic plane."""
    out = np.full(65536, OTHER, np.uint8)
    for k in range(65536):
        c = chr(k)
        if "a" <= c <= "z":
            out[k] = LETTER + k - 97
        elif c.isspace():
            out[k] = SPACE
        elif c.isupper():
            out[k] = UPPER
        elif c.isalpha():
            out[k] = OTHER_LETTER + k % 8
        elif c.isdigit():
            out[k] = DIGIT
    for chars, code in ((".", STOP), (",", COMMA), ("!?;:'\"()-", MARK), ("#*$%&|<>", SYMBOL)):
        for c in chars:
            out[ord(c)] = code
    return out


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return code_table()[np.minimum(points, 65535)]


def grams(text: str, letters_only: bool = False) -> np.ndarray:
    """The 4-gram that ends at each character, as an integer to base 43, the oldest character first; the text begins with three edges. letters_only: those of letters and white space."""
    c = codes(text).astype(np.int32)
    padded = np.concatenate([np.full(ORDER - 1, EDGE, np.int32), c])
    out = np.zeros(len(c), np.int32)
    for k in range(ORDER):
        out = out * SIZE + padded[k : k + len(c)]
    if letters_only:
        plain = (padded <= UPPER) | (padded == EDGE)
        return out[plain[:-3] & plain[1:-2] & plain[2:-1] & plain[3:]]
    return out
