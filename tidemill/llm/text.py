"""Normal forms and vectorised rolling hashes shared by the text operators."""

from __future__ import annotations

import numpy as np
import regex

# Scripts written without spaces between words (Han, Hiragana, Katakana, Thai).
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
NOT_ALNUM = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
#: The same for Spark's regular expressions.
JVM_NOT_ALNUM = r"[^\p{L}\p{M}\p{N}]+"

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def squeeze(text: str) -> str:
    """Case-folded letters, marks and digits of the text, in order."""
    return NOT_ALNUM.sub("", text.casefold())


def is_unspaced(text: str) -> bool:
    """Whether at least three tenths of the letters belong to a script without spaces."""
    n = len(UNSPACED.findall(text))
    return n > 0 and n >= 0.3 * sum(map(len, LETTERS.findall(text)))


CHUNK_CHARS = 2_000_000


def chunks(sizes: np.ndarray, most: int = CHUNK_CHARS) -> list[slice]:
    """Runs of rows of about ``most`` characters together, so that what is worked on at once does not grow with the texts."""
    if not len(sizes):
        return []
    which = (np.cumsum(sizes) - sizes) // most
    cut = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    return [slice(int(a), int(b)) for a, b in zip(cut, np.append(cut[1:], len(sizes)), strict=True)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` values; empty if there are fewer."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    c, h = codes.astype(np.uint64), np.zeros(m, np.uint64)
    for j in range(n):
        h *= _MULT
        h += c[j : j + m]
        h += np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def level_hashes(codes: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """:func:`gram_hashes` for rising lengths in one pass; no hash is 0."""
    out, n = [], len(codes)
    c, h = codes.astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(lengths[-1]):
        m = max(0, n - j)
        h = h[:m]
        h *= _MULT
        h += c[j : j + m]
        h += np.uint64(1)
        if j + 1 in lengths:
            g = h ^ (h >> np.uint64(29))
            g *= _MIX
            g ^= g >> np.uint64(32)
            out.append(np.maximum(g, np.uint64(1)))
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two code point arrays, ``most`` + 1 if it is larger.

    The furthest-reaching points of the diagonals: time in proportion to the distance squared and the characters that match.
    """
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1

    def slide(i: int, t: int) -> int:
        step = 64
        while i < la and i + t < lb:
            n = min(la - i, lb - i - t, step)
            odd = a[i : i + n] != b[i + t : i + t + n]
            k = int(odd.argmax())
            if odd[k]:
                return i + k
            i += n
            step *= 4
        return i

    far, goal = {0: slide(0, 0)}, lb - la
    for d in range(most + 1):
        if far.get(goal, -1) >= la:
            return d
        new = {}
        for t in range(max(-d - 1, -la), min(d + 1, lb) + 1):
            best = -1
            if t in far:
                best = far[t] + (far[t] < la and far[t] + t < lb)
            if t + 1 in far and far[t + 1] < la:
                best = max(best, far[t + 1] + 1)
            if t - 1 in far and far[t - 1] + t <= lb:
                best = max(best, far[t - 1])
            if best >= 0:
                new[t] = slide(best, t)
        far = new
    return most + 1
