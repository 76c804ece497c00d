"""Noisy-channel restoration of obfuscated words: Viterbi decoding of character lattices under a character language model.

The channel rewrites letters as look-alikes (leetspeak), repeats them, and puts separators between them. A span in which a letter meets a look-alike, stands
three times in a row, or stands between separators becomes a
lattice. There each character may stand for itself or for the letters that it resembles; a run of one letter for one, two or all of them; a run of one look-alike for one letter; a
separator for nothing, for a space or for itself. A mark that stays a mark ends a word, at a price for its kind, so a word that no one has touched wins by its score. The best path under
channel and language model is the restored span. Other words have one path only and pass unchanged.

The search is exact: all contexts of a place are kept, the best path to each. Spans may have any length, for paths are written out as far as all of them agree.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np

from lodestone.llm.char_codes import EDGE, SIZE, SPACE, UPPER, code_table
from lodestone.llm.kneser_ney import HashedModel

#: The letters that a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", "&": "a", "%": "o", "¡": "i", "°": "o",
}
SEPARATORS = " .-_*~/\\,'"
#: log10 costs of the channel: a letter written as a look-alike, a letter repeated, a separator put in.
READ, REPEAT, DROP = -0.6, -0.4, -0.25
#: log10 costs of marks that stand for themselves: a digit, a mark of punctuation, any other; three or more of the others are an ornament and cost as one.
DIGIT, STOP, MARK = -0.7, -0.3, -1.5
STOPS = ".,!'-/"
#: Characters between two looks at how far all paths agree.
STRETCH = 1024

_LETTER = r"[^\W\d_]"
_MARKS = re.escape("".join(LOOKALIKES))
#: Three or more single characters in a row, at least one a letter, with the same kind of gap.
_ALONE = rf"(?:{_LETTER}|[013457@$!])"
_SPACED = re.compile(rf"(?<!\S){_ALONE}(?: {_ALONE}){{2,}}(?!\S)")
_EDGES = re.compile(rf"^([^\w{_MARKS}]*)(.*?)([^\w{_MARKS}]*|[*#%&!|,.]{{2,}})$", re.S)

_TAIL = re.compile(rf"({_LETTER}{{3,}})((?!{_LETTER}).{{1,8}})\Z", re.S)
_TWICE = re.compile(r"(.)\1", re.S)


class Restorer:
    """Restores spans, and remembers those that it has met."""

    def __init__(self, model: HashedModel, remember: int = 50_000):
        self.model, self.remember = model, remember
        self.group = model.group(None)
        self.words: dict[str, str] = {}
        self.tails: dict[tuple[int, str], str] = {}
        self.rows: dict[int, list[float]] = {}

    def _row(self, context: int) -> list[float]:
        """log10 probabilities of all codes after a context of three."""
        row = self.rows.get(context)
        if row is None:
            if len(self.rows) > 20_000:
                self.rows.clear()
            row = self.rows[context] = self.model.log10(self.group, context * SIZE + np.arange(SIZE, dtype=np.int64)).tolist()
        return row

    def moves(self, span: str, at: int, end: int, fresh: bool, inside: bool) -> list[tuple[str, int, float, bool]]:
        """What the character at a place may stand for: text, characters used, price, and whether it is a mark that stays. end: of the run of equal characters; fresh: the run begins here; inside: text stands before the span."""
        c, run, between = span[at], end - at, (at > 0 or inside) and at < len(span) - 1
        if c == " ":
            return [(" ", 1, 0.0, False)] + ([("", 1, DROP, False)] if between else [])
        letter, reads = c.isalpha(), LOOKALIKES.get(c, "")
        out = [(c, 1, 0.0, False)] if letter else [(x, 1, READ, False) for x in reads]
        if fresh and run > 1 and letter:
            out += [(c, run, REPEAT, False)] + ([(c + c, run, REPEAT, False)] if run > 2 else [])
        elif fresh and run > 1:
            out += [(x, run, READ + REPEAT if run > 2 else 2 * READ, False) for x in reads]
        if c in SEPARATORS and between:
            out += [("", 1, DROP, False), (" ", 1, READ, False)]
        if not letter:
            kind = DIGIT if c.isdigit() else STOP if c in STOPS else MARK if reads or c in SEPARATORS else 0.0
            out.append((c * run, run, MARK, True) if kind == MARK and run > 2 else (c, 1, kind, True))
        return out

    def viterbi(self, span: str, before: int | None = None) -> str:
        """The best reading of a span. before: the context that it stands in, if it is not a word's beginning."""
        codes, square = code_table(), SIZE**2
        start = (EDGE * SIZE + EDGE) * SIZE + SPACE if before is None else before
        # Paths to each place: context -> (score, path); a path is (path before, text).
        ahead: dict[int, dict[int, tuple[float, tuple | None]]] = {0: {start: (0.0, None)}}
        done: list[str] = []
        end = 0
        for at in range(len(span)):
            fresh = at >= end
            if fresh:
                end = at + 1
                while end < len(span) and span[end] == span[at]:
                    end += 1
            here = ahead.pop(at, None)
            if not here:
                continue
            if at % STRETCH == STRETCH - 1 and len(ahead) == 0:
                here = self._agreed(here, done)
            for read, used, price, stays in self.moves(span, at, end, fresh, before is not None):
                there = ahead.setdefault(at + used, {})
                read_codes = [SPACE] if stays else [int(codes[min(ord(x), 65535)]) for x in read]
                for context, (score, path) in here.items():
                    k, total = context, score + price
                    if stays and context % SIZE == SPACE:
                        pass  # the word has ended before
                    else:
                        for y in read_codes:
                            total += self._row(k)[y]
                            k = (k % square) * SIZE + y
                    found = there.get(k)
                    if found is None or total > found[0]:
                        there[k] = (total, (path, read) if read else path)
        last = ahead.get(len(span), {})
        best = max(((score + (0.0 if context % SIZE == SPACE else self._row(context)[SPACE]), context) for context, (score, _) in last.items()), default=None)
        return "".join(done) + (_text(last[best[1]][1]) if best else span)

    @staticmethod
    def _agreed(here: dict, done: list[str]) -> dict:
        """Move what all paths begin with to done."""
        paths = [[] for _ in here]
        for out, (_, path) in zip(paths, here.values(), strict=True):
            while path is not None:
                out.append(path)
                path = path[0]
            out.reverse()
        shared = 0
        while all(len(p) > shared for p in paths) and len({id(p[shared]) for p in paths}) == 1:
            shared += 1
        if not shared:
            return here
        done.append("".join(p[1] for p in paths[0][:shared]))
        out = {}
        for (context, (score, _)), own in zip(here.items(), paths, strict=True):
            path = None
            for _, text in own[shared:]:
                path = (path, text)
            out[context] = (score, path)
        return out

    def word(self, token: str) -> str:
        """A token (lower case, without white space) as restored; marks at its edges that resemble no letter stay."""
        found = self.words.get(token)
        if found is None:
            before, core, after = _EDGES.match(token).groups()
            found = before + self._core(core) + after if len(core) > 1 and any(c.isalpha() for c in core) else token
            if len(self.words) > self.remember:
                self.words.clear()
            self.words[token] = found
        return found

    def _core(self, core: str) -> str:
        """The best reading of a token. Letters of which no two neighbours are alike have one path, so what follows three of them depends on these alone."""
        m = _TAIL.match(core)
        if not m or _TWICE.search(m[1]):
            return self.viterbi(core)
        a, b, c = (int(code_table()[min(ord(x), 65535)]) for x in m[1][-3:])
        key = (a * SIZE + b) * SIZE + c, m[2]
        tail = self.tails.get(key)
        if tail is None:
            if len(self.tails) > self.remember:
                self.tails.clear()
            tail = self.tails[key] = self.viterbi(m[2], key[0])
        return m[1] + tail

    def text(self, text: str) -> str:
        """The text in lower case, obfuscated words restored."""
        text = text.lower()
        spans = suspicious_spans(text, endings=True)
        if not spans:
            return text
        parts, at = [], 0
        for low, high, spaced in spans:
            span = text[low:high]
            if not spaced:
                span = self.word(span)
            elif any(c.isalpha() for c in span):
                span = self.viterbi(span)
            parts += [text[at:low], span]
            at = high
        return "".join([*parts, text[at:]])


def _text(path: tuple | None) -> str:
    out = []
    while path is not None:
        out.append(path[1])
        path = path[0]
    return "".join(reversed(out))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each code point of the basic plane is, as bits: 1 letter, 2 look-alike, 4 white space, 8 inner separator, 16 digit-like look-alike."""
    code = code_table()
    out = ((code < SPACE) | (code == UPPER)).astype(np.uint8) | (code == SPACE).astype(np.uint8) << 2
    for chars, bit in (("".join(LOOKALIKES), 2), (".-_*~/\\", 8), ("013457@$!", 16)):
        for c in chars:
            out[ord(c)] |= bit
    return out


def suspicious_spans(text: str, endings: bool = False) -> list[tuple[int, int, bool]]:
    """Where a text (lower case) may be obfuscated: from, to, and whether it is a row of single characters; tokens otherwise. endings: also tokens in which a look-alike follows a letter, as digits and marks at the end of a word do."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < 2:
        return []
    kind = _kinds()[np.minimum(points, 65535)]
    letter, mark, gap, inner, digit = (kind & 1 > 0), (kind & 2 > 0), (kind & 4 > 0), (kind & 8 > 0), (kind & 16 > 0)
    hit = np.zeros(len(points), bool)
    hit[1:] |= mark[:-1] & letter[1:]
    hit[2:] |= letter[2:] & (points[2:] == points[1:-1]) & (points[1:-1] == points[:-2])
    hit[2:] |= inner[:-2] & letter[1:-1] & inner[2:]
    if endings:
        hit[1:] |= letter[:-1] & mark[1:]
    edge = np.concatenate([[True], gap, [True]])
    single = edge[:-2] & ~gap & edge[2:] & (letter | digit)
    rows = single[:-4] & single[2:-2] & single[4:] if len(points) > 4 else np.zeros(0, bool)
    out = []
    if rows.any():
        low = max(0, int(np.flatnonzero(rows)[0]) - 1)
        out = [(m.start(), m.end(), True) for m in _SPACED.finditer(text, low)]
    if hit.any():
        gaps = np.flatnonzero(gap)
        at = np.unique(np.searchsorted(gaps, np.flatnonzero(hit)))
        rows_of, rows_from = list(out), [x for x, _, _ in out]
        for k in at.tolist():
            low = int(gaps[k - 1]) + 1 if k else 0
            high = int(gaps[k]) if k < len(gaps) else len(text)
            row = bisect_right(rows_from, low) - 1
            if row < 0 or low >= rows_of[row][1]:
                out.append((low, high, False))
    return sorted(out)
