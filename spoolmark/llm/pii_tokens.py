"""Tokens of texts and their observations, as arrays.

All work is done on arrays of code points, without a Python step per token.  A
token is a run of Latin letters up to a change from lower to upper case, a run
of digits, one Han character or one other sign.  Observations are the word, its affixes and shape, the blanks
before it, marks of the chunk (between blanks) and of the run of digits and
separators it belongs to, and those of its neighbours.  They are hashed to
``1 << BITS`` features.
"""

from __future__ import annotations

import numpy as np

BITS = 17

# Full-width signs and odd blanks read as ASCII, one for one.
WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x2009: 0x20, 0x202F: 0x20, 0x2011: 0x2D, 0x2013: 0x2D, 0x2019: 0x27}
BLANK, BREAK, LETTER, DIGIT, HAN, SIGN = range(6)
LOWER_WORD, TITLE, UPPER, INITIAL, MIXED = range(5)


def fold(text: str) -> str:
    """Full-width signs and odd blanks as ASCII, one character for one."""
    return text.translate(WIDE)


def _tables() -> tuple[np.ndarray, ...]:
    folded = np.arange(0x10000, dtype=np.uint32)
    for a, b in WIDE.items():
        folded[a] = b
    kind, lower, upper = np.full(0x10000, SIGN, np.uint8), np.arange(0x10000, dtype=np.uint32), np.zeros(0x10000, bool)
    for c in range(0x10000):
        if chr(c).isspace() or c in (0, 0x200B, 0xFEFF):
            kind[c] = BREAK if c in (10, 13) else BLANK
    for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x250)]:
        if c not in (0xD7, 0xF7):
            kind[c], upper[c] = LETTER, chr(c).isupper()
            low = chr(c).lower()
            lower[c] = ord(low) if len(low) == 1 else c
    kind[48:58], lower[48:58] = DIGIT, 48
    kind[0x4E00:0xA000] = HAN
    rng = np.random.default_rng(20)
    return folded, kind, lower, upper, rng.integers(1, 1 << 63, 0x10000, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


FOLDED, KIND, LOWERED, IS_UPPER, CHARACTER, PLACE = _tables()
_MIX = np.random.default_rng(21).integers(1, 1 << 63, (64, 8), np.uint64) * np.uint64(2) + np.uint64(1)


def word_code(word: str) -> int:
    """The number of a word of letters, one Han character or one sign, as tokens bear it."""
    c = FOLDED[np.array([ord(x) for x in word], np.uint32)]
    return int((CHARACTER[LOWERED[c]] * PLACE[np.minimum(np.arange(len(c)), 63)]).sum(dtype=np.uint64))


def word_codes(words) -> np.ndarray:
    return np.array(sorted({word_code(w) for w in words}), np.uint64)


_AT, _SEPARATORS = np.uint64(word_code("@")), word_codes("+-./()")


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


class Tokens:
    """Tokens of a batch of texts, documents one after another."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        offset = np.cumsum(sizes) - sizes
        c = np.frombuffer("".join(f"{t}\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = c = np.where(c < 0x10000, FOLDED[np.minimum(c, 0xFFFF)], np.uint32(0xFFFD))
        kind = KIND[c]
        kind[offset + sizes - 1] = BLANK
        # An apostrophe behind the first letter of a word is part of it.
        mid = np.flatnonzero(c[2:-1] == 39) + 2
        mid = mid[(kind[mid - 1] == LETTER) & (kind[mid + 1] == LETTER) & (kind[mid - 2] != LETTER)]
        kind[mid] = LETTER
        solid = kind >= LETTER
        first = solid.copy()
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] >= HAN) | (IS_UPPER[c[1:]] & (kind[:-1] == LETTER) & ~IS_UPPER[c[:-1]] & (c[:-1] != 39))
        at = np.flatnonzero(first)
        self.size = n = len(at)
        chars = np.flatnonzero(solid)
        begin = np.flatnonzero(first[chars])
        self.length = length = np.diff(np.append(begin, len(chars)))
        self.doc = np.searchsorted(offset, at, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.start = at - offset[self.doc]
        self.end = self.start + length
        self.at = at
        self.kind = kind[at]
        if not n:
            return
        low, own = LOWERED[c[chars]], np.repeat(np.arange(n), length)
        place = np.arange(len(chars)) - begin[own]
        back = length[own] - 1 - place
        value = CHARACTER[low]
        add = lambda x: np.add.reduceat(x, begin)
        self.word = add(value * PLACE[np.minimum(place, 63)])
        self.prefix = add(np.where(place < 3, value * PLACE[np.minimum(place, 63)], np.uint64(0)))
        self.suffix = add(np.where(back < 3, value * PLACE[np.minimum(back, 63)], np.uint64(0)))
        is_upper = IS_UPPER[c[chars]]
        n_upper = add(is_upper.astype(np.int64))
        # Shape of letters by case, of digits by length, of other tokens by sign.
        case = np.select([n_upper == 0, (n_upper == 1) & (length == 1), (n_upper == 1) & is_upper[begin], n_upper == length], [LOWER_WORD, INITIAL, TITLE, UPPER], MIXED)
        self.case = np.where(self.kind == LETTER, case, -1)
        shape = np.select([self.kind == LETTER, self.kind == DIGIT, self.kind == HAN], [1 + case * 4 + np.minimum(length, 3), 40 + np.minimum(length, 20), 30], 0).astype(np.uint64)
        self.shape = np.where(self.kind == SIGN, self.word, shape * np.uint64(0x9E3779B97F4A7C15))
        # Blanks before a token: none, one, several, a line break or the start of the text.
        breaks = np.cumsum(kind == BREAK)
        new = np.append(True, self.doc[1:] != self.doc[:-1])
        before = np.append(0, at[:-1])
        between = at - before - np.append(0, length[:-1])
        gap = np.select([between == 0, between == 1], [0, 1], 2)
        gap = np.where(breaks[at] > breaks[before], 3, gap)
        self.gap = np.where(new, 4, gap).astype(np.uint64)

    def shifted(self, values: np.ndarray, by: int) -> np.ndarray:
        """The value ``by`` tokens before (or after, if negative) in the same document, else 0."""
        out = np.zeros_like(values)
        if by > 0 and by < self.size:
            out[by:] = np.where(self.doc[by:] == self.doc[:-by], values[:-by], 0)
        elif by < 0 and -by < self.size:
            out[:by] = np.where(self.doc[:by] == self.doc[-by:], values[-by:], 0)
        elif not by:
            out = values
        return out

    def _runs(self) -> tuple[np.ndarray, ...]:
        """Marks of the run of digits and separators around each token: form, digits with first sign, word before, word after, neighbours without a blank."""
        n, zero = self.size, np.zeros(self.size, np.uint64)
        self.run_start = self.run_total = self.run_tail = np.zeros(0, np.int64)
        self.run_of = zero
        digit, sign = self.kind == DIGIT, (self.kind == SIGN) & _is_in(self.word, _SEPARATORS)
        close = np.append(self.gap[1:] <= 1, False)
        member = digit.copy()
        for _ in range(3):
            member |= sign & close & np.append(member[1:], False)
        starts = member & ~np.append(False, member[:-1] & (self.gap[1:] <= 1))
        at = np.flatnonzero(member)
        if not len(at):
            return (zero,) * 6
        run = np.cumsum(starts)[at] - 1
        head = np.flatnonzero(starts)
        begin = np.flatnonzero(starts[at])
        place = np.minimum(np.arange(len(at)) - begin[run], 63)
        item = np.where(digit[at], self.length[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), self.word[at]) + self.gap[at] * np.uint64(0xC2B2AE3D27D4EB4F) * (place > 0).astype(np.uint64)
        form = np.add.reduceat(item * PLACE[place], begin)
        total = np.add.reduceat(np.where(digit[at], self.length[at], 0), begin).astype(np.uint64)
        groups = np.diff(np.append(begin, len(at))).astype(np.uint64)
        tail = at[np.append(begin[1:], len(at)) - 1]
        first_code = self.codes[self.at[head]].astype(np.uint64)
        first_code = np.where((first_code >= 50) & (first_code < 58), 50, first_code).astype(np.uint64)
        follows = np.minimum(tail + 1, n - 1)
        same = (follows > tail) & (self.doc[follows] == self.doc[tail])
        glued_after = np.where(same & (self.gap[follows] == 0), self.kind[follows].astype(np.uint64) + np.uint64(1), np.uint64(0))
        glued_after = np.where((glued_after == SIGN + 1) & (self.codes[self.at[follows]] == 45), np.uint64(9), glued_after)
        ahead = np.maximum(head - 1, 0)
        there = (ahead < head) & (self.doc[ahead] == self.doc[head])
        glued_before = np.where(there & (self.gap[head] == 0), self.kind[ahead].astype(np.uint64) + np.uint64(1), np.uint64(0))
        of = lambda values: self._spread(at, values[run])
        # A word before: the nearest letters or Han before the run, over one sign such as a colon.
        over = np.where(there & (self.kind[ahead] == SIGN), np.maximum(ahead - 1, 0), ahead)
        word_before = np.where(there & (self.doc[over] == self.doc[head]), self.word[over], np.uint64(0))
        word_after = np.where(same, self.word[follows], np.uint64(0))
        self.run_start, self.run_of, self.run_total, self.run_tail = head, self._spread(at, run.astype(np.uint64) + np.uint64(1)), total, tail
        return of(form), of(total * np.uint64(64) + first_code % np.uint64(64) + np.uint64(1)), of(groups + np.uint64(1)), of(word_before), of(word_after), of(glued_before * np.uint64(16) + glued_after + np.uint64(1))

    def _spread(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, np.uint64)
        out[at] = values
        return out

    def _chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks of the chunk between blanks: whether an at-sign stands in it before or after the token, last word before it, first word after it."""
        han = self.kind == HAN
        begins = (self.gap > 0) | np.append(True, han[1:] != han[:-1])
        chunk = np.cumsum(begins) - 1
        head = np.flatnonzero(begins)
        tail = np.append(head[1:], self.size) - 1
        is_at = self.word == _AT
        seen = np.cumsum(is_at)
        before = seen - is_at - (seen - is_at)[head][chunk] + np.zeros(self.size, np.int64)
        after = seen[tail][chunk] - seen
        mark = (np.minimum(before, 1) + 2 * np.minimum(after, 1) + 4 * is_at).astype(np.uint64) + np.uint64(1)
        previous, following = np.maximum(head - 1, 0), np.minimum(tail + 1, self.size - 1)
        last = np.where((previous < head) & (self.doc[previous] == self.doc[head]), self.word[previous], np.uint64(0))
        nxt = np.where((following > tail) & (self.doc[following] == self.doc[tail]), self.word[following], np.uint64(0))
        return mark, last[chunk], nxt[chunk]

    def checks(self) -> np.ndarray:
        """1 for tokens of an 18-digit number with a valid public check digit (ISO 7064 MOD 11-2), 2 for an invalid one, else 0."""
        out = np.zeros(self.size, np.uint64)
        long = np.flatnonzero((self.kind == DIGIT) & (self.length >= 3))
        for run in set(self.run_of[long].tolist()) - {0}:
            head, tail = int(self.run_start[run - 1]), int(self.run_tail[run - 1])
            total = int(self.run_total[run - 1])
            x = total == 17 and tail + 1 < self.size and self.doc[tail + 1] == self.doc[tail] and self.length[tail + 1] == 1 and self.codes[self.at[tail + 1]] in (88, 120)
            if total == 18 or x:
                c = self.codes[self.at[head] : self.at[tail] + self.length[tail]]
                digits = (c[(c >= 48) & (c < 58)] - 48).tolist() + ([10] if x else [])
                good = sum(d * pow(2, 17 - i, 11) for i, d in enumerate(digits)) % 11 == 1
                out[head : tail + 1 + int(x)] = 1 if good else 2
        return out

    def flags(self, known: dict[str, np.ndarray]) -> np.ndarray:
        """Bits of the word lists that a token's word is in; of letters only, but for those of Han characters."""
        out = np.zeros(self.size, np.uint64)
        for k, name in enumerate(sorted(known)):
            out |= _is_in(self.word, known[name]).astype(np.uint64) << np.uint64(k)
        return out


def _hash(tag: int, parts: tuple[np.ndarray, ...]) -> np.ndarray:
    h = parts[0] * _MIX[tag, 0]
    for k, p in enumerate(parts[1:], 1):
        h = (h ^ (h >> np.uint64(31))) + p * _MIX[tag, k]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def features(t: Tokens, known: dict[str, np.ndarray], hidden: np.ndarray | None = None) -> np.ndarray:
    """Hashed features of every token, one row each; words, affixes and list marks of ``hidden`` tokens are not seen."""
    if not t.size:
        return np.zeros((0, 1), np.int32)
    form, digits, groups, ahead, behind, glued = t._runs()
    mark, chunk_before, chunk_after = t._chunks()
    check, flag = t.checks(), t.flags(known)
    word, prefix, suffix = t.word, t.prefix, t.suffix
    if hidden is not None:
        word, prefix, suffix, flag = (np.where(hidden, np.uint64(0), x) for x in (word, prefix, suffix, flag))
    w = {k: t.shifted(word, k) for k in (-3, -2, -1, 0, 1, 2, 3)}
    s = {k: t.shifted(t.shape, k) for k in (-3, -2, -1, 0, 1, 2, 3)}
    # What a token is at a glance: shape, list marks and the blanks before it.
    glance = s[0] + flag * np.uint64(0xD6E8FEB86659FD93) + t.gap * np.uint64(0xA0761D6478BD642F)
    g = {k: t.shifted(glance, k) for k in (-3, -2, -1, 1, 2, 3)} | {0: glance}
    gap_after = t.shifted(t.gap, -1)
    columns = [
        (w[0],), (w[1], g[0]), (w[-1], g[0]), (w[2], w[1], s[0]), (w[-1], w[-2], s[0]), (w[2], g[0]), (w[-2], g[0]), (w[3], w[2], w[1]),
        (g[0],), (g[1], g[0]), (g[0], g[-1]), (g[1], g[0], g[-1]), (g[2], g[1], g[0]), (g[0], g[-1], g[-2]), (s[3], s[2], s[1], s[0]), (s[0], s[-1], s[-2], s[-3]),
        (prefix, g[0]), (suffix, g[0]), (w[0], w[1]), (w[0], w[-1]), (w[2], g[1], g[0]), (w[3], g[2], g[1], g[0]), (w[-2], g[-1], g[0]), (gap_after, g[0], w[0]),
        (form, digits), (digits, groups, glued), (ahead, digits), (ahead, behind, form), (check, digits), (mark, s[0], chunk_after), (mark, chunk_before, s[0]), (mark, s[0], s[1], s[-1]),
    ]
    return np.stack([_hash(i, parts) for i, parts in enumerate(columns)], axis=1)
