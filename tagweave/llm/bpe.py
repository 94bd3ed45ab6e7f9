"""Byte-level BPE as a lazily determinised finite-state transducer, run over many words at once.

Text is first cut into words by character class (letters, digits, white space, other), then each
word goes byte by byte through a transducer whose states are the bytes read but not yet emitted.

Why it is exact. If the encoding of a word has a boundary at position s, the encoding is that of
w[:s] followed by that of w[s:], because no merge crosses s. After reading w[:i], the token that
will cover byte i starts at some s where w[s:i] is a proper prefix of a token, or at i itself: the
live positions. Whatever follows, the encoding begins with that of w[:s] for one live s. The tokens
in which all of these agree are final and are emitted; the rest is pending. So the lookahead is
bounded by the live positions, and the pending bytes alone determine everything that follows.

Transitions are computed when a byte is first met in a state and kept in a table, as a lazy DFA
does; a full table is emptied. Encoding is then one table lookup per byte, done in numpy for all
words of a block of text in step. Words of more than LONG bytes (glued text, encoded data), where a step
would move few words and pending bytes seldom recur, are merged in overlapping windows and joined where
two windows agree; see `_long`.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
BLOCK = 1 << 20
MAX_STATES = 96_000
UNKNOWN = -1
LONG = 512  # bytes of a word, from which on it is encoded by windows
PIECE, MEET = 128, 64  # bytes from window to window, and that two of them share
NONE = (1 << 31) - 1


class Vocabulary:
    """Tokens of a rank file: base64 token and its id on each line; the id is the merge rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.prefixes = {token[:i] for token in self.ranks for i in range(1, len(token))}
        self.tokens = {i: token for token, i in self.ranks.items()}
        self._known: dict[bytes, tuple[int, ...]] = {}

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The merges by rank, lowest first, leftmost first among equals; for pending bytes."""
        if word in self._known:
            return self._known[word]
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            pairs = [(self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(pairs)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out = tuple(self.ranks[p] for p in parts)
        if len(self._known) > 200_000:
            self._known.clear()
        if len(word) <= 64:
            self._known[word] = out
        return out

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(left id << 32 | right id, id) of every two tokens that are one together, in order."""
        both = sorted((self.ranks[t[:i]] << 32 | self.ranks[t[i:]], n) for t, n in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        return np.array([k for k, _ in both], np.int64), np.array([n for _, n in both], np.int32)

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE if they aren't a token."""
        keys, ids = self.pairs
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, ids[at], np.int32(NONE))

    def encode_windows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(does a token begin, where it ends, its id), each window x place, of the encodings of windows of
        a text: in every round each window makes its next merge."""
        n, size = len(starts), ends - starts
        width = int(size.max())
        column = np.arange(width + 1)[None, :]
        inside = column < size[:, None]
        single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        ids = np.where(inside, single[data[np.minimum(starts[:, None] + column, len(data) - 1)]], np.int32(-1))
        after = np.repeat(column + 1, n, 0).astype(np.int32)
        before = after - 2
        rank = np.full((n, width + 1), NONE, np.int32)
        ok = inside[:, 1:]
        rank[:, :-1][ok] = self.together(ids[:, :-1][ok], ids[:, 1:][ok])
        begins = inside.copy()
        rows = np.arange(n)
        while len(rows):
            i = rank[rows].argmin(1) if len(rows) < n else rank.argmin(1)
            r = rank[rows, i]
            live = r < NONE
            rows, i, r = rows[live], i[live], r[live]
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], after[rows, i] = r, k
            before[rows, np.minimum(k, width)] = i
            rank[rows, j], begins[rows, j] = NONE, False
            right = k < size[rows]
            rank[rows, i] = NONE
            rank[rows[right], i[right]] = self.together(r[right], ids[rows[right], k[right]])
            h = before[rows, i]
            left = h >= 0
            rank[rows[left], h[left]] = self.together(ids[rows[left], h[left]], r[left])
        return begins, after, ids

    def settled(self, pending: bytes) -> tuple[int, ...]:
        """The first tokens of every word that begins with `pending`, as far as they are certain."""
        n = len(pending)
        if pending in self.prefixes:
            return ()
        live = [s for s in range(1, n) if pending[s:] in self.prefixes] + [n]
        chains = [self.encode_word(pending[:s]) for s in live]
        shared = 0
        for column in zip(*chains):
            if len(set(column)) > 1:
                break
            shared += 1
        return chains[0][:shared]


class Transducer:
    """The table of transitions; `run` takes words in a buffer of bytes."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = MAX_STATES):
        self.vocabulary, self.max_states = vocabulary, max_states
        self.tokens = np.zeros(1 << 12, np.int32)  # the emissions, one after the other
        self.n_tokens = 0
        self.emit_at, self.emit_len = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.emissions: dict[tuple[int, ...], int] = {(): 0}
        self.clear()

    def clear(self) -> None:
        self.pending: list[bytes] = [b""]
        self.number: dict[bytes, int] = {b"": 0}
        self.next = np.full((1024, 256), UNKNOWN, np.int32)  # state, or -2 - place in `jumps`
        self.final = np.full(1024, UNKNOWN, np.int32)
        self.jump_state, self.jump_emit = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.n_jumps = 0

    def _emission(self, ids: tuple[int, ...]) -> int:
        at = self.emissions.get(ids)
        if at is None:
            at = self.emissions[ids] = len(self.emissions)
            if at >= len(self.emit_at):
                self.emit_at, self.emit_len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.emit_at, self.emit_len))
            while self.n_tokens + len(ids) > len(self.tokens):
                self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
            self.tokens[self.n_tokens : self.n_tokens + len(ids)] = ids
            self.emit_at[at], self.emit_len[at] = self.n_tokens, len(ids)
            self.n_tokens += len(ids)
        return at

    def _state(self, pending: bytes) -> int:
        at = self.number.get(pending)
        if at is None:
            at = self.number[pending] = len(self.pending)
            self.pending.append(pending)
            if at >= len(self.final):
                more = min(len(self.final), 1 << 14)
                self.next = np.concatenate([self.next, np.full((more, 256), UNKNOWN, np.int32)])
                self.final = np.concatenate([self.final, np.full(more, UNKNOWN, np.int32)])
        return at

    def _learn(self, state: int, byte: int) -> None:
        seen = self.pending[state] + bytes([byte])
        ids = self.vocabulary.settled(seen)
        if not ids:
            self.next[state, byte] = self._state(seen)
            return
        left = seen[sum(len(self.vocabulary.tokens[i]) for i in ids) :]
        target = self._state(left)
        if self.n_jumps == len(self.jump_state):
            self.jump_state, self.jump_emit = (np.concatenate([x, np.zeros_like(x)]) for x in (self.jump_state, self.jump_emit))
        self.jump_state[self.n_jumps], self.jump_emit[self.n_jumps] = target, self._emission(ids)
        self.next[state, byte] = -2 - self.n_jumps
        self.n_jumps += 1

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Codes of emissions: at 2 * p what byte p brings, at 2 * p + 1 what the end after it does."""
        if len(self.pending) > self.max_states:
            self.clear()
        if len(self.emissions) > 4 * self.max_states:
            self.emissions, self.n_tokens = {(): 0}, 0
            self.clear()
        codes = np.zeros(2 * len(data), np.int32)
        long = ends - starts > LONG
        self._steps(data, starts[~long], ends[~long], codes)
        if long.any():
            self._long(data, starts[long], ends[long], codes)
        return codes

    def _steps(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> None:
        """Words in step, byte by byte."""
        lengths = ends - starts
        longest = int(lengths.max()) if len(lengths) else 0
        order = np.argsort((longest - lengths).astype(np.uint16 if longest < 1 << 16 else np.int64), kind="stable")
        at, sizes = starts[order], lengths[order]
        active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
        state = np.zeros(len(starts), np.int32)
        for k, n in enumerate(active):
            here = at[:n] + k
            byte = data[here]
            while True:
                to = self.next.ravel()[state[:n].astype(np.int64) * 256 + byte]
                if not n or to.min() >= 0:
                    break
                missing = np.flatnonzero(to == UNKNOWN)
                if not len(missing):
                    break
                for pair in np.unique(state[missing].astype(np.int64) * 256 + byte[missing]):
                    self._learn(int(pair) >> 8, int(pair) & 255)
            jumps = np.flatnonzero(to < 0)
            if len(jumps):
                which = -2 - to[jumps]
                codes[2 * here[jumps]] = self.jump_emit[which]
                to[jumps] = self.jump_state[which]
            state[:n] = to
        last = self.final[state]
        for s in np.unique(state[last == UNKNOWN]):
            self.final[s] = self._emission(self.vocabulary.encode_word(self.pending[s]))
        codes[2 * (at + sizes - 1) + 1] = self.final[state]

    def _long(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> None:
        """Long words, whose pending bytes may never recur, by windows that overlap.

        A sequence of tokens is the encoding of its text if every two neighbours are that of theirs. So
        the encodings of two windows may be joined in front of any token that both have in the same
        place. Words with windows that share none go byte by byte.
        """
        pieces = [np.append(int(a), self._cuts(data, int(a), int(b))) for a, b in zip(starts, ends)]
        at = np.concatenate(pieces).astype(np.int64)
        word = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        final = np.append(word[1:] != word[:-1], True)
        upto = np.where(final, ends[word], np.append(at[1:], 0) + MEET)
        begins, after, ids = self.vocabulary.encode_windows(data, at, upto)
        later = np.flatnonzero(~np.append(True, final[:-1]))  # windows that follow another one of their word
        step, ahead = np.arange(MEET)[None, :], (at[later] - at[later - 1])[:, None]
        rows = later[:, None]
        same = begins[rows - 1, ahead + step] & begins[rows, step] & (after[rows - 1, ahead + step] - ahead == after[rows, step])
        lost = np.zeros(len(pieces), bool)
        lost[word[later[~same.any(1)]]] = True
        low, high = np.zeros(len(at), np.int64), upto - at
        low[later] = same.argmax(1)
        high[later - 1] = low[later] + ahead[:, 0]
        column = np.arange(begins.shape[1])[None, :]
        row, place = np.nonzero(begins & (column >= low[:, None]) & (column < high[:, None]) & ~lost[word][:, None])
        found, which = np.unique(ids[row, place], return_inverse=True)
        emission = np.array([self._emission((int(i),)) for i in found], np.int32)
        if len(row):
            codes[2 * (at[row] + place)] = emission[which]
        if lost.any():
            self._steps(data, starts[lost], ends[lost], codes)

    @staticmethod
    def _cuts(data: np.ndarray, start: int, end: int) -> np.ndarray:
        """Where the windows of a long word begin, behind the first one: PIECE apart, and at characters."""
        at = np.arange(start + PIECE, end - PIECE - MEET, PIECE)
        for _ in range(3):
            at += (data[at] & 0xC0) == 0x80
        return at


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point, by the Unicode categories and white space."""
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            a, b = m.span()
            for low, high, gap in ((0, 0xD800, 0), (0xD800, len(text), 0x800)):
                if a < high and b > low:
                    kinds[max(a, low) + gap : min(b, high) + gap] = kind
    return kinds


_ASCII_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_SHORT, _LONG = b"stmd", (b"re", b"ve", b"ll")


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of UTF-8 text belongs to."""
    table = char_classes()
    kinds = np.take(table[:256], data)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for j in (1, 2, 3):
            more = size > j
            code[more] = code[more] << 6 | (data[lead[more] + j] & 0x3F)
        kind = table[np.minimum(code, 0x10FFFF)]
        kinds[lead] = kind
        for j in (1, 2, 3):
            more = size > j
            kinds[lead[more] + j] = kind[more]
    return kinds


def word_starts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where words begin in texts that lie one after the other; `doc_starts` are below len(data).

    Runs of one class are words. One blank goes with the run behind it; of other white space
    before a run the last character stands alone. An apostrophe that begins its run takes s, t, m,
    d, re, ve or ll with it.
    """
    n = len(data)
    kinds = byte_classes(data)
    begin = np.empty(n, bool)
    begin[0:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begin[1:])
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    begin[doc_starts] = True

    # white space before another class
    turn = np.flatnonzero((kinds[1:] != SPACE) & (kinds[:-1] == SPACE)) + 1
    turn = turn[~first[turn]]
    blank = data[turn - 1] == 0x20
    begin[turn[blank]] = False
    begin[turn[blank] - 1] = True
    single = turn[~blank] - 1
    for _ in range(3):
        inside = (data[single] & 0xC0) == 0x80
        if not inside.any():
            break
        single[inside] -= 1
    begin[single] = True

    quote = np.flatnonzero(data == 0x27)
    if len(quote):
        before = np.maximum(quote - 1, 0)
        opens = first[quote] | ((kinds[before] != OTHER) & (data[before] != 0x20))
        quote = quote[opens & (quote + 1 < n)]
        quote = quote[~first[quote + 1]]
        one, two = data[quote + 1], data[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, np.frombuffer(_SHORT, np.uint8))
        fits = (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
        long = fits & np.logical_or.reduce([(one == a) & (two == b) for a, b in _LONG])
        for hit, size in ((quote[short], 2), (quote[long & ~short], 3)):
            begin[hit] = True
            for j in range(1, size):
                begin[hit + j] = False
            after = hit + size
            begin[after[after < n]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Texts to ids. One per worker process and vocabulary; see `encoder`."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.transducer = Transducer(self.vocabulary)

    def _block(self, data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of the non-empty texts in one block."""
        starts = word_starts(data, doc_starts)
        codes = self.transducer.run(data, starts, np.append(starts[1:], len(data)))
        spots = np.flatnonzero(codes != 0)
        codes = codes[spots]
        t = self.transducer
        sizes = t.emit_len[codes]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = t.tokens[np.repeat(t.emit_at[codes] - upto[:-1], sizes) + np.arange(upto[-1])]
        edges = upto[np.searchsorted(spots, 2 * np.append(doc_starts, len(data)))]
        return ids, np.diff(edges)

    def encode(self, texts: pa.Array, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        cuts, owner = pieces(data, offsets)
        counts = np.zeros(len(texts), np.int64)
        out = []
        lo = 0
        while lo < len(owner):
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + BLOCK, side="right")) - 1)
            hi = min(hi, len(owner))
            a, b = cuts[lo], cuts[hi]
            ids, sizes = self._block(data[a:b], cuts[lo:hi] - a)
            np.add.at(counts, owner[lo:hi], sizes)
            if want_ids:
                out.append(ids)
            lo = hi
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, text of each piece): every non-empty text whole, or, beyond a block, cut in front of
    a blank between two ASCII letters, where no word is ever joined."""
    cuts, owner = [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if a == b:
            continue
        cuts.append(a)
        owner.append(i)
        if b - a > 2 * BLOCK:
            text = data[a:b]
            safe = np.flatnonzero((text[1:-1] == 0x20) & _ASCII_LETTER[text[:-2]] & _ASCII_LETTER[text[2:]]) + 1
            at = 0
            while b - a - at > 2 * BLOCK:
                k = np.searchsorted(safe, at + BLOCK)
                if k == len(safe):
                    break
                at = int(safe[k])
                cuts.append(a + at)
                owner.append(i)
    return np.array([*cuts, int(offsets[-1])], np.int64), np.array(owner, np.int64)


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of this process; what its transducer has learnt serves all later tasks."""
    return Encoder(path)


# ---- decoding -----------------------------------------------------------------------------------


def _utf8_steps() -> np.ndarray:
    """Transitions of the state machine of well-formed UTF-8: 0 whole, 1 to 3 that many bytes to come,
    4 to 7 a restricted second byte, 8 malformed."""
    step = np.full((9, 256), 8, np.uint8)
    step[0, :0x80] = 0
    step[0, 0xC2:0xE0] = 1
    step[0, 0xE0:0xF0] = 2
    step[0, 0xF0:0xF5] = 3
    step[0, 0xE0], step[0, 0xED], step[0, 0xF0], step[0, 0xF4] = 4, 5, 6, 7
    for state, low, high, to in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1), (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
        step[state, low:high] = to
    return step


UTF8 = _utf8_steps()


class Utf8Stream:
    """Incremental decoder: bytes in, whole characters out; malformed parts become U+FFFD."""

    def __init__(self):
        self.rest = b""

    def feed(self, chunk: bytes) -> str:
        data = self.rest + chunk
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] >= 0xC0:
                state = 0
                for byte in data[-back:]:
                    state = UTF8[state, byte]
                keep = back if 0 < state < 8 else 0
                break
            if data[-back] < 0x80:
                break
        self.rest = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.rest = self.rest.decode("utf-8", "replace"), b""
        return out


def decode(vocabulary: Vocabulary, ids, chunk: int = 4096) -> str:
    """Text of ids, in chunks of tokens; an id without a token gives U+FFFD."""
    stream, out = Utf8Stream(), []
    for at in range(0, len(ids), chunk):
        out.append(stream.feed(b"".join(vocabulary.tokens.get(int(i), b"\xff") for i in ids[at : at + chunk])))
    return "".join(out) + stream.finish()
