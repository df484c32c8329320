"""Token counts of byte-level BPE by compiled finite-state transducers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import slices, table_of, tidy

# --------------------------------------------------------------------------
# transducer of the pre-tokenizer: where words begin
# --------------------------------------------------------------------------

# Classes of characters.
LETTER, NUMBER, BLANK, WHITE, OTHER, QUOTE, ENDS, R, V, L, E = range(11)
N_CLASSES = 11
# States: what the characters so far leave open.
START, WORD, DIGITS, SIGNS, ONE_BLANK, ONE_WHITE, BLANKS, WHITES, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
N_STATES = 12
# Output: a word begins at this character, at the one before it.
HERE, BEFORE = 1, 2
#: Characters of a chunk.
CHUNK = 128
#: Bytes of text at a time; lanes side by side need many.
SLICE = 2 << 20


def _pretokenizer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for each (state, class); class + N_CLASSES: the first character of a text."""
    enter = {LETTER: WORD, NUMBER: DIGITS, BLANK: ONE_BLANK, WHITE: ONE_WHITE, OTHER: SIGNS, QUOTE: QUOTED}
    letters = {LETTER, ENDS, R, V, L, E}

    def kind(c: int) -> int:
        return LETTER if c in letters else c

    def step(s: int, c: int) -> tuple[int, int]:
        k = kind(c)
        if s == QUOTED:
            if c == ENDS:
                return START, 0
            if c in (R, V, L):
                return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
            return (SIGNS, 0) if k in (OTHER, QUOTE) else (enter[k], HERE)
        if s in (QUOTED_R, QUOTED_V, QUOTED_L):
            if c == (L if s == QUOTED_L else E):
                return START, 0
            return (WORD, BEFORE) if k == LETTER else (enter[k], BEFORE | HERE)
        if s == WORD and k == LETTER or s == DIGITS and k == NUMBER:
            return s, 0
        if s == SIGNS and k in (OTHER, QUOTE):
            return SIGNS, 0
        if s in (ONE_BLANK, ONE_WHITE, BLANKS, WHITES):
            if k in (BLANK, WHITE):
                return (BLANKS if k == BLANK else WHITES), 0
            joined = SIGNS if k == QUOTE else enter[k]
            if s == ONE_BLANK:
                return joined, 0
            if s == BLANKS:
                return joined, BEFORE
            return enter[k], HERE | (BEFORE if s == WHITES else 0)
        return enter[k], HERE

    to = np.zeros((N_STATES, 2 * N_CLASSES), np.uint8)
    out = np.zeros((N_STATES, 2 * N_CLASSES), np.uint8)
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            to[s, c], out[s, c] = step(s, c)
            to[s, c + N_CLASSES], out[s, c + N_CLASSES] = step(START, c)
            if s in (QUOTED_R, QUOTED_V, QUOTED_L):
                out[s, c + N_CLASSES] |= BEFORE
    return to, out


def _classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                out[a : b + 1] = c
            else:
                out[[ord(x) for x in m[0]]] = c
    out[0x20] = BLANK
    out[ord("'")] = QUOTE
    for c, chars in ((ENDS, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e")):
        out[[ord(x) for x in chars]] = c
    return out


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix products of state maps (chunk, state) by doubling: out[i] = maps[i] after ... after maps[0]."""
    maps = maps.copy()
    step = 1
    while step < len(maps):
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        maps[step:] = later
        step *= 2
    return maps


class Pretokenizer:
    def __init__(self):
        self.to, self.out = _pretokenizer()
        self.classes = _classes()

    def starts(self, cls: np.ndarray) -> np.ndarray:
        """Whether a word begins at each character; ``cls`` has N_CLASSES added where a text begins."""
        n = len(cls)
        chunks = -(-n // CHUNK)
        pad = np.full(chunks * CHUNK, N_CLASSES + LETTER, np.uint8)
        pad[:n] = cls
        by = np.ascontiguousarray(pad.reshape(chunks, CHUNK).T)
        to = self.to.ravel()
        width = np.uint16(2 * N_CLASSES)
        # the map of each chunk: from every state it can begin in to that it ends in
        state = np.tile(np.arange(N_STATES, dtype=np.uint16), (chunks, 1))
        for row in by:
            state = to[state * width + row[:, None]].astype(np.uint16)
        first = np.zeros(chunks, np.uint16)
        first[1:] = compose_scan(state)[:-1, START]
        # and again from the one state that each begins in, for the output
        marks = np.empty((CHUNK, chunks), np.uint8)
        out, s = self.out.ravel(), first
        for i, row in enumerate(by):
            at = s * width + row
            marks[i] = out[at]
            s = to[at].astype(np.uint16)
        marks = marks.T.ravel()
        begin = (marks[:n] & HERE) > 0
        begin[:-1] |= (marks[1:n] & BEFORE) > 0
        # what a quote at the very end leaves open
        end = int(s[-1]) if len(pad) == n else None
        if len(pad) > n:
            begin[-1] |= bool(marks[n] & BEFORE)
        elif end in (QUOTED_R, QUOTED_V, QUOTED_L):
            begin[-1] = True
        return begin


# --------------------------------------------------------------------------
# transducer of the merges: tokens of a word
# --------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Pairs of tokens that a worker remembers to fit or not: about 40 MB.
PAIRS = 300_000


class MergeTransducer:
    """Deterministic transducer over the bytes of a word, made as far as texts need it.

    Reading a byte adds the weight of its transition to the number of tokens of
    what was read so far.  A state holds, for each place from which the bytes so
    far begin some token: the node of that token's prefix, the last token before
    the place, and how many fewer tokens there were.  Among the tokens that end
    with a byte exactly one fits the token before it; that one is the last token
    of the longer word.
    """

    def __init__(self, path: str, most_bytes: int = 200 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        tokens = {raw(t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        if spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path}: this normalizer or these added tokens are not supported")
        if len([t for t in tokens if len(t) == 1]) != 256:
            raise ValueError(f"{path}: not every byte is a token")
        self.kids: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in sorted(tokens):
            at = 0
            for b in t:
                if b not in self.kids[at]:
                    self.kids[at][b] = len(self.kids)
                    self.kids.append({})
                    self.token.append(None)
                at = self.kids[at][b]
            self.token[at] = t
        self.most = most_bytes
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._clear()

    def _clear(self) -> None:
        first = ((0, b"", 0),)
        self.states = [first]
        self.number = {first: 0}
        #: column of each byte; only bytes that occur have one
        self.column = np.full(256, -1, np.int64)
        self.width = 0
        self.to = np.full((1 << 14, 64), -1, np.int32)
        self.weight = np.zeros((1 << 14, 64), np.int8)

    def _renewed(self, state: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Forget all states but those given, which get new numbers; also within a word, however long."""
        kept, place = np.unique(state, return_inverse=True)
        kept = [self.states[i] for i in kept.tolist()]
        self._clear()
        self._columns(data)
        for s in kept:
            if s not in self.number:
                self.number[s] = len(self.states)
                self.states.append(s)
        return np.array([self.number[s] for s in kept], np.int64)[place]

    def _columns(self, data: np.ndarray) -> None:
        """Give every byte that occurs a column."""
        seen = np.flatnonzero(np.bincount(data, minlength=256))
        for b in seen[self.column[seen] < 0].tolist():
            if self.width == self.to.shape[1]:
                self.to = np.hstack([self.to, np.full((len(self.to), 32), -1, np.int32)])
                self.weight = np.hstack([self.weight, np.zeros((len(self.weight), 32), np.int8)])
            self.column[b] = self.width
            self.width += 1

    def merged(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            found = self._pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def _extend(self, state: int, byte: int) -> None:
        """Make the transition of a state on a byte."""
        moved, last, gain = [], None, 0
        for node, before, less in self.states[state]:
            kid = self.kids[node].get(byte)
            if kid is None:
                continue
            token = self.token[kid]
            if token is not None and last is None and self.fits(before, token):
                last, gain = token, less + 1
            if self.kids[kid]:
                moved.append((kid, before, less))
        if last is None:
            raise ValueError("no token fits")
        new = (*((k, b, less - gain) for k, b, less in moved), (0, last, 0))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
            if number >= len(self.to):
                more, wide = 1 << 15, self.to.shape[1]
                self.to = np.vstack([self.to, np.full((more, wide), -1, np.int32)])
                self.weight = np.vstack([self.weight, np.zeros((more, wide), np.int8)])
        self.to[state, self.column[byte]] = number
        self.weight[state, self.column[byte]] = gain

    def gains(self, data: np.ndarray, begin: np.ndarray, lane: int = 256) -> np.ndarray:
        """Weight of each byte's transition; ``begin``: where words begin, the first byte among them.

        Lanes of about ``lane`` bytes that begin with a word run side by side.
        """
        n = len(data)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        self._columns(data)
        places = np.flatnonzero(begin)
        heads = np.unique(places[np.searchsorted(places, np.arange(0, n, lane), "right") - 1])
        size = np.diff(np.append(heads, n))
        order = np.argsort(-size, kind="stable")
        heads, size = heads[order], size[order]
        state = np.zeros(len(heads), np.int64)
        live = len(heads)
        col = self.column[data]
        for i in range(int(size[0])):
            while size[live - 1] <= i:
                live -= 1
            if self.to.nbytes + self.weight.nbytes > self.most:
                state[:live] = self._renewed(state[:live], data)
                col = self.column[data]
            at = heads[:live] + i
            s = np.where(begin[at], 0, state[:live])
            c = col[at]
            flat = s * self.to.shape[1] + c
            to = self.to.ravel()[flat]
            if to.min() < 0:
                lost = np.flatnonzero(to < 0)
                for j in lost[np.unique(flat[lost], return_index=True)[1]].tolist():
                    self._extend(int(s[j]), int(data[at[j]]))
                to = self.to[s, c]
            out[at] = self.weight.ravel()[flat]
            state[:live] = to
        return out


class TokenCounter:
    def __init__(self, path: str):
        self.merges = MergeTransducer(path)
        self.pre = Pretokenizer()
        names = sorted(self.merges.specials, key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in names)) if names else None

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each text."""
        base = int(offsets[0])
        data, offs = data[base : int(offsets[-1])], (offsets - base).astype(np.int64)
        n = len(data)
        if not n:
            return np.zeros(len(offs) - 1, np.int64)
        raw = data.tobytes()
        fresh = np.zeros(n + 1, bool)
        fresh[offs] = True
        marked = []
        if self.special and any(s.encode() in raw for s in self.merges.specials):
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                for m in self.special.finditer(raw, a, b):
                    marked.append((m.start(), m.end()))
                    fresh[[m.start(), m.end()]] = True
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        cls = self.pre.classes[chars] + np.where(fresh[place], np.uint8(N_CLASSES), np.uint8(0))
        begin = np.zeros(n, bool)
        begin[place[self.pre.starts(cls)]] = True
        gain = np.zeros(n + 1, np.int64)
        gain[1:] = self.merges.gains(data, begin)
        for a, b in marked:
            gain[a + 1 : b + 1] = 0
            gain[a + 1] = 1
        total = np.cumsum(gain)
        return total[offs[1:]] - total[offs[:-1]]


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every whole text.

    A null text counts as empty: no bytes, no tokens.  Strings of special tokens
    in a text count as that one token; where two begin at one place the longer
    counts.  Rows with null or repeated ids are counted like any other, an empty
    table gives no rows, and further columns, whatever their names, are not looked
    at.  A very long text is one worker's; the transducer's states are bounded in
    number, also within one long word.  ``path`` must name the tokenizer on every
    executor.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]):
        c = counter(path)
        for batch, data, offsets in slices(batches, "text", SLICE):
            yield table_of(schema, doc_id=batch.column("doc_id"), n_bytes=np.diff(offsets), n_tokens=c.counts(data, offsets))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(tidy(work), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
