"""Exact SentencePiece BPE encoding by backtracking over longest matches."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import slices, tidy

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words whose ids a worker remembers, in each of two generations: about 20 MB each.
MEMORY = 120_000
#: Pairs of pieces that a worker remembers to fit or not, by their ids: about 40 MB; and of other pairs.
PAIRS = 400_000
#: Characters of a text that are split into words at a time.
LONG = 1 << 18
#: Ids that are turned into bytes at a time.
_IDS = 1 << 18
#: Words over this many characters are not remembered.
LONGEST_KEPT = 64


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            c = data[i]
            out |= (c & 127) << shift
            i, shift = i + 1, shift + 7
            if c < 128:
                return out, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else varint(i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class PieceModel:
    """A BPE model file with byte fallback and identity normalization."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.dummy_prefix, squeeze, rule = True, True, "identity"
        for field, value in _fields(data):
            if field == 1:
                d = dict(_fields(value))
                self.pieces.append(d[1].decode())
                scores.append(struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(d.get(3, NORMAL))
            elif field == 3:
                d = dict(_fields(value))
                rule, self.dummy_prefix, squeeze = d.get(1, b"").decode(), bool(d.get(3, 1)), bool(d.get(4, 1))
        if rule != "identity" or squeeze or set(self.kinds) & {USER, UNUSED}:
            raise ValueError(f"{path}: only identity normalization without user-defined pieces is supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        if len(self.byte_ids) != 256:
            raise ValueError(f"{path}: byte fallback is needed")
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path}: a piece holds a space after another character")
        #: longest piece that is a proper prefix of a piece, or None
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None) for p in self.ids}
        #: the same by ids; -1 for None
        self.shorter_id = [self.ids[self.shorter[p]] if self.shorter.get(p) else -1 for p in self.pieces]
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, i in self.ids.items():
            self.matcher.add_word(p, i)
        self.matcher.make_automaton()
        self.length = [len(p) for p in self.pieces]
        # characters in no piece never merge; before those of ``stops`` a word ends, as they only begin pieces
        known = set().union(*self.ids)
        apart = "".join(c for c in "\n\t\r" if c not in known)
        bare = [p.lstrip(SPACE) for p in self.ids]
        stops = set(".,;:!?)")
        while mixed := {c for p in bare if p and p[0] not in stops for c in p} & stops:
            stops -= mixed
        own = "".join(map(re.escape, sorted(stops)))
        parts = [f"{SPACE}*[^{SPACE}{apart}{own}]+", f"{SPACE}+(?![^{SPACE}{apart}])"]
        parts += [f"{SPACE}*[{own}][^{SPACE}{apart}]*"] if own else []
        parts += [f"[{apart}]"] if apart else []
        self._words = re.compile("|".join(parts)).findall
        self._pairs: dict[tuple[str, str], bool] = {}
        self._id_pairs: dict[int, bool] = {}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        table = [bytes([self.byte_of[i]]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        self._size = np.array([len(t) for t in table])
        self._place = np.cumsum(self._size) - self._size
        self._table = np.frombuffer(b"".join(table), np.uint8)

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself: best score first, leftmost among equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the merge procedure leaves the two pieces as they are, side by side."""
        key = (left, right)
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def word_pieces(self, word: str) -> list[str]:
        """Pieces of a word: the one sequence whose neighbours all fit.

        Takes the longest match at each place, falls back to shorter ones where
        neighbours do not fit, and marks places from which nothing follows.
        """
        n = len(word)
        longest = [1] * n
        length = self.length
        for end, i in self.matcher.iter(word):
            size = length[i]
            at = end - size + 1
            if size > longest[at]:
                longest[at] = size
        open_ = bytearray(b"\1") * (n + 1)
        out: list[str] = []
        pos = 0
        last = ""
        token: str | None = word[: longest[0]]
        known, shorter = self._pairs.get, self.shorter.get
        while True:
            while token is not None:
                end = pos + len(token)
                if open_[end]:
                    fit = known((last, token))
                    if fit or fit is None and self.fits(last, token):
                        break
                token = shorter(token)
            if token is None:
                open_[pos] = 0
                if not out:
                    raise ValueError(f"no encoding: {word!r}")
                pos -= len(last)
                token = shorter(out.pop())
                last = out[-1] if out else ""
                continue
            out.append(token)
            if end == n:
                return out
            pos, last = end, token
            token = word[pos : pos + longest[pos]]

    def word_ids(self, word: str) -> list[int] | None:
        """:meth:`word_pieces` by ids, for words whose characters all are in some piece where they are needed."""
        n = len(word)
        length, shorter, known = self.length, self.shorter_id, self._id_pairs
        longest = [-1] * n
        for end, i in self.matcher.iter(word):  # of matches that begin at one place the longest comes last
            longest[end + 1 - length[i]] = i
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, last, token = 0, -1, longest[0]
        if token < 0:
            return None
        while True:
            while token >= 0:
                end = pos + length[token]
                if open_[end]:
                    key = last << 20 | token
                    fit = known.get(key)
                    if fit is None:
                        if len(known) >= PAIRS:
                            known.clear()
                        both = self.pieces[last] + self.pieces[token] if out else self.pieces[token]
                        fit = known[key] = self.merged(both) == ([self.pieces[last], self.pieces[token]] if out else [both])
                    if fit:
                        break
                token = shorter[token]
            if token < 0:
                open_[pos] = 0
                if not out:
                    return None
                pos -= length[last]
                token = shorter[out.pop()]
                last = out[-1] if out else -1
                continue
            out.append(token)
            if end == n:
                return out
            pos, last, token = end, token, longest[end]
            if token < 0:
                return None

    def _word(self, word: str) -> bytes:
        """Ids of a word as 32-bit integers."""
        got = self._old.get(word)
        if got is None:
            ids = self.word_ids(word)
            if ids is None:
                ids = []
                for p in self.word_pieces(word):
                    i = self.ids.get(p)
                    if i is not None:
                        ids.append(i)
                    else:
                        ids += [self.byte_ids[b] for b in p.encode()]
            got = struct.pack(f"={len(ids)}i", *ids)
        if len(word) <= LONGEST_KEPT:
            if len(self._young) >= MEMORY:
                self._old, self._young = self._young, {}
            self._young[word] = got
        return got

    def raw_ids(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        if not text:
            return b""
        young, make = self._young, self._word
        out, at = [], 0
        while at < len(text):
            # words begin with their spaces, so a text can be cut before a run of these
            end = text.find(" ", at + LONG)
            while 0 < end < len(text) and text[end - 1] in (" ", SPACE):
                end = text.find(" ", end + 1)
            end = len(text) if end < 0 else end
            escaped = (SPACE if self.dummy_prefix and not at else "") + text[at:end].replace(" ", SPACE)
            ids = []
            for w in self._words(escaped):
                got = young.get(w)
                if got is None:
                    got = make(w)
                    young = self._young
                ids.append(got)
            out.append(b"".join(ids))
            at = end
        return b"".join(out)

    def forget(self) -> None:
        """Drop what was remembered of texts."""
        self._pairs.clear()
        self._id_pairs.clear()
        self._young, self._old = {}, {}

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.raw_ids(text or ""), np.int32).tolist()

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of runs of ids; run i is ids[ends[i]:ends[i + 1]]."""
        place, size = self._place[ids], self._size[ids]
        if self.dummy_prefix:
            head = ends[:-1][ends[:-1] < ends[1:]]
            head = head[self._table[np.minimum(place[head], len(self._table) - 1)] == 32]
            head = head[[self.kinds[i] == NORMAL for i in ids[head].tolist()]]
            place[head] += 1
            size[head] -= 1
        bounds = np.append(0, np.cumsum(size))[ends]
        parts = []
        for i in range(0, len(ids), _IDS):
            p, n = place[i : i + _IDS], size[i : i + _IDS]
            stop = np.cumsum(n)
            parts.append(self._table[np.repeat(p - stop + n, n) + np.arange(int(stop[-1]))].tobytes())
        data = b"".join(parts)
        try:
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                data[a:b].decode()
        except UnicodeDecodeError:
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.string())
        return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])

    def _text(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_bytes_text(held))
                held = bytearray()
            if kind == NORMAL:
                out.append(self.pieces[i].replace(SPACE, " "))
            elif kind == UNKNOWN:
                out.append(" ⁇ ")
        if held:
            out.append(_bytes_text(held))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids; control ids are left out, bytes that form no character become U+FFFD."""
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        text = self._text(ids)
        return text[1:] if self.dummy_prefix and first is not None and self.pieces[first].startswith(SPACE) else text


def _bytes_text(data: bytearray) -> str:
    """UTF-8 text, one U+FFFD for each byte that belongs to no character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a file, made once in each process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (string) of every whole text.

    No begin or end ids, no sampling.  A null or empty text has no ids and
    decodes to the empty string; rows with null or repeated ids are encoded like
    any other, each by itself.  Very long texts are split and decoded in pieces
    that change nothing.  Further columns, whatever their names, are not looked
    at; an empty table gives no rows.  ``path`` must name the model file on every
    executor.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]):
        m = model(path)
        try:
            for batch, _, _ in slices(batches, "text"):
                raw = [m.raw_ids(text) if text else b"" for text in batch.column("text").to_pylist()]
                ends = np.append(0, np.cumsum([len(x) // 4 for x in raw])).astype(np.int32)
                flat = np.frombuffer(b"".join(raw), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, m.decode_batch(flat, ends)], schema=schema)
        finally:
            m.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(work), "doc_id long, ids array<int>, decoded string")
