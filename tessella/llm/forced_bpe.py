"""Exact BPE encoding and decoding over fragments between forced boundaries."""

from __future__ import annotations

import heapq
import json
import struct
import sys
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import slices, tidy

#: Runs without spaces whose ids a worker remembers, in each of two generations, and words: about 20 MB each.
MEMORY = 120_000
#: Longer ones are not remembered.
LONGEST_KEPT = 64
#: Longer fragments are merged with a heap.
SHORT = 48
#: Characters of texts that are split into words at a time.
LONG = 1 << 19
#: Added to the last byte of a word, which merges by rules of its own.
END = 256


def _units() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _class(inside) -> str:
    """Body of a character class that holds the code points for which ``inside`` is true."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        held = c <= sys.maxunicode and not 0xD800 <= c < 0xE000 and inside(chr(c))
        if held and first is None:
            first = c
        elif not held and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


class ForcedBpe:
    """A tokenizer file of NFC, white space, lower case, a word pattern and byte-level BPE with a mark for a word's end.

    Texts are split into words and words into bytes.  Two bytes that stand side
    by side in no entry of the vocabulary are never part of one token, as every
    merge makes an entry; so a word is cut there, its fragments are merged each
    by itself, and their ids are put together.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path}: not a file of this kind")
        if steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or spec["decoder"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"] or model["continuing_subword_prefix"] or model["dropout"]:
            raise ValueError(f"{path}: these settings are not supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: these added tokens are not supported")
        self.path = path
        self.pattern = steps[0]["pattern"]["Regex"]
        self._words = regex.compile(self.pattern + "|\n").findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        letters, mark = _units(), model["end_of_word_suffix"]

        def plain(token: str) -> str:
            ends = token.endswith(mark)
            out = [letters[c] for c in (token[: -len(mark)] if ends else token)]
            return "".join(map(chr, out[:-1])) + chr(out[-1] + END * ends)

        units = {token: plain(token) for token in model["vocab"]}
        ids = {units[t]: i for t, i in model["vocab"].items()}
        if len(ids) > 1 << 20 or not all(chr(b + e) in ids for b in range(256) for e in (0, END)):
            raise ValueError(f"{path}: not every byte is a token")
        self.byte_id = np.array([ids[chr(u)] for u in range(2 * END)])
        #: whether two bytes stand side by side in some token
        self.inner = np.zeros((2 * END, 2 * END), bool)
        for t in ids:
            for a, b in pairwise(map(ord, t)):
                self.inner[a, b] = True
        #: rank of a pair of ids, and the id that each rank makes
        self.rank: dict[int, int] = {}
        made = []
        for m in model["merges"]:
            a, b = (units[x] for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank[ids[a] << 20 | ids[b]] = len(made)
            made.append(ids[a + b])
        self.made, self.none = np.array(made), len(made)
        self._keys = np.array(sorted(self.rank))
        self._values = np.array([self.rank[k] for k in self._keys.tolist()])
        self.token = {i: t for t, i in (model["vocab"] | self.special).items()}
        # code points whose classes and cases have been the same since Unicode 3.2
        old, now = unicodedata.ucd_3_2_0, unicodedata
        since = lambda c: old.category(c) != "Cn" and old.category(c) == now.category(c)
        self._newer = regex.compile(f"[^{_class(since)}]").search
        self._by_library = None
        self.forget()

    def forget(self) -> None:
        """Drop what was remembered of texts."""
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._known_words: dict[str, bytes] = {}

    # -- words of texts ----------------------------------------------------

    def words(self, runs: list[str]) -> list[list[str]]:
        """Normalized words of runs of characters without line ends and added tokens."""
        text = "\n".join(runs)  # a line's end composes with nothing
        if not text.isascii():
            if self._newer(text):
                return [self._newer_words(r) if self._newer(r) else self.words([r])[0] for r in runs]
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # cased by itself, also where it ends a word
        out: list[list[str]] = [[]]
        now = out[0]
        for w in self._words(text.lower()):
            if w == "\n":
                now = []
                out.append(now)
            else:
                now.append(w)
        return out

    def _newer_words(self, text: str) -> list[str]:
        """The same where a character's class depends on the version of Unicode: as the library's tables have it."""
        if self._by_library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self._by_library = Tokenizer.from_file(self.path).normalizer, pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        normalizer, split = self._by_library
        return [w for w, _ in split.pre_tokenize_str(normalizer.normalize_str(text))]

    # -- ids of words ------------------------------------------------------

    def fragments(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all words as ids, where fragments begin among them, and which of these begin a word."""
        raw = [w.encode() for w in words]
        end = np.cumsum([len(x) for x in raw])
        units = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        units[end - 1] += END
        cut = np.ones(len(units), bool)
        cut[1:] = ~self.inner[units[:-1], units[1:]]  # also at each word's start, as END is only its last byte's
        cut[end[:-1]] = True
        first = np.flatnonzero(cut)
        return self.byte_id[units], first, np.searchsorted(first, np.append(0, end[:-1]))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or ``none``."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._values[at], self.none)

    def merged(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all fragments, which begin at ``first``, and the number of each.

        In each one the pair of least rank merges first, the leftmost among
        equals; all fragments take one merge a round, side by side.
        """
        size = np.diff(np.append(first, len(ids)))
        owner = np.arange(len(first))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        long = size > SHORT
        if long.any():
            for k in np.flatnonzero(long).tolist():
                one = np.array(self.merged_long(ids[first[k] : first[k] + size[k]].tolist()), np.int64)
                done.append((np.array([k]), np.array([len(one)]), one))
            ids, size, owner = ids[np.repeat(~long, size)], size[~long], owner[~long]
        rank = np.full(len(ids), self.none)
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        rank[np.cumsum(size) - 1] = self.none
        while len(size):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            over = least == self.none
            if over.any():
                stay = np.repeat(~over, size)
                done.append((owner[over], size[over], ids[~stay]))
                ids, rank, size, owner, least = ids[stay], rank[stay], size[~over], owner[~over], least[~over]
                if not len(size):
                    break
                start = np.cumsum(size) - size
            here = np.flatnonzero(rank == np.repeat(least, size))
            at = here[np.searchsorted(here, start)]
            ids[at] = self.made[least]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, rank = ids[stay], rank[stay]
            size = size - 1
            shift = np.arange(len(at))
            at, start = at - shift, start - shift
            rank[at] = self.none
            more = at[at + 1 < start + size]
            rank[more] = self._ranks(ids[more], ids[more + 1])
            more = at[at > start] - 1
            rank[more] = self._ranks(ids[more], ids[more + 1])
        count = np.zeros(len(first), np.int64)
        for k, n, _ in done:
            count[k] = n
        place = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for k, n, tokens in done:
            out[np.repeat(place[k] - np.cumsum(n) + n, n) + np.arange(len(tokens))] = tokens
        return out, count

    def merged_long(self, ids: list[int]) -> list[int]:
        """Tokens of one fragment by a linked list and a heap of the pairs; time grows with n log n."""
        n, get = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(pairwise(ids)) if (r := get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j == n or get(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := get(ids[a] << 20 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in ids if p >= 0]

    def _make(self, runs: list[str]) -> list[bytes]:
        """Ids of runs that are not remembered, as 32-bit integers."""
        words = self.words(runs)
        known = self._known_words
        fresh = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in known]
        now = {}
        if fresh:
            ids, first, head = self.fragments(fresh)
            ids, count = self.merged(ids, first)
            stop = np.append(0, np.cumsum(np.add.reduceat(count, head))).tolist()
            raw = ids.astype(np.int32).tobytes()
            now = {w: raw[4 * a : 4 * b] for w, (a, b) in zip(fresh, pairwise(stop))}
        get, old = now.get, known.get
        out = [b"".join([get(w) or old(w) for w in ws]) for ws in words]
        if len(known) + len(now) > MEMORY:
            known.clear()
        known.update((w, x) for w, x in now.items() if len(w) <= LONGEST_KEPT)
        return out

    def _flush(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of lists of runs."""
        every = set().union(*lists)
        young, old = self._young, self._old
        now = {r: young.get(r) or old.get(r) for r in every}
        now[""] = b""
        fresh = [r for r, x in now.items() if x is None]
        if fresh:
            now.update(zip(fresh, self._make(fresh)))
        if len(young) >= MEMORY:
            self._old, self._young = young, {}
        self._young.update((r, x) for r, x in now.items() if len(r) <= LONGEST_KEPT)
        return [b"".join(map(now.__getitem__, runs)) for runs in lists]

    def _parts(self, text: str) -> Iterator[str]:
        """Pieces of about LONG characters, cut at a space, which belongs to no word."""
        at = 0
        while len(text) - at > LONG and (end := text.find(" ", at + LONG)) >= 0:
            yield text[at:end]
            at = end + 1
        yield text[at:]

    def raw_ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts as 32-bit integers.

        No word lies across a space or a line's end, and neither composes with
        what follows it; so texts are taken as runs between these.
        """
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, int, list[str]]] = []
        chars = 0

        def flush() -> None:
            for (t, k, _), ids in zip(held, self._flush([runs for *_, runs in held])):
                out[t][k] = ids
            held.clear()

        for t, text in enumerate(texts):
            at = 0
            for m in [*(self._special.finditer(text or "") if self._special else ()), None]:
                for part in self._parts((text or "")[at : m.start() if m else None]):
                    held.append((t, len(out[t]), part.replace("\n", " ").split(" ")))
                    out[t].append(b"")
                    chars += len(part)
                    if chars > LONG:
                        flush()
                        chars = 0
                if m:
                    out[t].append(struct.pack("=i", self.special[m[0]]))
                    at = m.end()
        flush()
        return [b"".join(x) for x in out]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.raw_ids([text])[0], np.int32).tolist()

    def decode(self, ids) -> str:
        """The tokens of a list of ids with a space between any two; ids that name no token are left out."""
        try:
            return " ".join(map(self.token.__getitem__, ids))
        except KeyError:
            return " ".join(self.token[i] for i in ids if i in self.token)


_models: dict[str, ForcedBpe] = {}


def model(path: str) -> ForcedBpe:
    """The model of a file, made once in each process."""
    if path not in _models:
        _models[path] = ForcedBpe(path)
    return _models[path]


def bpe_encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (string) of every whole text.

    Strings of added tokens in a text become that token, none are added.  A null
    or empty text, and one of white space, has no ids and decodes to the empty
    string; rows with null or repeated ids are encoded like any other, each by
    itself.  Very long texts are split in pieces that change nothing, very long
    words are merged with a heap, and what a worker remembers is bounded and
    forgotten after each task.  Further columns, whatever their names, are not
    looked at; an empty table gives no rows.  ``path`` must name the tokenizer on
    every executor.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]):
        m = model(path)
        try:
            for batch, _, _ in slices(batches, "text"):
                raw = m.raw_ids(batch.column("text").to_pylist())
                ends = np.append(0, np.cumsum([len(x) // 4 for x in raw])).astype(np.int32)
                flat = np.frombuffer(b"".join(raw), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                listed = flat.tolist()
                decoded = [m.decode(listed[a:b]) for a, b in pairwise(ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(decoded, pa.string())], schema=schema)
        finally:
            m.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(work), "doc_id long, ids array<int>, decoded string")
