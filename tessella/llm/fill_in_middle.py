"""Fill-in-the-middle transformation with cuts found through sparse checkpoints."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._core import slices, tidy

#: Marks of prefix, suffix and middle; fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two checkpoints.
EVERY = 64
#: Bytes that are counted at a time.
BLOCK = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


class Checkpoints:
    """Places of every ``every``-th unit's end in texts that lie side by side.

    A unit is white space and the run of other characters after it; white space
    at a text's end is a unit, too.  ``n``: units of each text.  Only the
    checkpoints are kept, with their byte and code-point offsets; the units
    between them are read again when a place is asked for.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, every: int = EVERY, block: int = BLOCK):
        self._data, self._offs = data, offsets.astype(np.int64)
        texts = len(offsets) - 1
        self.n = np.zeros(texts, np.int64)
        chars = np.zeros(texts, np.int64)
        ends_text = np.unique(self._offs[1:][np.diff(self._offs) > 0])
        # each text has a checkpoint at its start
        found = [(np.arange(texts), np.zeros(texts, np.int64), self._offs[:-1], np.zeros(texts, np.int64))]
        lo, stop = int(self._offs[0]), int(self._offs[-1])
        while lo < stop:
            hi = min(lo + block, stop)
            white = _WHITE[data[lo : min(hi + 1, stop)]]
            # after each byte: whether a unit ends there
            end = np.zeros(hi - lo, bool)
            end[: len(white) - 1] = ~white[:-1] & white[1:]
            here = ends_text[np.searchsorted(ends_text, lo, "right") : np.searchsorted(ends_text, hi, "right")]
            end[here - lo - 1] = True
            at = np.flatnonzero(end) + lo + 1
            text = np.searchsorted(self._offs, at - 1, "right") - 1
            first = np.searchsorted(text, text)  # of the block's units, the first of the same text
            unit = self.n[text] + np.arange(len(at)) - first + 1
            lead = np.zeros(hi - lo + 1, np.int64)
            np.cumsum((data[lo:hi] & 0xC0) != 0x80, out=lead[1:])
            kept = unit % every == 0
            begin = np.maximum(self._offs[text[kept]], lo)
            found.append((text[kept], unit[kept], at[kept], chars[text[kept]] + lead[at[kept] - lo] - lead[begin - lo]))
            t0, t1 = np.searchsorted(self._offs, [lo, hi - 1], "right") - 1
            edge = np.clip(self._offs[t0 : t1 + 2], lo, hi) - lo
            self.n[t0 : t1 + 1] += np.bincount(text - t0, minlength=t1 + 1 - t0)
            chars[t0 : t1 + 1] += np.diff(lead[edge])
            lo = hi
        text, unit, at, char = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((unit, text))
        self._key, self._at, self._char = (text << 40 | unit)[order], at[order], char[order]

    def place(self, text: int, unit: int) -> tuple[int, int]:
        """Byte offset and code-point offset in a text where its first ``unit`` units end."""
        k = int(np.searchsorted(self._key, text << 40 | unit, "right")) - 1
        at, char, left = int(self._at[k]), int(self._char[k]), unit - (int(self._key[k]) & (1 << 40) - 1)
        start = int(self._offs[text])
        if not left:
            return at - start, char
        raw = memoryview(self._data)
        last = next(islice(_UNIT.finditer(raw, at, int(self._offs[text + 1])), left - 1, None))
        return last.end() - start, char + len(bytes(raw[at : last.end()]).decode())


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, suffix_first: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` of every whole text.

    Numbers from a hash of ``seed`` and the id choose the form (``share`` of a
    hundred texts are changed, ``suffix_first`` of a hundred of these begin with
    the suffix) and the two cuts between units.  A null text counts as empty; an
    empty text and one that holds a mark stay plain, with null lengths.  Texts
    of white space are one unit.  Rows with null ids take the numbers of the
    seed alone; repeated ids take the same numbers, each row for its own text.
    Very long texts are counted block by block.  Further columns, whatever their
    names, are not looked at; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    h = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= share), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]):
        for batch, data, offsets in slices(batches, "text"):
            index = Checkpoints(data, offsets)
            raw = memoryview(data)
            cuts = [batch.column(c).to_numpy() % (index.n + 1) for c in ("h1", "h2")]
            lows, highs = np.minimum(*cuts).tolist(), np.maximum(*cuts).tolist()
            out: list[bytes] = []
            prefix: list[int | None] = []
            middle: list[int | None] = []
            for t, form in enumerate(batch.column("form").to_pylist()):
                one = bytes(raw[int(offsets[t]) : int(offsets[t + 1])])
                if form == "plain":
                    out.append(one)
                    prefix.append(None)
                    middle.append(None)
                    continue
                (a, ca), (b, cb) = index.place(t, lows[t]), index.place(t, highs[t])
                p, m, s = PREFIX.encode() + one[:a], MIDDLE.encode() + one[a:b], SUFFIX.encode() + one[b:]
                out.append(p + s + m if form == "psm" else s + p + m)
                prefix.append(ca)
                middle.append(cb - ca)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(index.n), batch.column("form"), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                schema=schema,
            )

    return rows.mapInArrow(tidy(work), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of :func:`fill_in_middle` was made of; marks end where the next part's begins, as no part holds one."""
    body = F.substr(output, F.lit(4))
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    first = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substr(body, F.length(first) + F.length(second) + 1)
    then = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(then) + len(MIDDLE) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, then)).otherwise(F.concat(then, middle, first))
