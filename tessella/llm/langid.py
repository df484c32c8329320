"""Language of texts by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._core import Tokens, mix, pieces, strings, table_of, tidy

#: Rows of each language that the model is fitted on, about; and of all.
SAMPLE_PER_LANGUAGE = 150
SAMPLE = 2_400
#: Characters of a sampled text, from its beginning, that are learned from.
SAMPLE_CHARACTERS = 8_000
#: Bytes of text of all sampled rows; rows beyond it are left out.
SAMPLE_BYTES = 4 << 20
#: Languages that are learned, the most frequent first: 256 times the characters of a text fit into the sample, so each of them has a row.
MOST_LANGUAGES = 256
_TABLE = 1 << 16
_GRAMS = (2, 3, 4)
_CHUNK = 64
#: Bytes of text at a time.
SLICE = 1 << 19
_SEQUENCE = 24
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def word_features(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words and where each word's begin.

    Each word has its n-grams of bytes, with a space at either end: those that
    hold the space are its affixes.  Its last feature stands for the whole word,
    in a table of its own.
    """
    n = len(t.buf)
    wide = np.empty(n + 1 + max(_GRAMS), np.uint64)
    wide[0] = 32
    wide[1 : n + 1] = t.buf
    wide[n + 1 :] = 32
    start, end = t.start, t.end + 2  # in ``wide``, spaces included
    sizes = [np.maximum(end - start - g + 1, 0) for g in _GRAMS]
    per = sum(sizes) + 1
    first = np.append(0, np.cumsum(per))
    out = np.empty(first[-1], np.int64)
    at = first[:-1].copy()
    for g, size in zip(_GRAMS, sizes):
        code = np.zeros(n + 1, np.uint64)
        for i in range(g):
            code = code << np.uint64(8) | wide[i : n + 1 + i]
        code = (mix(code + np.uint64(g << 40)) & np.uint64(_TABLE - 1)).astype(np.int64)
        total = int(size.sum())
        step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at, size) + step] = code[np.repeat(start, size) + step]
        at += size
    out[at] = _TABLE + (t.hashes() & np.uint64(_TABLE - 1)).astype(np.int64)
    return out, first


def emissions(weights: np.ndarray, t: Tokens) -> np.ndarray:
    """Score of each label for each word; features are looked up for a bounded number of words at a time."""
    n, k = len(t.doc), weights.shape[1]
    out = np.zeros((n, k), np.float32)
    if not n:
        return out
    feats, first = word_features(t)
    step = max(256, (1 << 17) // k)
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        out[lo:hi] = np.add.reduceat(weights[feats[first[lo] : first[hi]]], first[lo:hi] - first[lo], axis=0)
    return out


class _Chunks:
    """Words of texts in chunks of bounded length, with the transfer matrix of each chunk.

    A word turns the vector v of what came before into (v t) p, where t are the
    transitions and p the word's own scores; the first word of a text has no
    transition.  The product over a chunk takes vectors from one of its ends to
    the other, so all chunks run side by side and yet nothing is cut off.
    """

    def __init__(self, scores: np.ndarray, first: np.ndarray, trans: np.ndarray, goes_on: bool):
        k = scores.shape[1]
        self.p = np.exp(scores.astype(np.float64) - scores.max(axis=1, keepdims=True))
        self.t = np.exp(trans - trans.max())
        size = np.diff(first)
        self.chunks = -(-size // _CHUNK)
        self.begin = np.append(0, np.cumsum(self.chunks))
        owner = np.repeat(np.arange(len(size)), self.chunks)
        nth = np.arange(self.begin[-1]) - self.begin[owner]
        lo = first[owner] + nth * _CHUNK
        length = np.minimum(first[owner + 1] - lo, _CHUNK)
        self.order = np.argsort(-length, kind="stable")
        self.lo = lo[self.order]
        self.live = [int(np.searchsorted(-length[self.order], -i, "left")) for i in range(int(length.max()))]
        self.starts = ((nth == 0) & (not goes_on))[self.order]  # chunks whose first word has no transition
        m = np.tile(np.eye(k), (len(lo), 1, 1))
        for i, c in enumerate(self.live):
            new = (m[:c] @ self.t if i else np.where(self.starts[:, None, None], m, m @ self.t)) * self.p[self.lo[:c] + i][:, None, :]
            m[:c] = new / new.sum(axis=(1, 2), keepdims=True)
        self.transfer = np.empty_like(m)
        self.transfer[self.order] = m

    def marginals(self, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Probabilities; ``ahead`` and ``back`` are the vectors before and after each text."""
        k = self.p.shape[1]
        a, b = np.empty((len(self.order), k)), np.empty((len(self.order), k))
        some = np.flatnonzero(self.chunks)
        a[self.begin[some]], b[self.begin[some + 1] - 1] = ahead[some], back[some]
        # across chunks, all texts side by side
        texts = np.argsort(-self.chunks, kind="stable")
        counts = -self.chunks[texts]
        for i in range(1, int(self.chunks.max())):
            own = texts[: np.searchsorted(counts, -i, "left")]
            c = self.begin[own] + i
            v = np.einsum("ci,cij->cj", a[c - 1], self.transfer[c - 1])
            a[c] = v / v.sum(axis=1, keepdims=True)
            c = self.begin[own + 1] - 1 - i
            v = np.einsum("cij,cj->ci", self.transfer[c + 1], b[c + 1])
            b[c] = v / v.sum(axis=1, keepdims=True)
        # within chunks
        alpha = np.empty_like(self.p)
        v = a[self.order]
        for i, c in enumerate(self.live):
            at = self.lo[:c] + i
            new = (v[:c] @ self.t if i else np.where(self.starts[:, None], v, v @ self.t)) * self.p[at]
            v[:c] = alpha[at] = new / new.sum(axis=1, keepdims=True)
        v = b[self.order]
        for i in range(len(self.live) - 1, -1, -1):
            c = self.live[i]
            at = self.lo[:c] + i
            alpha[at] *= v[:c]
            new = (self.p[at] * v[:c]) @ self.t.T
            v[:c] = new / new.sum(axis=1, keepdims=True)
        return alpha / alpha.sum(axis=1, keepdims=True)


def marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of each label for each word, by forward-backward over each whole text."""
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    ones = np.ones((len(first) - 1, k))
    return _Chunks(scores, first, trans, False).marginals(ones, ones)


class Crf:
    """Labels, weights of the features and of the transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.weights, self.trans = labels, weights, trans

    def word_labels(self, text: str) -> list[str]:
        """The most probable label of each word of a text, which may change languages."""
        t = Tokens(*strings(pa.array([text], pa.large_string())))
        return [self.labels[i] for i in marginals(emissions(self.weights, t), t.first, self.trans).argmax(axis=1)]

    def predict(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Label with the largest share of each text's words, and that share; words count by their probabilities."""
        probs = marginals(emissions(self.weights, t), t.first, self.trans)
        share = np.stack([np.bincount(t.doc, probs[:, c], t.n_docs) for c in range(len(self.labels))], axis=1).astype(np.float64)
        share /= np.maximum(np.diff(t.first), 1)[:, None]
        return share.argmax(axis=1), share.max(axis=1)

    def predict_long(self, parts: list[np.ndarray]) -> tuple[int, float]:
        """:meth:`predict` for one text in pieces, of which one at a time is held; they are read twice, for the vectors between them and for the words."""
        k = len(self.labels)

        def chunks(i: int) -> _Chunks | None:
            t = Tokens(parts[i], np.array([0, len(parts[i])]))
            return _Chunks(emissions(self.weights, t), t.first, self.trans, goes_on=i > begun) if len(t.doc) else None

        begun = next((i for i, x in enumerate(parts) if len(Tokens(x, np.array([0, len(x)])).doc)), len(parts))
        whole = []
        for i in range(len(parts)):
            m = np.eye(k)
            if c := chunks(i):
                for x in c.transfer:
                    m = m @ x
                    m /= m.sum()
            whole.append(m)
        ahead, back = [np.ones(k)], [np.ones(k)]
        for m in whole[:-1]:
            v = ahead[-1] @ m
            ahead.append(v / v.sum())
        for m in whole[:0:-1]:
            v = m @ back[-1]
            back.append(v / v.sum())
        back.reverse()
        total, n = np.zeros(k), 0
        for i in range(len(parts)):
            if c := chunks(i):
                probs = c.marginals(ahead[i][None], back[i][None])
                total += probs.sum(axis=0)
                n += len(probs)
        share = total / max(n, 1)
        return int(share.argmax()), float(share.max())


def fit(texts: list[str], labels: list[str], rounds: int = 4, seed: int = 7) -> Crf | None:
    """Fit by stochastic gradients of the likelihood of short sequences of words.

    A third of the sequences change from one text to another in the middle, so
    that the transitions see switches.
    """
    names = sorted(set(labels))
    if not names:
        return None
    k = len(names)
    y_of = np.array([names.index(x) for x in labels])
    t = Tokens(*strings(pa.array(texts, pa.large_string())))
    rng = np.random.default_rng(seed)
    weights = np.zeros((2 * _TABLE, k), np.float32)
    trans = np.zeros((k, k))
    if not len(t.start) or k == 1:
        return Crf(names, weights, trans)
    feats, first = word_features(t)
    y = y_of[t.doc]
    heads = np.flatnonzero(t.first[t.doc] + _SEQUENCE <= np.arange(len(y)) + _SEQUENCE)
    heads = heads[heads + _SEQUENCE <= len(y)]
    if not len(heads):
        heads = np.zeros(1, np.int64)
    # each language as often as the others
    by = [heads[y[heads] == c] for c in range(k)]
    by = [b for b in by if len(b)]
    g_w, g_t = np.full(weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6)
    width = min(_SEQUENCE, len(y))
    steps = max(40, min(160, rounds * len(y) // (128 * width)))
    for _ in range(steps):
        pick = [by[i] for i in rng.integers(0, len(by), 128)]
        pick = np.array([b[rng.integers(len(b))] for b in pick])
        at = np.minimum(pick[:, None] + np.arange(width), len(y) - 1)
        mixed = np.flatnonzero(rng.random(len(pick)) < 0.33)
        at[mixed, width // 2 :] = at[rng.integers(0, len(pick), len(mixed)), : width - width // 2]
        words = at.ravel()
        size = first[words + 1] - first[words]
        bounds = np.append(0, np.cumsum(size))
        f = feats[np.repeat(first[words] - bounds[:-1], size) + np.arange(bounds[-1])]
        e = np.add.reduceat(weights[f], bounds[:-1], axis=0).reshape(len(pick), width, k).astype(np.float64)
        grad, pairs = _gradient(e, y[at], trans)
        grad = grad.reshape(-1, k)
        rows, inverse = np.unique(f, return_inverse=True)
        step = np.zeros((len(rows), k), np.float32)
        spread = np.repeat(grad, size, axis=0)
        for c in range(k):
            step[:, c] = np.bincount(inverse, spread[:, c], len(rows))
        step = step / len(pick) - 1e-4 * weights[rows]
        g_w[rows] += step**2
        weights[rows] += 0.1 * step / np.sqrt(g_w[rows])
        pairs /= len(pick)
        g_t += pairs**2
        trans += 0.1 * pairs / np.sqrt(g_t)
    return Crf(names, weights, trans)


def _gradient(e: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood of equally long sequences: of the scores and of the transitions."""
    b, n, k = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    t = np.exp(trans - trans.max())
    alpha, beta = np.empty((n, b, k)), np.ones((n, b, k))
    alpha[0] = p[:, 0] / p[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, n):
        v = (alpha[i - 1] @ t) * p[:, i]
        alpha[i] = v / v.sum(axis=1, keepdims=True)
    for i in range(n - 2, -1, -1):
        v = (p[:, i + 1] * beta[i + 1]) @ t.T
        beta[i] = v / v.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(1, n):
        joint = alpha[i - 1][:, :, None] * t * (p[:, i] * beta[i])[:, None, :]
        pairs -= (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        np.add.at(pairs, (y[:, i - 1], y[:, i]), 1)
    grad = -gamma.transpose(1, 0, 2)
    grad[np.arange(b)[:, None], np.arange(n)[None], y] += 1
    return grad, pairs


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Crf | None:
    """Fit on a sample of labelled rows that are not held out; None without any.

    The sample takes about ``per_language`` rows of each language by a hash of
    their ids, of each the first SAMPLE_CHARACTERS, at most SAMPLE rows and
    SAMPLE_BYTES of text, which the languages share evenly.  Only the
    MOST_LANGUAGES most frequent are learned.  These bounds hold for the sample
    alone; predictions read whole texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return None
    h = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    share = F.lit(0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1 << 30, int((1 << 30) * per_language / r["count"]) + 1))).otherwise(share)
    few = rows.where(h < share).select("lang", F.substring("text", 1, SAMPLE_CHARACTERS).alias("text"), h.alias("h"))
    # languages take turns, so that the bounds leave each as many rows as the others
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    kept = few.withColumn("turn", turn).orderBy("turn", "h", "text").limit(SAMPLE).toLocalIterator()
    texts, langs, size = [], [], 0
    for r in kept:
        size += len(r["text"].encode())
        if size > SAMPLE_BYTES and len(set(langs)) == len(sizes):
            break
        texts.append(r["text"])
        langs.append(r["lang"])
    return fit(texts, langs)


def _lettered(data: np.ndarray) -> bool:
    return bool(_LETTER[data].any()) or any(c.isalpha() for c in data.tobytes().decode("utf-8", "ignore"))


def _labelled(batches: Iterator[pa.RecordBatch], text: str, model: Crf | None) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Rows with the label and the score of each."""
    parts: list[np.ndarray] = []
    for batch, data, offsets, nth, last in pieces(batches, text, SLICE, b" \t\n\v\f\r"):
        if nth or not last:
            parts.append(data[offsets[0] : offsets[-1]])
            if not last:
                continue
            ok = model is not None and any(_lettered(x) for x in parts)
            best, share = model.predict_long(parts) if ok else (0, 0.0)
            parts = []
            yield batch, [model.labels[best] if ok else "und"], np.clip([share], 0, 1)
            continue
        t = Tokens(data, offsets)
        total = np.zeros(len(t._data) + 1, np.int64)
        np.cumsum(_LETTER[t._data], out=total[1:])
        lettered = total[t._offs[1:]] > total[t._offs[:-1]]
        for i in np.flatnonzero(~lettered).tolist():
            lettered[i] = _lettered(t._data[t._offs[i] : t._offs[i + 1]])
        if model is None:
            best, share = np.zeros(t.n_docs, np.int64), np.zeros(t.n_docs)
            lettered[:] = False
        else:
            best, share = model.predict(t)
        labels = [model.labels[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())]
        yield batch, labels, np.where(lettered, np.clip(share, 0, 1), 0.0)


def identify(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every whole text.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text without a model; where two labels tie, the first in their order is
    given.  Rows with null or repeated ids are labelled like any other; a null id
    is not held out.  A very long text is read in pieces, forward and backward
    over all of them.  An empty table gives no rows; further columns, whatever
    their names, are not looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def work(batches: Iterator[pa.RecordBatch]):
        for batch, labels, score in _labelled(batches, "text", sent.value):
            yield table_of(schema, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=labels, score=score)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(work), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, crf: Crf | None, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language: neither ``und`` nor a score below ``least``.

    Columns are those of ``docs``; nothing is shuffled.  Null, empty, repeated and
    very long texts are taken as by :func:`identify`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def work(batches: Iterator[pa.RecordBatch]):
        for batch, labels, score in _labelled(batches, text_col, sent.value):
            yield batch.filter(pa.array((np.array(labels, object) != "und") & (score >= least)))

    return docs.mapInArrow(tidy(work), docs.schema)
