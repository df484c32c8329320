"""Fill-in-the-middle cuts and forced-boundary BPE against plain versions."""

import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessella.llm import forced_bpe, queries
from tessella.llm.fill_in_middle import Checkpoints, fill_in_middle, restored
from tessella.llm.forced_bpe import bpe_encode_decode

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n long, form string, h string, h1 string, ids string"


def odd_texts():
    rnd = random.Random(4)
    some = ["", None, " ", "\n\t \n", "a", "a ", " a", "é 日本 \U0001d4b3 x", "<P> marked", "ends <M", "> begins <", "<S", "x\x85y z", "w" * 90_000, "b " * 70_000, "Don't we'LL 's 'S ''s", "İſΣς ΑΣ", "é Å", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "ꟜᲉ \U00032000"]
    return some + ["".join(rnd.choice("abc deé\n日<PSM>.'") for _ in range(rnd.randint(1, 400))) for _ in range(200)] + ["same text"] * 5


@pytest.fixture(scope="module")
def rows(spark):
    texts = odd_texts()
    return [(None if i == 3 else i // 2 if i < 8 else i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(5)


def test_checkpoints():
    rnd = random.Random(1)
    for _ in range(600):
        texts = ["".join(rnd.choice("ab é日 \n\t\U0001d4b3\x85") for _ in range(rnd.choice([0, 0, 1, 2, 5, 40, 200]))) for _ in range(rnd.randint(0, 6))]
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"zz" + b"".join(raw) + b"q ", np.uint8), np.cumsum([2] + [len(x) for x in raw])
        index = Checkpoints(data, offsets, every=rnd.choice([1, 2, 3, 7]), block=rnd.choice([1, 3, 10, 1000]))
        for i, t in enumerate(texts):
            units = UNITS.findall(t)
            assert index.n[i] == len(units)
            for u in range(len(units) + 1):
                head = "".join(units[:u])
                assert index.place(i, u) == (len(head.encode()), len(head))


def by_hand(doc_id, text):
    text = text or ""
    told = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(told[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, rows, frame):
    out = fill_in_middle(frame).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out), key=key)
    want = sorted(((i, *by_hand(i, t), t or "") for i, t in rows), key=key)
    assert got == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_in_middle(frame.limit(0)).count() == 0


def test_fill_in_middle_sql(spark, frame, tmp_path):
    """The SQL says the same, also of rows that the sample tables do not have."""
    frame.where("doc_id > 8").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.op12_fill_in_middle(spark, str(tmp_path)).select("doc_id", "n", "form", "output_sha256", "restored_sha256").collect())
    db = duckdb.connect()
    db.sql(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(db.sql("select doc_id, n, form, output_sha256, restored_sha256 from (" + queries.ORACLE_SQL["op12_fill_in_middle"] + ")").fetchall())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_bpe(rows, frame, library):
    key = lambda x: tuple((v is not None, v) for v in x)
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in bpe_encode_decode(frame, PATH).collect()), key=key)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=key)
    assert bpe_encode_decode(frame.limit(0), PATH).count() == 0


def test_bpe_of_every_character(library):
    m = forced_bpe.model(PATH)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 4000):
        for text in ("".join(chars[i : i + 4000]), " ".join(chars[i : i + 4000]), "a".join(chars[i : i + 4000])):
            assert m.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_random_texts(library, monkeypatch):
    monkeypatch.setattr(forced_bpe, "SHORT", 5)
    monkeypatch.setattr(forced_bpe, "LONG", 60)
    monkeypatch.setattr(forced_bpe, "MEMORY", 20)
    m = forced_bpe.model(PATH)
    m.forget()
    rnd = random.Random(3)
    alphabet = "abcdestvrlmABC 's't're  \n\t ΣσςİßǅéÉ̸́'0123٣½一二가각.!?<>|-_​᠎\x1c\x85"
    texts = []
    for k in range(6000):
        s = "".join(rnd.choice(alphabet) if rnd.random() < 0.8 else chr(rnd.randrange(1, 0x3000)) for _ in range(rnd.randint(0, 40)))
        texts.append(s + rnd.choice(["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|<|endoftext|>|>"]) + s[::-1] if k % 7 == 0 else s)
    texts += ["thethe" * 900, "é" * 2000, "'s" * 2000, "ab" * 3000]
    for i in range(0, len(texts), 37):
        raw = m.raw_ids(texts[i : i + 37])
        for t, r in zip(texts[i : i + 37], raw):
            assert np.frombuffer(r, np.int32).tolist() == library.encode(t, add_special_tokens=False).ids


def test_cuts_are_forced(library):
    """No token of any vocabulary entry lies across a cut."""
    m = forced_bpe.model(PATH)
    words = ["".join(random.Random(i).choice("abcxzqé日ßж") for _ in range(12)) for i in range(300)]
    ids, first, head = m.fragments(words)
    tokens, count = m.merged(ids.copy(), first)
    assert len(first) > len(words) and count.min() > 0 and len(head) == len(words)
    for a, b in zip(first[:40], np.append(first[1:], len(ids))[:40]):
        assert m.merged_long(ids[a:b].tolist()) == m.merged(ids[a:b].copy(), np.array([0]))[0].tolist()
