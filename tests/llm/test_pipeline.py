"""The pipeline's stages against what brute force keeps."""

import public_tokenizers

import corpus_pipeline
from tessella.llm._core import save
from tessella.llm.sentencepiece_bpe import model

from .test_operators import brute_lines, fingerprint, reach, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(rows)
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "language_id":
            assert len(after) >= 0.99 * sum(any(c.isalpha() for c in r.text or "") for r in rows.values())
        if name == "line_dedup":
            ids = sorted(rows)
            gone = brute_lines([rows[i].text for i in ids], least=1)
            for k, i in enumerate(ids):
                left = "\n".join(x for n, x in enumerate(rows[i].text.split("\n")) if n not in gone[k])
                assert after[i].text == left if left.strip() or not gone[k] else i not in after
        if name == "simhash_near_dedup":
            ids = sorted(rows)
            fps = [fingerprint(rows[i].text, 5) for i in ids]
            root = reach(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 6])
            assert set(after) == {ids[k] for k, r in enumerate(root) if r == k}
        if name == "benchmark_decontamination":
            bench = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            for i, r in rows.items():
                w = words(r.text)
                whole = any(x and any(w[k : k + len(x)] == x for k in range(len(w))) for x in bench)
                seeds = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
                some = any(sum(tuple(x[k : k + 3]) in seeds for k in range(len(x) - 2)) >= 0.2 * len(x) for x in bench)
                assert not (whole and i in after)
                assert i in after or some  # what goes shares much with an item
        if name == "sentencepiece":
            m = model(public_tokenizers.path("piece_bpe_32k.model"))
            assert all(m.encode(rows[i].text) == list(r.ids) for i, r in after.items())
        rows = after
    assert rows


def test_odd_rows(spark):
    """Null ids, null and empty texts, repeated rows, further columns of other names, and an empty table go through all stages."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, bucket int, `rows` string, _hit boolean"
    text = "these words make up a text that is long enough for every stage of it"
    rows = [(1, text, "aa", "s", 68, 1, "z", True), (1, text + " again", "aa", "s", 74, 1, "z", True), (None, text, "aa", "s", 68, 1, "z", True), (3, None, None, None, None, None, None, None), (4, "", "bb", "s", 0, 1, "z", None), (5, "1234 5678", None, "s", 9, 1, "z", None)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, columns)
        for name, stage in corpus_pipeline.STAGES:
            docs = save(stage(spark, docs, SF), name)
            assert name == "sentencepiece" or docs.columns == corpus_pipeline.COLUMNS
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= {1, None, 3, 4, 5} and (1 in ids) == bool(some)
