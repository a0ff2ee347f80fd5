"""The pipeline against the operators' rules, worked out one by one."""

import corpus_pipeline
import test_ngram_join
from helpers import SF, clashing, documents, odd_rows, parquet_rows
from test_packing import check_pieces, reference_ids, tokenizer  # noqa: F401

from censusloom.llm import feistel


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "run_index", "pii", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def cut(rows):
    """Texts after the removal of repeats, by brute force."""
    seen, out = set(), []
    for key, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(data[at : at + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((key, kept.decode("utf-8", "ignore") if any(gone) else text))
    return out


def test_run(spark, tokenizer):  # noqa: F811
    rows = sorted(parquet_rows("documents", "doc_id, text"))  # all are in known languages
    groups = test_ngram_join.brute(rows)
    rows = [(i, t) for i, t in rows if groups[i][0] == i]
    key = feistel.Feistel(feistel.EXAMPLE_KEY)
    rows = [(i, feistel.pseudonymise(t, key)[0]) for i, t in cut(rows)]
    found = corpus_pipeline.run(spark, SF).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
    check_pieces([tuple(r) for r in found.collect()], {i: reference_ids(tokenizer, t) for i, t in rows})


def test_stages_keep_columns_and_survive_odd_rows(spark):
    real = [(*r, 1) for r in parquet_rows("documents", "doc_id + 1000, text, lang, source")]
    for rows in (odd_rows() + real, odd_rows(), []):
        docs = clashing(documents(spark, rows))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            fresh = stage(spark, docs, SF)
            assert fresh.columns == docs.columns and fresh.dtypes == docs.dtypes
            docs = spark.createDataFrame(fresh.collect(), docs.schema)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert pieces.count() >= docs.count()
