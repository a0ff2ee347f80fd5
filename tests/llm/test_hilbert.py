import itertools
import zlib
from collections import Counter

import duckdb
import pytest
from helpers import SF, clashing, documents, odd_rows, parquet_rows

from pyspark.sql import functions as F

from censusloom.llm import hilbert
from censusloom.llm.queries import QUERIES


@pytest.mark.parametrize(("axes", "bits"), [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(axes, bits):
    cells = list(itertools.product(range(1 << bits), repeat=axes))
    path = sorted(cells, key=lambda c: hilbert.hilbert_index(c, bits))
    assert sorted(hilbert.hilbert_index(c, bits) for c in cells) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:]))


def check_shards(rows, texts, shards=24):
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts
    )
    counts = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in rows:
        counts[r.shard] += 1
        slots[r.shard].append(r.slot)
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    placed = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.place for r in placed] == sorted(r.place for r in rows)


def test_query(spark):
    rows = QUERIES["op9_hilbert_shards"](spark, SF).collect()
    check_shards(rows, [t for (t,) in parquet_rows("documents", "text")])
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_neighbours_share_shards(spark):
    """A filter on one dimension meets fewer shards than by chance."""
    facts = {i: (lang, source) for i, lang, source in parquet_rows("documents", "doc_id, lang, source")}
    met = {}
    for r in QUERIES["op9_hilbert_shards"](spark, SF).collect():
        met.setdefault(facts[r.doc_id][0], set()).add(r.shard)
    assert len(met["es"]) < 18


def test_many_partitions_and_odd_rows(spark):
    docs = clashing(documents(spark, odd_rows()))
    rows = hilbert.shard_documents(docs, rows_per_partition=2).collect()
    check_shards(rows, [r[1] for r in odd_rows()])
    assert hilbert.shard_documents(docs.limit(0)).count() == 0


def test_one_cell_with_all_rows(spark):
    docs = documents(spark, [(i, "same text", "en", "a", 9) for i in range(500)])
    rows = hilbert.shard_documents(docs, rows_per_partition=50).collect()
    check_shards(rows, ["same text"] * 500)


def by_hand(rows, shards=24):
    """(id, shard, slot) from scratch; the curve itself is tested above."""
    n = len(rows)

    def cells(values, cuts):
        points = sorted(set(cuts))
        return [sum(v is not None and v >= p for p in points) * 16 // (len(points) + 1) for v in values]

    axes = []
    for column in (2, 3):
        values = [r[column] for r in rows]
        ordered = sorted(values, key=lambda v: (v is not None, (v or "").encode()))
        axes.append(cells(values, {ordered[-(-k * n // 16) - 1] for k in range(1, 16)} - {None}))
    sizes = [len((r[1] or "").encode()) + 8 for r in rows]
    ordered = sorted(sizes)
    axes.append(cells(sizes, {ordered[max(0, -(-k * n // 16) - 1)] for k in range(1, 16)}))
    crcs = [zlib.crc32((r[1] or "").encode()) for r in rows]
    keys = [(hilbert.hilbert_index(c, 4), crc, (r[0] is not None, r[0])) for c, crc, r in zip(zip(*axes), crcs, rows, strict=True)]
    found, first = [], {}
    for position, i in enumerate(sorted(range(n), key=lambda i: keys[i][:2] + (keys[i][2][0], keys[i][2][1] or 0))):
        shard = position * shards // n
        found.append((rows[i][0], shard, position - first.setdefault(shard, position)))
    return sorted(found, key=repr)


def test_shards_and_slots_from_scratch(spark):
    given = parquet_rows("documents", "doc_id, text, lang, source, n_chars")
    found = QUERIES["op9_hilbert_shards"](spark, SF)
    assert sorted(((r.doc_id, r.shard, r.slot) for r in found.collect()), key=repr) == by_hand(given)
    odd = hilbert.shard_documents(documents(spark, odd_rows()))
    assert sorted(((r.doc_id, r.shard, r.slot) for r in odd.collect()), key=repr) == by_hand(odd_rows())


def test_files(spark, tmp_path):
    docs = documents(spark, [(i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(60)])
    assert hilbert.write_shards(docs, str(tmp_path / "out"), shards=4, bytes_per_file=200) == "shard"
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.input_file_name())
    rows = {r.doc_id: (r.shard, r.slot) for r in back.collect()}
    assigned = hilbert.shard_documents(docs, shards=4)
    assert rows == {r.doc_id: (r.shard, r.slot) for r in assigned.collect()} and len(rows) == 60
    sizes = back.groupBy("file").agg(F.sum(F.length("text") + 8).alias("n"), F.max("slot") - F.min("slot") + 1 - F.count("*")).collect()
    assert len(sizes) >= 4 and max(r.n for r in sizes) < 500 and {r[2] for r in sizes} == {0}


def test_files_keep_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = clashing(documents(spark, odd_rows())).selectExpr("*", "'x' AS slot")
    assert hilbert.write_shards(docs, str(tmp_path / "out")) == "shard_"
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd_rows()) and {"shard", "slot", "shard_", "slot_"} <= set(back.columns)
    assert back.where("doc_id IS NULL").count() == 2 and {r.slot for r in back.collect()} == {"x"}
    hilbert.write_shards(docs.limit(0), str(tmp_path / "none"))


def test_each_value_meets_few_shards(spark):
    """A language meets fewer of the 24 shards the rarer it is, although one has 60 % of the rows."""
    facts = {i: lang for i, lang in duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.1/documents.parquet'").fetchall()}
    met, share = {}, Counter(facts.values())
    for r in QUERIES["op9_hilbert_shards"](spark, "/root/testdata/sf0.1").collect():
        met.setdefault(facts[r.doc_id], set()).add(r.shard)
    for lang, shards in met.items():
        assert len(shards) <= 24 * share[lang] / len(facts) + 6, (lang, len(shards))


def test_long_common_prefixes_are_told_apart(spark):
    """Sources that differ only after many bytes still prune shards."""
    sources = [f"https://www.example.org/{i:02d}" for i in range(24)]
    rows = [(i, f"text {i}" * (i % 7 + 1), "en", sources[i * 7 % 24], 9) for i in range(1_200)]
    found = hilbert.shard_documents(documents(spark, rows)).collect()
    check_shards(found, [r[1] for r in rows])
    met = {}
    for r in found:
        met.setdefault(rows[r.doc_id][3], set()).add(r.shard)
    assert max(map(len, met.values())) <= 8


def test_text_cuts(spark):
    texts = [f"prefix-{i:03d}" for i in range(100) for _ in range(i % 3 + 1)] + [None] * 20 + ["prefix-050x"] * 60
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    ordered = sorted(texts, key=lambda t: (t is not None, t or ""))
    expected = {ordered[-(-k * len(texts) // 16) - 1] for k in range(1, 16)} - {None}
    for per_partition in (7, 1_000):
        assert hilbert.text_cuts(df, "d", 16, per_partition) == sorted(expected)
    assert hilbert.text_cuts(df.limit(0), "d", 16) == []
