from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridwright.catalog.base import Query
from gridwright.llm import packing, secrets
from gridwright.llm.queries import QUERIES, SQL
from tests.compare import compare, duck
from tests.llm import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "kept", "whole", "spans", "_row", "c0"]


@pytest.fixture(scope="module")
def folder(frame, spark, corpus, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("corpus"))
    # Ids are unique here; nulls, ties and repeated ids are tested operator by operator.
    seen, docs = set(), []
    for d, t in corpus:
        if d is not None and d not in seen:
            seen.add(d)
            docs.append((d, t))
    docs.append((500, " ".join(f"u{i}" for i in range(80)) + " token=abcdef123456 end"))
    table = frame(docs).select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"),
        F.length("text").cast("long").alias("n_chars"),
        *[F.lit(i).alias(c) for i, c in enumerate(COLUMNS[5:])])
    table.write.parquet(f"{where}/documents.parquet")
    labels = [(i, 1, 0) for i in range(200, 230)] + [(310, 0, 0), (311, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{where}/labels.parquet")
    return where


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        out = stage(spark, docs, folder)
        if name == "packing":
            kept[name] = out.collect()
            break
        assert out.columns == COLUMNS
        docs = corpus_pipeline.stored(out, "stage")
        kept[name] = after = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text)
        rows = list(before.items())
        if name == "quality rules":
            fine = {r[0] for r in plain.quality(rows) if not r[6]}
            assert set(after) <= fine and fine - set(after) <= {301}  # all capitals
        elif name == "near duplicates":
            assert set(after) == {r[0] for r in plain.near_copies(rows, 5, 80) if r[3]}
        elif name == "repeated passages":
            for d, units, left, _ in plain.repeats(rows, lambda t: tuple(plain.WORD.findall(t)), 50):
                assert after[d] == (before[d] if len(left) == len(units) else " ".join(left))
        elif name == "secret scan":
            assert "abcdef123456" in before[500] and "abcdef123456" not in after[500]
            assert all(after[d] == t for d, t in rows if not secrets.named(t) and d != 500)
    exact, fast = packing.encoders(*packing.default_files())
    pieces = defaultdict(int)
    for r in kept["packing"]:
        pieces[r.doc_id] += r.length
    assert pieces == {
        d: len(packing.token_ids(t, exact, fast)) for d, t in kept["secret scan"].items()}
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.drop("ids").collect())) == sorted(
        tuple(r)[:7] for r in kept["packing"])


def test_empty_tables(spark, folder, tmp_path):
    where = str(tmp_path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{where}/{name}.parquet")
    assert corpus_pipeline.run(spark, where).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    where = "/root/testdata/sf0.001"
    ok, message = compare(spark, duck(where), where, Query(QUERIES[name], SQL[name]))
    assert ok, message


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_keep_one_row_per_input_row(spark, name):
    where = "/root/testdata/sf0.001"
    out = QUERIES[name](spark, where)
    table = {"op5": "pages", "op8": "conversations", "op11": "conversations", "op12": "embeddings"}.get(
        name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{where}/{table}.parquet")
    if name.startswith("op7"):
        assert out.select("doc_id").distinct().count() == rows.count()
    elif name.startswith("op8"):
        assert out.count() == rows.where("role = 'user'").count()
    elif name.startswith("op11"):
        assert out.count() == rows.select("conv_id").distinct().count()
    elif name.startswith("op12"):
        assert out.count() == 5 * rows.where("vec_id % 50 = 0").count()
    else:
        assert out.count() == rows.count()
