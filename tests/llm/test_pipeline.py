"""Each stage of the pipeline against brute force on what it was given."""

from test_jaccard import brute as groups_of
from test_others import WORD_BPE, brute_hits, brute_lines
from voucherlens.llm import quality
from voucherlens.session import written

import corpus_pipeline


def test_stages(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, rows_of = docs.columns, lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]

    good = written(stages["quality classifier"](spark, docs, small), "test")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out(labels.doc_id)))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert good.columns == columns and {r[0] for r in rows_of(good)} == {d for d, s in scores.items() if s >= 0.5}

    thin = written(stages["line dedup"](spark, good, small), "test")
    before = dict(rows_of(good))
    expected = {(d, t) for d, t in brute_lines(list(before.items())) if t.strip(" \t\r\n") or t == before[d]}
    assert thin.columns == columns and set(rows_of(thin)) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in thin.collect())

    single = written(stages["n-gram Jaccard join"](spark, thin, small), "test")
    assert single.columns == columns
    assert {r[0] for r in rows_of(single)} == {d for d, _, c, _ in groups_of(rows_of(thin)) if d == c}

    clean = written(stages["benchmark decontamination"](spark, single, small), "test")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {d for d, n, hit, _ in brute_hits(rows_of(single), items) if hit and 20 * hit >= n}
    assert clean.columns == columns and {r[0] for r in rows_of(clean)} == {d for d, _ in rows_of(single)} - bad

    packed = stages["packing"](spark, clean, small).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    assert sum(r["length"] for r in packed) == sum(
        len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows_of(clean)
    )


def test_rows_without_ids_and_repeated_rows(spark, table, small):
    """Each row is decided on by its own text."""
    stages = dict(corpus_pipeline.STAGES)
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("length(text) > 100").first()["text"]
    words = [f"w{i}" for i in range(60)]
    copy, near, other = " ".join(words), " ".join(words[:-1] + ["end"]), " ".join(f"v{i}" for i in range(60))
    rows = [(None, copy), (None, copy), (7, near), (7, near), (5, copy), (7, other), (None, other), (None, None), (3, ""), (3, None)]
    docs = written(table(rows), "test")
    kept = stages["n-gram Jaccard join"](spark, docs, small)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert found == sorted([(5, copy), (7, other), (None, None), (3, ""), (3, None)], key=repr)
    rows = [(None, item), (None, other), (4, item), (4, other), (4, other), (None, None)]
    docs = written(table(rows), "test")
    clean = stages["benchmark decontamination"](spark, docs, small)
    assert clean.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr)
    assert found == sorted([(None, other), (4, other), (4, other), (None, None)], key=repr)
    empty = written(table([]), "test")
    for name in ("line dedup", "n-gram Jaccard join", "benchmark decontamination"):
        assert stages[name](spark, empty, small).collect() == []
