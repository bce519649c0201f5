"""The pipeline stage by stage against what the operators say of each stage's own input."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from gridwell.llm import jaccard, mixing, quality, toxicity
from gridwell.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = tmp_path_factory.mktemp("stages"), read(spark, SF, "documents")
    kept = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        kept.append((name, docs))
    return kept


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert [n for n, _ in stages[1:]] == ["quality_rules", "toxicity", "near_duplicates", "mixing", "bpe"]
    for _, df in stages[1:-1]:
        assert df.columns == stages[0][1].columns


def test_filters(spark, stages):
    labels = read(spark, SF, "labels")
    docs, good, clean, single, mix, out = (df for _, df in stages)
    judged = quality.judged(docs, quality.fit(docs, labels))
    assert ids(good) == sorted(r["doc_id"] for r in judged.filter("quality.kept").select("row.doc_id").collect())
    scores = toxicity.scored(good, toxicity.fit(good, labels), ["doc_id"])
    assert ids(clean) == sorted(r["doc_id"] for r in scores.filter("predicted = 0").collect())
    copies = mixing.mix(single).select("row.doc_id", "copies").collect()
    assert ids(mix) == sorted(d for d, n in copies for _ in range(n))
    assert ids(out) == ids(mix)


def test_near_duplicates_stay_once(stages):
    from test_ops import brute

    clean, single = stages[2][1], stages[3][1]
    found = brute({r["doc_id"]: r["text"] for r in clean.select("doc_id", "text").collect()})
    assert ids(single) == sorted({c for _, c in found.values()})


def test_near_duplicates_stay_once_whatever_their_ids(spark):
    a, b, c = ("one two three four five six seven eight nine ten", "red green blue black white grey pink brown", "up down left right in out on off")
    rows = [
        (1, a, "x"), (1, a, "y"), (1, a + " eleven", "z"),  # near copies with one id
        (1, b, "x"), (2, b, "y"),  # other text with that id, and a copy
        (None, c, "x"), (None, c, "y"), (None, c + " over", "z"), (None, "alone here", "x"), (None, None, "x"),
        (3, "", "x"), (3, "", "x"), (3, "", "y"), (4, a, "x"), (4, "of its own, but for its id", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = jaccard.kept(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        map(str, [(1, a, "x"), (1, b, "x"), (None, c, "x"), (None, "alone here", "x"), (None, None, "x"), (3, "", "x"), (3, "", "y"), (4, "of its own, but for its id", "x")])
    )


def test_odd_documents_go_through(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, and no rows at all."""
    plain = read(spark, SF, "documents")
    texts = [None, "", " ", "one", "w " * 5_000, "x" * 20_000, "a\nb\na\n\n\nb\n", "<|endoftext|> " * 30]
    rows = [(k if k % 3 else None, t, None if k % 2 else "en", None if k % 2 == 0 else "s", None, "row", k) for k, t in enumerate([*texts, *texts])]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, size long")
    odd = odd.unionAll(odd).unionByName(plain.limit(40), allowMissingColumns=True)
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        columns = docs.columns
        for k, (stage, of) in enumerate(corpus_pipeline.STAGES):
            out = of(spark, docs, SF)
            out.write.parquet(f"{tmp_path}/{name}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{k}")
            assert docs.columns == columns or stage == "bpe"
        assert (docs.count() > 0) == (name == "odd")


def test_a_failing_stage_leaves_nothing(spark, tmp_path, monkeypatch):
    def fails(*_):
        raise RuntimeError("stop")

    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", lambda spark, docs, _: docs.limit(3)), ("second", fails)])
    with pytest.raises(RuntimeError, match="stop"):
        corpus_pipeline.run(spark, SF)
    assert not list(tmp_path.glob("**/*.parquet"))


def test_ids(stages):
    from tokenizers import Tokenizer

    from gridwell.llm import bpe

    library = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in stages[4][1].select("doc_id", "text").collect()}
    for r in stages[5][1].limit(40).collect():
        wanted = np.array(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(r["ids"]) == wanted
        assert r["ids_sha256"] == hashlib.sha256(wanted).hexdigest()
        assert r["n_tokens"] == len(wanted) // 4
