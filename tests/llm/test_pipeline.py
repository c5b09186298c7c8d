import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_jaccard_join import brute
from tests.llm.test_substring_dedup import brute as brute_windows


def test_stages_on_their_own_inputs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas().set_index("doc_id")
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.toPandas().set_index("doc_id")
        kept[name] = len(after)
        assert set(after.index) <= set(before.index)
        if name == "n-gram Jaccard join":
            want = {c for (_, c, _, _) in brute(list(before.text.items()))}
            assert set(after.index) == want
        elif name == "substring dedup":
            want = {i: b for i, b in zip(before.index, brute_windows(list(before.text), 35))}
            for i, row in after.iterrows():
                assert row.text == (want[i][2] if want[i][1] else before.text[i]) and row.n_chars == len(row.text)
        elif name == "SentencePiece encoding":
            sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
            assert all(list(row.ids) == sp.encode(row.text) and row.round_trip for _, row in after.iterrows())
        if name != "SentencePiece encoding":
            assert docs.columns == columns
        else:
            assert docs.columns == [*columns, "ids", "round_trip"]
    assert 0 < kept["quality classifier"] < 200
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert kept["SentencePiece encoding"] <= kept["benchmark decontamination"] <= kept["substring dedup"] == kept["n-gram Jaccard join"]
    assert len(labels)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


CLASHING = ["_tessera_row", "_tessera_id", "_tessera_th", "n_words", "n_removed", "intervals", "kept_text", "own", "ids2", "th", "row"]


def test_columns_of_documents_stay(spark):
    """Columns named like those that the operators use pass through with their values."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = docs.unionByName(docs.limit(3)).select("*", *[F.lit(-7).cast("int").alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r[c] == -7 for r in rows for c in CLASHING), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns == [*docs.columns, "ids", "round_trip"] and last.select("own").first()[0] == -7
