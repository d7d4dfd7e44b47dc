import pytest
from pyspark.sql import functions as F

from lodestone.operators import reporting
from lodestone.sources import settings


def test_settings_from_file_and_overrides(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("corpus_dir: data\npipeline:\n  chunker: fixed\n  top_k: 7\n  embed_model: org/small-v1.5\n")
    got, rest = settings.load(str(path), {"pipeline": {"top_k": 3, "reranker": "lexical"}})
    assert (got.chunker, got.top_k, got.slug, got.collection, rest) == ("fixed", 3, "fixed__hybrid__lexical", "fixed__small-v1-5", {"corpus_dir": "data"})
    assert got.gate is None and settings.Settings(gate_enabled=True).gate == {"min_score": 0.45, "min_top": 0.5}
    assert got.fingerprint != settings.load(str(path))[0].fingerprint
    assert [s.slug for s in got.grid(["fixed"], ["bm25", "vector"], [None])] == ["fixed__bm25__norerank", "fixed__vector__norerank"]
    (tmp_path / "empty.yaml").write_text("")
    assert settings.load(str(tmp_path / "empty.yaml"))[0] == settings.Settings()


@pytest.mark.parametrize("own", [{"chunker": "none"}, {"retriever": ""}, {"top_k": 0}, {"top_k": True}, {"chunk_size": 100, "chunk_overlap": 100}, {"chunk_overlap": -1}, {"gate_min_score": 1.5}, {"gate_min_score": "x"}, {"reranker": "lexical", "rerank_candidates": 2}, {"unknown": 1}])
def test_settings_out_of_bounds(own):
    with pytest.raises(ValueError):
        settings.load(None, {"pipeline": own})


def test_cells_tables_and_stamps(spark):
    rows = spark.createDataFrame([("a", 0.51234, 12.6, 0.975), ("b", None, None, None), ("c", 0.7, 3.2, 1.0)], "slug string, mrr double, rerank_ms double, judge_coverage double")
    lines = [r.line for r in reporting.table(rows, "slug", ["mrr", "rerank_ms", "judge_coverage"], "mrr").orderBy("place").collect()]
    assert lines == ["| slug | mrr | rerank_ms | judge_coverage |", "|---|---|---|---|", "| c | 0.700 | 3 | 100% |", "| a | 0.512 | 13 | 98% |", "| b | -- | -- | -- |"]
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert spark.range(1).select(reporting.stamp(F.timestamp_seconds(F.lit(86_400.5)))).first()[0] == "1970-01-02T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
