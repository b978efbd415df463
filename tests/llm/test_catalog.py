"""The registered queries of the subpackage: DuckDB results and the columns of the contract."""

import pytest

from sitelens.llm import catalog
from tests.conftest import SF0001
from tests.oracle import compare, duck

COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_language": "doc_id held_out lang_pred score",
    "op3_pieces": "doc_id ids n_tokens n_byte_tokens round_trip",
    "op4_cover_tree": "vec_id n_links component_id kept",
    "op5_toxicity": "doc_id held_out score predicted spans",
    "op6_simhash": "doc_id fingerprint component_id",
    "op7_secrets": "doc_id n_assign n_access n_hex n_random base_sha256 spans",
    "op8_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op10_lines": "doc_id n_units n_removed spans kept_text",
    "op11_ranking": "item_id rank doc_id score",
    "op12_alignment": "doc_id n_a n_b n_groups n_links groups_sha256 n_best count_sum",
    "op13_ball_tree": "query_id rank vec_id score",
}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_oracle(spark, name):
    ok, msg = compare(catalog.QUERIES[name](spark, SF0001), catalog.ORACLE_SQL[name], duck(SF0001))
    assert ok, msg


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in catalog.ORACLE_SQL])
def test_whole_tables_and_columns(spark, name):
    df = catalog.QUERIES[name](spark, SF0001)
    source = "embeddings" if name == "op4_cover_tree" else "documents"
    assert df.columns == COLUMNS[name].split()
    assert df.count() == spark.read.parquet(f"{SF0001}/{source}.parquet").count()
