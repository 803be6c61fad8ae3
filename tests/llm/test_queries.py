import pytest
from against_sql import compare

from folioweave.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF_DIR)


def test_columns(spark):
    want = {
        "op2_hmm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op3_skip_chain_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op4_url_verdicts": "page_id host path rule verdict",
        "op7_simhash_components": "doc_id fingerprint component_id",
        "op9_hierarchical_language": "doc_id held_out lang_pred score",
        "op10_collision_neighbours": "query_id rank vec_id score",
        "op11_ranked_search": "item_id rank doc_id score",
        "op12_repeated_passages": "doc_id n_words n_removed kept_sha256",
    }
    for name, columns in want.items():
        assert set(columns.split()) <= set(queries.QUERIES[name](spark, SF_DIR).columns)
