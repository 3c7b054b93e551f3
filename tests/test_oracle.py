"""Queries against their SQL in DuckDB, on the smallest tables."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
SOME = "kg_stats encode_triples unify_ids split_train_test test_valid_invalid local_triples hash_partition induced_by_part hop_levels linking_entities counterpart_full benefit_joint g1_context_topk g2_context norm_adj row_norm_adj csls_topk l1_topk mutual_nn rank_metrics_both_dirs pair_bonus_metrics sim_features runtime_rollup seed_merge_first_wins subtask_pairs gcn_layer attention_layer negative_samples cross_entropy candidate_rank target_candidates rank_fusion_reranked weighted_concat_hits gcn_two_layers gcn_packed_layers dense_layer g2_connectors cosine_topk csls_row_thr knn_excl_self l2_topk local_reindex minmax_feature adjacency_sizes head_tail_sizes adjacency_segments head_tail_segments partition_cut".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float | Decimal) else v


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.oracles()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in names) for r in got.collect()) == want


def test_every_query_has_sql_or_is_listed():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"balanced_lp_partition", "alignment_loop", "chebyshev_basis", "attention_training", "multilevel_partition"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
