"""Every registered query against its DuckDB oracle (the driver's gate),
on the small driver tables; ids without SQL run and must return rows."""

import pytest

from conftest import SF_SMALL
from respondo.catalog import ORACLE, QUERIES

SLOW_ROWS_ONLY = {"feature_set_comparison", "stacking", "fit_boosted", "calibrate_sigmoid",
                  "random_search_cv", "grid_search_cv", "vote_soft_models", "vote_hard_models",
                  "fit_gbt", "fit_forest", "smote"}


@pytest.fixture(scope="module")
def duck():
    from tools.oracle_check import duck as make
    return make(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    from tools.oracle_check import compare, compare_types
    df = QUERIES[name](spark, SF_SMALL)
    ok, msg = compare_types(df, duck, ORACLE[name])
    assert ok, msg
    ok, msg = compare(df, duck.execute(ORACLE[name]))
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW_ROWS_ONLY))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 1


def test_every_survey_id_registered():
    survey_ids = """scan_delimited scan_delimiter_fallback split_single_column coerce_numeric
    scan_intermediate scan_with_fallback sink_stage_tables sink_metrics_csv sink_test_split
    report_tables save_load_models project_drop project_by_type project_list project_positions
    filter_eq filter_range filter_conjunction filter_membership recode_map label_encode
    align_features align_target shape_count null_profile unknown_profile describe_numeric
    value_counts class_balance group_mean group_quantile group_mode majority_class
    segment_response_rate conditional_rate share_within_class combo_segments
    crosstab_normalized correlation_matrix correlation_topk histogram box_stats
    confusion_matrix head_n sort_desc topk_segments argmax_row nested_topk_features
    union_results str_replace str_split prefix_parse pct_round minmax_domain_scale
    one_hot_probe sigmoid clip grid_range impute_median one_hot_drop_first one_hot_all
    standard_scale pca_95 select_k_best smote train_test_split stratified_split class_weights
    feature_importance impute_mode permutation_importance fit_logistic fit_tree fit_forest
    fit_gbt fit_boosted fit_linear_svm grid_search_cv random_search_cv cross_val_score
    calibrate_sigmoid vote_hard vote_soft accuracy_train_test stacking binary_metrics roc_auc
    roc_curve classification_report model_comparison feature_set_comparison f1_threshold
    profit_sweep profit_simple base_rate_score fallback_score score_with_fallback
    auto_approval decide probability_band recommendation_band factor_explain factor_ranking
    interaction_flags profile_compare negative_signal_adjust bucket_response
    reliability_bins pr_curve""".split()
    missing = [i for i in survey_ids if i not in QUERIES]
    assert not missing, missing
