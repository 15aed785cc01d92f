"""Declared schemas of every file the scans read."""

from __future__ import annotations

SPLIT_CSV = "object string, split string, label string, image string"
SUBSET_CSV = "category string, session string, path string"
SCORE_CSV = (
    "dataset string, category string, seed int, split string, file string, label int, "
    "score_two_view double, score_single double, pos_weight double"
)
TIMING_CSV = (
    "model string, image_size int, precision string, status string, params long, size_mb double, gmacs string, "
    "ms_bs1 double, ms_bs1_std double, img_per_s double, peak_mem_mb double, note string"
)
METRICS = "threshold double, auroc double, aupr double, f1 double, precision double, recall double, ece double"
EPOCHS = (
    f"epoch int, train_loss double, val_loss double, val_metrics struct<{METRICS.replace(' ', ':').replace(',:', ', ')}>, "
    "is_best boolean, tiebreak_win boolean, best_epoch int, patience_left int, pooling_p double, firewalled_test_auroc double"
)
CLASS_HIST = "struct<count:long, mean:double, std:double, hist:array<long>>"
LOGIT_HIST = f"epoch int, edges array<double>, normal {CLASS_HIST}, anomaly {CLASS_HIST}"
SPLIT_COUNTS = "struct<count:long, normal:long, anomaly:long, anomaly_ratio:double>"
STAGE = (
    "stage string, dataset string, category string, "
    f"splits struct<train:{SPLIT_COUNTS}, val:{SPLIT_COUNTS}, test:{SPLIT_COUNTS}>, "
    "flags map<string,boolean>, floors map<string,int>, injected boolean, mode string, anomaly_fraction double, "
    "injection_val_share double, num_train_anomalies int, seed int, "
    "val_share_evidence struct<mode:string, requested:double, resolved:double, val_anomalies_at_resolved:int, floor:int, floor_met:boolean>, "
    "per_type_available map<string,int>, per_type_split map<string,struct<available:int,taken:int,train:int,val:int>>, "
    "train_defect_types array<string>, val_defect_types array<string>, n_defect_types int, n_injected_train int, "
    "n_injected_val int, n_removed_from_test int, type_coverage_complete boolean, pos_weight double, "
    f"metrics struct<{METRICS.replace(' ', ':').replace(',:', ', ')}>"
)
SUMMARY = (
    f"test_metrics struct<{METRICS.replace(' ', ':').replace(',:', ', ')}>, best_epoch int, epochs_ran int, best_val_score double, "
    "monitor string, selection_failed boolean, collapsed boolean, reportable boolean, reliability_tier string, "
    "caveats array<string>, image_size int, model struct<backbone:string, head:string, pooling:string, feat_dim:int, "
    "total_params:long, trainable_params:long, size_mb:double, leaf_ops:int, gmacs:string, macs_at_px:int>"
)
RUN_META = (
    "best_epoch int, epochs_ran int, pos_weight double, transplant_applied boolean, n_synthetic int, n_distinct_hosts int, "
    "original_commit string, original_env string"
)
CENSUS_SPLITS = "map<string,struct<count:long,normal:long,anomaly:long>>"
CENSUS = (
    f"injected map<string,struct<splits_at_locked_fraction:{CENSUS_SPLITS}>>, "
    f"native map<string,struct<splits:{CENSUS_SPLITS},error:string>>"
)
VIEW_SCORES = "dataset string, backbone string, category string, split string, path string, label int, views array<double>"
SCORES = (
    "dataset string, backbone string, category string, split string, path string, label int, score double, features array<float>"
)
