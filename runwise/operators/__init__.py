from runwise.operators.counts import partition_profile, row_count, value_counts
from runwise.operators.curve import (
    Curve, fit_curve, merge_curve, pooled_points, predict_curve, probe_points, read_curve, refit_curve,
    write_curve,
)
from runwise.operators.joins import expand_pairs, factor_join, join_size, pair_join, self_join
from runwise.operators.metrics import (
    app_durations, app_metrics, effective_conf, task_bytes, task_metrics, task_peak_memory,
)
from runwise.operators.people import derive_persons, prefix_columns
from runwise.operators.predict import (
    combine_predictions, predict_footprint, predict_gc, predict_spill, training_points,
)
from runwise.operators.trials import best_trial, trial_stats, trial_table

__all__ = [
    "Curve", "app_durations", "app_metrics", "best_trial", "combine_predictions",
    "derive_persons", "effective_conf", "expand_pairs", "factor_join", "fit_curve", "join_size", "merge_curve", "pair_join",
    "partition_profile", "pooled_points", "predict_curve", "predict_footprint", "predict_gc",
    "predict_spill", "prefix_columns", "probe_points", "read_curve", "refit_curve", "row_count", "self_join",
    "task_bytes", "task_metrics", "task_peak_memory", "training_points", "trial_stats",
    "trial_table", "value_counts", "write_curve",
]
