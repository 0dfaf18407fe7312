"""The operators that a production search draws from, by role."""

from __future__ import annotations

#: Operators of one argument, which make new trees' shapes and mutations.
MUTATION = (
    "cs_rank", "cs_indrank", "cs_indneutral", "cs_abs", "cs_neg", "cs_sign", "cs_sqrt", "cs_log", "cs_inv", "cs_power_third",
    "ts_ttm_4", "ts_growth_1", "ts_growth_2", "ts_growth_4", "ts_delta_1", "ts_delta_2", "ts_delta_4", "ts_delay_1", "ts_delay_2", "ts_delay_4",
    "ts_rank_2", "ts_rank_4", "ts_rank_8", "ts_zscore_4", "ts_zscore_8", "ts_demean_4", "ts_demean_8", "ts_mean_4", "ts_mean_8", "ts_median_4",
    "ts_std_4", "ts_grstable_4", "ts_autoslope_4", "ts_decay_linear_4", "cs_signed_square", "cs_demean", "cs_zscore", "cs_switch_packet_flexible",
    "ts_avg_2", "ts_first_slope_4", "ts_median_abs_deviation_2", "ts_rms_4", "ts_norm_mean_4", "ts_norm_max_4", "ts_norm_min_4", "ts_norm_min_max_4",
    "ts_ratio_beyond_sigma_2_2", "ts_ratio_beyond_sigma_3_2", "ts_index_mass_quantile_q25_2", "ts_number_cross_mean_2", "ts_time_asymmetry_stats_2",
    "ts_longest_strike_above_mean_2", "ts_longest_strike_below_mean_2", "ts_mean_over_1norm_4", "ts_quantile_q25_4", "ts_decay_exp_2", "ts_fw_fracdiff_2",
    "ts_stddev_lms_4", "ts_sharp_4", "ts_sharp_lms_4", "ts_skew_lms_4", "ts_decay_linear_pctchg_4", "ts_smooth_pos_gp_4", "ts_count_over_cs_mean_4", "ts_rsi_4", "ts_rsi_of_pctchg_2",
)
#: Operators of two arguments, which relate two signals.
CROSSOVER = (
    "cs_add", "cs_sub", "cs_mul", "cs_div", "cs_max", "cs_min", "cs_residual", "cs_regressor", "ts_cov_4", "ts_corr_4", "cs_signmul", "cs_zscore_diff", "cs_rank_diff", "cs_zscore_add",
    "cs_zscore_min", "cs_zscore_max", "cs_zscore_mul", "cs_zscore_ratio", "cs_imbalance_coef", "cs_zscore_imbalance_coef", "cs_zscore_harmonic_mean", "cs_double_scored", "ts_roll_resid_4", "ts_signmul_4",
)
PRODUCTION = MUTATION + CROSSOVER
