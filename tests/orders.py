"""The order of rows of every query that sorts its result, as SQL over its twin's columns."""

_DAYS = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"
_AGES = ("['Child (0-12)', 'Teen (13-17)', 'Young Adult (18-35)', 'Adult (36-50)', 'Middle Age (51-65)', "
         "'Senior (65+)']")
_BUCKETS = "['0–20 min', '21–40 min', '41–60 min', '60+ min']"


def _by(labels: str, column: str) -> str:
    return f"coalesce(list_position({labels}, {column}), 0)"


_DAY, _AGE = _by(_DAYS, "day_of_week"), _by(_AGES, "age_group")
_ORDERS = {
    "admission_date NULLS FIRST": ("daily_volume", "chart_daily_volume"),
    "filter, value NULLS FIRST": ("filter_choices",),
    "patient_count DESC, department NULLS LAST": (
        "department_performance", "preset_department_performance", "report_top_departments"),
    "admission_rate_pct DESC NULLS LAST, race NULLS LAST": (
        "equity_by_race", "preset_admission_rate_by_race", "report_admission_rate_by_race"),
    _AGE: ("by_age_group", "age_group_frequencies", "chart_score_box"),
    "hour NULLS FIRST": (
        "hourly", "hourly_with_unknown", "preset_hourly_peak", "report_hourly_peak", "mean_wait_by_hour",
        "chart_hourly_volume"),
    f"CASE WHEN {_DAY} = 0 THEN 7 ELSE {_DAY} END, day_of_week NULLS LAST": ("by_weekday",),
    "year NULLS FIRST, month NULLS FIRST": (
        "monthly_trend", "preset_monthly_trend", "report_monthly_trend", "chart_monthly_volume"),
    "wait_time DESC NULLS LAST, patient_id NULLS FIRST": (
        "long_wait_alerts", "preset_long_wait_admitted", "report_long_wait_admitted"),
    "count DESC, race NULLS LAST, gender NULLS LAST, age_group NULLS LAST, department_referral NULLS LAST": (
        "low_score_groups",),
    "count DESC, race NULLS LAST, gender NULLS LAST, age_group NULLS LAST": ("report_low_scorers",),
    _by(_BUCKETS, "wait_bucket"): ("score_by_wait_bucket",),
    "year NULLS FIRST": ("yearly", "yearly_table"),
    "dimension, key": ("admission_rates", "mean_waits", "mean_scores", "temporal_counts"),
    "dimension, n DESC, key": ("frequencies",),
    "patients DESC, department NULLS FIRST": ("department_table",),
    "patient_id NULLS FIRST, wait_time NULLS FIRST": ("anomaly_list",),
    "count DESC, admission_flag": ("chart_admission_status",),
    "count DESC, gender": ("chart_gender",),
    "count DESC, race": ("chart_race",),
    "bin_start": ("chart_age_histogram", "chart_score_histogram"),
    "scope": ("chart_age_box",),
    f"{_AGE}, admission_flag": ("chart_age_group_status",),
    "count, department_referral": ("chart_department_counts",),
    "admission_rate NULLS FIRST, department_referral": ("chart_department_rates",),
    "avg_wait NULLS FIRST, department_referral": ("chart_department_waits",),
    "admission_flag NULLS FIRST, bin_start": ("chart_wait_histogram",),
    _DAY: ("chart_wait_box", "chart_wait_heatmap", "chart_weekday_volume"),
    f"{_DAY}, wait_time": ("chart_wait_outliers",),
    "avg_score NULLS FIRST, race": ("chart_score_by_race",),
    f"{_AGE}, point": ("chart_score_density",),
    f"{_AGE}, satisfaction_score": ("chart_score_outliers",),
    "md5('42|' || patient_id), patient_id": ("sampled_visits", "segment_scatter"),
    "label": ("confusion_matrix",),
    "cluster": ("cluster_profiles", "patient_segments"),
    "visits DESC, department": ("quick_chart_of_departments",),
}
ORDER = {name: order for order, names in _ORDERS.items() for name in names}
