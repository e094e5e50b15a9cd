"""Feature columns of the master dataset after the readmission drop list.

Written out for the SQL oracle, which cannot select columns by Spark type;
the Spark side derives the same lists from the schema at run time, so a
drift between the two shows up as a failed check.
"""

NUMERIC_FEATURES = ['length_of_stay_days', 'icu_days', 'total_charges_usd', 'insurance_paid_usd', 'admission_year', 'admission_month', 'admission_dayofweek', 'is_weekend_admission', 'cost_per_day', 'out_of_pocket_cost', 'insurance_coverage_ratio', 'icu_ratio', 'had_icu_stay', 'systolic_bp_mean', 'systolic_bp_min', 'systolic_bp_max', 'systolic_bp_std', 'diastolic_bp_mean', 'diastolic_bp_min', 'diastolic_bp_max', 'diastolic_bp_std', 'heart_rate_mean', 'heart_rate_min', 'heart_rate_max', 'heart_rate_std', 'respiratory_rate_mean', 'respiratory_rate_min', 'respiratory_rate_max', 'respiratory_rate_std', 'temperature_c_mean', 'temperature_c_min', 'temperature_c_max', 'temperature_c_std', 'spo2_percent_mean', 'spo2_percent_min', 'spo2_percent_max', 'spo2_percent_std', 'gcs_score_mean', 'gcs_score_min', 'gcs_score_max', 'gcs_score_std', 'news2_score_mean', 'news2_score_min', 'news2_score_max', 'news2_score_std', 'pain_score_mean', 'pain_score_min', 'pain_score_max', 'pain_score_std', 'num_vital_readings', 'bmi', 'num_lab_tests', 'num_abnormal_labs', 'pct_abnormal_labs', 'num_medications', 'num_high_alert_meds', 'num_unique_drug_classes', 'has_high_alert_med', 'num_diagnoses', 'num_poa_diagnoses', 'age', 'charlson_comorbidity_index', 'num_prior_admissions', 'num_prior_ed_visits', 'social_support_score', 'has_diabetes', 'has_hypertension', 'has_heart_disease', 'has_copd', 'has_ckd', 'has_depression', 'has_obesity', 'has_cancer', 'total_comorbidities', 'is_high_comorbidity', 'is_high_utiliser', 'low_social_support', 'num_ed_visits', 'num_ed_admissions', 'avg_ed_wait_minutes', 'avg_ed_los_minutes']
CATEGORICAL_FEATURES = ['admission_type', 'admission_source', 'discharge_disposition', 'gender', 'ethnicity', 'insurance_type', 'smoking_status', 'alcohol_use', 'language_preference', 'age_group']
