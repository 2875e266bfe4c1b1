"""Table schemas as DDL text.  Jobs always read with these; nothing is inferred."""

POSTINGS = (
    "source string, job_id string, url string, title string, company string, description_raw string, "
    "description_text string, location_raw string, country_code string, region string, city string, "
    "job_posting_date string, applicants_raw string, applicants_count bigint, application_links array<string>, "
    "role_label string, role_confidence double, "
    "role_reason struct<summary:string,evidence:array<string>,gaps:array<string>>, taxonomy_version string, "
    "language_reason string, searched_keywords string, searched_location string, application_status string, "
    "applied_at timestamp, created_at timestamp, updated_at timestamp")
POSTING_LANGUAGES = ("source string, job_id string, language string, importance string")
POSTING_WORK_MODES = ("source string, job_id string, work_mode string, is_primary boolean")
MATCHES = (
    "search_id string, source string, job_id string, fit_score double, cta string, stretch_label string, "
    "must_total bigint, must_matched bigint, nice_total bigint, nice_matched bigint, has_language_blocker boolean, "
    "criteria array<struct<sentence:bigint,kind:string,language:string,terms:array<string>,quote:string,"
    "no_sponsorship:boolean,status:string,evidence:string>>, blockers array<string>, created_at timestamp")
SALARY_OBSERVATIONS = (
    "job_source string, job_id string, observation_id string, data_source string, data_source_url string, "
    "benchmark_id string, confidence_label string, matched_by string, is_posted boolean, is_predicted boolean, "
    "currency string, amount_min double, amount_max double, amount_median double, period string, "
    "compensation_type string, annualized_min double, annualized_max double, annualized_median double, "
    "country_code string, region string, city string, evidence string, observed_at timestamp, created_at timestamp")
SALARY_BENCHMARKS = (
    "benchmark_id string, series_id string, data_source string, data_source_url string, normalized_title string, "
    "seniority string, industry string, country_code string, region string, city string, currency string, "
    "period string, compensation_type string, amount_min double, amount_max double, amount_median double, "
    "amount_p10 double, amount_p25 double, amount_p75 double, amount_p90 double, sample_size bigint, "
    "confidence double, fetched_at timestamp, payload string, payload_hash string, normalizer_version int")
ENRICHMENT_STATE = (
    "job_source string, job_id string, exact_status string, exact_attempts int, exact_next_retry_at timestamp, "
    "exact_last_attempt_at timestamp, exact_error string, benchmark_status string, benchmark_attempts int, "
    "benchmark_next_retry_at timestamp, benchmark_last_attempt_at timestamp, benchmark_error string")
STAGE_EVENTS = (
    "id bigint, job_source string, job_id string, stage string, note string, occurred_at timestamp")
APPLICATION_RUNS = ("job_source string, job_id string, status string")
FETCH_LOG = ("id bigint, source string, key string, state string, new_ids bigint, at timestamp")
PAGES = ("page_id bigint, url string, html string")
RESUMES = ("resume_id string, text string")
VECTORS = ("id bigint, embedding array<float>, category string, split string")
