"""Declared schemas; nothing is inferred from data."""

RESULT = """name string, status string, attempts int, duration string, output_path string,
 size_bytes bigint, artifact_sha256 string, sql_sha256 string,
 table_count bigint, view_count bigint, trigger_count bigint, routine_count bigint, event_count bigint,
 schema_fingerprint string, row_counts bigint, row_count_mode string,
 table_row_counts map<string,bigint>, sample_row_hashes map<string,string>, sample_row_count int,
 error_category string, error string"""

PHYSICAL = """status string, target_dir string, duration string, error string,
 attempts int, rate_limit_retries int, xtrabackup_parallel int, xbcloud_parallel int"""

VALIDATION = "database string, valid boolean, error string"

# One run of one host.
RUN = f"""timestamp timestamp, run_id string, status string,
 backup_dir string, run_folder string, log_file string,
 failure_reason string, cleanup_error string, duration string,
 databases_total int, databases_succeeded int, databases_failed int,
 results array<struct<{RESULT}>>, physical_backup struct<{PHYSICAL}>,
 logical_upload_run boolean, logical_upload_status string, logical_upload_note string, logical_upload_error string,
 adaptive_load_per_cpu double, adaptive_logical_parallel int, adaptive_physical_parallel int,
 adaptive_xbcloud_parallel int, adaptive_tuning_reason string,
 validation_checked_at timestamp, validation_mode string, validation_status string, validation_error string,
 validation_databases array<struct<{VALIDATION}>>,
 os_user string, execution_source string, hostname string, pid int"""

SAMPLE = "host string, metric string, labels map<string,string>, ts timestamp, value double"
LOG_LINE = "host string, run_id string, line_no bigint, ts timestamp, msg string"
CATALOG_OBJECT = "host string, db string, section string, name string"
ARTIFACT = "run_id string, db string, path string, bytes bigint"
SCHEDULE_STATE = "logical_last_success string, physical_last_success string"
OVERRIDES = "created_at timestamp, expires_at timestamp, `values` map<string,string>, note string"
