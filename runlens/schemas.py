"""The library's tables as DDL; every question takes DataFrames with (a superset of) these columns."""

RUNS = """id BIGINT, repository_id BIGINT, branch STRING, ci_run_id STRING, commit_sha STRING, created_at TIMESTAMP,
updated_at TIMESTAMP, duration_seconds DOUBLE, total_specs_count INT, annotated_specs_count INT"""

SHARDS = """id BIGINT, test_run_id BIGINT, shard_id STRING, duration_seconds DOUBLE, total_specs_count INT,
annotated_specs_count INT, created_at TIMESTAMP, updated_at TIMESTAMP"""

OBSERVATIONS = """id BIGINT, repository_id BIGINT, test_run_id BIGINT, test_run_shard_id BIGINT, spec_identity_id BIGINT,
example_id STRING, spec_file_path STRING, file_path STRING, line_number INT, name STRING, intent_entity STRING,
intent_action STRING, intent_behavior STRING, duration_seconds DOUBLE, outcome STRING, status STRING,
embed_failed_at TIMESTAMP, embed_failure_count INT, created_at TIMESTAMP, updated_at TIMESTAMP"""

IDENTITIES = """id BIGINT, repository_id BIGINT, text STRING, text_digest STRING, signal_source STRING,
embedding ARRAY<FLOAT>, file_path STRING, line_number INT, last_seen_test_run_id BIGINT, created_at TIMESTAMP,
updated_at TIMESTAMP"""

EMBEDDING_CACHE = """provider_fingerprint STRING, text_digest STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP,
updated_at TIMESTAMP"""

REJECTIONS = """id BIGINT, repository_id BIGINT, occurred_at TIMESTAMP, details ARRAY<STRING>, total_reasons_count INT,
user_agent STRING"""
