"""Column layouts of the stored tables, their keys and accepted values."""

from __future__ import annotations

from custody.functions import labels

BRONZE = (
    "event_id STRING, source_system STRING, source_sheet_id STRING, source_tab STRING, "
    "source_row_key STRING, source_timestamp TIMESTAMP, payload MAP<STRING,STRING>, "
    "payload_hash STRING, schema_version STRING, ingested_at TIMESTAMP"
)
STG_SHRED = (
    "event_id STRING, batch_id STRING, batch_date DATE, client STRING, location STRING, "
    "tech STRING, serial_raw STRING, serial_norm STRING, dedupe_key STRING, "
    "event_time TIMESTAMP, is_valid BOOLEAN, validation_errors ARRAY<STRING>, created_at TIMESTAMP"
)
STG_REMOVAL = (
    "event_id STRING, client STRING, computer_serial_raw STRING, computer_serial_norm STRING, "
    "drive_serial_raw STRING, drive_serial_norm STRING, notes STRING, tech_email STRING, "
    "event_time TIMESTAMP, is_valid BOOLEAN, validation_errors ARRAY<STRING>, created_at TIMESTAMP"
)
DRIVE = "serial_norm STRING, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP"
BATCH = (
    "batch_id STRING, batch_date DATE, client STRING, location STRING, tech STRING, "
    "first_seen_at TIMESTAMP, last_seen_at TIMESTAMP"
)
DRIVE_EVENT = (
    "drive_event_id STRING, serial_norm STRING, event_type STRING, event_time TIMESTAMP, "
    "source_event_id STRING, batch_id STRING, client STRING, computer_serial STRING, "
    "notes STRING, created_at TIMESTAMP"
)
DECISION = (
    "decision_id STRING, serial_norm STRING, removed_event_id STRING, shredded_event_id STRING, "
    "decision STRING, rule_version STRING, confidence DECIMAL(3,2), reason STRING, "
    "decided_at TIMESTAMP"
)
ASSET = (
    "asset_tag STRING, created_at TIMESTAMP, created_by STRING, computer_serial STRING, "
    "status STRING, device_type STRING, cosmetic_grade STRING, cosmetic_notes STRING, "
    "location STRING"
)
SCAN = (
    "asset_tag STRING, bundle_hash STRING, schema STRING, generated_at TIMESTAMP, "
    "device_serial STRING, tech_name STRING, client_name STRING, cosmetic_condition STRING, "
    "intake_note STRING, summary STRUCT<ram: STRING, storage: STRING>, scanned_at TIMESTAMP, "
    "scanned_by STRING, user_notes STRING, raw STRING"
)
ASSET_DRIVE = (
    "asset_tag STRING, serial STRING, logicalname STRING, capacity_bytes BIGINT, model STRING, "
    "source STRING, status STRING, status_note STRING, status_by STRING, status_at TIMESTAMP"
)
IMPORT_BATCH = (
    "batch_id STRING, created_at TIMESTAMP, created_by STRING, filename STRING, "
    "manual_text STRING, note STRING, total_rows BIGINT, imported_rows BIGINT, "
    "duplicate_rows BIGINT, error_rows BIGINT"
)
LINK = (
    "computer_serial STRING, drive_serial STRING, first_seen_at TIMESTAMP, "
    "last_seen_at TIMESTAMP, seen_count BIGINT, last_batch STRING, resolved_asset STRING, "
    "resolved_drive STRING, resolved_at TIMESTAMP, flagged_suspect BOOLEAN, flag_note STRING"
)
TOUCH = (
    "asset_tag STRING, touch_type STRING, touched_by STRING, touched_at TIMESTAMP, details STRING"
)

BRONZE_KEY = ["source_system", "source_sheet_id", "source_tab", "source_row_key", "payload_hash"]

# table -> (columns that must be unique together)
UNIQUE_KEYS = {
    "bronze": BRONZE_KEY,
    "drives": ["serial_norm"],
    "batches": ["batch_id"],
    "events": ["source_event_id", "event_type"],
    "assets": ["asset_tag"],
    "scans": ["asset_tag", "bundle_hash"],
    "asset_drives": ["asset_tag", "serial"],
    "links": ["computer_serial", "drive_serial"],
}

# table -> {column: accepted codes}; a blank is accepted where the code is optional
ACCEPTED_VALUES = {
    "events": {"event_type": list(labels.EVENT_TYPE)},
    "decisions": {"decision": list(labels.DECISION)},
    "assets": {
        "status": ["", *labels.ASSET_STATUS],
        "device_type": ["", *labels.DEVICE_TYPE],
        "cosmetic_grade": ["", *labels.COSMETIC_GRADE],
    },
    "asset_drives": {
        "status": list(labels.DRIVE_STATUS),
        "source": list(labels.DRIVE_SOURCE),
    },
    "touches": {"touch_type": list(labels.TOUCH_TYPE)},
}

# table -> {column: (table, key it refers to)}
REFERENCES = {
    "scans": {"asset_tag": ("assets", "asset_tag")},
    "asset_drives": {"asset_tag": ("assets", "asset_tag")},
    "touches": {"asset_tag": ("assets", "asset_tag")},
}
