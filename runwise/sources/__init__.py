from runwise.sources.config_logs import config_record, read_config_logs, write_config_log
from runwise.sources.event_logs import (
    read_event_logs, require_readable, unreadable_event_logs, with_application_id, write_event_logs,
)
from runwise.sources import pools
from runwise.sources.footers import parquet_footers, parquet_profile
from runwise.sources.persons import generate_persons, person_ids
from runwise.sources.tables import read_table, write_table

__all__ = [
    "config_record", "generate_persons", "parquet_footers", "parquet_profile",
    "person_ids", "pools", "read_config_logs", "read_event_logs", "read_table",
    "require_readable", "unreadable_event_logs", "with_application_id", "write_config_log", "write_event_logs", "write_table",
]
