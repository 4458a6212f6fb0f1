"""Size Spark jobs from their own event logs and configuration logs."""

from runwise.session import s3a_conf, scratch_path, scratch_scope

__all__ = ["s3a_conf", "scratch_path", "scratch_scope"]
