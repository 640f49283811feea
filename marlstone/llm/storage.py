"""Staged tables, as in the rest of the library, and the bound on Arrow batches of operators with Python."""

from __future__ import annotations

from marlstone.staging import BATCH_BYTES, fresh_path, mark, release, remove, shared_dir, small_batches, stage_table, staged_since

__all__ = ["BATCH_BYTES", "fresh_path", "mark", "release", "remove", "shared_dir", "small_batches", "stage_table", "staged_since"]
