"""Key columns.  Every table may have a leading ``repo``; where it does, files are
``(repo, path)`` and commits ``(repo, commit_id)``, else ``path`` and ``commit_id`` alone."""

from __future__ import annotations

from pyspark.sql import DataFrame


def file_key(df: DataFrame) -> list[str]:
    return ["repo", "path"] if "repo" in df.columns else ["path"]


def commit_key(df: DataFrame) -> list[str]:
    return ["repo", "commit_id"] if "repo" in df.columns else ["commit_id"]


def repo_key(df: DataFrame) -> list[str]:
    return ["repo"] if "repo" in df.columns else []
