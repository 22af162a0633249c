"""What the operators on texts share: deliveries of source_files, labels of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import spread


def raw_files(source_files: DataFrame) -> DataFrame:
    """file_id, project_id, path, content, loaded_at of all deliveries; a null file_id is no file.

    Contents are judged where they are read and only the short results are brought together by file_id (``latest``), so no
    content is ever shuffled at size; the few repeated deliveries are judged once more each.
    """
    f = source_files.select("file_id", "project_id", "path", "content", "loaded_at").filter(F.col("file_id").isNotNull())
    return spread(f)


def source_label(c: Column) -> Column:
    """Trimmed, lower-cased, '-' as '_'."""
    return F.translate(F.lower(F.trim(c)), "-", "_")
