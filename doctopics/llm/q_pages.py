"""Thin queries over ``pages``."""

from __future__ import annotations

from doctopics.llm.base import register, table
from doctopics.llm.warc import archive_pages


@register("op10_warc")
def op10_warc(spark, sf_dir):
    """No SQL: DuckDB has no base32 and no archives; checked by an exact round trip against the pages."""
    rows = archive_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length")
