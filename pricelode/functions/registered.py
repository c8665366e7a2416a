"""Functions for users of SQL: temporary SQL functions, which Catalyst puts into the plan of the query that calls them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Signature and body. The rules are those of ``ids.ean`` without a decimal tail, and of ``ids.gtin14``.
SCALARS = {
    "normalize_ean(value STRING) RETURNS STRING": """
        CASE length(regexp_replace(coalesce(value, ''), '[^0-9]', ''))
            WHEN 11 THEN concat('0', regexp_replace(value, '[^0-9]', ''))
            WHEN 8 THEN regexp_replace(value, '[^0-9]', '') WHEN 12 THEN regexp_replace(value, '[^0-9]', '')
            WHEN 13 THEN regexp_replace(value, '[^0-9]', '') WHEN 14 THEN regexp_replace(value, '[^0-9]', '')
        END""",
    "gtin_14(value STRING) RETURNS STRING": "lpad(normalize_ean(value), 14, '0')",
}


def register(spark: SparkSession) -> list[str]:
    """Make the scalar functions known to a session; their names."""
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in SCALARS]


def register_claims(spark: SparkSession, queue: str, name: str = "claim_next") -> None:
    """A table function ``name(most)``: the next ``most`` jobs of a view with job, priority, requested_at, state and next_attempt_at as of a time,
    in the order of ``queueing.claim_order``: the highest priority (null last), then the longest wait, then job. A literal
    ``most`` becomes a top list below the window, so each task passes on no more rows than that."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(most INT, as_of TIMESTAMP_NTZ) RETURNS TABLE (place INT, job BIGINT, priority INT, requested_at TIMESTAMP_NTZ)
        RETURN SELECT place, job, priority, requested_at FROM (
            SELECT job, priority, requested_at, row_number() OVER (ORDER BY priority DESC NULLS LAST, requested_at ASC NULLS FIRST, job) AS place
            FROM {queue} WHERE state = 'queued' OR (state = 'retry_later' AND next_attempt_at <= as_of))
        WHERE place <= most""")  # fmt: skip
