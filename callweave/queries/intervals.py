"""Periods, silences and overlaps of speech."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.operators import intervals
from callweave.queries.registry import query, table

SIDE_SQL = "CASE WHEN lower(trim(speaker)) IN ('0','0.0','dispatcher','상담원','119대원','spk0') THEN 'dispatcher' WHEN lower(trim(speaker)) IN ('1','1.0','reporter','caller','신고자','spk1') THEN 'reporter' ELSE 'unknown' END"


def side(col: str = "speaker"):
    """The side that a speaker value names, in any of its spellings; ``unknown`` for all else."""
    v = F.lower(F.trim(F.col(col)))
    # fixed values: spellings of the two sides
    return (
        F.when(v.isin("0", "0.0", "dispatcher", "상담원", "119대원", "spk0"), "dispatcher")
        .when(v.isin("1", "1.0", "reporter", "caller", "신고자", "spk1"), "reporter")
        .otherwise("unknown")
    )


_U = "SELECT DISTINCT call_id, startAt AS s, endAt AS e FROM utterances WHERE startAt >= 0 AND endAt > startAt"


@query(
    "p3_found",
    f"""WITH w AS (SELECT call_id, s, max(e) OVER (PARTITION BY call_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ({_U}))
SELECT call_id, pe AS gap_start, s AS gap_end FROM w WHERE s - pe >= 1500""",
)
def p3_found(spark, sf):
    return intervals.gaps(table(spark, sf, "utterances"), ["call_id"], min_gap=1500).distinct()


@query(
    "p3_side_periods",
    f"""WITH u AS (SELECT DISTINCT call_id, {SIDE_SQL} AS side, startAt AS s, endAt AS e FROM utterances WHERE startAt >= 0 AND endAt > startAt),
w AS (SELECT *, max(e) OVER (PARTITION BY call_id, side ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM u),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY call_id, side ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM w)
SELECT call_id, side, CAST(k AS BIGINT) AS period_no, min(s) AS period_start, max(e) AS period_end FROM i GROUP BY call_id, side, k""",
)
def p3_side_periods(spark, sf):
    """Continuous periods of each side of each call."""
    u = table(spark, sf, "utterances").withColumn("side", side())
    return intervals.periods(u, ["call_id", "side"])
