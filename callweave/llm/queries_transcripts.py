"""Queries of problem 4."""

from __future__ import annotations

from callweave.llm import transcripts
from callweave.llm.registry import query, table

P4_SQL = r"""
WITH u AS (SELECT id, any_value(call_id) AS call_id, min(startAt) AS s, arg_min(text, loaded_at) AS t, arg_min(lower(trim(speaker)), loaded_at) AS sp
  FROM utterances WHERE startAt >= 0 AND endAt > startAt GROUP BY id),
b AS (SELECT *, lower(regexp_replace(replace(t, '：', ':'), '^\s*((\[\d+:\d+(:\d+)?\]|\(\d+:\d+(:\d+)?\.\d+\)|<\d+(\.\d+)?s>|\d+:\d+:\d+(\.\d+)?)\s*)+', '')) AS body FROM u),
r AS (SELECT *, CASE
    WHEN sp IN ('0','0.0','dispatcher','상담원','119대원','spk0') THEN 'dispatcher'
    WHEN sp IN ('1','1.0','reporter','caller','신고자','spk1') THEN 'reporter'
    WHEN regexp_matches(body, '^\s*(\[상담원\]|(상담원|dispatcher):|119>|접수요원\s+-|상담원\s+\))') THEN 'dispatcher'
    WHEN regexp_matches(body, '^\s*(\[신고자\]|(신고자|caller):|신고인>|민원인\s+-|신고자\s+\))') THEN 'reporter' ELSE 'unknown' END AS role,
  regexp_replace(regexp_replace(body, '^\s*(\[상담원\]|\[신고자\]|(상담원|dispatcher|신고자|caller):|(119|신고인)>|(접수요원|민원인)\s+-|(상담원|신고자)\s+\))', ' '),
    '\(\([^)]*\)\)|[\[(<{【][^\])>}】]*[\])>}】]|\*[^*]*\*|[♪]', ' ', 'g') AS words FROM b),
k AS (SELECT * FROM r WHERE len(list_filter(list_transform(regexp_split_to_array(words, '\s+'), lambda w: regexp_replace(w, '[^가-힣a-z0-9]', '', 'g')),
    lambda w: w <> '' AND NOT regexp_full_match(w, '으*음+|어+|아아+|에+|흠+|u+m+|u+h+|h+m+|e+r+m*'))) > 0),
l AS (SELECT *, lag(role) OVER (PARTITION BY call_id ORDER BY s) AS p FROM k)
SELECT call_id, id AS first_id, role FROM l WHERE p IS NULL OR p <> role"""


@query("p4_found", P4_SQL)
def p4_found(spark, sf):
    return transcripts.turn_starts(table(spark, sf, "utterances")).distinct()


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000\u00a0"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "  "
_FORMS_D, _FORMS_R = r"\[상담원\]|(?:상담원|dispatcher):|119>|접수요원\s+-|상담원\s+\)", r"\[신고자\]|(?:신고자|caller):|신고인>|민원인\s+-|신고자\s+\)"
P4_TURNS_SQL = rf"""
WITH u AS (SELECT id, any_value(call_id) AS call_id, min(startAt) AS s, min(endAt) AS e, arg_min(translate(text, '{_WIDE}', '{_NARROW}'), loaded_at) AS t, arg_min(lower(trim(speaker)), loaded_at) AS sp
  FROM utterances WHERE startAt >= 0 AND endAt > startAt GROUP BY id),
b AS (SELECT *, regexp_replace(t, '^\s*((\[\d+:\d+(:\d+)?\]|\(\d+:\d+(:\d+)?\.\d+\)|<\d+(\.\d+)?s>|\d+:\d+:\d+(\.\d+)?)\s*)+', '') AS body FROM u),
r AS (SELECT *, CASE
    WHEN sp IN ('0','0.0','dispatcher','상담원','119대원','spk0') THEN 'dispatcher'
    WHEN sp IN ('1','1.0','reporter','caller','신고자','spk1') THEN 'reporter'
    WHEN regexp_matches(body, '(?i)^\s*({_FORMS_D})') THEN 'dispatcher'
    WHEN regexp_matches(body, '(?i)^\s*({_FORMS_R})') THEN 'reporter' ELSE 'unknown' END AS role,
  regexp_replace(regexp_replace(body, '(?i)^\s*({_FORMS_D}|{_FORMS_R})', ' '),
    '\(\([^()]*\)\)|[\[(<{{【][^\[(<{{【\])>}}】]*[\])>}}】]|\*[^*]*\*|[♪♫♬]', ' ', 'g') AS words FROM b),
k AS (SELECT *, list_filter(regexp_split_to_array(words, '\s+'), lambda w: regexp_replace(lower(w), '[^가-힣a-z0-9]', '', 'g') <> '' AND NOT regexp_full_match(regexp_replace(lower(w), '[^가-힣a-z0-9]', '', 'g'), '으*음+|어+|아아+|에+|흠+|u+m+|u+h+|h+m+|e+r+m*')) AS said FROM r),
l AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY call_id ORDER BY s) IS DISTINCT FROM role THEN 1 ELSE 0 END AS opens FROM k WHERE len(said) > 0),
n AS (SELECT *, sum(opens) OVER (PARTITION BY call_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS no FROM l)
SELECT call_id, CAST(no AS BIGINT) AS turn_no, role, arg_min(id, s) AS first_id, min(s) AS turn_start, max(e) AS turn_end, count(*) AS n_lines, string_agg(array_to_string(said, ' '), ' ' ORDER BY s) AS turn_text FROM n GROUP BY call_id, no, role"""


@query("p4_turns", P4_TURNS_SQL)
def p4_turns(spark, sf):
    """Every turn of every call, with its text."""
    return transcripts.turns(table(spark, sf, "utterances"))
