"""DuckDB SQL of those training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_TYPE = r"nullif(lower(regexp_replace(metadata['document_type'], '^\s+|\s+$', '', 'g')), '')"

P1_FOUND = f"""
with m as (select dataset, sample_id, {_TYPE} as t from manifest where sample_id is not null and dataset is not null),
n as (select dataset, count(distinct sample_id) as n from m group by 1),
s as (select dataset, t, count(distinct sample_id) as supply from m where t is not null group by 1, 2)
select r.dataset, r.document_type
from sample_request r left join n on n.dataset = r.dataset
left join s on s.dataset = r.dataset and s.t = r.document_type
where coalesce(s.supply, 0) < greatest(r.min_rows::double, r.target_share * r.sample_fraction * coalesce(n.n, 0))
"""

P8_ROUNDTRIP = "select doc_id, coalesce(text, '') as text from documents"

SQL = {"p1_found": P1_FOUND, "p8_roundtrip": P8_ROUNDTRIP}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
