"""Check SQL of sequential greedy selection."""
from __future__ import annotations

from ownerlens.plans import sqltext as Q


def greedy_sql(items: str, close: str) -> str:
    """Sequential greedy selection over ``items(i, …)`` numbered from 1."""
    return f"""WITH RECURSIVE {items},
 near_v AS MATERIALIZED (SELECT b.i, list(a.i) AS earlier FROM item_v a JOIN item_v b ON a.i < b.i AND {close} GROUP BY b.i),
 step_v AS MATERIALIZED (SELECT x.i, coalesce(n.earlier, []) AS earlier FROM item_v x LEFT JOIN near_v n ON n.i = x.i),
 walk_v(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
   SELECT s.i, CASE WHEN list_has_any(w.kept, s.earlier) THEN w.kept ELSE list_append(w.kept, s.i) END FROM walk_v w JOIN step_v s ON s.i = w.i + 1),
 kept_v AS (SELECT unnest(kept) AS i FROM walk_v WHERE i = (SELECT max(i) FROM walk_v))"""


_TOKENS = rf"list_sort(list_distinct(regexp_extract_all(lower({Q.strip('title')}), '[\p{{L}}\p{{N}}_]+')))"
WORD_ITEMS = f"""item_v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS i, seq, toks FROM (SELECT seq, {_TOKENS} AS toks FROM articles_v WHERE {Q.strip('title')} <> '') x)"""
#: Titles whose sets of words are this alike are one story.
WORD_CLOSE = "len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) >= 0.65"
