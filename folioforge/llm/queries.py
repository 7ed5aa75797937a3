"""Registered queries of the training-data operators: pN_... by problem number, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import p1_reposts, p2_pairs, p3_scans, p4_canonical, p5_split, p6_visible, p7_names, p8_encode, p9_leaks, p10_encoding
from folioforge.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: p1_reposts.reposts(table(s, d, "stories")),
        "p1_groups": lambda s, d: p1_reposts.groups(table(s, d, "stories")),
        "p2_found": lambda s, d: p2_pairs.related(table(s, d, "story_tags")),
        "p2_lifts": lambda s, d: p2_pairs.lifts(table(s, d, "story_tags")),
        "p3_found": lambda s, d: p3_scans.affected(table(s, d, "stories")),
        "p3_texts": lambda s, d: p3_scans.repaired(table(s, d, "stories")),
        "p4_found": lambda s, d: p4_canonical.resolve(table(s, d, "tag_candidates"), table(s, d, "tags")),
        "p4_matches": lambda s, d: p4_canonical.matches(table(s, d, "tag_candidates"), table(s, d, "tags")),
        "p5_found": lambda s, d: p5_split.oversized(table(s, d, "stories")),
        "p5_pieces": lambda s, d: p5_split.split(table(s, d, "stories")),
        "p6_found": lambda s, d: p6_visible.disguised(table(s, d, "stories")),
        "p6_texts": lambda s, d: p6_visible.normalized(table(s, d, "stories")),
        "p7_found": lambda s, d: p7_names.linked(table(s, d, "stories")),
        "p7_entities": lambda s, d: p7_names.attribute(table(s, d, "stories")),
        "p8_ids": lambda s, d: p8_encode.encode(table(s, d, "documents")),
        "p9_found": lambda s, d: p9_leaks.leaked(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_alignments": lambda s, d: p9_leaks.alignments(table(s, d, "documents"), table(s, d, "eval_items")),
        "p10_found": lambda s, d: p10_encoding.affected(table(s, d, "documents")),
        "p10_texts": lambda s, d: p10_encoding.restored(table(s, d, "documents")),
    }


_PAIRS = """
with l as (select distinct story_id, tag_id from story_tags where story_id is not null and tag_id is not null),
n as (select count(distinct story_id) n from l),
c as (select tag_id, count(*) k from l group by 1),
p as (select x.tag_id tag_id_a, y.tag_id tag_id_b, count(*) n_ab from l x join l y on x.story_id = y.story_id and x.tag_id < y.tag_id group by 1, 2)
"""


_RUNS = """
s as (select id, arg_max(body_text, ingested_at) body_text from stories where body_text is not null group by 1),
w as (select id, regexp_extract_all(lower(body_text), '[\\p{L}\\p{N}]+') w from s),
r as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) run from w where len(w) >= 20),
n as (select id, count(*) n from r group by 1),
o as (select x.id id_a, y.id id_b, count(*) o from r x join r y on x.run = y.run and x.id < y.id group by 1, 2)
"""

_LEAKS = """
i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from eval_items where text is not null),
ir as (select distinct item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) run from i where len(w) >= 12),
d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null),
dr as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) run from d where len(w) >= 12)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_RUNS} select id_a, id_b from o join n a on a.id = id_a join n b on b.id = id_b where 5 * o >= 3 * (a.n + b.n - o)",
        "p9_found": f"with {_LEAKS} select distinct doc_id, item_id from dr join ir on ir.run = dr.run",
        "p2_found": _PAIRS
        + "select tag_id_a, tag_id_b from p join c a on a.tag_id = tag_id_a join c b on b.tag_id = tag_id_b, n "
        "where n_ab >= 5 and cast(n_ab as hugeint) * n >= 3 * cast(a.k as hugeint) * b.k",
        "p2_lifts": _PAIRS
        + "select tag_id_a, tag_id_b, n_ab, a.k n_a, b.k n_b, n, n_ab * cast(n as double) / (a.k * cast(b.k as double)) lift "
        "from p join c a on a.tag_id = tag_id_a join c b on b.tag_id = tag_id_b, n",
        "p5_found": "select distinct id from stories where length(body_text) > 4000",
    }
