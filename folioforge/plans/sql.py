"""The same queries as SQL for DuckDB over the raw tables."""

from __future__ import annotations

from folioforge.functions.text import ACCENTED, PLAIN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STORIES = "s as (select * exclude (rn) from (select *, row_number() over (partition by id order by ingested_at desc nulls last) rn from stories) where rn = 1)"
LINKS = "l as (select * exclude (rn) from (select *, row_number() over (partition by story_id, tag_id order by source, job_id nulls first) rn from story_tags) where rn = 1)"
LISTING = (
    STORIES
    + """, a as (select * from s where status = 'active'),
reps as (select group_id, min(part_index) part_index, count(*) part_count from a group by 1),
li as (select a.id, a.group_id, a.part_index, coalesce(nullif(trim(a.title, ' '), ''), nullif(trim(g.title, ' '), ''), '(untitled)') title, a.author, part_count
  from reps join a on a.group_id = reps.group_id and a.part_index = reps.part_index left join s g on g.group_id = a.group_id and g.part_index = 0)"""
)
_LOW = f"translate(title, '{UPPER}', '{LOWER}')"
KEY = f"case when {_LOW} like 'a _%' then ltrim(substr(title, 3), ' ') when {_LOW} like 'an _%' then ltrim(substr(title, 4), ' ') when {_LOW} like 'the _%' then ltrim(substr(title, 5), ' ') else title end"


def _like(column: str, q: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}') like '%{q.lower()}%'"


def _page(where: str = "true", limit: str = "", ctes: str = "") -> str:
    return f"with {LISTING}{ctes} select * from li where {where}" + (f" order by {KEY}, id, title {limit}" if limit else "")


def _groups(tag_ids: str) -> str:
    return f"(select a.group_id from a join story_tags t on t.story_id = a.id where t.tag_id in ({tag_ids}))"


def _tokens(column: str) -> str:
    return f"regexp_extract_all(regexp_replace(translate(lower(coalesce({column}, '')), '{ACCENTED}', '{PLAIN}'), '[\\x{{300}}-\\x{{36f}}]', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"


def _tf(phrase: list[str]) -> str:
    if len(phrase) == 1:
        one = "len(list_filter({c}, lambda w: w = '" + phrase[0] + "'))"
    else:
        test = " and ".join(f"{{c}}[i + {k}] = '{p}'" for k, p in enumerate(phrase))
        one = "len(list_filter(range(1, len({c}) - " + str(len(phrase) - 2) + "), lambda i: " + test + "))"
    return " + ".join(one.replace("{c}", c) for c in ("t1", "t2", "t3"))


def _scored(*terms: list[str]) -> str:
    tf = ", ".join(f"{_tf(t)} tf{k}" for k, t in enumerate(terms))
    n = ", ".join(f"sum(case when tf{k} > 0 then 1 else 0 end) n{k}" for k in range(len(terms)))
    idf = lambda k: f"(case when ln((n - n{k} + 0.5) / (n{k} + 0.5)) > 0 then ln((n - n{k} + 0.5) / (n{k} + 0.5)) else 1e-6 end)"
    score = " + ".join(f"{idf(k)} * (tf{k} * 2.2) / (tf{k} + 1.2 * (0.25 + 0.75 * d / ad))" for k in range(len(terms)))
    hit = " and ".join(f"tf{k} > 0" for k in range(len(terms)))
    return f"""tok as (select *, {_tokens("title")} t1, {_tokens("author")} t2, {_tokens("body_text")} t3 from s),
fr as (select *, len(t1) + len(t2) + len(t3) d, {tf} from tok), st as (select count(*) n, avg(d) ad, {n} from fr),
sc as (select fr.*, -({score}) r from fr, st where {hit} and status = 'active')"""


def _works(terms: list[list[str]], where: str) -> str:
    return f"""with {LISTING}, {_scored(*terms)}, b as (select * from (select *, row_number() over (partition by group_id order by r, id) rn from sc) where rn = 1)
select b.id, b.group_id, b.part_index, coalesce(nullif(trim(b.title, ' '), ''), nullif(trim(g.title, ' '), ''), '(untitled)') title, b.author, part_count, round(r, 6) r
from b join reps on reps.group_id = b.group_id left join s g on g.group_id = b.group_id and g.part_index = 0 where {where} order by r, b.id, title limit 50"""


TAGS = "n as (select tag_id, count(*) n from l group by 1), tc as (select id, name, coalesce(n, 0) story_count from tags left join n on id = tag_id)"
SITE = "sn as (select code, count(distinct story_id) n from story_site_tags group by 1), sc as (select t.code, label, coalesce(n, 0) story_count from site_tags t left join sn on sn.code = t.code)"
FIRST, NOW = "(select min(id) from stories)", "2026-01-01T00:00:00Z"
GROUP = "(select group_id from s group by 1 order by count(*) desc, group_id limit 1)"
AUTHOR = "(select author from s where status = 'active' and author is not null group by 1 order by count(distinct group_id) desc, author limit 1)"
TAGGED = "(select story_id from story_site_tags group by 1 order by count(distinct code) desc, story_id limit 1)"
JOBS = "select j.id, type, status, prompt_id, p.name prompt_name, model, scope, total, done, failed, j.created_at from jobs j left join prompts p on p.id = prompt_id"
PENDING = "pe as (select distinct story_id, tag_id, job_id from story_tags where source = 'model')"
LINK_COLUMNS = "story_id, tag_id, source, job_id"
VEC = "list_dot_product(cast(x.embedding as double[]), cast(y.embedding as double[]))"
NORM = "sqrt(list_dot_product(cast({0}.embedding as double[]), cast({0}.embedding as double[])))"


def _cluster_ctes() -> str:
    fold = f"regexp_replace(translate(lower(trim(tag_text, ' ')), '{ACCENTED}', '{PLAIN}'), '[\\x{{300}}-\\x{{36f}}]', '', 'g')"
    return f"""h as (select tag_text, count(*) uses from tag_candidates where status = 'candidate' group by 1),
m as (select tag_text, {fold} c, uses from h where {fold} <> ''),
nm as (select c, first(tag_text order by uses desc, length(tag_text), tag_text) name from m group by 1),
mm as (select tag_text, name from m join nm on m.c = nm.c),
nt as (select name, (select max(id) from tags) + row_number() over (order by name) id from (select distinct name from mm where name not in (select name from tags))),
aw as (select id, name from tags union all select id, name from nt),
nl as (select distinct k.story_id, aw.id tag_id from tag_candidates k join mm on mm.tag_text = k.tag_text join aw on aw.name = mm.name where k.status = 'candidate')"""


def oracle_sql() -> dict[str, str]:
    scope = f"with {STORIES} select id, title from s where status = 'active'"
    eta = """with j as (select id, case when id = 5 then 'running' else status end status, type, model, total, done, failed,
case when id = 5 then 30.0 else last_block_seconds end sec, case when id = 5 then 10 else last_block_items end items from jobs),
ac as (select * from j where status in ('queued', 'running') and type in ('extract', 'cluster')),
ow as (select id, case when total - done - failed <= 0 then 0.0 else (total - done - failed) * sec / items end own from ac where coalesce(items, 0) <> 0 and coalesce(sec, 0) <> 0),
st as (select id, (count(*) over () - row_number() over (order by own, id) + 1) * (own - lag(own, 1, 0.0) over (order by own, id)) step, own from ow),
cu as (select id, sum(step) over (order by own, id rows unbounded preceding) e from st)
select ac.id, round(e, 6) eta_seconds, case when status = 'running' then case when e is null or e < 60 then '<1m' when e < 3600 then '~' || floor(e / 60)::bigint || 'm'
 when e < 86400 then '~' || floor(e / 3600)::bigint || 'h ' || floor(e % 3600 / 60)::bigint || 'm' else '~' || floor(e / 86400)::bigint || 'd ' || floor(e % 86400 / 3600)::bigint || 'h' end end eta
from ac left join cu on cu.id = ac.id"""
    return {
        "browse_page1": _page(limit="limit 50"),
        "browse_page2": _page(limit="limit 50 offset 50"),
        "browse_include_tags": _page(f"group_id in {_groups('1')} and group_id in {_groups('3')}"),
        "browse_exclude_tags": _page(f"group_id not in {_groups('1, 2')}"),
        "browse_include_exclude": _page(f"group_id in {_groups('1')} and group_id not in {_groups('3, 5')}"),
        "sort_keys": f"with {LISTING} select id, title, {KEY} sort_key from li",
        "stories_for_tag": _page(f"group_id in {_groups('1')}", "limit 50"),
        "count_stories_for_tag": f"with {LISTING} select count(distinct group_id) works from a where group_id in {_groups('1')}",
        "stories_for_site_tag": _page("group_id in (select group_id from a join story_site_tags t on t.story_id = a.id where code = 'fa')"),
        "count_stories_for_site_tag": f"with {LISTING} select count(distinct group_id) works from a join story_site_tags t on t.story_id = a.id where code = 'fa'",
        "stories_for_author": _page(f"author = {AUTHOR}", "limit 50"),
        "count_stories_for_author": f"with {LISTING} select count(distinct group_id) works from a where author = {AUTHOR}",
        "more_by_author": _page(f"author = {AUTHOR} and group_id <> {GROUP}", "limit 10"),
        "group_parts": f"with {STORIES} select id, part_index, title, status from s where group_id = {GROUP}",
        "removed_stories": f"with {STORIES} select id, title, author, removed_at from s where status = 'removed' order by removed_at desc, id limit 50",
        "count_removed": f"with {STORIES} select count(*) stories from s where status = 'removed'",
        "story_by_id": f"with {STORIES} select id, title, content_hash from s where id = {FIRST}",
        "random_sample_size": "select least(10, count(distinct id)) stories, least(10, count(distinct id)) ids, least(10, count(distinct id)) active from stories where status = 'active'",
        "tag_counts": f"with {LINKS}, {TAGS} select * from tc",
        "site_tag_counts": f"with {SITE} select * from sc",
        "tag_autocomplete": f"with {LINKS}, {TAGS} select * from tc where {_like('name', 'wid_wed')} order by story_count desc, name limit 20",
        "tag_cloud": f"with {LINKS}, {TAGS}, {SITE} select * from (select 'site' kind, code as key, label, story_count from sc union all select 'tag', cast(id as varchar), name, story_count from tc) order by story_count desc, label, kind, key limit 40",
        "tag_cloud_size": "select (select count(*) from tags) + (select count(*) from site_tags) tags",
        "count_tags": f"select count(*) n from tags where {_like('name', 'masq')}",
        "count_site_tags": f"select count(*) n from site_tags where {_like('label', 's')}",
        "count_prompts": f"select count(*) n from prompts where {_like('name', 'tone')}",
        "tags_of_story": f"with {LINKS} select id, name, source, confidence from tags join l on tag_id = id where story_id = {FIRST}",
        "site_tags_of_story": f"select distinct t.code, label from site_tags t join story_site_tags x on x.code = t.code where story_id = {TAGGED}",
        "prompts_page": "select id, name, based_on_id, created_at from prompts order by created_at desc, id limit 20",
        "prompt_lineage": "select a.id, a.name, b.id parent_id, b.name parent_name from prompts a join prompts b on a.based_on_id = b.id",
        "tag_by_name": "select id, name from tags where name = 'sea witch'",
        "tag_by_id": "select id, name from tags where id = 7",
        "site_tag_by_code": "select code, label from site_tags where code = 'fa'",
        "prompt_by_id": "select id, name, based_on_id from prompts where id = 2",
        "has_candidates": f"with {STORIES} select id from s where status = 'active' and id in (select story_id from tag_candidates where prompt_version = 'v1')",
        "pending_candidates": "select id, story_id, tag_text from tag_candidates where status = 'candidate'",
        "scope_untagged": f"{scope} and id not in (select story_id from story_tags)",
        "scope_resume": f"{scope} and id not in (select story_id from tag_candidates where job_id = 1)",
        "candidate_histogram": "select tag_text, count(*) uses, min(id) first_id from tag_candidates where status = 'candidate' group by 1",
        "search_parts_bm25": f"with {STORIES}, {_scored(['lighthouse'], ['cafe'])} select id, group_id, title, author, round(r, 6) r from sc order by sc.r, id limit 50",
        "search_works_bm25": _works([["harbour"], ["kettle"]], "true"),
        "search_phrase": f"with {STORIES}, {_scored(['way', 'home'])} select id, group_id, title, author, round(r, 6) r from sc order by sc.r, id limit 50",
        "search_with_tags": _works([["kettle"]], f"b.group_id in {_groups('1')} and b.group_id not in {_groups('3')}"),
        "search_nothing": "select id, group_id, title, author, 0.0::double r from stories where false",
        "posting_sizes": f"""with {STORIES}, t as (select id, 'title' field, {_tokens("title")} w from s union all select id, 'author', {_tokens("author")} from s union all select id, 'body_text', {_tokens("body_text")} from s)
select token, field, count(distinct id) stories, count(*) hits from (select id, field, unnest(w) token from t) group by 1, 2""",
        "pending_counts": f"with {PENDING} select count(distinct story_id) stories, count(distinct tag_id) tags from pe",
        "pending_counts_job": f"with {PENDING} select count(distinct story_id) stories, count(distinct tag_id) tags from pe where job_id = 3",
        "pending_tags": f"with {PENDING} select id, name, count(distinct story_id) pending_count from tags join pe on tag_id = id group by 1, 2 order by 3 desc, name limit 50",
        "pending_tags_job": f"with {PENDING} select id, name, count(distinct story_id) pending_count from tags join pe on tag_id = id where job_id = 3 group by 1, 2 order by 3 desc, name limit 50",
        "pending_stories_by_tag": f"""with {STORIES}, {PENDING}, w as (select unnest([2, 3, 999999]) tag_id), r as (select distinct pe.tag_id, coalesce(title, '') title, s.id from pe join s on s.id = story_id)
select cast(w.tag_id as bigint) tag_id, title, id from w left join r on r.tag_id = w.tag_id""",
        "pending_by_story": f"""with {STORIES}, {PENDING}, p as (select id, title, author from s where id in (select story_id from pe) order by title nulls first, id limit 50)
select p.id, p.title, p.author, string_agg(name, ';' order by name) tags from p join (select distinct story_id, tag_id from pe) d on d.story_id = p.id join tags t on t.id = d.tag_id group by 1, 2, 3""",
        "jobs_page": f"{JOBS} order by j.created_at desc, j.id desc limit 25",
        "jobs_extract_done": f"{JOBS} where status = 'done' and type = 'extract' order by j.created_at desc, j.id desc limit 25",
        "jobs_count": "select count(*) jobs from jobs where status = 'queued'",
        "job_detail": f"{JOBS} where j.id = 2",
        "active_jobs": "select id, type, status, model, created_at from jobs where status in ('queued', 'running') and type in ('extract', 'cluster')",
        "job_completion": eta,
        "block_schedule": "select job_id, item, (n - 1) // 10 round, (n - 1) % 10 turn from (select job_id, c.id item, row_number() over (partition by job_id order by c.id) n from tag_candidates c join jobs j on j.id = job_id)",
        "jobs_reaped": "select id, case when id = 4 and type not in ('extract', 'cluster') then 'failed' when id = 4 then 'running' when status = 'running' and (pid is null or type not in ('extract', 'cluster')) then 'failed' else status end status, case when (id = 4 and type not in ('extract', 'cluster')) or (id <> 4 and status = 'running' and (pid is null or type not in ('extract', 'cluster'))) then 'the process is gone' else error end error from jobs",
        "jobs_cancelled": f"select id, case when id = 4 and status in ('queued', 'running') then 'failed' else status end status, case when id = 4 and status in ('queued', 'running') then '{NOW}' else finished_at end finished_at from jobs",
        "jobs_progressed": "select id, done + (select count(*) from tag_candidates c where c.job_id = j.id) done, failed from jobs j",
        "jobs_created": "select id, type, status, total from jobs union all select max(id) + 1, 'sync', 'queued', 0 from jobs",
        "mut_upsert_stories": f"with {STORIES} select id, group_id, part_index, case when part_index = 1 then 'New ' || coalesce(title, '') else title end title, status, removed_at from s",
        "mut_link_absent": f"with {LINKS} select {LINK_COLUMNS} from l union all select distinct story_id, 2, 'model', 5 from story_site_tags t where not exists (select 1 from l where l.story_id = t.story_id and tag_id = 2)",
        "mut_label_upsert": "select code, case when code < 'h' then label else 'New ' || label end label from site_tags",
        "mut_merge_tags": f"with {LINKS} select {LINK_COLUMNS} from l where tag_id <> 1 union all select story_id, 3, source, job_id from l where tag_id = 1 and story_id not in (select story_id from l where tag_id = 3)",
        "mut_delete_tag": f"with {LINKS} select {LINK_COLUMNS} from l where tag_id <> 1",
        "mut_rename_tag": "select id, case when id = 5 then 'renamed' else name end name from tags",
        "mut_approve_tag": f"with {LINKS} select story_id, tag_id, case when tag_id = 1 and job_id = 3 and source = 'model' then 'human' else source end source, job_id from l",
        "mut_reject_tag": f"with {LINKS} select {LINK_COLUMNS} from l where not (tag_id = 1 and source = 'model')",
        "mut_approve_story": f"with {LINKS} select story_id, tag_id, case when story_id = {FIRST} and source = 'model' then 'human' else source end source, job_id from l",
        "mut_revert_job": f"with {LINKS} select id, name from tags where id in (select tag_id from l where not (coalesce(job_id, 0) = 3 and source = 'model'))",
        "mut_revert_links": f"with {LINKS} select {LINK_COLUMNS} from l where not (coalesce(job_id, 0) = 3 and source = 'model')",
        "mut_status": f"with {STORIES} select id, case when id = {FIRST} then 'removed' else status end status, case when id = {FIRST} then '{NOW}' else removed_at end removed_at from s",
        "mut_new_tags": "select id, name from tags union all select (select max(id) from tags) + row_number() over (order by name), name from (select distinct lower(label) as name from site_tags where lower(label) not in (select name from tags))",
        "mut_manual_story": f"with {STORIES} select id, content_hash, source_relpath, status from s union all select 'manual-1', sha1('Body'), 'manual-entry', 'active'",
        "mut_write_clusters": f"with {LINKS}, {_cluster_ctes()} select {LINK_COLUMNS} from l union all select story_id, tag_id, 'model', 999 from nl where not exists (select 1 from l where l.story_id = nl.story_id and l.tag_id = nl.tag_id)",
        "mut_clustered_marks": f"with {_cluster_ctes()} select case when status = 'candidate' and tag_text in (select tag_text from mm) then 'clustered' else status end status, count(*) n from tag_candidates group by 1",
        "cosine_pairs": f"select x.vec_id a, y.vec_id b, round({VEC} / ({NORM.format('x')} * {NORM.format('y')}), 6) similarity from embeddings x join embeddings y on x.vec_id < y.vec_id where {VEC} / ({NORM.format('x')} * {NORM.format('y')}) >= 0.4",
        "label_centroids": "select label, position - 1 as position, round(avg(x), 6) as value from (select label, cast(unnest(embedding) as double) x, unnest(range(1, len(embedding) + 1)) as position from embeddings) group by 1, 2",
        "nearest_centroid": f"""with c as (select label, list(v order by position) embedding from (select label, position, avg(x) v from (select label, cast(unnest(embedding) as double) x, unnest(range(1, len(embedding) + 1)) as position from embeddings) group by 1, 2) group by 1),
p as (select x.vec_id, y.label, {VEC} / ({NORM.format("x")} * {NORM.format("y")}) sim from embeddings x, c y)
select vec_id, label nearest, round(sim, 5) similarity from (select *, row_number() over (partition by vec_id order by round(sim, 9) desc, label) n from p) where n = 1""",
        "context_sizes": f"with {STORIES}, n as (select length(coalesce(body_text, '')) * 8 // 4 + 512 need from s) select case when need <= 4096 then 4096 when need <= 8192 then 8192 when need <= 16384 then 16384 else 32768 end context, count(*) stories from n group by 1",
        "body_limits": "select id, (greatest(least(16384, 131072, id * 4096), 4096) - 512) * 4 - 4000 chars from jobs",
        "durations": "with d as (select id, total * 97 * id * id s from jobs) select id, case when s >= 86400 then '~' || s // 86400 || 'd ' || s % 86400 // 3600 || 'h' when s >= 3600 then '~' || s // 3600 || 'h ' || s % 3600 // 60 || 'm' when s >= 60 then '~' || s // 60 || 'm' else '<1m' end as text from d",
        "signature_ids": f"with {STORIES} select sha1(source_relpath) id, sha1(group_id) group_id, sha1(coalesce(body_text, '')) content_hash from s",
        "repeated_story_ids": "select id, count(*) as rows from stories group by 1 having count(*) > 1",
        "orphan_links": f"with {STORIES} select story_id, tag_id from story_tags where story_id not in (select id from s where status = 'active')",
        "latest_rows": f"with {STORIES} select id, ingested_at, status from s",
        "event_windows": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2",
        "scope_words": "select id, case when scope like '{%' then json_extract_string(scope, '$.limit') end most, case when scope like '{%' then null else scope end word from jobs",
    }
