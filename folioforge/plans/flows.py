"""Registered queries of sources, adapters, job runs and small changes, with the same as SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.model import SCHEMAS, Library, evolve
from folioforge.operators import jobs, mutate, runs
from folioforge.plans.sql import LINK_COLUMNS, LINKS, STORIES
from folioforge.sources import adapters, files, registry

NOW, LATE = "2026-01-01T00:00:00Z", "2027-02-03T04:05:06Z"
FIRST = "(select min(story_id) from story_tags)"
WHOLE = 10_000_000  # characters; no body is cut into pieces


class Lengths:
    """A stand-in for a model: tags by the length of the prompt, no answer for every seventh."""

    def generate(self, prompt: str) -> str:
        n = len(prompt)
        return "none" if n % 7 == 0 else json.dumps({"tags": [f"Size: {n % 5}", "even" if n % 2 == 0 else "odd", "size:EVEN"]})


class Initials:
    """A stand-in for an embedding: one of two directions by the first letter."""

    def embed(self, text: str) -> list[float]:
        return [1.0, 0.0] if text[:1] < "n" else [0.0, 1.0]


def pages(library: Library) -> DataFrame:
    """A page for every document, for the adapters; without a text for those that have none."""
    head = F.concat(F.coalesce(F.concat(F.lit("== "), X.escape_html(F.col("title")), F.lit(" ==\n")), F.lit("")), F.lit("~ "), F.coalesce("source", F.lit("nobody")), F.lit(" ~\n"))
    page = F.concat(F.lit("<main>"), head, F.lit("<nav>skip</nav><p>"), X.escape_html(F.col("text")), F.lit("</p></main>"))
    return library.table("documents").select(F.concat(F.lit("d/page_"), F.col("doc_id"), F.lit(".html")).alias("relpath"), page.alias("text"))


def adapter() -> adapters.PatternAdapter:
    return adapters.PatternAdapter(title="== (.*?) ==", author="~ ([^~\n]+) ~", static_tags=("imported", "fa"), strip_html=True)


def tables_of(library: Library) -> runs.Tables:
    named = {n: library.table(n) for n in SCHEMAS if n not in ("stories", "story_tags", "job_errors")}
    return named | {"stories": library.stories, "story_tags": library.links, "job_errors": library.spark.createDataFrame([], SCHEMAS["job_errors"])}


def with_job(library: Library, kind: str, **more) -> tuple[runs.Tables, int]:
    tables = tables_of(library)
    table = jobs.create(tables["jobs"], kind, NOW, **more).select(*SCHEMAS["jobs"].names)
    return tables | {"jobs": table}, table.agg(F.max("id")).first()[0]


def synced(library: Library) -> runs.Tables:
    tables, job = with_job(library, "sync")
    return tables | runs.sync(tables, job, pages(library), adapter(), LATE, 5)


def extracted(library: Library) -> runs.Tables:
    tables, job = with_job(library, "extract", prompt_id=2, model="m", scope="untagged")
    return tables | runs.extract(tables, runs.job_row(tables, job), Lengths, LATE, 5, WHOLE)


def clustered(library: Library) -> runs.Tables:
    tables, job = with_job(library, "cluster", model="m")
    return tables | runs.cluster(tables, runs.job_row(tables, job), Initials, LATE, 5)


def newest(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("id")).limit(1).select("type", "status", "total", "done", "failed", "pid", "started_at", "finished_at")


def raw_signatures(library: Library) -> DataFrame:
    """Signature files of all stories: by part, whole, without a title, broken, or no object."""
    s = library.stories.withColumn("tags", F.array(F.lit("x")))
    whole = F.to_json(F.struct("id", "group_id", "part_index", "title", "author", "body_text", "source_relpath", "content_hash", "ingested_at", "tags"), {"ignoreNullFields": "false"})
    untitled = F.to_json(F.struct("id", "group_id", "part_index", "author", "body_text", "source_relpath", "content_hash", "ingested_at"), {"ignoreNullFields": "false"})
    kind = F.col("part_index") % 4
    return s.select(F.col("id").alias("file"), F.when(kind == 0, whole).when(kind == 1, untitled).when(kind == 2, "{broken").otherwise("[1]").alias("text"))


def registered(library: Library) -> DataFrame:
    """A registry that grew by every site tag, as rows; one name was moved and one taken out."""
    state = registry.EMPTY
    for r in library.site_tags.orderBy("code").collect():
        state = registry.changed(state, "ensure", r.code, r.label)
    state = registry.changed(registry.changed(state, "rename", state[1][0][0], "renamed"), "unregister", state[1][1][0])
    return library.spark.createDataFrame([(k, n, p, n == state[0]) for k, (n, p) in enumerate(state[1])], "place bigint, name string, path string, active boolean")


def _jobs_changed(library: Library) -> DataFrame:
    t = jobs.failed(jobs.finished(jobs.set_total(library.jobs, 4, 77), 1, NOW), 2, "boom", NOW)
    return jobs.reset(t, 3).select("id", "status", "total", "done", "failed", "error", "finished_at")


def _links(df: DataFrame) -> DataFrame:
    return df.select("story_id", "tag_id", "source", "job_id")


def _first(library: Library) -> str:
    return library.story_tags.agg(F.min("story_id")).first()[0]


def queries() -> dict[str, Callable[[Library], DataFrame]]:
    return {
        "adapter_fields": lambda x: adapter().apply(pages(x).where("text is not null")).select("relpath", "group_key", "part_index", "title", "author", F.array_join("tags", ",").alias("tags")),
        "adapter_bodies": lambda x: adapter().apply(pages(x).where("text is not null")).select("relpath", "body_text"),
        "article_text": lambda x: pages(x).select("relpath", adapters.prose_udf("main")("text").alias("body")),
        "signatures_good": lambda x: files.split_signatures(raw_signatures(x))[0].select("file", "id", "title", "body_text", F.array_join("tags", ",").alias("tags")),
        "signatures_bad": lambda x: files.split_signatures(raw_signatures(x))[1],
        "story_signatures": lambda x: runs.signature_of(x.stories).select("id", "title", "source_relpath", F.size("tags").alias("tags")),
        "stories_evolved": lambda x: evolve(x.stories.drop("status", "removed_at", "media_path"), "stories").select("id", "status", "removed_at", "media_path"),
        "registry_rows": registered,
        "normalized_tags": lambda x: x.tag_candidates.groupBy("story_id").agg(F.array_sort(F.collect_list("tag_text")).alias("t")).select("story_id", F.array_join(X.normalized_tags(F.col("t")), "|").alias("tags")),
        "chunk_counts": lambda x: x.stories.where("body_text is not null").select("id", F.size(X.chunk_paragraphs(F.col("body_text"), 1500)).alias("chunks")),
        "chunk_letters": lambda x: x.stories.where("body_text is not null").select("id", F.explode(X.chunk_paragraphs(F.col("body_text"), 1500)).alias("c")).groupBy("id").agg(F.sum(F.length(F.replace("c", F.lit("\n"), F.lit("")))).alias("letters"), (F.max(F.length("c")) <= 1500).alias("fits")),
        "prompts_rendered": lambda x: x.stories.select("id", X.rendered(F.lit("T {title} A {author}\n{body_text}"), F.col("title"), F.col("author"), X.truncated(F.coalesce("body_text", F.lit("")), 1000)).alias("prompt")),
        "job_sync_stories": lambda x: synced(x)["stories"].select("id", "group_id", "title", "author", "content_hash", "ingested_at", "status"),
        "job_sync_errors": lambda x: synced(x)["job_errors"].select("id", "story_ref", "error"),
        "job_sync_site_tags": lambda x: synced(x)["site_tags"],
        "job_sync_job": lambda x: newest(synced(x)["jobs"]),
        "job_extract_candidates": lambda x: extracted(x)["tag_candidates"].select("id", "story_id", "tag_text", "prompt_version", "status", "job_id"),
        "job_extract_errors": lambda x: extracted(x)["job_errors"].select("id", "story_ref"),
        "job_extract_job": lambda x: newest(extracted(x)["jobs"]),
        "job_cluster_tags": lambda x: clustered(x)["tags"].select("id", "name"),
        "job_cluster_links": lambda x: _links(clustered(x)["story_tags"]),
        "job_cluster_job": lambda x: newest(clustered(x)["jobs"]),
        "prompt_preview": lambda x: runs.previewed(x.stories.where("part_index = 1"), "{title}: {body_text}", Lengths, WHOLE).select("id", F.array_join("tags", ",").alias("tags"), F.col("error").isNotNull().alias("lost")),
        "jobs_changed": _jobs_changed,
        "jobs_unfinished": lambda x: jobs.unfinished(x.jobs),
        "mut_merge_tags_tags": lambda x: mutate.merge_tags(x.tags, x.links, 1, 3)[0].select("id", "name"),
        "mut_delete_tag_tags": lambda x: mutate.delete_tag(x.tags, x.links, 1)[0].select("id", "name"),
        "mut_revert_jobs": lambda x: mutate.revert_job(x.jobs, x.tag_candidates, x.links, x.tags, 3, NOW)["jobs"].select("id", "reverted_at"),
        "mut_revert_candidates": lambda x: mutate.revert_job(x.jobs, x.tag_candidates, x.links, x.tags, 3, NOW)["tag_candidates"].select("id", "job_id"),
        "mut_delete_link": lambda x: _links(mutate.delete_link(x.links, _first(x), x.story_tags.where(F.col("story_id") == _first(x)).agg(F.min("tag_id")).first()[0])),
        "mut_link_source": lambda x: _links(mutate.set_link_source(x.links, _first(x), x.story_tags.where(F.col("story_id") == _first(x)).agg(F.max("tag_id")).first()[0], "checked")),
        "mut_reject_story": lambda x: _links(mutate.reject(x.links, story_id=_first(x))),
        "mut_add_by_name": lambda x: _links(mutate.add_tags_by_name(x.tags, x.links, _first(x), ["sea witch", "entirely new"], NOW)[1]),
        "mut_insert_candidates": lambda x: mutate.insert_candidates(x.tag_candidates, "s", ["b", "a", "b"], "v", "m", NOW, 4).select("id", "story_id", "tag_text", "status", "job_id"),
        "mut_create_prompt": lambda x: mutate.seed_prompt(mutate.create_prompt(x.prompts, "new", "text", NOW, 3), "never", "", NOW).select("id", "name", "based_on_id"),
        "mut_site_links": lambda x: mutate.signature_site_links(x.story_site_tags, x.stories.select("id", F.array(F.lit("fa"), F.lit("zz")).alias("tags"))),
    }


BLANK = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _paragraphs(x: str, separator: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '{separator}'), lambda p: trim(regexp_replace(p, '{BLANK}+', ' ', 'g'), ' ')), lambda p: p <> ''), chr(10) || chr(10))"


PAGES = f"""pg as (select 'd/page_' || doc_id || '.html' relpath, coalesce(nullif({_stripped("title")}, ''), 'Page ' || doc_id) title, coalesce(source, 'nobody') author, text, title own,
  {_paragraphs("' skip  ' || text || ' '", "\\n" + BLANK + "*\\n")} body_text from documents)"""
EXTRACT = (
    STORIES
    + """, todo as (select s.id, title, replace(replace(replace(p.text, '{title}', coalesce(nullif(title, ''), '(untitled)')), '{author}', coalesce(nullif(author, ''), '(unknown)')), '{body_text}', coalesce(body_text, '')) prompt, p.name prompt_name
  from s, prompts p where p.id = 2 and status = 'active' and s.id not in (select story_id from story_tags)),
pr as (select *, length(prompt) n from todo),
tg as (select id, cast(n % 5 as varchar) t, prompt_name from pr where n % 7 <> 0 union select id, case when n % 2 = 0 then 'even' else 'odd' end, prompt_name from pr where n % 7 <> 0 union select id, 'even', prompt_name from pr where n % 7 <> 0)"""
)
CLUSTER = """h as (select tag_text, count(*) uses from tag_candidates where status = 'candidate' group by 1),
nm as (select substr(tag_text, 1, 1) < 'n' k, first(tag_text order by uses desc, length(tag_text), tag_text) name from h group by 1),
nt as (select name, (select max(id) from tags) + row_number() over (order by name) id from nm where name not in (select name from tags)),
aw as (select id, name from tags union all select id, name from nt),
nl as (select distinct c.story_id, aw.id tag_id from tag_candidates c join nm on nm.k = (substr(c.tag_text, 1, 1) < 'n') join aw on aw.name = nm.name where c.status = 'candidate')"""
_TIMES = f"cast(5 as bigint) pid, '{LATE}' started_at, '{LATE}' finished_at"
CHUNKS = f"""with recursive {STORIES}, b as (select id, length(body_text) whole, list_transform(string_split(body_text, chr(10) || chr(10)), lambda p: length(p)) ps from s where body_text is not null),
w as (select id, ps, 0 i, 0::bigint done, null::bigint held from b where whole > 1500 union all
  select id, ps, i + 1, case when ps[i + 1] > 1500 then done + (held is not null)::bigint + (ps[i + 1] + 1499) // 1500 when held + 2 + ps[i + 1] <= 1500 then done else done + (held is not null)::bigint end,
  case when ps[i + 1] > 1500 then null when held + 2 + ps[i + 1] <= 1500 then held + 2 + ps[i + 1] else ps[i + 1] end from w where i < len(ps))
select id, 1 chunks from b where whole <= 1500 union all select id, done + (held is not null)::bigint from w where i = len(ps)"""


def oracle_sql() -> dict[str, str]:
    return {
        "adapter_fields": f"with {PAGES} select relpath, relpath group_key, 0 part_index, title, author, 'imported,fa' tags from pg where text is not null",
        "adapter_bodies": f"with {PAGES} select relpath, body_text from pg where text is not null",
        "article_text": f"with {PAGES} select relpath, {_paragraphs("coalesce('== ' || own || ' ==' || chr(10), '') || '~ ' || author || ' ~' || chr(10) || chr(10) || chr(10) || text", "\\n\\n")} body from pg",
        "signatures_good": f"with {STORIES} select id file, id, title, body_text, 'x' tags from s where part_index % 4 = 0",
        "signatures_bad": f"with {STORIES} select id file, case part_index % 4 when 1 then 'missing title' else 'not a JSON object' end reason from s where part_index % 4 <> 0",
        "story_signatures": f"with {STORIES} select id, title, source_relpath, 0 tags from s",
        "stories_evolved": "select distinct id, 'active' status, null::varchar removed_at, null::varchar media_path from stories",
        "registry_rows": "with n as (select code, label, row_number() over (order by code) n from site_tags) select row_number() over (order by n = 1, n) - 1 as place, case n when 1 then 'renamed' else code end as name, label as path, n = 1 as active from n where n <> 2",
        "normalized_tags": f"""with r as (select story_id, tag_text, row_number() over (partition by story_id order by tag_text) i from tag_candidates),
k as (select story_id, i, {_stripped(f"regexp_replace(lower({_stripped('tag_text')}), '(?s)^.*:', '')")} t from r),
d as (select story_id, t, min(i) i from k where t <> '' group by 1, 2)
select ids.story_id, coalesce(string_agg(t, '|' order by i), '') tags from (select distinct story_id from tag_candidates) ids left join d on d.story_id = ids.story_id group by 1""",
        "chunk_counts": CHUNKS,
        "chunk_letters": f"with {STORIES} select id, length(replace(body_text, chr(10), '')) letters, true fits from s where body_text is not null",
        "prompts_rendered": f"""with {STORIES}, b as (select id, title, author, case when length(body_text) > 1000 then substr(body_text, 1, 1000) || chr(10) || '[... truncated ...]' else coalesce(body_text, '') end body from s)
select id, replace(replace(replace('T {{title}} A {{author}}' || chr(10) || '{{body_text}}', '{{title}}', coalesce(nullif(title, ''), '(untitled)')), '{{author}}', coalesce(nullif(author, ''), '(unknown)')), '{{body_text}}', body) prompt from b""",
        "job_sync_stories": f"with {STORIES}, {PAGES} select id, group_id, title, author, content_hash, ingested_at, status from s union all select sha1(relpath), sha1(relpath), title, author, sha1(body_text), '{LATE}', 'active' from pg where text is not null",
        "job_sync_errors": "select row_number() over (order by 'd/page_' || doc_id || '.html') id, 'd/page_' || doc_id || '.html' story_ref, 'the file holds no text' error from documents where text is null",
        "job_sync_site_tags": "select code, label from site_tags union select 'imported', 'imported'",
        "job_sync_job": f"select 'sync' as type, 'done' as status, count(*) total, count(text) done, count(*) - count(text) failed, {_TIMES} from documents",
        "job_extract_candidates": f"""with {EXTRACT} select id, story_id, tag_text, prompt_version, status, job_id from tag_candidates union all
select (select max(id) from tag_candidates) + row_number() over (order by id, t), id, t, prompt_name, 'candidate', (select max(id) + 1 from jobs) from tg""",
        "job_extract_errors": f"with {EXTRACT} select row_number() over (order by coalesce(title, '') || ' (' || id || ')') id, coalesce(title, '') || ' (' || id || ')' story_ref from pr where n % 7 = 0",
        "job_extract_job": f"with {EXTRACT} select 'extract' as type, 'done' as status, count(*) total, count(*) filter (n % 7 <> 0) done, count(*) filter (n % 7 = 0) failed, {_TIMES} from pr",
        "job_cluster_tags": f"with {CLUSTER} select id, name from aw",
        "job_cluster_links": f"with {LINKS}, {CLUSTER} select {LINK_COLUMNS} from l union all select story_id, tag_id, 'model', (select max(id) + 1 from jobs) from nl where not exists (select 1 from l where l.story_id = nl.story_id and l.tag_id = nl.tag_id)",
        "job_cluster_job": f"with {CLUSTER} select 'cluster' as type, 'done' as status, count(*) total, count(*) done, cast(0 as bigint) failed, {_TIMES} from h",
        "prompt_preview": f"""with {STORIES}, q as (select id, length(coalesce(nullif(title, ''), '(untitled)') || ': ' || coalesce(body_text, '')) n from s where part_index = 1)
select id, case when n % 7 <> 0 then (n % 5) || case when n % 2 = 0 then ',even' else ',odd,even' end end tags, n % 7 = 0 lost from q""",
        "jobs_changed": f"""select id, case id when 1 then 'done' when 2 then 'failed' else status end status, case id when 4 then 77 else total end total, case id when 3 then 0 else done end done, case id when 3 then 0 else failed end failed,
case id when 2 then 'boom' else error end error, case when id in (1, 2) then '{NOW}' else finished_at end finished_at from jobs""",
        "jobs_unfinished": "select count(*) jobs from jobs where status in ('queued', 'running') and type in ('extract', 'cluster')",
        "mut_merge_tags_tags": "select id, name from tags where id <> 1",
        "mut_delete_tag_tags": "select id, name from tags where id <> 1",
        "mut_revert_jobs": f"select id, case id when 3 then '{NOW}' else reverted_at end reverted_at from jobs",
        "mut_revert_candidates": "select id, job_id from tag_candidates where coalesce(job_id, 0) <> 3",
        "mut_delete_link": f"with {LINKS} select {LINK_COLUMNS} from l where not (story_id = {FIRST} and tag_id = (select min(tag_id) from story_tags where story_id = {FIRST}))",
        "mut_link_source": f"with {LINKS} select story_id, tag_id, case when story_id = {FIRST} and tag_id = (select max(tag_id) from story_tags where story_id = {FIRST}) then 'checked' else source end source, job_id from l",
        "mut_reject_story": f"with {LINKS} select {LINK_COLUMNS} from l where not (story_id = {FIRST} and source = 'model')",
        "mut_add_by_name": f"""with {LINKS}, n as (select id from tags where name in ('sea witch', 'entirely new') union all select max(id) + 1 from tags)
select {LINK_COLUMNS} from l union all select {FIRST}, id, 'human', null from n where id not in (select tag_id from l where story_id = {FIRST})""",
        "mut_insert_candidates": "select id, story_id, tag_text, status, job_id from tag_candidates union all select (select max(id) from tag_candidates) + n, 's', t, 'candidate', 4 from (values (1, 'b'), (2, 'a'), (3, 'b')) v(n, t)",
        "mut_create_prompt": "select id, name, based_on_id from prompts union all select max(id) + 1, 'new', 3 from prompts",
        "mut_site_links": "select story_id, code from story_site_tags union all select distinct id, c from stories, (values ('fa'), ('zz')) v(c) where not exists (select 1 from story_site_tags t where t.story_id = id and t.code = c)",
    }
