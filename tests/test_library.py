"""Small hand-made libraries: grouping, titles, filters, search, review, mutations, jobs."""

import json

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.model import SCHEMAS, commit, current, duplicated, evolve, latest, opened, require_unique
from folioforge.operators import clustering, facets, jobs, listing, mutate, review, search, tagging
from tests.conftest import values

T0 = "2026-01-01T00:00:00Z"


def story(key, group=None, part=0, title="Title", author="Author", body="One short sentence.", status="active", at=T0):
    return (key, group or key, part, title, author, body, f"{key}.html", f"h{key}", at, status, None, None)


class Fake:
    """A library of DataFrames made in the test."""

    def __init__(self, spark, **rows):
        self.spark = spark
        for name, schema in SCHEMAS.items():
            setattr(self, name, spark.createDataFrame(rows.get(name, []), schema))
        self.active = self.stories.where("status = 'active'")
        self.links = self.story_tags

    def table(self, name):
        return getattr(self, name)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_parts_are_one_work_and_part_zero_lends_its_title(spark):
    lib = Fake(spark, stories=[story("a0", "a", 0, "The Tale"), story("a1", "a", 1, ""), story("a2", "a", 2, " "), story("b", title="Alone")])
    assert values(listing.browse(lib), "id", "title", "part_count") == [("a0", "The Tale", 3), ("b", "Alone", 1)]
    gone = Fake(spark, stories=[story("a0", "a", 0, "The Tale", status="removed"), story("a1", "a", 1, "")])
    assert values(listing.browse(gone), "id", "title", "part_count") == [("a1", "The Tale", 1)]


def test_article_sort_keeps_the_shown_title(spark):
    lib = Fake(spark, stories=[story("1", title="The Zebra"), story("2", title="An Apple"), story("3", title="a Mango"), story("4", title="Banana"), story("5", title="THE  Cat")])
    assert [r.title for r in listing.browse(lib).collect()] == ["An Apple", "Banana", "THE  Cat", "a Mango", "The Zebra"]


def test_tag_filters_work_on_whole_works(spark):
    lib = Fake(spark, stories=[story("a0", "a", 0), story("a1", "a", 1), story("b")], story_tags=[("a1", 1, None, "human", None), ("a1", 2, None, "human", None), ("b", 1, None, "human", None)])
    assert values(listing.browse(lib, (1,)), "id") == [("a0",), ("b",)]
    assert values(listing.browse(lib, (1, 2)), "id") == [("a0",)]
    assert values(listing.browse(lib, (1,), (2,)), "id") == [("b",)]
    assert listing.browse(Fake(spark)).count() == 0


def test_pages_and_id_lists():
    assert listing.page_offset(0, 50) == (1, 0) and listing.page_offset(3, 20) == (3, 40)
    assert listing.parse_ids("1, x,3,3") == [1, 3, 3]


def test_search_rules(spark):
    lib = Fake(spark, stories=[story("a", body="foo bar <b>& café"), story("b", body="bar foo"), story("c", body="foo", title="bar"), story("d", body="none")])
    index = search.Index.of(lib.stories)
    ids = lambda q, at=index: [r.id for r in search.parts(lib, at, q, with_snippet=False).collect()]
    assert ids("foo-bar") == ["a"]
    assert set(ids("foo bar")) == {"a", "b", "c"}
    assert ids("CAFE !!!") == ["a"] and ids("!!!") == [] and ids("") == []
    snippet = search.parts(lib, index, "cafe").first().snippet
    assert "<mark>café</mark>" in snippet and "&lt;b&gt;&amp;" in snippet


def test_search_index_is_stored_and_follows_updates(spark, tmp_path):
    lib = Fake(spark, stories=[story("a", body="foo foo bar foo bar"), story("b", body="old word"), story("c", body="foo")])
    index = search.Index.of(lib.stories).stored(str(tmp_path / "i"))
    ids = lambda at, q: [r.id for r in search.parts(lib, at, q, with_snippet=False).collect()]
    assert values(search.hits(index, ["foo", "bar"])) == [("a", 2)] and values(search.hits(index, ["foo"])) == [("a", 3), ("c", 1)]
    changed = Fake(spark, stories=[story("b", body="new word"), story("d", body="word word")]).stories
    after = index.updated(changed, spark.createDataFrame([("c",)], "id string")).stored(str(tmp_path / "j"))
    assert ids(after, "old") == [] and ids(after, "new") == ["b"] and ids(after, "foo") == ["a"] and set(ids(after, "word")) == {"b", "d"}
    plan = search.works(lib, after, "word")._jdf.queryExecution().executedPlan().toString()
    assert "body_text" not in plan and "token" in plan


def test_label_upsert_prefers_real_labels(spark):
    old = spark.createDataFrame([("a", "a"), ("b", "Real"), ("c", "Old")], "code string, label string")
    new = spark.createDataFrame([("a", "Alpha"), ("b", "b"), ("c", "New"), ("d", None)], "code string, label string")
    assert values(mutate.upsert_site_tags(old, new)) == [("a", "Alpha"), ("b", "Real"), ("c", "New"), ("d", "d")]


def test_upsert_keeps_status_and_adds_new(spark):
    old = Fake(spark, stories=[story("a", status="removed")]).stories
    new = Fake(spark, stories=[story("a", title="New", at="2026-02-01T00:00:00Z"), story("b")]).stories.withColumn("tags", F.array(F.lit("x")))
    out = mutate.upsert_stories(old, new)
    assert values(out, "id", "title", "status") == [("a", "New", "removed"), ("b", "Title", "active")]


def test_merge_revert_and_unique(spark):
    lib = Fake(spark, tags=[(1, "x", None, T0), (2, "y", None, T0), (3, "z", None, T0)], story_tags=[("s", 1, None, "model", 1), ("s", 2, None, "human", None), ("t", 1, None, "model", 1), ("u", 3, None, "model", 2)], jobs=[], tag_candidates=[])
    tags, links = mutate.merge_tags(lib.tags, lib.story_tags, 1, 2)
    assert values(tags, "id") == [(2,), (3,)] and values(links, "story_id", "tag_id", "source") == [("s", 2, "human"), ("t", 2, "model"), ("u", 3, "model")]
    out = mutate.revert_job(lib.jobs, lib.tag_candidates, lib.story_tags, lib.tags, 1, T0)
    assert values(out["tags"], "id") == [(2,), (3,)]
    with pytest.raises(ValueError):
        mutate.rename_tag(lib.tags, 1, "y")
    with pytest.raises(ValueError):
        require_unique(lib.story_tags, ["story_id"])


def test_link_never_downgrades(spark):
    lib = Fake(spark, story_tags=[("s", 1, None, "human", None)])
    new = spark.createDataFrame([("s", 1, "model", 7), ("s", 2, "model", 7)], "story_id string, tag_id bigint, source string, job_id bigint")
    assert values(mutate.link(lib.story_tags, new), "tag_id", "source") == [(1, "human"), (2, "model")]


def test_ids_go_on_from_the_largest(spark):
    lib = Fake(spark, tags=[(5, "x", None, T0)])
    names = spark.createDataFrame([(n,) for n in ("b", "a", "x", None)], "name string")
    assert values(mutate.get_or_create_tags(lib.tags, names, T0), "id", "name") == [(5, "x"), (6, "a"), (7, "b")]


def test_review_counts_and_lists(spark):
    lib = Fake(spark, stories=[story("s", title="B"), story("t", title="A")], tags=[(1, "x", None, T0), (2, "y", None, T0)], story_tags=[("s", 1, None, "model", 1), ("t", 1, None, "model", 1), ("s", 2, None, "model", 2)])
    assert values(review.by_tag(lib), "id", "pending_count") == [(1, 2), (2, 1)]
    assert values(review.by_tag(lib, 2), "id") == [(2,)]
    assert [tuple(r) for r in review.stories_for_tags(lib, [1, 9]).collect()] == [(1, "A", "t"), (1, "B", "s"), (9, None, None)]
    assert values(mutate.approve(lib.story_tags, tag_id=1, job=1), "tag_id", "source") == [(1, "human"), (1, "human"), (2, "model")]


def job(key, total, done, seconds, items, status="running", kind="extract", model="m"):
    return (key, kind, status, None, model, None, total, done, 0, None, None, T0, None, None, None, seconds, items)


def test_completion_shares_one_worker(spark):
    alone = Fake(spark, jobs=[job(1, 100, 10, 10.0, 10)])
    assert jobs.completion(alone.jobs).first().eta_seconds == 90.0
    two = Fake(spark, jobs=[job(1, 10, 0, 1.0, 1), job(2, 100, 0, 1.0, 1), job(3, 5, 0, None, None)])
    assert values(jobs.completion(two.jobs), "id", "eta_seconds") == [(1, 20.0), (2, 110.0), (3, None)]


def test_durations(spark):
    assert [one(spark, X.duration(F.lit(float(s)))) for s in (30, 90, 3700, 90000, -5)] == ["<1m", "~1m", "~1h 1m", "~1d 1h", "<1m"]


def test_chunks(spark):
    pieces = lambda t, n: one(spark, X.chunk_paragraphs(F.lit(t), n))
    assert pieces("ab\n\ncd", 1000) == ["ab\n\ncd"]
    assert pieces("\n\n".join(["aaaaa"] * 4), 12) == ["aaaaa\n\naaaaa"] * 2
    assert pieces("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert pieces("ab\n\n" + "y" * 22 + "\n\ncd", 10) == ["ab", "y" * 10, "y" * 10, "yy", "cd"]


def test_tag_texts_and_contexts(spark):
    assert one(spark, X.normalized_tags(F.array(*map(F.lit, (" Genre: Sea Tale", "sea tale", " ", "X:Y: z"))))) == ["sea tale", "z"]
    caps = [(8192, 131072), (131072, 4096), (16384, None)]
    assert [one(spark, X.effective_context(F.lit(a), F.lit(b).cast("int"))) for a, b in caps] == [8192, 4096, 16384]


def test_folding_of_vectors():
    fold = clustering.Fold(0.5)
    assert [fold.add(v) for v in ([1, 0], [0, 1], [1, 0])] == [0, 1, 0]
    strict = clustering.Fold(0.9)
    assert [strict.add(v) for v in ([1.0], [0.0])] == [0, 1]


class Echo:
    def generate(self, prompt):
        return "broken" if "BAD" in prompt else json.dumps({"tags": ["Kind: One", "one", "two"]})


def test_a_failure_costs_one_story(spark):
    lib = Fake(spark, stories=[story("a"), story("b", body="BAD"), story("c", body=None)])
    out = tagging.extract_job(lib, 4, None, "{title} {body_text}", Echo, 1000, "v1", "echo", T0)
    assert values(out["tag_candidates"], "story_id", "tag_text") == [("a", "one"), ("a", "two"), ("c", "one"), ("c", "two")]
    assert values(out["job_errors"], "story_ref") == [("b",)]


def test_scope_and_schedule(spark):
    lib = Fake(spark, stories=[story("a"), story("b"), story("c")], story_tags=[("a", 1, None, "human", None)], tag_candidates=[(1, "b", "t", "v1", "m", T0, "candidate", 1)])
    assert values(facets.in_scope(lib, "untagged", 1), "id") == [("c",)]
    items = spark.createDataFrame([(1, "X", "1", 1), (1, "X", "1", 2), (2, "Y", "2", 3), (3, "X", "3", 4)], "job_id bigint, model string, created_at string, item bigint")
    order = jobs.block_schedule(items, 1).orderBy("round", "model", "created_at").select("model").collect()
    assert [r.model for r in order] == ["X", "X", "Y", "X"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "lib")
    assert opened(spark, root)["tags"].count() == 0
    commit(root, {"tags": Fake(spark, tags=[(1, "x", None, T0)]).tags})
    commit(root, {"prompts": mutate.create_prompt(opened(spark, root)["prompts"], "p", "text", T0)})
    tables = opened(spark, root)
    assert tables["tags"].count() == 1 and tables["prompts"].first().id == 1 and len(current(root)) == 2
    short = spark.createDataFrame([("a",)], "id string")
    full = short.select("id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["stories"].fields[1:9]))
    assert evolve(full, "stories").first().status == "active"


def test_latest_row_counts(spark):
    twice = Fake(spark, stories=[story("a", at="2026-01-01T00:00:00Z"), story("a", at="2026-03-01T00:00:00Z", title="Late")]).stories
    assert values(latest(twice), "title") == [("Late",)]
    assert values(duplicated(twice, ["id"])) == [("a", 2)]


def test_plans_read_no_more_than_they_need(spark, data):
    from folioforge.model import Library

    plan = listing.browse(Library(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert "body_text" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
