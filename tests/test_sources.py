"""Files, signatures, adapters, registry, settings and the drop folder."""

import json

import pytest

from folioforge.model import REQUIRED, opened
from folioforge.sources import adapters, files, registry
from folioforge.streaming.drop import pick_up
from tests.conftest import values


def record(key="s1", **more):
    return {"id": key, "group_id": key, "part_index": 0, "title": "T", "author": "A", "body_text": "B", "source_relpath": f"{key}.html", "content_hash": "h", "ingested_at": "2026-01-01T00:00:00Z"} | more


def test_signatures_are_split(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(record("a", tags=["x"], extra=1)))
    (tmp_path / "b.json").write_text(json.dumps(record("b", title=None)))
    (tmp_path / "c.json").write_text("{broken")
    for k in REQUIRED:
        bad = record("m")
        del bad[k]
        (tmp_path / f"m_{k}.json").write_text(json.dumps(bad))
    good, bad = files.signatures(spark, str(tmp_path))
    assert values(good, "id", "title", "tags") == [("a", "T", ["x"]), ("b", None, [])]
    assert bad.count() == len(REQUIRED) + 1


def test_archive_and_folders(spark, tmp_path):
    tale = tmp_path / "the-tale"
    tale.mkdir()
    page = '<meta property="author" value="A &amp; B"><meta property="tags" value="x, y,"><nav>no</nav><main><h2>Tale</h2><p>One\n  two.</p><script>no</script><p>Three</p></main>'
    (tale / "index.html").write_text('<table data-parts><a data-file="b.html"><a data-file="a.html"></table>')
    for name in ("a", "b", "unlisted"):
        (tale / f"{name}.html").write_text(page)
    (tmp_path / "note.txt").write_bytes(b"caf\xff")
    got = files.archive(spark, str(tmp_path), "*.html, *.txt,*.html")
    assert got.count() == 5
    text = got.select("relpath", files.plain_text(got.content).alias("text"))
    assert text.where("relpath = 'note.txt'").first().text == "caf\ufffd"
    rows = adapters.FolderAdapter(options={"skip": adapters.SKIPPED | {"h2"}}).apply(text)
    same = ("Tale", "A & B", "One two.\n\nThree", ["x", "y"])
    assert values(rows, "relpath", "group_key", "part_index", "title", "author", "body_text", "tags") == [(f"the-tale/{n}.html", "the-tale", k, *same) for n, k in (("a", 1), ("b", 0), ("unlisted", 0))]
    loose = adapters.FolderAdapter(loose=True).apply(text)
    assert values(loose.where("group_key = relpath"), "relpath") == [("note.txt",)]
    assert adapters.FolderAdapter(no_works=("the-tale",)).apply(text).count() == 0


@pytest.mark.parametrize("tag", sorted(adapters.BLOCKS))
def test_blocks_make_paragraphs(tag):
    assert adapters.prose(f"<main>a<{tag}>b</{tag}>c <i>d</i></main>", "main") == "a\n\nb\n\nc d"


@pytest.mark.parametrize("tag", sorted(adapters.SKIPPED))
def test_skipped_elements_hold_no_prose(tag):
    # the first end tag of its name ends a skipped element, nested ones aren't counted
    assert adapters.prose(f"<main>a<{tag}>b<{tag}>c</{tag}>d</main>", "main") == "ad"


def test_containers():
    page = "x<main id=k>a<main>b</main>c</main>d<main id=k>e<br>f<p class='x y'>g</p><nav>h</main>i<main>j</main>"
    assert adapters.prose(page, "main", "id", "k", skip_classes=frozenset({("p", "y")})) == "abe f"
    assert adapters.prose("<main>a &amp; b\n\n<p></p> c", "main") == "a & b\n\nc"
    assert adapters.prose("", "main") == adapters.prose("no container", "main") == ""


def one(text):
    return {"title": text.upper(), "tags": ["t"]}


def test_functions_are_adapters_by_their_number_of_arguments(spark):
    rows = spark.createDataFrame([("a.txt", "x"), ("b.txt", None)], "relpath string, text string")
    assert values(adapters.FunctionAdapter(one).apply(rows), "group_key", "title", "body_text", "tags") == [("a.txt", "X", None, ["t"]), ("b.txt", "", None, ["t"])]
    assert values(adapters.FunctionAdapter(lambda t, p: {"body_text": p}).apply(rows), "body_text", "tags") == [("a.txt", []), ("b.txt", [])]


def test_pattern_adapter(spark):
    source = "<title>A &amp; B</title>by Me\nTags: p, q\n<p>One</p>\n\n<p>Two   x</p>"
    rows = spark.createDataFrame([("x/my_first-story.txt", source), ("d/index.html", "no"), ("index.html", "yes")], "relpath string, text string")
    a = adapters.PatternAdapter(title=r"<title>(.*?)</title>", author=r"by ([^\n<]+)", tags=r"Tags: ([^\n<]+)", static_tags=("s",), strip_html=True, exclude=("**/index.html",))
    out = {r.relpath: r for r in a.apply(rows).collect()}
    assert set(out) == {"x/my_first-story.txt", "index.html"}
    r = out["x/my_first-story.txt"]
    assert (r.title, r.author, r.body_text, r.tags) == ("A & B", "Me", "One\n\nTwo x", ["s", "p", "q"])
    assert adapters.title_from_path("a/don't_stop-3rd.txt") == "Don'T Stop 3Rd"
    assert isinstance(adapters.load("folioforge.sources.adapters:PatternAdapter", title="x", unknown=1), adapters.PatternAdapter)


def test_registry_and_settings(tmp_path):
    path = str(tmp_path / "x" / "libraries.json")
    assert registry.load(path) == registry.EMPTY
    (tmp_path / "bad.json").write_text("[1")
    assert registry.load(str(tmp_path / "bad.json")) == registry.EMPTY
    assert registry.served(path, "a", "/a") == "/a"
    registry.store(path, "register", "b", "/b")
    assert registry.served(path, "b", "/other") == "/a"
    assert registry.load(path) == ("a", (("a", "/a"), ("b", "/b")))
    with pytest.raises(KeyError):
        registry.store(path, "activate", "zzz")
    with pytest.raises(KeyError):
        registry.store(path, "rename", "zzz", "y")
    assert registry.store(path, "rename", "a", "c") == ("c", (("b", "/b"), ("c", "/a")))
    assert registry.store(path, "unregister", "c") == ("b", (("b", "/b"),))
    assert registry.store(path, "unregister", "b") == registry.EMPTY
    path = str(tmp_path / "settings.json")
    assert registry.update_settings(path, theme="neon", default_embed_model="m", junk=1) == registry.DEFAULTS | {"default_embed_model": "m"}


def test_drop_folder_is_picked_up_once(spark, tmp_path):
    folder, root, state = tmp_path / "in", str(tmp_path / "lib"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(record("a", tags=["x"])))
    pick_up(spark, str(folder), root, state)
    (folder / "b.json").write_text(json.dumps(record("b")))
    (folder / "bad.json").write_text("{")
    pick_up(spark, str(folder), root, state)
    tables = opened(spark, root)
    assert values(tables["stories"], "id", "status") == [("a", "active"), ("b", "active")]
    assert values(tables["story_site_tags"]) == [("a", "x")]
