import json
import os

import pytest

from notarium.functions.people import Aliases
from notarium.operators import sync
from notarium.sources import config, files


def put(root, path, text="x"):
    os.makedirs(os.path.dirname(f"{root}/{path}") or root, exist_ok=True)
    with open(f"{root}/{path}", "w") as f:
        f.write(text)


def paths(root, **options):
    return sorted(f["path"] for f in files.walk(str(root), **options))


def test_walk(tmp_path):
    for p in ("a.md", "b.TXT", "c.exe", ".hidden/x.md", "sub/.h.md", "sub/d.md", "sub/deep/e.md", "node_modules/n.md", "_under/f.md"):
        put(tmp_path, p)
    assert paths(tmp_path) == ["_under/f.md", "a.md", "b.TXT", "sub/d.md", "sub/deep/e.md"]
    assert paths(tmp_path, include=["sub"]) == ["sub/d.md", "sub/deep/e.md"]
    assert paths(tmp_path, exclude=["sub/deep", "**/a.md"], extensions=["md"]) == ["_under/f.md", "sub/d.md"]
    assert [os.path.basename(f) for f in files.ingest_files(str(tmp_path))] == ["a.md", "b.TXT"]


def test_sync_runs(tmp_path):
    root, manifest = tmp_path / "v", str(tmp_path / "m.json")
    for p in ("a.md", "b.md", "c.md"):
        put(root, p)
    done, gone = [], []
    ingest = lambda p, again: done.append((p, again)) or p != "c.md"
    r = sync.sync(str(root), manifest, ingest, gone.append, "t1")
    assert (r.new, r.failures) == (3, [("c.md", "not ingested")]) and files.read_manifest(manifest) == (None, {p: files.read_manifest(manifest)[1][p] for p in ("a.md", "b.md")})
    os.remove(root / "b.md")
    os.utime(root / "a.md", (1, 1))
    done.clear()
    assert sync.sync(str(root), manifest, ingest, gone.append, "t2", dry_run=True).changed == 1 and not done
    r = sync.sync(str(root), manifest, lambda p, again: done.append((p, again)) or True, gone.append, "t3")
    assert sorted(done) == [("a.md", True), ("c.md", False)] and gone == ["b.md"] and files.read_manifest(manifest)[0] == "t3" and r.deleted == 1

    def refuse(path):
        raise OSError("busy")

    os.remove(root / "a.md")
    r = sync.sync(str(root), manifest, ingest, refuse, "t4")
    assert r.failures == [("a.md", "busy")] and "a.md" in files.read_manifest(manifest)[1] and files.read_manifest(manifest)[0] == "t3"
    r = sync.sync(str(root), manifest, lambda p, again: again, gone.append, "t5", force=True)
    assert r.deleted == 0 and r.new == 1 and set(files.read_manifest(manifest)[1]) == {"c.md"}
    with open(manifest, "w") as f:
        f.write("{")
    with pytest.raises(json.JSONDecodeError):
        files.read_manifest(manifest)


def test_roots():
    assert sync.overlapping_roots(["/a", "/ab", "/a/b"]) == [("/a", "/a/b")]
    with pytest.raises(ValueError, match="overlap"):
        sync.sync_roots(["/a", "/a/x"], lambda r: sync.SyncResult())

    def run(root):
        if root == "/b":
            raise OSError("gone")
        return sync.SyncResult(new=2)

    total = sync.sync_roots(["/a", "/b", "/c"], run)
    assert total.new == 4 and total.failures == [("/b", "gone")]


def test_config(tmp_path, monkeypatch):
    p = tmp_path / "c.json"
    assert config.load(str(p)) == config.DEFAULTS
    p.write_text(json.dumps({"embedder": {"model": "m"}, "categories": ["x"], "tools": {"save_fact": {"currencies": [], "units": ["kg"]}, "no_tool": {}}, "unknown": 1, "metadataExtractor": None, "indexSync": {"include": ["a"]}}))
    got = config.load(str(p))
    assert got["embedder"] == {**config.DEFAULTS["embedder"], "model": "m"} and got["categories"] == ["x"] and got["metadataExtractor"] is None and "unknown" not in got
    assert got["tools"]["save_fact"]["currencies"] is None and got["tools"]["save_fact"]["units"] == ["kg"] and "no_tool" not in got["tools"] and got["indexSync"] == {"include": ["a"]}
    assert config.DEFAULTS["indexSync"] is None and config.DEFAULTS["tools"]["save_fact"]["units"] is None
    p.write_text("{")
    with pytest.raises(json.JSONDecodeError):
        config.load(str(p))
    monkeypatch.setenv("L", " a, ,b")
    assert config.env_list("L", ["z"]) == ["a", "b"] and config.env_list("NOT_SET", ["z"]) == ["z"]
    assert config.secret("plain") == "plain" and config.secret("env:L") == " a, ,b"
    with pytest.raises(KeyError):
        config.secret("env:NOT_SET")


def test_roots(tmp_path):
    got = sync.resolve_roots({"vaultRoot": "/a", "indexSync": {"include": ["x"], "exclude": None}, "additionalRoots": [{"root": "/b", "extensions": [".md"]}]})
    assert got == [sync.Root("/a", include=("x",)), sync.Root("/b", extensions=(".md",))] and got[1].include == ("**",)
    for bad in ({}, {"vaultRoot": " "}, {"vaultRoot": "/a", "additionalRoots": {}}, {"vaultRoot": "/a", "additionalRoots": [{}]}, {"vaultRoot": "/a", "additionalRoots": [{"root": "/a/b"}]}):
        with pytest.raises(ValueError):
            sync.resolve_roots(bad)


def test_people_file(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "people.yaml").write_text("Adam:\n  aliases: [Adam-H, 7]\nEve:\n_drop: [Bot]\n_note: {aliases: [x]}\n")
    a = files.read_aliases("people.yaml", str(tmp_path))
    assert a.canonical == {"adam": "adam", "adam-h": "adam", "7": "adam", "eve": "eve"} and a.drop == {"bot"}
    (tmp_path / "empty.yaml").write_text("")
    assert files.read_aliases(str(tmp_path / "empty.yaml")).canonical == {} == files.read_aliases(None).canonical
    with pytest.raises(FileNotFoundError):
        files.read_aliases("none.yaml", str(tmp_path))


def test_store_versions(spark, tmp_path, monkeypatch):
    from notarium.sources.tables import Conflict, Store

    one, two = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i long")
    held = lambda s: sorted(r.i for r in s.read("t", "i long").collect())
    assert held(one) == []
    one.commit(t=rows(1))
    with two.transaction():
        assert held(two) == [1]
        one.commit(t=rows(1, 2))
        assert held(two) == [1]
        with pytest.raises(Conflict):
            two.commit(t=rows(1, 3))
    assert held(two) == [1, 2] and two.commit(u=rows(9)) == 3 and held(one) == [1, 2]

    def crash(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(Store, "_claim", crash)
        with pytest.raises(OSError):
            one.commit(t=rows(5))
    assert held(one) == [1, 2] and one.commit(t=rows(6)) == 4 and held(two) == [6]


def test_aliases():
    a = Aliases.of({"Adam": {"aliases": ["Adam-H"]}, "_drop": ["bot"], "_other": {"aliases": ["x"]}})
    assert a.canonical == {"adam": "adam", "adam-h": "adam"} and a.drop == {"bot"}
    with pytest.raises(ValueError, match="both"):
        Aliases.of({"a": {"aliases": ["x"]}, "b": {"aliases": ["X"]}})


def test_front_matter():
    f = files.front_matter_type
    assert f("---\ntype: note\nother: 1\n---\nx") == "note" and f("no") is None and f("---\ntype: 5\n---\n") is None and f("---\ntype: [a\n---\n") is None and f("---\ntype: x\n") is None


def test_readers(spark, tmp_path):
    put(tmp_path, "a.md", "é text")
    (r,) = files.read_texts(spark, [str(tmp_path / "a.md")]).collect()
    assert r.content == "é text" and r.file_path == str(tmp_path / "a.md") and len(r.file_hash) == 64
    put(tmp_path, "one.json", json.dumps({"number": 42, "title": "t", "body": "b", "comments": []}))
    put(tmp_path, "many.json", json.dumps([{"number": 1}, {"number": 2, "comments": [{"author": {"login": "x"}, "body": "y", "createdAt": "z"}]}]))
    assert files.read_issues(spark, str(tmp_path / "one.json")).first().number == 42
    assert files.read_issues(spark, str(tmp_path / "many.json")).count() == 2
