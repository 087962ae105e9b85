"""The folder data source: ignored folders stay shut, links and depth have their reasons."""

import os

import pytest

from skeinwork.sources import files as sources
from skeinwork.sources import folder_scan


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "project"
    for folder in ("a/b/c/d", ".git/x", "own", "src"):
        (root / folder).mkdir(parents=True)
    for name in ("a/one.sql", "a/b/two.log", "a/b/c/three.sql", "a/b/c/d/four.sql", ".git/x/no.sql", "own/mine.sql", "src/é b.sql", "src/x.pyc"):
        (root / name).write_text(f"select '{name}' from dual")
    (root / "src/blob.dat").write_bytes(b"a\x00b")
    outside = tmp_path / "project-secrets"
    outside.mkdir()
    (outside / "key.sql").write_text("secret")
    (root / "src/out").symlink_to(outside)
    (root / "src/key.sql").symlink_to(outside / "key.sql")
    (root / "src/in.sql").symlink_to(root / "a/one.sql")
    (root / "src/up").symlink_to(root)
    (root / "src/broken.sql").symlink_to(root / "nothing")
    return root


def found(spark, root, shares=None, **policy):
    return {r.path: r.skip_reason for r in sources.scan(spark, str(root), sources.ScanPolicy(**policy), shares).collect()}


@pytest.mark.parametrize("shares", [1, 2, 64])
def test_links_depth_and_types(spark, tree, shares):
    got = found(spark, tree, shares, max_depth=3, extra_ignored_directories=("own",))
    links = {f"src/{n}": "symlink_escape" for n in ("out", "key.sql", "in.sql", "up", "broken.sql")}
    assert got == {"a/one.sql": None, "a/b/two.log": None, "a/b/c/three.sql": None, "a/b/c/d": "too_deep", "src/é b.sql": None, "src/blob.dat": "binary"} | links


def test_links_inside_are_followed_and_end(spark, tree):
    got = found(spark, tree, follow_symlinks=True)
    assert got["src/in.sql"] is None and got["src/out"] == got["src/key.sql"] == "symlink_escape"
    assert "src/broken.sql" not in got or got["src/broken.sql"] == "unreadable"
    assert not any(p.startswith("src/up/") for p in got)
    assert sources.is_within(str(tree), str(tree / "src/in.sql")) and not sources.is_within(str(tree), str(tree / "src/out/key.sql"))


def test_ignored_folders_are_never_opened(tree, monkeypatch):
    opened, scandir = [], os.scandir
    monkeypatch.setattr(folder_scan.os, "scandir", lambda p: opened.append(str(p)) or scandir(p))
    rules = folder_scan.Rules(str(tree), frozenset((".git", "own")), (), 10**6, 3, False)
    reader = folder_scan.Reader(rules, 2)
    rows = [r for share in reader.partitions() for r in reader.read(share)]
    assert rows and not any(part in (".git", "own", "d") for p in opened for part in p.split("/"))
    assert len(opened) == len(set(opened))


def test_large_files_are_listed_unread(spark, tree):
    rows = {r.path: r for r in sources.scan(spark, f"file://{tree}", sources.ScanPolicy(max_bytes=10)).collect()}
    assert rows["a/one.sql"].skip_reason == "too_large" and rows["a/one.sql"].content is None and rows["a/one.sql"].size_bytes == 28
    assert rows["a/one.sql"].absolute_path == str(tree / "a/one.sql") and rows["src/blob.dat"].content_hash


def test_policy_settings(spark, tree):
    policy = sources.ScanPolicy.from_dict({"max_depth": "2", "ignored_files": ["*.log"], "junk": 1, "follow_symlinks": None})
    assert (policy.max_depth, policy.ignored_files, policy.follow_symlinks) == (2, ("*.log",), False)
    assert sources.ScanPolicy.from_dict(policy.to_dict()) == policy and sources.ScanPolicy.from_dict(None) == sources.ScanPolicy()
    with pytest.raises(ValueError):
        sources.ScanPolicy.from_dict({"max_bytes": 0})
    with pytest.raises(ValueError):
        sources.scan(spark, str(tree / "none"))


def test_text_of_any_encoding(spark):
    rows = [("ü é", "utf-8"), ("﻿mark", "utf-8"), ("“quoted” – 5 €", "cp1252"), ("é\x81 –", "latin-1")]
    raw = [(t.encode(e, "ignore"),) for t, e in rows]
    got = [r[0] for r in spark.createDataFrame(raw, "content binary").select(sources.decode(sources.F.col("content"))).collect()]
    assert got == ["ü é", "mark", "“quoted” – 5 €", "é\x81 "]
