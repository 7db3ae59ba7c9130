"""Scans of real trees: outcomes of every entry, links, manifests, and snapshots of files that are there, gone or no files."""

import hashlib
import os

from larkspur.session import keep
from larkspur.sources import files as S


def _tree(tmp_path):
    texts = {"a/one.js": b"x\r\ny", "a/two.MD": b"# 2", "a/b/plain": b"h", "a/b/three.tsx": b"\xff\x00bin\n", "node_modules/lib/x.js": b"n", "a/node_modules/y.js": b"n", "top.json": b"{}", "a/pic.png": b"p", "with space/f g.ts": b"s"}
    for name, data in texts.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return texts, f"file://{tmp_path}"


def test_scan_outcomes(spark, tmp_path):
    texts, root = _tree(tmp_path)
    (tmp_path / ".hidden.js").write_bytes(b"h")
    (tmp_path / "empty.js").write_bytes(b"")
    listed = S.listing(spark, root)
    assert {r["path"]: r["length"] for r in listed.collect()} == {k: len(v) for k, v in texts.items()}
    links = spark.createDataFrame([("a/l1.js", "one.js"), ("a/l2.js", "../a/./l1.js"), ("a/self.js", "self.js"), ("a/dir", "/a/b"), ("a/none.js", "../../../nowhere"), ("a/l3.txt", "one.js"), ("node_modules/l.js", "lib/x.js")], "path string, target string")
    got = {r["path"]: (r["outcome"], r["real"]) for r in S.scan(listed, links, excluded_names=("node_modules",), excluded_patterns=("top",), follow=True).collect()}
    no = ("extension-or-exclusion", None)
    assert got == {
        "a/one.js": ("kept", "a/one.js"), "a/two.MD": ("kept", "a/two.MD"), "a/b/plain": no, "a/b/three.tsx": ("kept", "a/b/three.tsx"), "node_modules": ("directory-exclusion", None), "a/node_modules": ("directory-exclusion", None),
        "top.json": no, "a/pic.png": no, "with space/f g.ts": ("kept", "with space/f g.ts"), "a/l1.js": ("kept", "a/one.js"), "a/l2.js": ("kept", "a/one.js"), "a/self.js": ("ELOOP", None), "a/dir": ("already-visited", None), "a/none.js": ("ENOENT", None), "a/l3.txt": no,
    }
    shut = {r["path"]: r["outcome"] for r in S.scan(listed, links).collect()}
    assert shut["a/l1.js"] == shut["node_modules/l.js"] == "symlink-policy" and shut["node_modules/lib/x.js"] == "kept"


def test_snapshots(spark, tmp_path):
    texts, root = _tree(tmp_path)
    listed = keep(S.listing(spark, root))
    os.remove(tmp_path / "top.json")
    wanted = spark.createDataFrame([(k,) for k in [*texts, "a/one.js", "a/b", "gone.js"]], "path string")
    got = {r["path"]: tuple(r)[1:] for r in S.snapshots(spark, root, wanted, listed).collect()}
    for k, v in texts.items():
        if k != "top.json":
            assert got[k] == ("ok", len(v), v.count(b"\n") + 1, hashlib.sha256(v).hexdigest())
    assert got["top.json"] == ("unreadable", None, None, None) and got["a/b"][0] == "not-a-file" and got["gone.js"][0] == "missing" and len(got) == len(texts) + 2


def test_manifest_and_names(spark):
    lines = spark.createDataFrame([(" a.js ",), ("# no",), ("",), ("\t../b/./c.js\r",), ("/d//e.js",), ("../../../f",)], "value string")
    assert {r["path"] for r in S.manifest(lines, "base/x").collect()} == {"base/x/a.js", "base/b/c.js", "d/e.js", "f"}
    names = spark.createDataFrame([("a/B.JS", ".js"), (".git", ""), ("x.y/z", ""), ("q.", "."), ("a.tar.gz", ".gz")], "path string, want string")
    assert all(r["got"] == r["want"] for r in names.withColumn("got", S.extension(names["path"])).collect())


def test_tree_of_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a/x y.js", "one\ntwo"), ("a+b/%2F=.md", None), ("é.ts", "")], "path string, text string")
    root = f"file://{tmp_path}/tree"
    S.write_tree(rows, root)
    got = {r["path"]: (r["outcome"], r["bytes"], r["lines"]) for r in S.snapshots(spark, root, rows).collect()}
    assert got["a/x y.js"] == ("ok", 8, 3) and got["é.ts"] == ("ok", 1, 2) and got["a+b/%2F=.md"] == ("ok", 1, 2)


def test_packed_tree(spark, tmp_path):
    rows = spark.createDataFrame([("a/x y.js", "one\ntwo"), ("a+b/%2F=.md", None), ("é.ts", "é")], "path string, text string")
    root = f"file://{tmp_path}/tree"
    S.write_tree(rows, root)
    wanted = rows.select("path").union(spark.createDataFrame([("a",), ("gone",)], "path string"))
    pack = S.packed(rows)
    assert sorted(S.snapshots(spark, None, wanted, pack=pack).collect()) == sorted(S.snapshots(spark, root, wanted).collect())
    assert sorted(pack.select("path", "length").collect()) == sorted(S.listing(spark, root).collect())


def test_scans_write_no_file_for_each_document(spark, sf, monkeypatch):
    from larkspur import catalog

    monkeypatch.setattr(S, "_read", None)  # a listing of single files
    for name in ("SRC1", "SRC1_links", "SRC2", "SRC3", "SRC4", "SRC5", "SRC6"):
        assert catalog.queries()[name](spark, sf).count() > 0, name
