import pytest

from sextant.operators import roots

ROOTS = [("/a", True, False), ("/a/b", False, False), ("/a/b/c", True, False), ("/a/skip", True, True), ("/z", False, False)]


@pytest.mark.parametrize(
    ("path", "root", "fine"),
    [
        ("/a", "/a", True), ("/a/x", "/a", True), ("/a/x/y", "/a", True), ("/a/b", "/a/b", True), ("/a/b/x", "/a/b", True), ("/a/b/x/y", "/a/b", False), ("/a/b/c/x/y", "/a/b/c", True), ("/a/bc", "/a", True),
        ("/a/skip/x", "/a/skip", False), ("/z/x", "/z", True), ("/z/x/y", "/z", False), ("/q", None, False), ("/a/.hidden", "/a", False), ("/a/x.tmp", "/a", False), ("/zz", None, False),
    ],
)
def test_indexable(spark, path, root, fine):
    tree = spark.createDataFrame(ROOTS, "root string, recursive boolean, ignored boolean")
    row = roots.indexable(spark.createDataFrame([(path,)], "path string"), tree, ["*.tmp"]).first()
    assert (row.root, row.indexable) == (root, fine)


def test_reparent_and_dedupe(spark):
    tree = spark.createDataFrame([(r,) for r, *_ in ROOTS], "root string")
    assert {r.root: r.parent for r in roots.reparent(tree).collect()} == {"/a": None, "/a/b": "/a", "/a/b/c": "/a/b", "/a/skip": "/a", "/z": None}
    assert sorted(r.root for r in roots.dedupe_roots(tree).collect()) == ["/a", "/z"]


def test_filters(spark):
    files = spark.createDataFrame([("/a/1",), ("/a/.nomedia",), ("/b/1",)], "path string")
    assert [r.path for r in roots.poisoned(files, [".nomedia"]).collect()] == ["/b/1"]
