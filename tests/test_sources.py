import subprocess

import pytest

from lumenlog.engine import Engine
from lumenlog.lang.loader import load_text
from lumenlog.sources import registry
from lumenlog.sources.base import DIFF, reconciled
from lumenlog.sources.facts import read_facts
from lumenlog.sources.sinks import cell, write_csv

ALL = registry()


def test_facts_files(spark, tmp_path):
    (tmp_path / "e.facts").write_text("1,a,0.5\n\n2,,\nx,b,1.0\n3,c,\n")
    decl = load_text(".in\n.decl e(x: number, n: string, v: float)").decls["e"]
    assert [tuple(r) for r in read_facts(spark, decl, str(tmp_path)).collect()] == [(1, "a", 0.5), (2, None, None), (3, "c", None)]
    (tmp_path / "e.facts").write_text("1,a\n")
    with pytest.raises(Exception, match="2 fields, not 3"):
        read_facts(spark, decl, str(tmp_path)).collect()


def test_csv_infers_and_reconciles(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("x,y,z\n1,1.5,a\n2,,\nq,2.5,b\n")
    source = ALL["csv"]({"path": str(path)})
    first = source.changes(spark, {})["rows"]
    assert [tuple(r) for r in first.collect()] == [(1, 1.5, "a", 1), (2, None, None, 1), (None, 2.5, "b", 1)]
    new = spark.createDataFrame([(1,), (1,), (3,)], "x long")
    old = spark.createDataFrame([(1,), (2,)], "x long")
    assert sorted(map(tuple, reconciled(old, new).collect())) == [(1, 1), (2, -1), (3, 1)]
    assert DIFF in first.columns
    with pytest.raises(ValueError, match="doesn't know"):
        ALL["csv"]({"file": "x"})


def test_fs_ast_and_clock(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "m.py").write_text("def f(x):\n    return x\n\n")
    (tmp_path / "pkg" / "skip.log").write_text("")
    (tmp_path / ".gitignore").write_text("*.log\n")
    (tmp_path / ".hidden").write_text("")
    files = ALL["fs"]({"root": str(tmp_path)}).batch(spark, {})["files"]
    assert [tuple(r) for r in files.collect()] == [("pkg/m.py", "py")]
    out = ALL["ast"]({"root": str(tmp_path)}).batch(spark, {})
    kinds = {(r.node, r.kind) for r in out["ast_node"].collect()}
    assert ("0", "Module") in kinds and ("0.0", "FunctionDef") in kinds
    assert [(r.lineno, r.blank) for r in out["line"].orderBy("lineno").collect()] == [(0, 0), (1, 0), (2, 1)]
    now = ALL["clock"]({"fixed": "2024-01-02T03:04:05Z"}).batch(spark, {})["now"].first()
    assert tuple(now) == ("2024-01-02T03:04:05Z", 1704164645)


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a").write_text("1\n2\n3\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a").rename(tmp_path / "b")
    git("add", "-A")
    git("commit", "-qm", "two")
    out = ALL["git"]({"root": str(tmp_path)}).batch(spark, {})
    assert sorted(r.message for r in out["commit"].collect()) == ["one", "two"]
    assert out["commit_parent"].count() == 1
    assert sorted((r.file, r.change) for r in out["commit_file"].collect()) == [("a", "A"), ("b", "R")]


def test_git_walks_merged_branches(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "trunk")
    for branch, name in (("trunk", "one"), ("side", "two"), ("side", "three"), ("trunk", "four")):
        git("checkout", "-q", "-B", branch) if name == "two" else git("checkout", "-q", branch) if name == "four" else None
        (tmp_path / name).write_text(name)
        git("add", ".")
        git("commit", "-qm", name)
    git("merge", "-q", "--no-ff", "-m", "five", "side")
    out = ALL["git"]({"root": str(tmp_path)}).batch(spark, {})
    named = {r.id: r.message for r in out["commit"].collect()}
    assert sorted(named.values()) == ["five", "four", "one", "three", "two"]
    parents = sorted((named[r.id], named[r.parent]) for r in out["commit_parent"].collect())
    assert parents == [("five", "four"), ("five", "three"), ("four", "one"), ("three", "two"), ("two", "one")]
    files = sorted((named[r.id], r.file, r.change) for r in out["commit_file"].collect())
    assert files == [("five", "three", "A"), ("five", "two", "A"), ("four", "four", "A"), ("one", "one", "A"), ("three", "three", "A"), ("two", "two", "A")]


def test_a_program_names_its_sources(spark, tmp_path):
    (tmp_path / "e.csv").write_text("x,y\n1,2\n2,3\n")
    text = f'.require csv\n.source e = csv(path = "{tmp_path}/e.csv")\n.in\n.decl e(x: number, y: number)\n.out\n.decl q(x: number, y: number)\nq(X, Z) :- e(X, Y), e(Y, Z).\n'
    assert [tuple(r) for r in Engine(spark).load_text(text).evaluate()["q"].collect()] == [(1, 3)]
    spark.createDataFrame([(5, 6), (6, 7)], "x long, y long").createOrReplaceTempView("edges")
    other = Engine(spark)
    other.add_source("sql", {"sql": "SELECT * FROM edges"}, "e")
    got = other.load_text(text.replace("csv(path", "csv(path")).evaluate()["q"].collect()
    assert (5, 7) in {tuple(r) for r in got}
    with pytest.raises(ValueError, match="is required"):
        Engine(spark).load_text(".require nothing\n" + text)


def test_sinks(spark, tmp_path):
    assert [cell(v) for v in (None, 1.0, 1e21, 0.1, float("inf"), 3, "a")] == ["NULL", "1", "1000000000000000000000", "0.1", "inf", "3", "a"]
    assert write_csv({"r": spark.createDataFrame([(1, None)], "a long, b double")}, str(tmp_path)) == {"r": 1}
    assert (tmp_path / "csvs" / "r.csv").read_text() == "1, NULL\n"
