import pytest

from lumenlog.lang.ast import Aggregate, Atom, Chain, Comparison, Const, Var, Wildcard
from lumenlog.lang.diagnostics import ProgramError
from lumenlog.lang.loader import load_file, load_text
from lumenlog.plans.rewrite import rewrite
from lumenlog.plans.strata import stratify
from lumenlog.plans.typing import check

HEAD = ".in\n.decl e(x: number, y: number)\n.decl s(n: string, v: float)\n.printsize\n.decl p(x: number, y: number)\n.rule\n"


def test_a_program_is_parsed():
    p = load_text(HEAD + 'p(X, Y - 1) :- e(X, Y), !e(Y, _), X-5 < Y, Y != 3. # comment\np(X, count(Y)) :- e(X, Y) .plan // more\n')
    a, b = p.rules
    assert a.args == (Var("X"), Chain(Var("Y"), (("-", Const(1)),)))
    assert a.body[1] == Atom("e", (Var("Y"), Wildcard()), True)
    assert a.body[2] == Comparison(Chain(Var("X"), (("-", Const(5)),)), "<", Var("Y"))
    assert b.aggregate == Aggregate("count", Var("Y")) and b.hint == "plan"


def test_decl_suffixes():
    d = load_text(".in\n.decl a(x: number) .input A.csv\n.out\n.decl b(x: number, y: float) limit(3) order_by(y desc, x) merge(max)\n").decls
    assert d["a"].path == "A.csv" and d["b"].limit == 3 and d["b"].merge == "max" and d["b"].order_by == (("y", True), ("x", False))


@pytest.mark.parametrize(
    ("text", "said"),
    [
        (".decl a(x: number)", "outside any section"),
        (".in\n.decl a(x: text)", "unknown type"),
        (HEAD + "p(X, nope(Y)) :- e(X, Y).", "unknown function"),
        (HEAD + "p(X, Y) :- e(X, _).", "isn't bound"),
        (HEAD + "p(X, Y) :- e(X, Y), !e(Z, Y).", "isn't bound"),
        (HEAD + "p(X, Y) :- q(X, Y).", "isn't declared"),
        (HEAD + "p(X) :- e(X, _).", "has 2 columns"),
        (HEAD + "p(X, Y) :- e(X, Y, _).", "has 2 columns"),
        (HEAD + "p(X, Y) :- e(X, _), s(_, Y).", "has a number where"),
        (HEAD + "p(X, X) :- e(X, _), s(N, V), V + 1 > 2.0.", "a number and a float"),
        (HEAD + "p(X, X) :- e(X, _), !p(X, _).", "own negation"),
        (HEAD + "p(X, sum(N)) :- e(X, _), s(N, _).", "sum of a string"),
        (HEAD + "p(sum(X), Y) :- e(X, Y).", "last argument"),
        (HEAD + "p(X, min(Y)) :- e(X, Y).\np(X, max(Y)) :- e(X, Y).", "aggregated by"),
        (HEAD + "p(X, Y) :- e(X, Y), X = 99999999999999999999.", "64 bits"),
        (HEAD + "p(X, round(Y)) :- e(X, Y).", "argument 1 of round"),
        (HEAD + "p(1, 2) :- !e(1, 2).", "isn't negated"),
        (".in\n.decl a(x: number) order_by(z)", "isn't a column"),
        (".in\n.decl a(x: number) merge(sum)", "min or max"),
        (HEAD + "p(X, Y) :- e(X, Y)", "expected '.'"),
        (HEAD + "p(X, Y) :- e(X, Y), @.", "unexpected character"),
    ],
)
def test_faults_are_reported_where_they_are(text, said):
    with pytest.raises(ProgramError, match=said) as e:
        check(load_text(text))
    assert "-->" in str(e.value) and "^" in str(e.value)


def test_imports_once_and_cycles(tmp_path):
    (tmp_path / "a.dl").write_text('.import "b.dl"\n.import "c.dl"\n.printsize\n.decl p(x: number)\np(X) :- e(X).\n')
    (tmp_path / "b.dl").write_text('.import "c.dl"\n.in\n.decl e(x: number)\n')
    (tmp_path / "c.dl").write_text('.import "a.dl"\n.in\n.decl e(x: number)\n')
    assert len(load_file(str(tmp_path / "a.dl")).rules) == 1
    (tmp_path / "c.dl").write_text(".in\n.decl e(x: string)\n")
    with pytest.raises(ProgramError, match="declared"):
        load_file(str(tmp_path / "a.dl"))


def test_rewrites_and_strata():
    p = rewrite(load_text(HEAD + "p(X, sum(Y * 2)) :- e(X, Y).\nq(X, count(Y)) :- e(X, Y).\nq(X, count(Z)) :- q(X, Y), e(Y, Z).\n"))
    strata = stratify(p)
    assert [s for s in strata if s.recursive and s.heads == ("q_rows",)]
    assert any(h.startswith("p_value") for s in strata for h in s.heads)
    assert strata.index(next(s for s in strata if s.heads == ("q_rows",))) < strata.index(next(s for s in strata if s.heads == ("q",)))


def test_file_names_with_dashes_and_strings_over_lines():
    program = load_text('.in\n.decl e(x: number) .input my-rel.csv\n.out\n.decl q(x: number, s: string)\n.rule\nq(X, "one\ntwo") :- e(X).\n')
    assert program.decls["e"].path == "my-rel.csv" and program.rules[0].args[1].value == "one\ntwo"
