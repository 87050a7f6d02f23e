"""Programs over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .operators import fixpoint

#: The tables' columns, as inputs; times are epoch seconds.
TABLES = {
    "region": "r_regionkey: number, r_name: string",
    "nation": "n_nationkey: number, n_name: string, n_regionkey: number",
    "customer": "c_custkey: number, c_name: string, c_nationkey: number, c_acctbal: float, c_mktsegment: string",
    "supplier": "s_suppkey: number, s_name: string, s_nationkey: number, s_acctbal: float",
    "part": "p_partkey: number, p_name: string, p_brand: string, p_type: string, p_size: number, p_retailprice: float",
    "orders": "o_orderkey: number, o_custkey: number, o_orderstatus: string, o_totalprice: float, o_orderdate: number, o_orderpriority: string",
    "lineitem": "l_orderkey: number, l_partkey: number, l_suppkey: number, l_linenumber: number, l_quantity: float, l_extendedprice: float, l_discount: float, l_tax: float, l_returnflag: string, l_linestatus: string, l_shipdate: number",
    "events": "event_id: number, ts: number, user_id: number, event_type: string, value: float, props: string",
    "documents": "doc_id: number, text: string, lang: string, source: string, n_chars: number",
    "labels": "doc_id: number, quality: number, toxic: number",
    "pages": "page_id: number, url: string, html: string",
    "conversations": "conv_id: number, turn: number, role: string, text: string",
    "benchmark": "item_id: number, text: string",
}


def run(spark: SparkSession, sf_dir: str, program: str, relation: str = "q", **options) -> DataFrame:
    """The relation that a program derives from the tables that it names after "use"."""
    first, _, rest = program.strip().partition("\n")
    names = first.removeprefix("use").split()
    columns = {n: TABLES[n] for n in names}
    text = ".in\n" + "".join(f".decl {n}({c})\n" for n, c in columns.items()) + rest
    engine = Engine(spark, **options).load_text(text)
    return engine.query(relation, {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


#: name -> (program, SQL)
PROGRAMS: dict[str, tuple[str, str]] = {}
#: Those whose SQL keeps a row for each match where the matches' rows repeat: their relation is a bag.
BAGS = {"interval_join"}


def _add(name: str, program: str, sql: str) -> None:
    PROGRAMS[name] = (program, sql)


def _simple(name: str, tables: str, columns: str, rules: str, sql: str, more: str = "") -> None:
    _add(name, f"use {tables}\n.printsize\n{more}\n.out\n.decl q({columns})\n.rule\n{rules}\n", sql)


# Projection, filters, arithmetic.
_simple("proj_reorder", "nation", "region: number, name: string", "q(R, N) :- nation(_, N, R).", "SELECT DISTINCT n_regionkey::BIGINT AS region, n_name AS name FROM nation")
_simple("const_filter", "customer", "k: number, name: string", 'q(K, N) :- customer(K, N, _, _, "BUILDING").', "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
_simple("const_number", "nation", "name: string", "q(N) :- nation(_, N, 2).", "SELECT DISTINCT n_name AS name FROM nation WHERE n_regionkey = 2")
_simple("repeated_var", "lineitem", "k: number, n: number", "q(K, N) :- p(K, N, N).\np(K, N, L) :- lineitem(K, N, _, L, _, _, _, _, _, _, _).", "SELECT DISTINCT l_orderkey AS k, l_partkey AS n FROM lineitem WHERE l_partkey = l_linenumber")
_simple("repeated_head", "nation", "a: number, b: number", "q(K, K) :- nation(K, _, _).", "SELECT n_nationkey::BIGINT AS a, n_nationkey::BIGINT AS b FROM nation")
_simple("constant_head", "region", "a: number", "q(0) :- region(_, _).", "SELECT 0::BIGINT AS a FROM region LIMIT 1")
for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _simple(f"cmp_{_name}", "part", "k: number", f"q(K) :- part(K, _, _, _, S, _), S {_op} 25.", f"SELECT p_partkey AS k FROM part WHERE p_size {'<>' if _op == '!=' else _op} 25")
_simple("cmp_float", "customer", "k: number", "q(K) :- customer(K, _, _, B, _), B > 5000.0.", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000.0")
_simple("head_arith", "lineitem", "k: number, n: number, v: number", "q(K, N, K * 10 + N - 1) :- lineitem(K, _, _, N, _, _, _, _, _, _, _).", "SELECT DISTINCT l_orderkey AS k, l_linenumber::BIGINT AS n, l_orderkey * 10 + l_linenumber - 1 AS v FROM lineitem")
_simple("left_to_right", "part", "k: number, v: number", "q(K, S - 3 * 2) :- part(K, _, _, _, S, _).", "SELECT p_partkey AS k, ((p_size - 3) * 2)::BIGINT AS v FROM part")
_simple("paren_arith", "part", "k: number, v: number", "q(K, S - (3 * 2)) :- part(K, _, _, _, S, _).", "SELECT p_partkey AS k, (p_size - 6)::BIGINT AS v FROM part")
_simple("float_arith", "part", "k: number, v: float", "q(K, P / 2.0 + 1.0) :- part(K, _, _, _, _, P).", "SELECT p_partkey AS k, p_retailprice / 2.0 + 1.0 AS v FROM part")
_simple("int_div_null", "part", "k: number, d: number, r: number", "q(K, K / (S - 25), K % (S - 25)) :- part(K, _, _, _, S, _).", "SELECT p_partkey AS k, CASE WHEN p_size <> 25 THEN p_partkey // (p_size - 25) END AS d, CASE WHEN p_size <> 25 THEN p_partkey % (p_size - 25) END AS r FROM part")
_simple("bit_ops", "part", "k: number, a: number, o: number, x: number", "q(K, K & S, K | S, K ^ S) :- part(K, _, _, _, S, _).", "SELECT p_partkey AS k, p_partkey & p_size AS a, p_partkey | p_size AS o, xor(p_partkey, p_size::BIGINT) AS x FROM part")
_simple("overflow_null", "part", "k: number, v: number", "q(K, K + 9223372036854775807) :- part(K, _, _, _, _, _).", "SELECT p_partkey AS k, CASE WHEN p_partkey <= 0 THEN p_partkey + 9223372036854775807 END AS v FROM part")
_simple("null_compare", "part", "k: number", "v(K, K / (S - 25)) :- part(K, _, _, _, S, _).\nq(K) :- v(K, V), V != 7.", "SELECT p_partkey AS k FROM part WHERE p_size <> 25 AND p_partkey // (p_size - 25) <> 7")

# Joins.
_simple("join2", "nation region", "n: string, r: string", "q(N, R) :- nation(_, N, K), region(K, R).", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
_simple("join3_chain", "orders customer nation", "o: number, n: string", "q(O, N) :- orders(O, C, _, _, _, _), customer(C, _, K, _, _), nation(K, N, _).", "SELECT o_orderkey AS o, n_name AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
_simple("join4_star", "supplier nation region customer", "s: number, c: number, r: string", 'q(S, C, R) :- supplier(S, _, K, _), nation(K, _, G), region(G, R), customer(C, _, K, _, "MACHINERY").', "SELECT s_suppkey AS s, c_custkey AS c, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'")
_simple("self_join_ne", "nation", "a: number, b: number", "q(A, B) :- nation(A, _, R), nation(B, _, R), A != B.", "SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
_simple("triangle", "supplier", "a: number, b: number, c: number", "e(A, A * 7 % 25) :- supplier(_, _, A, _).\ne(A, A * 3 % 25) :- supplier(_, _, A, _).\ne(A, A + 1 % 25) :- supplier(_, _, A, _).\nq(A, B, C) :- e(A, B), e(B, C), e(C, A).", "WITH e AS (SELECT s_nationkey::BIGINT AS a, (s_nationkey * 7 % 25)::BIGINT AS b FROM supplier UNION SELECT s_nationkey, s_nationkey * 3 % 25 FROM supplier UNION SELECT s_nationkey, (s_nationkey + 1) % 25 FROM supplier) SELECT DISTINCT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a AND z.b = x.a")
_simple("semijoin", "customer orders", "k: number, n: string", "q(K, N) :- customer(K, N, _, _, _), orders(_, K, _, _, _, _).", "SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
_simple("key_intersection", "customer supplier", "k: number", "a(K) :- customer(_, _, K, _, _).\nb(K) :- supplier(_, _, K, _).\nq(K) :- a(K), b(K).", "SELECT c_nationkey::BIGINT AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_simple("cartesian", "region nation", "a: string, b: string", "q(A, B) :- region(_, A), nation(_, B, _).", "SELECT DISTINCT r_name AS a, n_name AS b FROM region, nation")
_simple("theta_range", "nation", "a: number, b: number", "q(A, B) :- nation(A, _, _), nation(B, _, _), A < B, B <= A + 3.", "SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND b.n_nationkey <= a.n_nationkey + 3")
_simple("interval_join", "orders lineitem", "o: number, n: number", "q(O, N) :- orders(O, _, _, _, D, _), lineitem(O, _, _, N, _, _, _, _, _, _, S), S >= D, S <= D + 864000.", "SELECT o_orderkey AS o, l_linenumber::BIGINT AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE epoch(l_shipdate) BETWEEN epoch(o_orderdate) AND epoch(o_orderdate) + 864000")
_simple("computed_key_join", "supplier nation", "s: number, n: string", "q(S, N) :- supplier(S, _, _, _), nation(K, N, _), S % 25 = K.", "SELECT s_suppkey AS s, n_name AS n FROM supplier JOIN nation ON s_suppkey % 25 = n_nationkey")
_simple("existence", "nation orders", "n: string", 'q(N) :- nation(_, N, _), orders(_, _, "F", _, _, _).', "SELECT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F')")
_simple("null_join_whole", "part", "a: number, b: number", "v(K, K / (S - 25)) :- part(K, _, _, _, S, _).\nq(A, B) :- v(A, V), v(B, V).", "WITH v AS (SELECT p_partkey AS k, CASE WHEN p_size <> 25 THEN p_partkey // (p_size - 25) END AS v FROM part) SELECT x.k AS a, y.k AS b FROM v x JOIN v y ON x.v IS NOT DISTINCT FROM y.v")
_simple("fuzzy_join", "nation", "a: string, b: string", "q(A, B) :- nation(_, A, _), nation(_, B, _), similarity(A, B) > 50.", "WITH g AS (SELECT n_name AS s, unnest(list_transform(range(1, length(n_name)), lambda i: substr(n_name, i, 2))) AS g FROM nation), c AS (SELECT s, g, count(*) AS k FROM g GROUP BY ALL), t AS (SELECT s, sum(k) AS n FROM c GROUP BY s), o AS (SELECT x.s AS a, y.s AS b, sum(least(x.k, y.k)) AS m FROM c x JOIN c y USING (g) GROUP BY ALL) SELECT a, b FROM o JOIN t x ON a = x.s JOIN t y ON b = y.s WHERE 200 * m // (x.n + y.n) > 50")

# Negation and set operations.
_simple("anti_no_orders", "customer orders", "k: number", "q(K) :- customer(K, _, _, _, _), !orders(_, K, _, _, _, _).", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_simple("anti_const", "customer orders", "k: number", 'q(K) :- !orders(_, K, "F", _, _, _), customer(K, _, _, _, _).', "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
_simple("anti_multi", "customer orders supplier", "k: number", "q(K) :- customer(K, _, _, _, _), !orders(_, K, _, _, _, _), !supplier(K, _, _, _).", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
_simple("anti_two", "customer orders supplier", "k: number", 'q(K) :- customer(K, _, _, _, _), !orders(_, K, "P", _, _, _), !supplier(K, _, _, _), !orders(_, K, "O", _, _, "1-URGENT").', "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT s_suppkey FROM supplier) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')")
_simple("anti_self", "nation", "a: number", "q(A) :- nation(A, _, R), !below(A, R).\nbelow(A, R) :- nation(A, _, R), nation(B, _, R), B < A.", "SELECT min(n_nationkey)::BIGINT AS a FROM nation GROUP BY n_regionkey")
_simple("union_rules", "customer supplier", "k: number", "q(K) :- customer(_, _, K, _, _).\nq(K) :- supplier(_, _, K, _).", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_simple("difference", "customer supplier", "k: number", "a(K) :- customer(K, _, _, _, _).\nb(K) :- supplier(K, _, _, _).\nq(K) :- a(K), !b(K).", "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier")
_simple("intersect", "customer supplier", "k: number", "q(K) :- customer(K, _, _, _, _), supplier(K, _, _, _).", "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier")

# Aggregates.
_L = "lineitem(K, P, S, N, Q, E, D, T, F, L, W)"
_simple("count_bag", "lineitem", "f: string, n: number", f"q(F, count(P)) :- {_L}.", "SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1")
_simple("count_set", "lineitem", "f: string, n: number", f"fp(F, P) :- {_L}.\nq(F, count(P)) :- fp(F, P).", "SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
_simple("sum_num", "lineitem", "f: string, l: string, n: number", f"q(F, L, sum(N)) :- {_L}.", "SELECT l_returnflag AS f, l_linestatus AS l, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
_simple("sum_float", "lineitem", "f: string, n: float", f"q(F, sum(Q)) :- {_L}.", "SELECT l_returnflag AS f, sum(l_quantity) AS n FROM lineitem GROUP BY 1")
_simple("avg_num", "lineitem", "s: number, n: number", f"q(S, avg(P)) :- {_L}.", "SELECT l_suppkey AS s, (sum(l_partkey) // count(*))::BIGINT AS n FROM lineitem GROUP BY 1")
_simple("avg_float", "lineitem", "s: number, n: float", f"q(S, avg(Q)) :- {_L}.", "SELECT l_suppkey AS s, avg(l_quantity) AS n FROM lineitem GROUP BY 1")
_simple("min_str", "customer", "m: string, n: string", "q(M, min(N)) :- customer(_, N, _, _, M).", "SELECT c_mktsegment AS m, min(c_name) AS n FROM customer GROUP BY 1")
_simple("max_str", "customer", "m: string, n: string", "q(M, max(N)) :- customer(_, N, _, _, M).", "SELECT c_mktsegment AS m, max(c_name) AS n FROM customer GROUP BY 1")
_simple("min_float", "orders", "c: number, n: float", "q(C, min(P)) :- orders(_, C, _, P, _, _).", "SELECT o_custkey AS c, min(o_totalprice) AS n FROM orders GROUP BY 1")
_simple("multikey_min", "orders", "s: string, p: string, n: number", "q(S, P, min(D)) :- orders(_, _, S, _, D, P).", "SELECT o_orderstatus AS s, o_orderpriority AS p, min(epoch(o_orderdate))::BIGINT AS n FROM orders GROUP BY 1, 2")
_simple("global_count", "orders", "n: number", "q(count(O)) :- orders(O, _, _, _, _, _).", "SELECT count(*) AS n FROM orders")
_simple("global_empty", "orders", "n: number", 'q(count(O)) :- orders(O, _, "none", _, _, _).', "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'none' HAVING count(*) > 0")
_simple("agg_over_join", "orders customer nation", "n: string, c: number", "q(N, count(O)) :- orders(O, C, _, _, _, _), customer(C, _, K, _, _), nation(K, N, _).", "SELECT n_name AS n, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_simple("agg_expr_distinct", "lineitem", "f: string, n: number", f"q(F, sum(N * 2)) :- {_L}.", "SELECT f, sum(v)::BIGINT AS n FROM (SELECT DISTINCT l_returnflag AS f, l_linenumber * 2 AS v FROM lineitem) GROUP BY 1")
_simple("agg_count_const", "lineitem", "f: string, n: number", f"q(F, count(1)) :- {_L}.", "SELECT l_returnflag AS f, 1::BIGINT AS n FROM lineitem GROUP BY 1")
_simple("agg_two_rules", "customer supplier", "k: number, n: number", "q(K, count(C)) :- customer(C, _, K, _, _).\nq(K, count(S)) :- supplier(S, _, K, _).", "SELECT k, count(*) AS n FROM (SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
_simple("agg_nulls", "part", "b: string, n: number, m: number", "v(K, B, K / (S - 25)) :- part(K, _, B, _, S, _), S = 25.\nv(K, B, K / (S - 25)) :- part(K, _, B, _, S, _), S < 24.\nc(B, count(V)) :- v(K, B, V).\nm(B, max(V)) :- v(K, B, V).\nq(B, N, M) :- c(B, N), m(B, M).", "SELECT p_brand AS b, count(v) AS n, max(v) AS m FROM (SELECT p_brand, CASE WHEN p_size <> 25 THEN p_partkey // (p_size - 25) END AS v FROM part WHERE p_size < 24 OR p_size = 25) GROUP BY 1 HAVING count(v) > 0")
_simple("agg_negation", "orders lineitem", "c: number, n: number", 'q(C, count(O)) :- orders(O, C, _, _, _, _), !lineitem(O, _, _, _, _, _, _, _, "R", _, _).', "SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
_simple("top_per_group", "orders", "c: number, o: number, p: float", "best(C, max(P)) :- orders(_, C, _, P, _, _).\nq(C, O, P) :- orders(O, C, _, P, _, _), best(C, P).", "SELECT o_custkey AS c, o_orderkey AS o, o_totalprice AS p FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) = 1")
_simple("having", "orders", "c: number, n: number", "cnt(C, count(O)) :- orders(O, C, _, _, _, _).\nq(C, N) :- cnt(C, N), N > 12.", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
_simple("lattice_merge", "orders", "c: number, d: number", "q(C, D) :- orders(_, C, _, _, D, _).", "SELECT o_custkey AS c, max(epoch(o_orderdate))::BIGINT AS d FROM orders GROUP BY 1")
PROGRAMS["lattice_merge"] = (PROGRAMS["lattice_merge"][0].replace(".decl q(c: number, d: number)", ".decl q(c: number, d: number) merge(max)"), PROGRAMS["lattice_merge"][1])

# Recursion. Edges come from nations (k to k + 1, 2k and 3k within 25) and from conversations' turns.
_EDGES = "e(A, A * 2 % 25) :- nation(A, _, _).\ne(A, A * 3 % 25) :- nation(A, _, _).\n"
_ESQL = "e AS (SELECT n_nationkey::BIGINT AS a, (n_nationkey * 2 % 25)::BIGINT AS b FROM nation UNION SELECT n_nationkey, n_nationkey * 3 % 25 FROM nation)"
_simple("tc", "nation", "a: number, b: number", _EDGES + "q(A, B) :- e(A, B).\nq(A, C) :- q(A, B), e(B, C).", f"WITH RECURSIVE {_ESQL}, t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t")
_simple("tc_nonlinear", "nation", "a: number, b: number", _EDGES + "q(A, B) :- e(A, B).\nq(A, C) :- q(A, B), q(B, C).", f"WITH RECURSIVE {_ESQL}, t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t")
_simple("tc_turns", "conversations", "c: number, a: number, b: number", "s(C, A, A + 1) :- conversations(C, A, _, _), conversations(C, B, _, _), B = A + 1.\nq(C, A, B) :- s(C, A, B).\nq(C, A, D) :- q(C, A, B), s(C, B, D).", "SELECT x.conv_id AS c, x.turn AS a, y.turn AS b FROM (SELECT DISTINCT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT DISTINCT conv_id, turn FROM conversations)) x JOIN (SELECT DISTINCT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT DISTINCT conv_id, turn FROM conversations)) y ON x.conv_id = y.conv_id AND x.run = y.run AND x.turn < y.turn")
_simple("reach", "nation", "a: number", _EDGES + "q(A) :- nation(A, _, _), A = 1.\nq(B) :- q(A), e(A, B).", f"WITH RECURSIVE {_ESQL}, t AS (SELECT 1::BIGINT AS a UNION SELECT e.b FROM t JOIN e ON t.a = e.a) SELECT a FROM t")
_simple("unreachable", "nation", "a: number", _EDGES + "r(A) :- nation(A, _, _), A = 1.\nr(B) :- r(A), e(A, B).\nq(A) :- nation(A, _, _), !r(A).", f"WITH RECURSIVE {_ESQL}, t AS (SELECT 1::BIGINT AS a UNION SELECT e.b FROM t JOIN e ON t.a = e.a) SELECT n_nationkey::BIGINT AS a FROM nation EXCEPT SELECT a FROM t")
_simple("same_generation", "nation", "a: number, b: number", "p(A, A / 2) :- nation(A, _, _), A > 0.\nq(A, B) :- p(A, P), p(B, P), A != B.\nq(A, B) :- p(A, X), q(X, Y), p(B, Y).", "WITH RECURSIVE p AS (SELECT n_nationkey::BIGINT AS a, (n_nationkey // 2)::BIGINT AS p FROM nation WHERE n_nationkey > 0), t AS (SELECT x.a, y.a AS b FROM p x JOIN p y USING (p) WHERE x.a <> y.a UNION SELECT x.a, y.a FROM t JOIN p x ON x.p = t.a JOIN p y ON y.p = t.b) SELECT a, b FROM t")
_simple("mutual_even_odd", "nation", "a: number, k: number", _EDGES + "even(A) :- nation(A, _, _), A = 1.\nodd(B) :- even(A), e(A, B).\neven(B) :- odd(A), e(A, B).\nq(A, 0) :- even(A).\nq(A, 1) :- odd(A).", f"WITH RECURSIVE {_ESQL}, t AS (SELECT 1::BIGINT AS a, 0::BIGINT AS k UNION SELECT e.b, 1 - k FROM t JOIN e ON t.a = e.a) SELECT a, k FROM t")
_simple("bounded_tc", "nation", "a: number, b: number, n: number", _EDGES + "q(A, B, 1) :- e(A, B).\nq(A, C, N + 1) :- q(A, B, N), e(B, C), N < 3.", f"WITH RECURSIVE {_ESQL}, t AS (SELECT a, b, 1::BIGINT AS n FROM e UNION SELECT t.a, e.b, n + 1 FROM t JOIN e ON t.b = e.a WHERE n < 3) SELECT a, b, n FROM t")
_simple("dyck", "nation", "a: number, b: number", "o(A, A * 2 % 25) :- nation(A, _, _).\nc(A, A * 3 % 25) :- nation(A, _, _).\nq(A, B) :- o(A, M), c(M, B).\nq(A, B) :- o(A, M), q(M, N), c(N, B).\nq(A, B) :- q(A, M), q(M, B).", "WITH RECURSIVE o AS (SELECT n_nationkey::BIGINT AS a, (n_nationkey * 2 % 25)::BIGINT AS b FROM nation), c AS (SELECT n_nationkey::BIGINT AS a, (n_nationkey * 3 % 25)::BIGINT AS b FROM nation), w AS (SELECT n_nationkey::BIGINT AS a, n_nationkey::BIGINT AS b, 0 AS d, 0 AS n FROM nation UNION SELECT w.a, x.b, d + s, 1 FROM w JOIN (SELECT a, b, 1 AS s FROM o UNION ALL SELECT a, b, -1 FROM c) x ON w.b = x.a WHERE d + s BETWEEN 0 AND 60) SELECT DISTINCT a, b FROM w WHERE d = 0 AND n = 1")
_simple("cc_min", "nation", "a: number, c: number", "e(A, B) :- nation(A, _, R), nation(B, _, R).\nq(A, min(A)) :- nation(A, _, _).\nq(B, min(C)) :- q(A, C), e(A, B).", "SELECT n_nationkey::BIGINT AS a, min(n_nationkey) OVER (PARTITION BY n_regionkey)::BIGINT AS c FROM nation")
_simple("sssp_merge", "nation", "a: number, d: number", "e(A, A * 2 % 25, A + 1) :- nation(A, _, _).\ne(A, A * 3 % 25, 2) :- nation(A, _, _).\nq(A, 0) :- nation(A, _, _), A = 1.\nq(B, D + W) :- q(A, D), e(A, B, W).", "WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS a, (n_nationkey * 2 % 25)::BIGINT AS b, (n_nationkey + 1)::BIGINT AS w FROM nation UNION SELECT n_nationkey, n_nationkey * 3 % 25, 2 FROM nation), t AS (SELECT 1::BIGINT AS a, 0::BIGINT AS d UNION SELECT e.b, d + w FROM t JOIN e ON t.a = e.a WHERE d + w < 120) SELECT a, min(d) AS d FROM t GROUP BY 1")
PROGRAMS["sssp_merge"] = (PROGRAMS["sssp_merge"][0].replace(".decl q(a: number, d: number)", ".decl q(a: number, d: number) merge(min)"), PROGRAMS["sssp_merge"][1])
_simple("longest_dag_max", "nation", "a: number, d: number", "e(A, B) :- nation(A, _, R), nation(B, _, R), A < B.\nq(A, max(0)) :- nation(A, _, _).\nq(B, max(D + 1)) :- q(A, D), e(A, B).", "SELECT n_nationkey::BIGINT AS a, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS d FROM nation")
_simple("recursive_count_steps", "nation", "a: number, n: number", _EDGES + "q(A, count(B)) :- e(A, B).\nq(A, count(C)) :- q(A, B), e(B, C).", f"WITH RECURSIVE {_ESQL}, t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, count(*) AS n FROM t GROUP BY 1")
_simple("guarded_reach", "nation", "a: number", _EDGES + "shut(A) :- nation(A, _, R), R = 3, A != 6.\nq(A) :- nation(A, _, _), A = 1.\nq(B) :- q(A), e(A, B), !shut(B).", f"WITH RECURSIVE {_ESQL}, t AS (SELECT 1::BIGINT AS a UNION SELECT e.b FROM t JOIN e ON t.a = e.a WHERE e.b NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3 AND n_nationkey <> 6)) SELECT a FROM t")
_simple("new_numbers", "nation", "a: number, s: string", 'q(A, N) :- nation(A, N, R), R = 1.\nq(A * 2 + 1, concat(N, "+")) :- q(A, N), A < 400.', "WITH RECURSIVE t AS (SELECT n_nationkey::BIGINT AS a, n_name AS s FROM nation WHERE n_regionkey = 1 UNION SELECT a * 2 + 1, s || '+' FROM t WHERE a < 400) SELECT a, s FROM t")
_simple("order_chains", "orders", "c: number, o: number, n: number", "best(C, min(O)) :- orders(O, C, _, _, _, _).\nnext(C, O, min(P)) :- orders(O, C, _, _, _, _), orders(P, C, _, _, _, _), P > O.\nq(C, O, 1) :- best(C, O).\nq(C, P, N + 1) :- q(C, O, N), next(C, O, P).", "SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)")
# Terms over nations: a leaf for each, above it one of a pair of leaves, and above that one of a pair of those; leaves of two regions are made equal.
_add(
    "congruence",
    """use nation
.printsize
.decl pair(t: number, level: number, left: number, right: number)
.decl given(a: number, b: number)
.decl shape(level: number, left: number, right: number, first: number) merge(min)
.out
.decl q(t: number, rep: number) merge(min)
.rule
pair(N + 100, 1, N, N * 7 % 25) :- nation(N, _, _).
pair(N + 200, 2, N + 100, M + 100) :- nation(N, _, _), pair(_, 1, N, M).
given(A, B) :- nation(A, _, R), nation(B, _, R), R > 2, A != B.
q(N, N) :- nation(N, _, _).
q(T, T) :- pair(T, _, _, _).
q(A, R) :- given(A, B), q(B, R).
shape(L, X, Y, T) :- pair(T, L, A, B), q(A, X), q(B, Y).
q(T, F) :- pair(T, L, A, B), q(A, X), q(B, Y), shape(L, X, Y, F).
""",
    """WITH leaf AS (SELECT n_nationkey::BIGINT AS t, CASE WHEN n_regionkey > 2 THEN min(n_nationkey) OVER (PARTITION BY n_regionkey) ELSE n_nationkey END::BIGINT AS rep FROM nation),
    one AS (SELECT x.t + 100 AS t, x.t AS a, y.t AS b, min(x.t + 100) OVER (PARTITION BY x.rep, y.rep) AS rep FROM leaf x JOIN leaf y ON y.t = x.t * 7 % 25),
    two AS (SELECT x.t + 100 AS t, min(x.t + 100) OVER (PARTITION BY x.rep, y.rep) AS rep FROM one x JOIN one y ON y.t = x.b + 100)
    SELECT t, rep FROM leaf UNION ALL SELECT t, rep FROM one UNION ALL SELECT t, rep FROM two""",
)

# Builtins.
_simple("fn_split_nth", "pages", "k: number, a: string, b: string", 'q(K, split_nth(U, "/", 2), split_nth(U, "/", 9)) :- pages(K, U, _).', "SELECT page_id AS k, string_split(url, '/')[3] AS a, string_split(url, '/')[10] AS b FROM pages")
_simple("fn_starts_with", "pages", "k: number, a: number", 'q(K, starts_with(U, "https")) :- pages(K, U, _).', "SELECT page_id AS k, starts_with(url, 'https')::BIGINT AS a FROM pages")
_simple("fn_contains", "pages", "k: number", 'q(K) :- pages(K, U, _), contains(U, "blog.") = 1.', "SELECT page_id AS k FROM pages WHERE contains(url, 'blog.')")
_simple("fn_str_before", "nation", "a: string, b: string", "q(A, B) :- nation(_, A, R), nation(_, B, R), str_before(A, B) = 1.", "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name")
_simple("fn_replace", "part", "k: number, v: string", 'q(K, replace(T, "A", "__")) :- part(K, _, _, T, _, _).', "SELECT p_partkey AS k, replace(p_type, 'A', '__') AS v FROM part")
_simple("fn_before_after_last", "pages", "k: number, a: string, b: string", 'q(K, before_last(U, "/"), after_last(U, "/")) :- pages(K, U, _).', "SELECT page_id AS k, regexp_replace(url, '/[^/]*$', '') AS a, regexp_extract(url, '([^/]*)$', 1) AS b FROM pages")
_simple("fn_concat", "nation", "v: string", 'q(concat(N, concat("-", N))) :- nation(_, N, _).', "SELECT DISTINCT n_name || '-' || n_name AS v FROM nation")
_simple("fn_extract_number", "customer", "k: number, v: number", "q(K, extract_number(N)) :- customer(K, N, _, _, _).", "SELECT c_custkey AS k, TRY_CAST(replace(regexp_extract(c_name, '[0-9](?:,?[0-9])*'), ',', '') AS BIGINT) AS v FROM customer")
_simple("fn_case", "nation", "a: string, b: string", "q(to_lower(N), to_upper(N)) :- nation(_, N, _).", "SELECT DISTINCT lower(n_name) AS a, upper(n_name) AS b FROM nation")
_simple("fn_round_floor", "customer", "k: number, a: number, b: number", "q(K, round(B), floor(B)) :- customer(K, _, _, B, _).", "SELECT c_custkey AS k, round(c_acctbal)::BIGINT AS a, floor(c_acctbal)::BIGINT AS b FROM customer")
_simple("fn_float_math", "part", "k: number, a: float, b: float, c: float", "q(K, ln(to_float(S)), sqrt(P), pow(to_float(S), 2.0)) :- part(K, _, _, _, S, P).", "SELECT p_partkey AS k, ln(p_size::DOUBLE) AS a, sqrt(p_retailprice) AS b, pow(p_size::DOUBLE, 2.0) AS c FROM part")
_simple("fn_exp", "part", "k: number, a: number", "q(K, round(exp(to_float(S % 12)) * 1000.0)) :- part(K, _, _, _, S, _).", "SELECT p_partkey AS k, round(exp((p_size % 12)::DOUBLE) * 1000.0)::BIGINT AS a FROM part")
_simple("fn_date_of_orders", "orders", "o: number, d: number", 'q(O, date_epoch(concat("1995-0", concat(split_nth(P, "-", 0), "-11")))) :- orders(O, _, _, _, _, P).', "SELECT o_orderkey AS o, epoch(TRY_CAST('1995-0' || string_split(o_orderpriority, '-')[1] || '-11' AS TIMESTAMP))::BIGINT AS d FROM orders")
_simple("fn_abs", "customer", "k: number, a: number, b: float", "q(K, abs(5 - K), abs(B)) :- customer(K, _, _, B, _).", "SELECT c_custkey AS k, abs(5 - c_custkey) AS a, abs(c_acctbal) AS b FROM customer")
_simple("fn_similarity", "nation", "a: string, s: number", 'q(N, similarity(N, "UNITED NATIONS")) :- nation(_, N, _).', "WITH g AS (SELECT n_name AS s, unnest(list_transform(range(1, length(n_name)), lambda i: substr(n_name, i, 2))) AS g FROM nation), c AS (SELECT s, g, count(*) AS k FROM g GROUP BY ALL), t AS (SELECT g, count(*) AS k FROM (SELECT unnest(list_transform(range(1, 14), lambda i: substr('UNITED NATIONS', i, 2))) AS g) GROUP BY 1) SELECT c.s AS a, (200 * sum(CASE WHEN t.k IS NULL THEN 0 ELSE least(c.k, t.k) END) // (sum(c.k) + 13))::BIGINT AS s FROM c LEFT JOIN t USING (g) GROUP BY 1")
_simple("fn_date_epoch", "nation", "k: number, v: number, w: number", 'q(K, date_epoch(concat("2024-02-", concat("1", "5T10:20:30Z"))) + K, date_epoch("2024-13-01")) :- nation(K, _, _).', "SELECT n_nationkey::BIGINT AS k, epoch(TIMESTAMP '2024-02-15 10:20:30')::BIGINT + n_nationkey AS v, NULL::BIGINT AS w FROM nation")
_simple("deadline_window", "orders", "o: number", 'q(O) :- orders(O, _, _, _, D, _), D >= date_epoch("1995-01-01"), D < date_epoch("1996-01-01T00:00:00").', "SELECT o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")

# Presentation.
_simple("order_limit_topk", "orders", "o: number, p: float", "q(O, P) :- orders(O, _, _, P, _, _).", "SELECT o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY p DESC NULLS LAST, o::VARCHAR LIMIT 10")
PROGRAMS["order_limit_topk"] = (PROGRAMS["order_limit_topk"][0].replace(".decl q(o: number, p: float)", ".decl q(o: number, p: float) order_by(p desc) limit(10)"), PROGRAMS["order_limit_topk"][1])


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type maintained over three epochs: all events, then deletions, then some of those again."""
    from pyspark.sql import functions as F

    from .lang.loader import load_text
    from .plans.typing import check
    from .streaming.epoch import Maintained

    program = ".in\n.decl ev(id: number, kind: string, user_id: number)\n.out\n.decl n(kind: string, n: number)\n.rule\nn(K, count(I)) :- ev(I, K, _).\n"
    kept = Maintained(spark, check(load_text(program)), 1000)
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "user_id")
    kept.advance({"ev": ev})
    kept.advance({"ev": ev.where("id % 3 = 0").withColumn("__diff", F.lit(-1))})
    kept.advance({"ev": ev.where("id % 6 = 0").withColumn("__diff", F.lit(1))})
    return kept.relation("n")


def incremental_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closure maintained over insertions and a deletion."""
    from pyspark.sql import functions as F

    from .lang.loader import load_text
    from .plans.typing import check
    from .streaming.epoch import Maintained

    program = ".in\n.decl e(a: number, b: number)\n.out\n.decl t(a: number, b: number)\n.rule\nt(A, B) :- e(A, B).\nt(A, C) :- t(A, B), e(B, C).\n"
    kept = Maintained(spark, check(load_text(program)), 1000)
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("a"))
    e = n.select("a", (F.col("a") * 2 % 25).alias("b"))
    kept.advance({"e": e})
    kept.advance({"e": n.select("a", (F.col("a") * 3 % 25).alias("b"))})
    kept.advance({"e": e.where("a % 4 = 0").withColumn("__diff", F.lit(-1))})
    return kept.relation("t")


def incremental_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a join whose two sides change in turn: customers go, orders go, the customers come back."""
    from pyspark.sql import functions as F

    engine = Engine(spark).load_text(f".in\n.decl orders({TABLES['orders']})\n.decl customer({TABLES['customer']})\n.out\n.decl n(k: number, n: number)\n.rule\nn(K, count(O)) :- orders(O, C, _, _, _, _), customer(C, _, K, _, _).\n")
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    engine.bind("orders", orders)
    engine.bind("customer", customer)
    kept = engine.run()
    some = customer.where("c_mktsegment = 'BUILDING'")
    kept.advance({"customer": some.withColumn("__diff", F.lit(-1))})
    kept.advance({"orders": orders.where("o_orderstatus = 'F'").withColumn("__diff", F.lit(-1))})
    kept.advance({"customer": some.withColumn("__diff", F.lit(1))})
    return kept.relation("n")


def incremental_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who can be reached by turns of a conversation, after some turns went and others came back."""
    from pyspark.sql import functions as F

    program = ".in\n.decl t(c: number, a: number)\n.out\n.decl r(c: number, a: number)\n.rule\nr(C, A) :- t(C, A), A = 0.\nr(C, A + 1) :- r(C, A), t(C, B), B = A + 1.\n"
    engine = Engine(spark).load_text(program)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("a")).distinct()
    engine.bind("t", turns)
    kept = engine.run()
    kept.advance({"t": turns.where("a = 1 or a = 3").withColumn("__diff", F.lit(-1))})
    kept.advance({"t": turns.where("a = 1").withColumn("__diff", F.lit(1))})
    return kept.relation("r")


def _exported(spark: SparkSession, sf_dir: str, table: str, kind: str) -> str:
    """A folder below the shared one with the table's whole rows as text: nulls empty, one line each."""
    import uuid

    from pyspark.sql import functions as F

    at = f"{fixpoint.shared_dir(spark)}/export-{uuid.uuid4().hex}"
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if kind == "csv":
        df.write.csv(f"{at}/{table}.csv", header=True)
    else:
        df.select(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))).write.text(f"{at}/{table}.facts")
    return at


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV source of the whole customer table, under a rule."""
    at = _exported(spark, sf_dir, "customer", "csv")
    text = f'.source c = csv(path = "{at}/customer.csv", types = "number,string,number,float,string")\n.in\n.decl c({TABLES["customer"]})\n.out\n.decl q(k: number, n: string, b: float)\n.rule\nq(K, N, B) :- c(K, N, _, B, _), B > 0.0.\n'
    return Engine(spark).load_text(text).query("q")


def facts_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts files of the whole supplier and nation tables, joined."""
    from .sources.facts import read_facts

    text = f".in\n.decl supplier({TABLES['supplier']})\n.decl nation({TABLES['nation']})\n.out\n.decl q(s: number, n: string)\n.rule\nq(S, N) :- supplier(S, _, K, _), nation(K, N, _).\n"
    engine = Engine(spark).load_text(text)
    inputs = {t: read_facts(spark, engine.program.inputs[t], _exported(spark, sf_dir, t, "facts"), "|") for t in ("supplier", "nation")}
    return engine.query("q", inputs)


def sql_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL source over the tables' folder, under a fold."""
    text = f'.source o = sql(db = "{sf_dir}", sql = "SELECT o_custkey AS c, o_orderkey AS o FROM orders")\n.in\n.decl o(c: number, o: number)\n.out\n.decl q(c: number, n: number)\n.rule\nq(C, count(O)) :- o(C, O).\n'
    return Engine(spark).load_text(text).query("q")


def live_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that joins a running program, reads what it publishes, and follows an epoch of deletions."""
    from pyspark.sql import functions as F

    engine = Engine(spark).load_text(f".in\n.decl orders({TABLES['orders']})\n.out\n.decl spent(c: number, p: float)\n.rule\nspent(C, max(P)) :- orders(_, C, _, P, _, _).\n")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    engine.bind("orders", orders)
    kept = engine.run()
    engine.live_queries.add("top", ".in\n.decl spent(c: number, p: float)\n.out\n.decl q(c: number, p: float)\n.rule\nq(C, P) :- spent(C, P), P > 200000.0.\n")
    kept.advance({"orders": orders.where("o_orderstatus = 'O'").withColumn("__diff", F.lit(-1))})
    return engine.live_queries.relations("top")["q"]


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, sf_dir, PROGRAMS[name][0], bags=("q",) if name in BAGS else ())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(n) for n in PROGRAMS} | {"incremental_counts": incremental, "incremental_closure": incremental_closure, "incremental_join": incremental_join, "incremental_reach": incremental_reach, "csv_rows": csv_rows, "facts_rows": facts_rows, "sql_rows": sql_rows, "live_query": live_query}
ORACLE_SQL: dict[str, str] = {n: sql for n, (_, sql) in PROGRAMS.items()} | {
    "incremental_counts": "SELECT event_type AS kind, count(*) AS n FROM (SELECT DISTINCT event_id, event_type, user_id FROM events) WHERE event_id % 3 <> 0 OR event_id % 6 = 0 GROUP BY 1",
    "incremental_closure": "WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS a, (n_nationkey * 2 % 25)::BIGINT AS b FROM nation WHERE n_nationkey % 4 <> 0 UNION SELECT n_nationkey, n_nationkey * 3 % 25 FROM nation), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t",
    "incremental_join": "SELECT c_nationkey::BIGINT AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY 1",
    "incremental_reach": "WITH RECURSIVE t AS (SELECT DISTINCT conv_id::BIGINT AS c, turn::BIGINT AS a FROM conversations WHERE turn <> 3), r AS (SELECT c, a FROM t WHERE a = 0 UNION SELECT t.c, t.a FROM r JOIN t ON t.c = r.c AND t.a = r.a + 1) SELECT c, a FROM r",
    "csv_rows": "SELECT c_custkey AS k, c_name AS n, c_acctbal AS b FROM customer WHERE c_acctbal > 0",
    "facts_rows": "SELECT s_suppkey AS s, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "sql_rows": "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1",
    "live_query": "SELECT o_custkey AS c, max(o_totalprice) AS p FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1 HAVING max(o_totalprice) > 200000",
}
