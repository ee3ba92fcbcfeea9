"""DuckDB text of the fixture views, shared by the oracle queries."""

from __future__ import annotations

V_GATES = """
v_gates AS (
  SELECT l_suppkey AS file,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq,
         ['h','cx','rz','cz','cp','u','ccx'][l_linenumber] AS name,
         CAST(l_partkey % 64 AS INTEGER) AS a,
         CAST((l_partkey + 1 + l_orderkey % 63) % 64 AS INTEGER) AS b,
         CAST((l_partkey + 1 + (l_orderkey + 1) % 63) % 64 AS INTEGER) AS c,
         CASE WHEN l_linenumber IN (3,5,6) THEN round_even(l_discount * 100, 0) * pi() / 16 END AS param,
         64 AS n_qubits
  FROM lineitem)"""

V_GATES_SMALL = """
v_gates AS (
  SELECT l_orderkey AS file,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq,
         ['h','cx','rz','cz','cp','u','ccx'][l_linenumber] AS name,
         CAST(l_partkey % 8 AS INTEGER) AS a,
         CAST((l_partkey + 1 + l_suppkey % 7) % 8 AS INTEGER) AS b,
         CAST((l_partkey + 1 + (l_suppkey + 1) % 7) % 8 AS INTEGER) AS c,
         8 AS n_qubits
  FROM lineitem)"""

INTER = """
inter AS (
  SELECT file, seq, a, b FROM v_gates WHERE name IN ('cx','cz','cp','ccx')
  UNION ALL SELECT file, seq, a, c FROM v_gates WHERE name = 'ccx'
  UNION ALL SELECT file, seq, b, c FROM v_gates WHERE name = 'ccx')"""

EDGES = """
edges AS (
  SELECT file, least(a, b) AS u, greatest(a, b) AS v, count(*) AS weight FROM inter GROUP BY 1, 2, 3)"""

SPINE = """
spine AS (SELECT DISTINCT file, n_qubits FROM v_gates)"""

NODES = """
nodes AS (SELECT file, unnest(range(0, n_qubits)) AS node FROM spine),
ends AS (SELECT file, u AS node, v AS other, weight FROM edges UNION ALL SELECT file, v, u, weight FROM edges),
deg AS (SELECT n.file, n.node, count(e.other) AS deg, CAST(coalesce(sum(e.weight), 0) AS BIGINT) AS wdeg
        FROM nodes n LEFT JOIN ends e ON e.file = n.file AND e.node = n.node GROUP BY 1, 2)"""

V_SWEEP = """
v_sweep AS (
  SELECT l_orderkey AS file,
         CASE WHEN l_orderkey % 2 = 0 THEN 'CPU' ELSE 'GPU' END AS backend,
         CASE WHEN l_orderkey % 4 < 2 THEN 'single' ELSE 'double' END AS precision_,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos,
         CAST(2 ** (l_linenumber - 1) AS INTEGER) AS threshold,
         l_quantity / 50 AS fid, l_extendedprice / 1000 AS wall, l_extendedprice / 10 AS rss, l_tax AS p0,
         CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 END AS returncode,
         CASE WHEN l_returnflag = 'R' THEN 'mirror_TimeOut' WHEN l_linestatus = 'O' THEN 'ok' END AS note,
         CASE WHEN l_orderkey % 7 = 3 THEN 'runner_failed' ELSE 'ok' END AS status
  FROM lineitem),
kept AS (
  SELECT file, backend, precision_, threshold, arg_max_null(fid, pos) AS fid, arg_max_null(wall, pos) AS wall, arg_max_null(rss, pos) AS rss
  FROM v_sweep WHERE note IS NULL OR lower(note) NOT LIKE '%timeout%' GROUP BY 1, 2, 3, 4)"""

V_RESULTS = """
v_results AS (
  SELECT o_orderkey AS file,
         CASE WHEN o_orderkey % 2 = 0 THEN 'CPU' ELSE 'GPU' END AS backend,
         CASE WHEN o_orderkey % 4 < 2 THEN 'single' ELSE 'double' END AS precision_,
         CASE WHEN o_orderstatus = 'P' THEN 'runner_failed' ELSE 'ok' END AS status,
         o_orderpriority AS family,
         CASE WHEN o_custkey % 10 <> 0 THEN CAST(2 ** (o_custkey % 9) AS INTEGER) END AS selected_threshold,
         o_totalprice / 1000 AS forward_wall_s,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 10000 END AS state_setup_wall_s,
         CAST(o_custkey % 131 AS INTEGER) AS n_qubits
  FROM orders)"""

V_SCORED = """
v_scored AS (
  SELECT o_orderkey AS id, o_orderpriority AS family,
         CAST(2 ** (o_custkey % 9) AS INTEGER) AS true_threshold_min,
         CASE WHEN o_orderkey % 17 <> 0 THEN CAST(2 ** ((o_custkey + o_orderkey % 3) % 9) AS INTEGER) END AS predicted_threshold_min,
         o_totalprice AS true_s,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice * (0.5::DOUBLE + (o_custkey % 20) / 10.0::DOUBLE) END AS pred_s
  FROM orders)"""

V_FEATURES = """
v_features AS (
  SELECT o_orderkey AS id, o_custkey AS grp, CAST(n_lines AS DOUBLE) AS n_lines, sum_qty, avg_discount, max_price, sum_tax,
         o_totalprice * 0.5::DOUBLE + coalesce(sum_qty, 0) * 100 AS blend, 1.0::DOUBLE AS constant,
         CASE WHEN o_orderkey % 2 = 0 THEN 'CPU' ELSE 'GPU' END AS backend,
         CASE WHEN o_orderkey % 4 < 2 THEN 'single' ELSE 'double' END AS precision_,
         CAST(2 ** (o_custkey % 9) AS DOUBLE) AS selected_threshold,
         o_totalprice / 1000 AS forward_wall_s, o_totalprice / 10000 AS estimated_setup_s,
         o_totalprice / 10000000 AS estimated_per_shot_s
  FROM orders LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty, avg(l_discount) AS avg_discount,
           max(l_extendedprice) AS max_price, sum(CASE WHEN l_tax > 0 THEN l_tax END) AS sum_tax
    FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""

V_PROBA = """
raw_proba AS (
  SELECT o_orderkey AS id, o_orderpriority AS family, i AS idx, CAST(1 + (o_orderkey * (i + 3)) % 7 AS DOUBLE) AS w
  FROM orders, range(0, 9) AS r(i)),
v_proba AS (SELECT id, family, idx, w / sum(w) OVER (PARTITION BY id) AS p FROM raw_proba)"""

ANGLES = ["0", "pi", "-pi/2", "3*pi/8", "-2*pi", "0.927", "2.1e-08", "7", "pi/4", "5*pi/16", "theta"]

V_LINES = """
lines AS (
  SELECT concat_ws('-', l_suppkey, l_orderkey, l_linenumber, l_partkey) AS file, l_linenumber AS line,
         ['h','cx','rz','cz','cp','u','ccx'][l_linenumber] AS name, l_orderkey, l_linenumber,
         CAST(l_partkey % 8 AS INTEGER) AS x, CAST((l_partkey + 1 + l_suppkey % 7) % 8 AS INTEGER) AS y,
         CAST((l_partkey + 1 + (l_suppkey + 1) % 7) % 8 AS INTEGER) AS z,
         CAST(round_even(l_discount * 100, 0) AS INTEGER) + 1 AS k
  FROM lineitem),
v_stmts AS (
  SELECT *, CASE WHEN x < 5 THEN 'a[' || x || ']' ELSE 'b[ ' || (x - 5) || ' ]' END AS ox,
         CASE WHEN y < 5 THEN 'a[' || y || ']' ELSE 'b[ ' || (y - 5) || ' ]' END AS oy,
         CASE WHEN z < 5 THEN 'a[' || z || ']' ELSE 'b[ ' || (z - 5) || ' ]' END AS oz,
         ['0','pi','-pi/2','3*pi/8','-2*pi','0.927','2.1e-08','7','pi/4','5*pi/16','theta'][k] AS angle,
         list_extract(CAST([0, pi(), -pi()/2, 3*pi()/8, -2*pi(), 0.927, 2.1e-08, 7, pi()/4, 5*pi()/16, NULL] AS DOUBLE[]), k) AS radians
  FROM lines),
v_args AS (
  SELECT *, CASE WHEN line IN (3,5) THEN angle WHEN line = 6 THEN angle || ', -pi/2,1.5e-08' ELSE '' END AS args,
         CASE line WHEN 7 THEN ox || ',' || oy || ',' || oz WHEN 2 THEN ox || ', ' || oy WHEN 4 THEN ox || ', ' || oy
                   WHEN 5 THEN ox || ', ' || oy ELSE ox END AS ops,
         CASE line WHEN 7 THEN [x, y, z] WHEN 2 THEN [x, y] WHEN 4 THEN [x, y] WHEN 5 THEN [x, y] ELSE [x] END AS qubits
  FROM v_stmts)"""


def with_views(*views: str, body: str) -> str:
    return "WITH " + ",".join(views) + "\n" + body


def round6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)
