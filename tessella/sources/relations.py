"""Relations of source-code facts, stated over the sample tables.

Each is plain SQL that Spark and DuckDB read alike, so that a query and its SQL
see the same rows.  ``load`` gives the DataFrame, ``with_relations`` the SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")

_NAME = "concat(replace(p_name, ' ', '_'), '_', p_partkey % 50)"
_NTH = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"

RELATIONS = {
    "symbols": f"""
        SELECT p_partkey AS sid,
          concat('mod', p_partkey % 7, '/src/', CASE p_partkey % 4 WHEN 0 THEN 'commonMain' WHEN 1 THEN 'jvmMain' WHEN 2 THEN 'main' ELSE 'test' END, '/File', p_partkey % 100, '.kt') AS path,
          16 * p_partkey AS start_byte, 16 * p_partkey + length(p_name) AS end_byte,
          {_NAME} AS name, p_brand AS package,
          CASE WHEN p_partkey % 5 = 1 THEN p_type END AS container,
          CASE p_partkey % 10 WHEN 0 THEN 'Class' WHEN 1 THEN 'Interface' WHEN 2 THEN 'Object' WHEN 3 THEN 'EnumClass' WHEN 4 THEN 'TypeAlias' WHEN 5 THEN 'EnumEntry' WHEN 6 THEN 'Function' WHEN 7 THEN 'Function' ELSE 'Property' END AS kind,
          CASE WHEN p_partkey % 4 = 0 THEN 'Durable' ELSE 'Volatile' END AS tier,
          p_size % 6 AS max_arity, p_size % 3 AS min_arity, p_partkey % 19 = 0 AS has_vararg,
          CASE WHEN p_partkey % 13 = 0 THEN p_type END AS ext_receiver,
          CASE WHEN p_partkey % 3 = 0 THEN concat('T', p_size % 9) END AS value_type
        FROM part""",
    "file_ctx": "SELECT o_orderkey AS path, concat('Brand#', o_custkey % 5 + 1, CAST(floor((o_custkey % 25) / 5.0) AS INT) + 1) AS package, o_custkey % 8 <> 0 OR o_custkey % 25 < 16 AS clean, concat('mod', o_custkey % 7) AS module FROM orders",
    "usages": f"""
        SELECT l_orderkey AS path, 10 * {_NTH} AS start_byte, {_NAME} AS name,
          CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 0 THEN 'MemberSelector' WHEN l_returnflag = 'A' THEN 'Type' WHEN l_returnflag = 'N' THEN 'Call' ELSE 'Value' END AS use_kind,
          CAST(l_quantity AS INT) % 5 AS n_args
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "imports": f"""
        SELECT l_orderkey AS path, {_NTH} AS ord, p_brand AS package, {_NAME} AS name, l_suppkey % 4 = 0 AS wildcard,
          CASE WHEN l_suppkey % 4 <> 0 AND l_partkey % 9 = 0 THEN concat('as_', {_NAME}) END AS alias
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 2 = 0""",
    "type_edges": "SELECT p_partkey AS sub, CAST(floor(p_partkey / 2.0) AS BIGINT) AS sup FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey AS sub, p_partkey + 3 AS sup FROM part WHERE p_partkey % 97 = 5",
    "coordinates": "SELECT p_partkey AS ord, p_brand AS grp, p_type AS artifact, concat(p_size, '.', p_partkey % 10, CASE WHEN p_partkey % 7 = 0 THEN concat('-RC', p_size % 3) WHEN p_partkey % 11 = 0 THEN '-jre' WHEN p_partkey % 13 = 0 THEN concat('_', p_size % 12) ELSE '' END) AS version FROM part",
    "nodes": """
        SELECT c_custkey AS path, 0 AS depth, CAST(0 AS BIGINT) AS pre, CAST(1000000000 AS BIGINT) AS post, 'file' AS kind, c_custkey AS ref FROM customer
        UNION ALL SELECT o_custkey, 1, 1000 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 1000 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 999, CASE o_orderkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'block' END, o_orderkey FROM orders
        UNION ALL SELECT o_custkey, 2, o.pre + 2 * l.nth, o.pre + 2 * l.nth + 1, 'identifier', l.l_partkey
        FROM (SELECT o_custkey, o_orderkey, 1000 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pre FROM orders) o
        JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS nth FROM lineitem) l ON o.o_orderkey = l.l_orderkey""",
    "telemetry": """
        SELECT event_id, user_id, event_type AS scenario, value AS wall_ms, event_type <> 'error' AS executed, event_id % 11 = 0 AS superseded,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS cold
        FROM events""",
    "diags_a": "SELECT concat('File', user_id % 40, '.kt') AS path, event_id % 17 AS line, event_id % 5 AS col, CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Warning' END AS severity, concat('message  of ', event_type) AS message FROM events WHERE event_id % 3 <> 0",
    "diags_b": "SELECT concat('File', user_id % 40, '.kt') AS path, event_id % 17 + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS line, event_id % 5 AS col, CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Warning' END AS severity, concat('message of ', event_type) AS message FROM events WHERE event_id % 4 <> 0",
    "edits": "SELECT conv_id AS file, turn AS ord, 7 * turn AS start_byte, 7 * turn + length(text) % 11 AS end_byte, role AS new_text FROM conversations",
    "candidates": "SELECT DISTINCT concat('query', sid % 40) AS qid, CASE sid % 4 WHEN 0 THEN 'co' WHEN 1 THEN 'new' WHEN 2 THEN 'hot_' ELSE '' END AS prefix, name, package, kind, tier, container FROM symbols",
    "qualified_uses": f"SELECT l_orderkey AS path, 10 * {_NTH} AS start_byte, p_brand AS qualifier, p_type AS outer_type, {_NAME} AS name, CASE WHEN l_returnflag = 'A' THEN 'Type' WHEN l_returnflag = 'N' THEN 'Call' ELSE 'Value' END AS use_kind FROM lineitem JOIN part ON l_partkey = p_partkey",
    "members": f"SELECT p_partkey AS sid, CAST(floor(p_partkey / 4.0) AS BIGINT) + 1 AS owner, {_NAME} AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Property' ELSE 'Function' END AS kind FROM part",
    "member_decls": "SELECT p_partkey AS sid, CAST(floor(p_partkey / 4.0) AS BIGINT) + 1 AS owner, concat('m', p_partkey % 4) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Property' ELSE 'Function' END AS kind, CASE WHEN p_size % 3 > 0 THEN concat('T', p_size % 2) ELSE '' END AS params FROM part",
    "new_names": f"SELECT p_partkey AS sid, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN concat('renamed_', p_partkey) WHEN 2 THEN 'class' WHEN 3 THEN concat('é', p_size) WHEN 4 THEN concat(p_size, 'x') ELSE concat('_', p_size) END AS new_name FROM part",
    "expr_nodes": """
        SELECT o_orderkey AS path, 0 AS node_id, CAST(NULL AS INT) AS parent_id, CAST(NULL AS INT) AS named_ord,
          CASE o_orderkey % 6 WHEN 0 THEN 'infix_expression' WHEN 1 THEN 'navigation_expression' WHEN 2 THEN 'user_type' WHEN 3 THEN 'call_expression' WHEN 4 THEN 'block' ELSE 'property_declaration' END AS kind FROM orders
        UNION ALL SELECT l_orderkey, l_linenumber, 0, l_linenumber - 1, 'identifier' FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l""",
    "named_nodes": "SELECT *, concat('v', ref % 7) AS name, CASE ref % 3 WHEN 0 THEN 'Value' WHEN 1 THEN 'Call' ELSE 'Type' END AS use_kind FROM nodes",
    "scope_decls": """
        SELECT path, pre - pre % 1000 AS scope, concat('v', ref % 7) AS name, pre AS decl_start, CAST(ref % 2 AS INT) AS prio, CASE ref % 3 WHEN 0 THEN 'Property' WHEN 1 THEN 'Function' ELSE 'Class' END AS kind FROM nodes WHERE depth = 2 AND ref % 5 = 0
        UNION ALL SELECT path, CAST(0 AS BIGINT), concat('v', ref % 7), pre, 0, CASE ref % 4 WHEN 0 THEN 'Property' WHEN 1 THEN 'Function' ELSE 'Class' END FROM nodes WHERE depth = 1 AND ref % 3 <> 1""",
    "guards": "SELECT path, concat('v', ref % 7) AS name, concat('T', ref % 3) AS type, pre AS lo, post AS hi FROM nodes WHERE depth = 1",
    "assigned": "SELECT path, concat('v', ref % 7) AS name, pre AS place FROM nodes WHERE depth = 2 AND ref % 13 = 0",
    "syntax": f"""
        SELECT o_orderkey AS path, CAST(0 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS BIGINT) AS named_ord, CAST(NULL AS STRING) AS field, CAST(NULL AS STRING) AS text,
          CASE o_orderkey % 10 WHEN 0 THEN 'variable_declaration' WHEN 1 THEN 'parameter' WHEN 2 THEN 'enum_entry' WHEN 3 THEN 'class_declaration' WHEN 4 THEN 'function_declaration' WHEN 5 THEN 'type_alias' WHEN 6 THEN 'value_argument' WHEN 7 THEN 'call_expression' WHEN 8 THEN 'object_declaration' ELSE 'block' END AS kind FROM orders
        UNION ALL SELECT l_orderkey, CAST({_NTH} AS BIGINT), CAST(0 AS BIGINT), CAST({_NTH} AS BIGINT) - 1, CASE {_NTH} WHEN 1 THEN 'name' WHEN 2 THEN 'type' END,
          CASE l_partkey % 9 WHEN 0 THEN 'true' WHEN 1 THEN 'null' WHEN 2 THEN 'break' ELSE concat('n', l_partkey) END, 'identifier' FROM lineitem""",
    "import_paths": f"""
        SELECT l_orderkey AS path, {_NTH} AS ord, concat(p_brand, CASE WHEN l_suppkey % 4 <> 0 AND p_partkey % 5 = 1 THEN concat('.', p_type) ELSE '' END, CASE WHEN l_suppkey % 4 <> 0 AND p_partkey % 5 = 1 AND l_linenumber % 3 = 0 THEN '.Companion' ELSE '' END) AS prefix,
          {_NAME} AS simple, l_suppkey % 4 = 0 AS wildcard FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "java_types": "SELECT p_partkey AS sid, concat('C', p_partkey % 50) AS name, p_brand AS package, CAST(NULL AS STRING) AS container, CASE WHEN p_partkey % 3 = 0 THEN 'Interface' ELSE 'Class' END AS kind FROM part WHERE p_partkey % 2 = 0",
    "java_members": "SELECT p_partkey AS sid, concat('m', p_partkey % 9) AS name, CASE WHEN p_partkey % 41 = 0 THEN 'java.lang' ELSE p_brand END AS package, concat('C', p_partkey % 50) AS container, CASE WHEN p_partkey % 4 = 1 THEN 'Property' ELSE 'Function' END AS kind, CASE WHEN p_partkey % 31 = 0 THEN 'Durable' ELSE 'Volatile' END AS tier, least(p_size % 3, 1) AS min_arity, CASE WHEN p_partkey % 37 <> 0 THEN p_size % 3 END AS max_arity, p_partkey % 29 = 0 AS has_vararg, CASE p_size % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'long' WHEN 2 THEN 'Object' ELSE 'String' END AS param FROM part WHERE p_partkey % 2 = 1",
    "java_imports": "SELECT l_orderkey AS path, concat(p_brand, CASE WHEN l_suppkey % 4 <> 0 AND l_partkey % 2 = 1 THEN concat('.C', l_partkey % 50) ELSE '' END) AS prefix, CASE WHEN l_partkey % 2 = 1 THEN concat('m', l_partkey % 9) ELSE concat('C', l_partkey % 50) END AS simple, l_suppkey % 4 = 0 AS wildcard FROM lineitem JOIN part ON l_partkey = p_partkey",
    "java_uses": f"SELECT l_orderkey AS path, CAST({_NTH} AS BIGINT) AS use_id, CASE WHEN l_returnflag = 'A' THEN concat('C', l_suppkey % 50) WHEN l_suppkey % 13 = 0 THEN 'getClass' WHEN l_suppkey % 11 = 0 THEN concat('z', l_partkey % 9) ELSE concat('m', l_partkey % 9) END AS name, l_returnflag = 'A' AS in_type, l_returnflag = 'N' AS is_call, CASE WHEN l_returnflag <> 'A' AND l_linenumber % 4 = 0 THEN concat('C', l_suppkey % 60) END AS receiver, CASE WHEN l_returnflag <> 'A' AND l_linenumber % 4 = 1 THEN concat('C', l_suppkey % 50) END AS owner, CAST(l_quantity AS INT) % 4 AS n_args, CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'long' WHEN 2 THEN 'char' WHEN 3 THEN 'String' END AS arg_type FROM lineitem",
    "java_locals": f"SELECT l_orderkey AS path, concat('m', l_partkey % 9) AS name, CAST({_NTH} AS BIGINT) AS decl_start, l_linenumber FROM lineitem",
    "java_files": "SELECT o_orderkey AS path, o_custkey % 3 = 0 AS static_imports, o_custkey % 5 = 0 AS supertypes, o_custkey % 2 = 0 AS is_enum FROM orders",
    "expr_types": "SELECT l_orderkey AS path, 10 * l_linenumber AS start_byte, CASE WHEN l_suppkey % 6 > 0 THEN concat('C', l_partkey % 50) END AS type, CASE WHEN l_linenumber % 2 = 0 THEN p_brand END AS package FROM lineitem JOIN part ON l_partkey = p_partkey",
    "typed_members": "SELECT p_partkey AS sid, CAST(floor(p_partkey / 4.0) AS BIGINT) + 1 AS owner, concat('m', p_partkey % 4) AS name, p_size % 3 AS arity, p_partkey % 11 = 0 AS extension, concat('T', p_size % 2) AS type FROM part",
    "member_calls": "SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS call_id, l_partkey AS recv, concat('m', l_suppkey % 4) AS name, l_linenumber % 3 AS n_args FROM lineitem",
    "exprs": f"""
        SELECT l_orderkey AS path, 10 * {_NTH} AS node_id, CAST(NULL AS INT) AS child_id, 0 AS height, CASE l_partkey % 8 WHEN 0 THEN 'string_literal' WHEN 1 THEN 'character_literal' WHEN 2 THEN 'number_literal' WHEN 3 THEN 'float_literal' WHEN 4 THEN 'this_expression' ELSE 'identifier' END AS kind,
          CASE l_partkey % 8 WHEN 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN '5L' ELSE '5' END WHEN 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN '1.5f' ELSE '1.5' END WHEN 4 THEN 'this' WHEN 5 THEN 'true' ELSE concat('v', l_partkey % 7) END AS text FROM lineitem
        UNION ALL SELECT l_orderkey, 10 * {_NTH} + 1, 10 * {_NTH}, 1, CASE l_suppkey % 6 WHEN 0 THEN 'parenthesized_expression' WHEN 1 THEN 'elvis_expression' WHEN 2 THEN 'unary_expression' WHEN 3 THEN 'as_expression' WHEN 4 THEN 'navigation_expression' ELSE 'lambda_literal' END, concat('m', l_linenumber % 3) FROM lineitem
        UNION ALL SELECT l_orderkey, 10 * {_NTH} + 2, 10 * {_NTH} + 1, 2, CASE l_linenumber % 4 WHEN 0 THEN 'parenthesized_expression' WHEN 1 THEN 'navigation_expression' WHEN 2 THEN 'elvis_expression' ELSE 'as_expression' END, concat('m', l_partkey % 3) FROM lineitem""",
    "bound_names": "SELECT o_orderkey AS path, concat('v', n_nationkey % 7) AS name, concat('K', (o_orderkey + n_nationkey) % 5) AS type, (o_orderkey + n_nationkey) % 2 = 0 AS nullable FROM orders JOIN nation ON n_nationkey < 6 UNION ALL SELECT o_orderkey, 'this', concat('K', o_orderkey % 5), false FROM orders",
    "properties_of": "SELECT concat('K', n_nationkey % 5) AS owner, concat('m', n_nationkey % 3) AS name, concat('K', (n_nationkey + 2) % 5) AS type, n_nationkey % 4 = 0 AS nullable FROM nation WHERE n_nationkey < 15",
    "lambdas": "SELECT p_partkey AS lambda_id, CASE p_partkey % 6 WHEN 0 THEN 'map' WHEN 1 THEN 'let' WHEN 2 THEN 'also' WHEN 3 THEN 'filter' WHEN 4 THEN 'run' ELSE 'forEach' END AS operation, concat('List', p_size % 3) AS receiver, CASE p_size % 3 WHEN 0 THEN concat('A', p_size) WHEN 1 THEN concat('A', p_size, ',B') ELSE '' END AS listed FROM part",
    "formals": "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'T' WHEN 1 THEN 'List<T>' WHEN 2 THEN 'Map<T, T>' WHEN 3 THEN 'Map<T, List<U>>' WHEN 4 THEN 'Set<T>' ELSE 'List<X>' END AS formal, CASE p_size % 5 WHEN 0 THEN concat('K', p_size) WHEN 1 THEN concat('List<K', p_size, '>') WHEN 2 THEN concat('Map<K', p_size, ', J>') WHEN 3 THEN concat('Map<K', p_size, ', List<J>>') ELSE 'T' END AS actual FROM part",
    "cached_types": "SELECT l_orderkey AS path, 10 * l_linenumber AS start_byte, 10 * l_linenumber + 5 AS end_byte, 'call' AS kind, o_custkey % 3 AS revision, concat('T', min(l_partkey) % 4) AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber, o_custkey",
    "typed_decls": "SELECT p_partkey % 100 AS path, 16 * p_partkey AS position, CASE WHEN p_size % 7 > 0 THEN concat('K', p_size) END AS type, p_partkey % 3 = 0 AS nullable, p_partkey % 5 = 0 AS annotated, CASE WHEN p_size % 2 = 0 THEN concat('A', p_size) ELSE '' END AS first_arg, p_size % 4 = 0 AS arg_null, p_size % 6 AS n_args FROM part",
    "open_calls": f"SELECT p_partkey AS call_id, {_NAME} AS name, concat('(', repeat('a, ', p_size % 4), CASE p_partkey % 4 WHEN 0 THEN '[b, c], ' WHEN 1 THEN 'f(x, y), ' WHEN 2 THEN '{{ d, e }}' ELSE 'g' END, CASE WHEN p_partkey % 5 = 0 THEN ')' ELSE '' END, CASE WHEN p_partkey % 10 = 0 THEN ', z' ELSE '' END) AS arguments FROM part",
    "kotlin_files": """
        SELECT concat('F', p_partkey, '.kt') AS path, p_partkey AS n, concat('package demo.p', p_partkey % 50, chr(10), 'import a.b.C', p_partkey % 5, chr(10), CASE WHEN p_partkey % 2 = 0 THEN concat('import x.y', p_partkey % 3, '.*', chr(10)) ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN concat('import q.Z as W', p_partkey, chr(10)) ELSE '' END,
          'data class Point', p_partkey, '(val x: Int, var y: List<Int>? = null) : Base<Int>(1), Shape {', chr(10), '    companion object { const val ORIGIN = 0 }', chr(10), '    fun <T : Any> String.len(a: T, b: Int = 2, vararg c: Int): Int { fun hidden() {}; return 1 }', chr(10), '}', chr(10),
          'enum class Color { RED, GREEN; fun f() = 1 }', chr(10), 'typealias Handler<T> = (T) -> Unit', chr(10), 'val total', p_partkey, ' = ', p_size, chr(10)) AS text FROM part""",
    "import_texts": "SELECT p_partkey AS file, concat('package p', p_size, chr(10), 'import a.', p_type, chr(10), 'import b.', p_brand, CASE WHEN p_partkey % 2 = 0 THEN chr(10) ELSE '' END) AS text, p_partkey % 4 <> 0 AS clean, length(p_type) AS n, length(p_brand) AS m, length(concat('package p', p_size)) AS head FROM part",
    "functions": "SELECT p_partkey AS file, CASE p_partkey % 4 WHEN 0 THEN concat('fun f(a: Int = 1): Int = ', p_size) WHEN 1 THEN concat('fun f(): Int { return g(', p_size, ') }') WHEN 2 THEN concat('fun f() { val x = ', p_size, chr(10), ' return x }') ELSE concat('fun f() { h(', p_size, ') }') END AS text, p_partkey % 4 AS form, p_size AS size FROM part",
    "archive_names": f"SELECT p_type AS coordinate, concat(p_brand, '.', {_NAME}) AS fqn, concat(p_brand, '/', {_NAME}, '.kt') AS entry FROM part",
    "compile_runs": "SELECT event_id, user_id AS root, ts, value AS wall_ms FROM events",
    "ingested": "SELECT user_id AS coordinate, event_id % 10 AS batch, event_type AS name, event_id FROM events",
    "params": "SELECT p_partkey AS sid, 0 AS pos, concat('T', p_size % 4) AS type, p_partkey % 17 = 0 AS variable FROM part UNION ALL SELECT p_partkey, 1, concat('T', (p_size + 1) % 4), false FROM part WHERE p_size % 2 = 0",
    "type_subs": "SELECT concat('T', n_nationkey) AS sub, concat('T', n_nationkey - 1) AS sup FROM nation WHERE n_nationkey IN (1, 2)",
    "outer_types": "SELECT p_partkey AS sid, p_type AS name, p_brand AS package FROM part WHERE p_partkey % 3 > 0",
    "outer_imports": f"SELECT l_orderkey AS path, {_NTH} AS ord, p_brand AS package, p_type AS name, l_suppkey % 4 = 0 AS wildcard, CASE WHEN l_suppkey % 8 = 1 THEN concat(p_type, 'X') END AS alias FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 2 = 0",
    "outer_uses": f"SELECT l_orderkey AS path, 10 * {_NTH} AS start_byte, CASE WHEN l_suppkey % 3 = 0 THEN concat(p_type, 'X') ELSE p_type END AS outer_type, {_NAME} AS name, CASE WHEN l_returnflag = 'A' THEN 'Value' ELSE 'Type' END AS use_kind FROM lineitem JOIN part ON l_partkey = p_partkey",
    "owned_members": "SELECT p_partkey AS sid, CAST(floor(p_partkey / 4.0) AS BIGINT) + 1 AS owner, CASE WHEN p_partkey % 10 = 0 THEN concat('u', p_partkey) ELSE concat('m', p_partkey % 4) END AS name, p_partkey % 11 = 0 AS extension FROM part",
    "selector_uses": "SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS call_id, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey END AS recv, CASE WHEN l_suppkey % 5 = 0 THEN concat('u', l_partkey - l_partkey % 10) ELSE concat('m', l_suppkey % 4) END AS name FROM lineitem",
    "call_args": f"SELECT path, start_byte, name, pos, CASE WHEN code % 5 <> 0 THEN concat('T', code % 4) END AS type FROM (SELECT l_orderkey AS path, 10 * {_NTH} AS start_byte, {_NAME} AS name, 0 AS pos, l_suppkey AS code FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT l_orderkey, 10 * {_NTH}, {_NAME}, 1, l_suppkey + l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 2 = 0) a",
    "positions": "SELECT o_custkey AS path, o_orderkey AS qid, 1000 + o_orderkey % 9000 AS place FROM orders",
    "documents_state": "SELECT user_id % 50 AS path, event_id AS version, ts, props AS text, event_type = 'error' AS closed FROM events",
    # one function of a Kotlin source for each line of an order, in ten forms; ``byte_at`` is where it begins, ``head`` what stands before the first
    "kt_lines": f"""
        SELECT path, nth, form, v, ty, code, head, CAST(length(head) + coalesce(sum(length(code)) OVER (PARTITION BY path ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_at,
          CAST(4 + coalesce(sum(1 + breaks) OVER (PARTITION BY path ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line, CAST(sum(1 + breaks) OVER (PARTITION BY path) AS BIGINT) AS lines
        FROM (SELECT *, concat('package p', path % 5, chr(10), 'import a.B', chr(10), 'import a.C', chr(10), 'class C', path, ' {{', chr(10)) AS head, CASE form WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 1 WHEN 8 THEN 1 WHEN 9 THEN 2 ELSE 0 END AS breaks,
          concat('fun f', nth, '(', CASE form WHEN 3 THEN ') {{ var ' WHEN 6 THEN ') {{ if (field is ' WHEN 7 THEN concat(v, ': Any {{ use(') ELSE concat(v, ': Any) {{ ') END,
            CASE form WHEN 0 THEN concat('if (', v, ' is ', ty, ' && ok(', v, ')) {{ use(', v, ') }} else {{ other(', v, ') }}')
              WHEN 1 THEN concat('when (', v, ') {{ is ', ty, ' -> use(', v, ')', chr(10), 'is T9, is T8 -> two(', v, ')', chr(10), 'else -> other(', v, ') }}')
              WHEN 2 THEN concat('if (', v, ' !is ', ty, ') return', chr(10), 'use(', v, ')')
              WHEN 3 THEN concat(v, ': Any = make()', chr(10), 'if (', v, ' is ', ty, ') {{ use(', v, ')', chr(10), v, ' = make()', chr(10), 'other(', v, ') }}')
              WHEN 4 THEN concat('when {{ ', v, ' is ', ty, ' -> use(', v, ')', chr(10), '(', v, ' is T9) && ok(', v, ') -> two(', v, ') }}')
              WHEN 5 THEN concat('if (', v, ' is ', ty, ') {{ if (', v, ' is T9) {{ use(', v, ') }} else {{ other(', v, ') }} }}')
              WHEN 6 THEN concat(ty, ') {{ use(field) }}')
              WHEN 7 THEN concat(v, ')')
              WHEN 8 THEN concat('val a = 1 2', chr(10), 'use(', v, ')')
              ELSE concat('if (', v, ' !is ', ty, ' || bad()) {{ log(', v, ')', chr(10), 'throw Err() }}', chr(10), 'run {{ use(', v, ') }}') END, ' }}', chr(10)) AS code
          FROM (SELECT l_orderkey AS path, {_NTH} AS nth, CAST((l_partkey + l_linenumber) % 10 AS INT) AS form, concat('v', l_partkey % 7) AS v, concat('T', l_suppkey % 9) AS ty FROM lineitem) k0) k1""",
    # a library source for each part: generic types that inherit with other arguments, overloads, generic functions, an extension
    "kt_library": """
        SELECT concat('lib', p_partkey) AS path, concat('package lib', chr(10),
          CASE WHEN p_partkey = 1 THEN concat('class List<E> {', chr(10), 'fun first(): E = TODO()', chr(10), '}', chr(10)) ELSE '' END,
          CASE WHEN p_partkey <= 5 THEN concat('class D', p_partkey % 5, '<Z> {', chr(10), 'fun item(): Z = TODO()', chr(10), '}', chr(10)) ELSE '' END,
          'open class B', p_partkey, '<Y> {', chr(10), 'fun get(): Y = TODO()', chr(10), 'fun name(n: Int): String = make()', chr(10), 'fun name(n: String): Int = 1', chr(10), 'val owner: D', p_partkey % 5, '<Y> = TODO()', chr(10), '}', chr(10),
          'class A', p_partkey, '<X> : B', p_partkey, '<List<X>>() {', chr(10), 'fun self(): A', p_partkey, '<X> = this', chr(10), 'fun size(): Int = 0', chr(10), '}', chr(10),
          'fun <T> pack', p_partkey, '(x: T): B', p_partkey, '<T> = TODO()', chr(10), 'fun same', p_partkey, '(x: Int): Long = 1L', chr(10), 'fun same', p_partkey, '(x: String): Char = TODO()', chr(10),
          'fun <T> B', p_partkey, '<T>.head(): T = TODO()', chr(10)) AS text
        FROM part""",
    # uses of it: a function for each line of an order, in twelve forms
    "kt_calls": f"""
        SELECT path, nth, form, p, k, concat(lead_, body, ' }}', chr(10)) AS code, CAST(length(lead_) AS BIGINT) AS skip, body,
          CAST(12 + coalesce(sum(length(lead_) + length(body) + 3) OVER (PARTITION BY path ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_at
        FROM (SELECT *, concat('fun u', nth, '(a: A', p, '<', k, '>, i: Int, s: String) {{ val q = ') AS lead_,
          CASE form WHEN 0 THEN 'a.get()' WHEN 1 THEN 'a.get().first()' WHEN 2 THEN 'a.name(i)' WHEN 3 THEN 'a.name(s)' WHEN 4 THEN 'a.self().owner.item()'
            WHEN 5 THEN concat('pack', p, '(a.get()).get()') WHEN 6 THEN concat('same', p, '((i))') WHEN 7 THEN concat('(a as A', p, ').self()') WHEN 8 THEN '(a.self() ?: a).size()'
            WHEN 9 THEN 'a.missing()' WHEN 10 THEN 'a.head()' ELSE concat('a.get()', chr(10), 'val r = q.first()') END AS body
          FROM (SELECT l_orderkey AS path, {_NTH} AS nth, CAST((l_partkey + l_linenumber) % 12 AS INT) AS form, l_partkey AS p, concat('T', l_suppkey % 9) AS k FROM lineitem) c0) c1""",
    # a source for each nation that others point into, and one for each order, with a declaration for each line in seven forms
    "kt_homes": "SELECT n_nationkey AS c, concat('home', n_nationkey) AS path, concat('package h', n_nationkey % 5, chr(10), 'open class K', n_nationkey, ' {', chr(10), 'class In', n_nationkey, chr(10), 'fun m', n_nationkey, '() {}', chr(10), '}', chr(10), 'fun top', n_nationkey, '() {}', chr(10)) AS text FROM nation",
    "kt_uses": f"""
        SELECT path, nth, form, c, code, CAST(87 + coalesce(sum(length(code)) OVER (PARTITION BY path ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_at
        FROM (SELECT *, concat(CASE form WHEN 0 THEN concat('fun f', nth, '() {{ h', c % 5, '.top', c, '() }}') WHEN 1 THEN concat('fun f', nth, '(k: K', c, ') {{ k.m', c, '() }}') WHEN 2 THEN concat('fun f', nth, '(v: Int) {{ v }}')
            WHEN 3 THEN concat('class S', path, '_', nth, ' : K', c, '() {{ fun g() {{ m', c, '() }} }}') WHEN 4 THEN concat('fun f', nth, '(x: K', c, '.In', c, ') {{}}') WHEN 5 THEN concat('fun f', nth, '() {{ top', c, '() }}')
            ELSE concat('fun f', nth, '() {{ k.missing(); h9.top', c, '() }}') END, chr(10)) AS code
          FROM (SELECT l_orderkey AS path, {_NTH} AS nth, CAST((l_partkey + l_linenumber) % 7 AS INT) AS form, l_suppkey % 25 AS c FROM lineitem) u0) u1""",
    "jar_entries": """
        SELECT concat('lib', p_partkey % 50, '.jar') AS jar, concat('org.g', p_size % 7) AS grp, concat('org/g', p_size % 7, '/q', p_partkey % 3, '/C', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '$In' WHEN 1 THEN '$In$Deep' ELSE '' END, '.class') AS entry FROM part
        UNION ALL SELECT concat('deep', p_partkey % 20, '.jar'), concat('org.g', p_size % 7, '.q', p_partkey % 3), concat('org/g', p_size % 7, '/q', p_partkey % 3, '/C', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '$In' WHEN 1 THEN '$In$Deep' ELSE '' END, '.class') FROM part WHERE p_partkey % 5 = 0
        UNION ALL SELECT concat('other', p_partkey % 20, '.jar'), 'com.other', concat('org/g', p_size % 7, '/q', p_partkey % 3, '/C', p_partkey, '.class') FROM part WHERE p_partkey % 7 = 0""",
    "import_fqns": "SELECT l_orderkey AS path, concat('org.g', p_size % 7, '.q', p_partkey % 3, '.C', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.In' WHEN 1 THEN '.In.Deep' ELSE '' END, CASE WHEN l_linenumber % 3 = 0 THEN 'X' ELSE '' END) AS fqn FROM lineitem JOIN part ON l_partkey = p_partkey",
    "token_spans": f"SELECT l_orderkey AS path, CAST(2 * {_NTH} + l_partkey % 5 AS BIGINT) AS start_byte, CAST(2 * {_NTH} + l_partkey % 5 + 1 + l_suppkey % 6 AS BIGINT) AS end_byte, CASE l_linenumber % 3 WHEN 0 THEN 'Class' WHEN 1 THEN 'Variable' ELSE 'Keyword' END AS kind, l_returnflag = 'A' AS declaration FROM lineitem",
}

#: Packages that every file imports, in the order of their precedence (fixed values).
DEFAULT_PACKAGES = ["kotlin", "kotlin.annotation", "kotlin.collections", "kotlin.comparisons", "kotlin.io", "kotlin.ranges", "kotlin.sequences", "kotlin.text", "kotlin.jvm", "java.lang"]


def needed(sql: str) -> list[str]:
    """Relations that some SQL reads, those that others need first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in RELATIONS:
            if re.search(rf"\b{name}\b", text) and name not in out:
                visit(RELATIONS[name])
                out.append(name)

    visit(sql)
    return out


def with_relations(sql: str) -> str:
    """DuckDB SQL with the relations it reads as common table expressions."""
    ctes = [f"{name} AS ({RELATIONS[name]})" for name in needed(sql)]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join([*ctes, body[14:].strip()])
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join([*ctes, body[4:].strip()])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation, or a sample table, as a DataFrame."""
    if name not in RELATIONS:
        return table(spark, sf_dir, name)
    sql = RELATIONS[name]
    for t in TABLES:
        if any(re.search(rf"\b{t}\b", RELATIONS[r]) for r in [name, *needed(sql)]):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    for r in needed(sql):
        if r != name:
            load(spark, sf_dir, r).createOrReplaceTempView(r)
    return spark.sql(sql)
