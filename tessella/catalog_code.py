"""Queries of scopes, types, Java, assistance and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import assist, facts, graph, infer, resolve, scopes, types
from .registry import query
from .sources import builds, files, kotlin, logs
from .streaming import state

_TYPES = ", ".join(f"'{k}'" for k in resolve.TYPE_LIKE)
_NAMES = ", ".join(f"'{k}'" for k in types.ELEMENT_OPERATIONS)
_WALK = "walk(src, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT w.src, e.sup, w.depth + 1 FROM walk w JOIN type_edges e ON e.sub = w.node WHERE w.depth < 32)"
_CLOSE = f"WITH RECURSIVE {_WALK}, near AS (SELECT DISTINCT src, node FROM walk)"


def _kind_ok(kind: str = "kind") -> str:
    use = lambda u, ks: f"(use_kind = '{u}' AND {kind} IN ({', '.join(repr(k) for k in ks)}))"
    return f"(use_kind = 'MemberSelector' OR {use('Type', resolve.TYPE_LIKE)} OR {use('Call', resolve.CALLABLE_LIKE)} OR {use('Value', resolve.VALUE_LIKE)})"


# ---- scopes and definitions


@query("r2_local_scopes", f"""WITH c AS (SELECT u.path, u.pre, a.depth, a.kind AS sk, d.decl_start, d.prio FROM named_nodes u JOIN nodes a ON a.path = u.path AND a.pre < u.pre AND a.post > u.post JOIN scope_decls d ON d.path = a.path AND d.scope = a.pre AND d.name = u.name
  WHERE u.kind = 'identifier' AND ((a.kind = 'block' AND d.decl_start < u.pre) OR a.kind = 'function' OR (a.kind IN ('class', 'file') AND {_kind_ok('d.kind')})))
  SELECT path, pre, decl_start FROM (SELECT *, row_number() OVER (PARTITION BY path, pre ORDER BY depth DESC, CASE sk WHEN 'block' THEN -decl_start WHEN 'function' THEN prio ELSE 0 END, decl_start) AS r FROM c) WHERE r = 1""")
def _(t):
    return scopes.local_scopes(t("named_nodes"), t("scope_decls"))


@query("t9_receiver_stack", "SELECT d.path, d.pre, coalesce(string_agg(concat('', a.ref), ',' ORDER BY a.depth DESC) FILTER (a.kind IN ('function', 'class')), '') AS receivers FROM nodes d LEFT JOIN nodes a ON a.path = d.path AND a.pre < d.pre AND a.post > d.post WHERE d.kind = 'identifier' GROUP BY d.path, d.pre")
def _(t):
    return scopes.receiver_stack(t("nodes"), ["function", "class"])


_CASTS = """casts AS (SELECT path, start_byte, type FROM (SELECT u.path, u.pre AS start_byte, g.type, row_number() OVER (PARTITION BY u.path, u.pre ORDER BY g.lo DESC, g.type DESC) AS r FROM named_nodes u JOIN guards g ON g.path = u.path AND g.name = u.name AND g.lo < u.pre AND u.pre < g.hi
  WHERE u.kind = 'identifier' AND NOT EXISTS (SELECT 1 FROM assigned a WHERE a.path = u.path AND a.name = u.name AND a.place > g.lo AND a.place < u.pre)) WHERE r = 1)"""


def _casts(t):
    uses = t("named_nodes").where("kind = 'identifier'").select("path", F.col("pre").alias("start_byte"), "name")
    return scopes.smart_casts(uses, t("guards"), t("assigned"))


@query("t7_smart_casts", f"WITH {_CASTS} SELECT * FROM casts")
def _(t):
    return _casts(t)


@query("f18_identifier_roles", f"""SELECT n.path, n.node_id, coalesce(p.kind IN ({', '.join(repr(k) for k in scopes.DECLARING)}) OR (p.kind IN ({', '.join(repr(k) for k in scopes.DECLARING_BY_NAME)}) AND coalesce(n.field, '') = 'name') OR (p.kind = 'type_alias' AND coalesce(n.field, '') = 'type'), false) AS declares,
    n.text IN ('true', 'false', 'null', 'break', 'continue') OR (p.kind = 'value_argument' AND n.named_ord = 0 AND (SELECT count(*) FROM syntax s WHERE s.path = n.path AND s.parent_id = 0) >= 2) AS no_reference
  FROM syntax n JOIN syntax p ON p.path = n.path AND p.node_id = n.parent_id WHERE n.kind = 'identifier'""")
def _(t):
    return scopes.identifier_roles(t("syntax"))


@query("f16_import_paths", "SELECT DISTINCT i.path, i.ord, s.sid FROM import_paths i JOIN symbols s ON s.name = i.simple WHERE NOT i.wildcard AND CASE WHEN s.container IS NULL THEN i.prefix = s.package ELSE i.prefix IN (concat(s.package, '.', s.container), concat(s.package, '.', s.container, '.Companion')) END")
def _(t):
    return scopes.import_path_matches(t("import_paths"), t("symbols"))


def _sees(uses: str, symbols: str) -> str:
    return f"""SELECT DISTINCT u.path, u.name, s.sid FROM {uses} u JOIN {symbols} s ON s.name = u.name JOIN file_ctx f ON f.path = u.path
      WHERE (s.package = f.package AND s.package <> '') OR s.package = 'java.lang' OR EXISTS (SELECT 1 FROM java_imports i WHERE i.path = u.path AND ((i.wildcard AND i.prefix = s.package) OR (NOT i.wildcard AND i.simple = s.name AND (i.prefix = s.package OR (s.container IS NOT NULL AND i.prefix = concat(s.package, '.', s.container))))))"""


_JAVA = f"""every AS (SELECT sid, name, package, container, kind FROM java_types UNION ALL SELECT sid, name, package, container, kind FROM java_members),
  near AS (SELECT u.path, u.use_id, max(l.decl_start) AS sid FROM java_uses u JOIN java_locals l ON l.path = u.path AND l.name = u.name AND l.decl_start < u.use_id WHERE l.linenumber % 3 = 0 GROUP BY u.path, u.use_id),
  rest AS (SELECT u.* FROM java_uses u LEFT JOIN near n ON n.path = u.path AND n.use_id = u.use_id WHERE n.path IS NULL),
  asked AS (SELECT DISTINCT path, owner AS name FROM rest WHERE receiver IS NULL AND owner IS NOT NULL), owners AS ({_sees('asked', 'java_types')}),
  bare AS (SELECT DISTINCT path, name FROM rest WHERE receiver IS NULL AND owner IS NULL), seen AS ({_sees('bare', 'every')}),
  defined AS (SELECT path, use_id, 'local' AS stage, sid FROM near
    UNION SELECT u.path, u.use_id, 'receiver', m.sid FROM rest u JOIN java_members m ON m.name = u.name AND m.container = u.receiver
    UNION SELECT u.path, u.use_id, 'owner', m.sid FROM rest u JOIN owners o ON o.path = u.path AND o.name = u.owner JOIN java_types y ON y.sid = o.sid JOIN java_members m ON m.name = u.name AND m.container = u.owner AND m.package = y.package WHERE u.receiver IS NULL
    UNION SELECT u.path, u.use_id, 'visible', s.sid FROM rest u JOIN seen s ON s.path = u.path AND s.name = u.name JOIN every e ON e.sid = s.sid WHERE u.receiver IS NULL AND u.owner IS NULL AND (NOT u.in_type OR e.kind IN ({_TYPES})))""".replace("l.linenumber", "l.l_linenumber")


def _java(t):
    local = t("java_locals").where("l_linenumber % 3 = 0").drop("l_linenumber")
    return t("java_uses"), local, t("file_ctx"), t("java_imports"), t("java_types"), t("java_members")


@query("f14_java_visibility", f"WITH every AS (SELECT sid, name, package, container FROM java_members) {_sees('java_uses', 'every')}")
def _(t):
    return scopes.visible_in_java(t("java_uses"), t("file_ctx"), t("java_imports"), t("java_members"))


@query("r15_java_definitions", f"WITH {_JAVA} SELECT * FROM defined")
def _(t):
    return scopes.java_definitions(*_java(t))


@query("d9_java_unresolved", f"""WITH {_JAVA} SELECT u.path, u.use_id, u.name FROM java_uses u JOIN java_files f ON f.path = u.path WHERE u.is_call AND u.receiver IS NULL AND u.owner IS NULL AND NOT f.static_imports AND NOT f.supertypes
  AND NOT (u.name = 'getClass' OR (f.is_enum AND u.name IN ('values', 'valueOf', 'name', 'ordinal'))) AND NOT EXISTS (SELECT 1 FROM defined d WHERE d.path = u.path AND d.use_id = u.use_id)""")
def _(t):
    uses, *rest = _java(t)
    uses = uses.where("is_call and receiver is null and owner is null")
    return scopes.java_unresolved(uses, *scopes.java_groups(uses, *rest), t("java_files"))


_ACCEPTED = ", ".join(f"('{a}', '{p}')" for a, p in infer.ACCEPTED)


@query("d10_java_call_shapes", f"""WITH {_JAVA}, accepted(arg, param) AS (VALUES {_ACCEPTED}, ('int', 'Object'), ('long', 'Object'), ('char', 'Object'), ('String', 'Object')),
  c AS (SELECT u.path, u.use_id, u.n_args, u.arg_type, m.tier = 'Volatile' AND NOT m.has_vararg AND m.max_arity IS NOT NULL AND m.min_arity IS NOT NULL AS known, coalesce(u.n_args BETWEEN m.min_arity AND m.max_arity, false) AS fits,
    coalesce(u.n_args BETWEEN m.min_arity AND m.max_arity, false) AND (u.n_args = 0 OR coalesce(u.arg_type = m.param, false) OR EXISTS (SELECT 1 FROM accepted a WHERE a.arg = u.arg_type AND a.param = m.param)) AS takes
    FROM java_uses u JOIN defined d ON d.path = u.path AND d.use_id = u.use_id AND d.stage <> 'local' JOIN java_members m ON m.sid = d.sid WHERE u.is_call)
  SELECT path, use_id, n_args, CASE WHEN bool_or(fits) THEN arg_type END AS arg_type FROM c GROUP BY path, use_id, n_args, arg_type HAVING bool_and(known) AND NOT bool_or(takes) AND (NOT bool_or(fits) OR arg_type IS NOT NULL OR n_args = 0)""")
def _(t):
    accepted = t("region").sparkSession.createDataFrame([*infer.ACCEPTED, *((a, "Object") for a in ("int", "long", "char", "String"))], "arg string, param string")
    uses, *rest = _java(t)
    calls = uses.where("is_call")
    return scopes.java_call_shapes(calls, scopes.java_groups(calls, *rest)[1], t("java_members"), accepted)


@query("c7_java_completion", f"""WITH asked AS (SELECT path, min(name) AS prefix FROM java_uses GROUP BY path), seen AS (SELECT path, package FROM file_ctx UNION SELECT path, prefix FROM java_imports WHERE wildcard)
  SELECT a.path, s.name AS label, min(s.sid) AS sid FROM asked a JOIN seen USING (path) JOIN java_members s ON s.package = seen.package AND starts_with(s.name, left(a.prefix, 1)) GROUP BY a.path, s.name""")
def _(t):
    asked = t("java_uses").groupBy("path").agg(F.substring(F.min("name"), 1, 1).alias("prefix"))
    return scopes.java_scope_completions(asked, t("file_ctx"), t("java_imports"), t("java_members"))


@query("r14_type_definitions", "SELECT e.path, e.start_byte, s.sid FROM expr_types e JOIN java_types s ON s.name = e.type AND (e.package IS NULL OR e.package = s.package)")
def _(t):
    return scopes.type_definitions(t("expr_types"), t("java_types"))


def _found(t, usages=None):
    from .catalog import DEFAULTS

    return resolve.cross_names(t("usages") if usages is None else usages, t("file_ctx"), t("imports"), t("symbols"), DEFAULTS)


def _cross() -> str:
    from .catalog import _CROSS

    return _CROSS


@query("r1_goto", f"""WITH {_cross()}, decl AS (SELECT path, name, start_byte FROM usages WHERE use_kind = 'Value' AND n_args = 0),
  s AS (SELECT q.path, q.start_byte, 0 AS stage, s.sid AS target FROM qualified_uses q JOIN symbols s ON s.name = q.name AND s.package = q.qualifier AND s.container IS NULL WHERE q.start_byte % 70 = 0 AND {_kind_ok('s.kind')}
    UNION ALL SELECT u.path, u.start_byte, 1, s.sid FROM usages u JOIN symbols s ON s.name = u.name WHERE u.use_kind = 'MemberSelector' AND (SELECT count(*) FROM symbols z WHERE z.name = s.name) = 1
    UNION ALL SELECT u.path, u.start_byte, 2, max(d.start_byte) FROM usages u JOIN decl d ON d.path = u.path AND d.name = u.name AND d.start_byte < u.start_byte GROUP BY u.path, u.start_byte
    UNION ALL SELECT path, start_byte, 3, sid FROM found),
  k AS (SELECT s.*, rank() OVER (PARTITION BY s.path, s.start_byte ORDER BY s.stage) AS r FROM s JOIN usages u ON u.path = s.path AND u.start_byte = s.start_byte WHERE s.stage <= CASE WHEN u.use_kind = 'MemberSelector' THEN 1 ELSE 4 END)
  SELECT DISTINCT path, start_byte, stage, target FROM k WHERE r = 1""")
def _(t):
    u = graph._saved(t("usages").select("path", "start_byte", "name", "use_kind", "n_args"))  # each stage reads it, it is made once
    qualified = infer.qualified(t("qualified_uses").where("start_byte % 70 = 0"), t("symbols")).withColumnRenamed("sid", "target")
    member = resolve.unique_member(u, t("symbols")).withColumnRenamed("sid", "target")
    local = graph.nearest_before(u.select("path", "name", "start_byte"), u.where("use_kind = 'Value' and n_args = 0"), ["path", "name"]).select("path", "start_byte", F.col("decl_start").alias("target"))
    # what the stages before leave open, of the uses that mean symbols alike; those are listed last
    found = _found(t, u)
    cross = found.select("path", F.explode("places").alias("start_byte"), F.struct(*resolve.ALIKE).alias("alike"))
    first = [x.withColumn("alike", F.lit(None).cast(cross.schema["alike"].dataType)) for x in (qualified, member, local)]
    last = cross.withColumn("target", F.lit(None).cast("long"))
    best = scopes.goto(u, [(first[0], None), (first[1], F.col("use_kind") == "MemberSelector"), (first[2], None), (last, None)], ["target", "alike"])
    packed = best.where("stage = 3").groupBy("path", "stage", "alike.name", "alike.package", "alike.kind").agg(F.collect_set("start_byte").alias("places"))
    listed = resolve.with_symbols(packed, t("symbols")).select("path", F.explode("places").alias("start_byte"), "stage", F.col("sid").alias("target"))
    return best.where("stage < 3").select("path", "start_byte", "stage", "target").unionByName(listed)


@query("j3_candidates_by_file", f"WITH {_cross()} SELECT path, string_agg(concat(start_byte, ':', sid), ',' ORDER BY start_byte, sid) AS places FROM (SELECT DISTINCT path, start_byte, sid FROM found) GROUP BY path")
def _(t):
    return scopes.candidates_by_file(_found(t), t("symbols"))


@query("r18_import_seeded", f"""WITH {_cross()}, missing AS (SELECT u.* FROM usages u WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.path = u.path AND f.start_byte = u.start_byte))
  SELECT DISTINCT m.path, m.start_byte, a.coordinate, a.entry FROM missing m JOIN imports i ON i.path = m.path AND NOT i.wildcard AND coalesce(i.alias, i.name) = m.name JOIN archive_names a ON a.fqn = concat(i.package, '.', i.name)""")
def _(t):
    u = graph._saved(t("usages").select("path", "start_byte", "name", "use_kind"))  # read twice, made once
    return scopes.import_seeded(u.select("path", "start_byte", "name"), resolve.used_places(_found(t, u)), t("imports"), t("archive_names"))


@query("h5_implementation_at", f"""WITH {_cross()}, first AS (SELECT path, start_byte, sid AS target FROM (SELECT f.path, f.start_byte, f.sid, row_number() OVER (PARTITION BY f.path, f.start_byte ORDER BY s.path, s.start_byte, s.sid) AS r FROM found f JOIN symbols s USING (sid)) WHERE r = 1),
  impl AS (SELECT a.sid AS target, b.sid AS impl FROM type_edges e JOIN symbols a ON a.sid = e.sup JOIN symbols b ON b.sid = e.sub WHERE a.kind IN ({_TYPES}) AND b.kind IN ({_TYPES})
    UNION SELECT a.sid, b.sid FROM type_edges e JOIN member_decls a ON a.owner = e.sup JOIN member_decls b ON b.owner = e.sub WHERE a.name = b.name AND a.kind = b.kind AND (a.kind = 'Property' OR a.params = b.params))
  SELECT path, start_byte, impl FROM first JOIN impl USING (target)""")
def _(t):
    return scopes.implementation_at(_found(t), t("symbols"), t("type_edges"), t("member_decls"))


# ---- types

_PROPERTIES = "SELECT f.path, f.start_byte, min(s.value_type) AS type FROM found f JOIN symbols s USING (sid) WHERE s.kind = 'Property' AND s.value_type IS NOT NULL GROUP BY f.path, f.start_byte"


@query("t1_expression_types", """WITH leaf AS (SELECT e.path, e.node_id, CASE e.kind WHEN 'string_literal' THEN 'String' WHEN 'character_literal' THEN 'Char' WHEN 'number_literal' THEN CASE WHEN e.text LIKE '%L' THEN 'Long' ELSE 'Int' END WHEN 'float_literal' THEN CASE WHEN e.text LIKE '%f' THEN 'Float' ELSE 'Double' END ELSE CASE WHEN e.kind = 'identifier' AND e.text = 'true' THEN 'Boolean' ELSE b.type END END AS type,
    CASE WHEN e.kind = 'this_expression' OR (e.kind = 'identifier' AND e.text <> 'true') THEN coalesce(b.nullable, false) ELSE false END AS nullable FROM exprs e LEFT JOIN bound_names b ON b.path = e.path AND b.name = e.text WHERE e.height = 0),
  one AS (SELECT e.path, e.node_id, CASE WHEN e.kind = 'as_expression' THEN e.text WHEN e.kind IN ('parenthesized_expression', 'elvis_expression', 'unary_expression') THEN c.type WHEN e.kind = 'navigation_expression' THEN m.type END AS type, CASE WHEN e.kind = 'parenthesized_expression' THEN coalesce(c.nullable, false) WHEN e.kind = 'navigation_expression' THEN coalesce(m.nullable, false) ELSE false END AS nullable
    FROM exprs e JOIN leaf c ON c.path = e.path AND c.node_id = e.child_id LEFT JOIN properties_of m ON m.owner = c.type AND m.name = e.text WHERE e.height = 1),
  two AS (SELECT e.path, e.node_id, CASE WHEN e.kind = 'as_expression' THEN e.text WHEN e.kind IN ('parenthesized_expression', 'elvis_expression', 'unary_expression') THEN c.type WHEN e.kind = 'navigation_expression' THEN m.type END AS type, CASE WHEN e.kind = 'parenthesized_expression' THEN coalesce(c.nullable, false) WHEN e.kind = 'navigation_expression' THEN coalesce(m.nullable, false) ELSE false END AS nullable
    FROM exprs e JOIN one c ON c.path = e.path AND c.node_id = e.child_id LEFT JOIN properties_of m ON m.owner = c.type AND m.name = e.text WHERE e.height = 2)
  SELECT * FROM leaf WHERE type IS NOT NULL UNION ALL SELECT * FROM one WHERE type IS NOT NULL UNION ALL SELECT * FROM two WHERE type IS NOT NULL""")
def _(t):
    return types.expression_types(t("exprs"), t("bound_names"), t("properties_of"))


@query("t2_identifier_types", f"""WITH {_cross()}, u2 AS (SELECT path, start_byte, CASE WHEN start_byte % 110 = 0 THEN 'true' ELSE name END AS name FROM usages WHERE use_kind = 'Value'), local AS (SELECT DISTINCT path, name, concat('L', path % 5) AS type FROM usages WHERE n_args = 0),
  p AS ({_PROPERTIES}), s AS (SELECT path, start_byte, 0 AS o, 'boolean' AS source, 'Boolean' AS type FROM u2 WHERE name IN ('true', 'false')
    UNION ALL SELECT u2.path, u2.start_byte, 1, 'cast', g.type FROM u2 JOIN guards g ON g.path = u2.path AND g.lo = u2.start_byte * 100
    UNION ALL SELECT u2.path, u2.start_byte, 2, 'local', l.type FROM u2 JOIN local l ON l.path = u2.path AND l.name = u2.name
    UNION ALL SELECT u2.path, u2.start_byte, 3, 'type', u2.name FROM u2 WHERE EXISTS (SELECT 1 FROM symbols z WHERE z.name = u2.name AND z.kind IN ({_TYPES}))
    UNION ALL SELECT u2.path, u2.start_byte, 4, 'property', p.type FROM u2 JOIN p ON p.path = u2.path AND p.start_byte = u2.start_byte)
  SELECT path, start_byte, type, source FROM (SELECT *, row_number() OVER (PARTITION BY path, start_byte ORDER BY o, source, type) AS r FROM s) WHERE r = 1""")
def _(t):
    u = t("usages").where("use_kind = 'Value'").select("path", "start_byte", F.when(F.col("start_byte") % 110 == 0, "true").otherwise(F.col("name")).alias("name"))
    local = t("usages").where("n_args = 0").select("path", "name", F.concat(F.lit("L"), F.col("path") % 5).alias("type")).distinct()
    cast = t("guards").where("lo % 100 = 0").select("path", (F.col("lo") / 100).cast("bigint").alias("start_byte"), "type")
    typed = t("symbols").where("kind = 'Property' and value_type is not null").groupBy(*resolve.ALIKE).agg(F.min("value_type").alias("type"))
    p = resolve.by_symbol(_found(t), typed).groupBy("path", "start_byte").agg(F.min("type").alias("type"))
    return types.identifier_types(u, cast, local, t("symbols"), p)


@query("t3_call_types", f"""WITH {_cross()}, c AS (SELECT path, start_byte, name, n_args FROM usages WHERE use_kind = 'Call'), made AS (SELECT path, start_byte, name AS type FROM c WHERE EXISTS (SELECT 1 FROM symbols z WHERE z.name = c.name AND z.kind IN ({_TYPES}))),
  free AS (SELECT c.path, c.start_byte, s.value_type AS type, s.max_arity = c.n_args AS fits FROM c JOIN found f ON f.path = c.path AND f.start_byte = c.start_byte JOIN symbols s ON s.sid = f.sid AND s.kind = 'Function' AND s.value_type IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.path = c.path AND m.start_byte = c.start_byte)),
  n AS (SELECT *, bool_or(fits) OVER (PARTITION BY path, start_byte) AS any_fit FROM free)
  SELECT * FROM made UNION ALL SELECT path, start_byte, min(type) FROM n WHERE fits OR NOT any_fit GROUP BY path, start_byte HAVING count(DISTINCT type) = 1""")
def _(t):
    return types.call_types(t("usages").where("use_kind = 'Call'"), _found(t), t("symbols"))


@query("t4_member_types", f"""{_CLOSE}, c AS (SELECT DISTINCT k.call_id, k.n_args, m.sid, m.arity, m.extension, m.type FROM member_calls k JOIN near n ON n.src = k.recv JOIN typed_members m ON m.owner = n.node AND m.name = k.name),
  a AS (SELECT *, bool_or(NOT extension) OVER (PARTITION BY call_id) AS own FROM c), b AS (SELECT *, bool_or(arity = n_args) OVER (PARTITION BY call_id) AS any_fit FROM a WHERE NOT own OR NOT extension)
  SELECT call_id, min(type) AS type FROM b WHERE NOT any_fit OR arity = n_args GROUP BY call_id HAVING count(DISTINCT type) = 1""")
def _(t):
    supers = graph.closure_of_all(t("part").select(F.col("p_partkey").alias("src")), t("type_edges"), 32)
    return types.member_types(t("member_calls"), supers, t("typed_members"))


@query("t6_unification", """SELECT id, CASE WHEN formal = 'T' THEN CASE WHEN actual = 'T' THEN '' ELSE concat('T=', actual) END
    WHEN formal = 'List<T>' AND starts_with(actual, 'List<') THEN concat('T=', regexp_extract(actual, '<(.*)>', 1))
    WHEN formal = 'Map<T, T>' AND starts_with(actual, 'Map<') THEN concat('T=', regexp_extract(actual, '<([^,]*),', 1))
    WHEN formal = 'Map<T, List<U>>' AND starts_with(actual, 'Map<') THEN concat('T=', regexp_extract(actual, '<([^,]*),', 1), CASE WHEN contains(actual, 'List<') THEN ';U=J' ELSE '' END)
    ELSE '' END AS bound FROM formals""")
def _(t):
    found = types.unified(F.col("formal"), F.col("actual"), F.array(F.lit("T"), F.lit("U")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(found)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return t("formals").select("id", shown.alias("bound"))


@query("t8_lambda_parameters", f"SELECT lambda_id, CASE WHEN operation IN ('let', 'also') THEN receiver ELSE listed END AS type FROM lambdas WHERE operation IN ('let', 'also') OR (operation IN ({_NAMES}) AND listed <> '' AND NOT contains(listed, ','))")
def _(t):
    args = F.filter(F.split("listed", ","), lambda x: x != "")
    return types.lambda_parameters(t("lambdas").withColumn("args", args))


@query("t12_memoized", "SELECT e.path, e.start_byte, e.start_byte + 5 AS end_byte, 'call' AS kind, o.o_custkey % 2 AS revision, CASE WHEN k.path IS NULL THEN concat('new', e.start_byte) ELSE k.type END AS type, k.path IS NOT NULL AS cached FROM (SELECT DISTINCT path, start_byte FROM expr_types) e JOIN orders o ON o.o_orderkey = e.path LEFT JOIN cached_types k ON k.path = e.path AND k.start_byte = e.start_byte AND k.revision = o.o_custkey % 2")
def _(t):
    asked = t("expr_types").select("path", "start_byte").distinct().join(t("orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 2).alias("revision")), "path")
    asked = asked.withColumn("end_byte", F.col("start_byte") + 5).withColumn("kind", F.lit("call"))
    return types.memoized(asked, t("cached_types"), lambda new: new.withColumn("type", F.concat(F.lit("new"), "start_byte")))


_ARGS = "array(named_struct('name', first_arg, 'nullable', arg_null))"
_LABEL = "concat(type, CASE WHEN n_args > 2 THEN concat('<', CASE WHEN first_arg = '' THEN '_' ELSE concat(first_arg, CASE WHEN arg_null THEN '?' ELSE '' END) END, '>') ELSE '' END, CASE WHEN nullable THEN '?' ELSE '' END)"


def _decls(t):
    none = F.expr(f"filter({_ARGS}, x -> false)")
    return t("typed_decls").withColumn("args", F.when(F.col("n_args") > 2, F.expr(_ARGS)).otherwise(none))


@query("l6_type_labels", f"SELECT path, position, CASE WHEN type IS NULL THEN '_' ELSE {_LABEL} END AS label FROM typed_decls")
def _(t):
    return _decls(t).select("path", "position", types.type_label(F.col("type"), F.col("args"), F.col("nullable")).alias("label"))


@query("e18_inlay_hints", f"SELECT path, position, {_LABEL} AS label FROM typed_decls WHERE NOT annotated AND type IS NOT NULL AND NOT (n_args > 2 AND first_arg = '') AND position >= path * 10 AND position <= path * 10 + 20000")
def _(t):
    return types.inlay_hints(_decls(t), F.col("path") * 10, F.col("path") * 10 + 20000)


# ---- assistance

_OFFSETS = "SELECT conv_id, turn, text, o AS place FROM conversations, LATERAL (SELECT unnest(generate_series(0, length(text), 37)) AS o)"


@query("c1_completion_context", f"""SELECT conv_id, turn, place, CASE WHEN place % 11 = 3 THEN 'None' WHEN place % 13 = 5 OR regexp_matches(ltrim(regexp_extract(substr(text, 1, place), '[^\\n]*$')), '^(import|package) ') THEN 'Import'
    WHEN place % 17 = 7 OR regexp_matches(substr(text, 1, place), '\\.[ \\t]*[\\p{{L}}\\p{{N}}_]*$') THEN 'AfterDot' ELSE 'ScopeName' END AS context FROM ({_OFFSETS})""")
def _(t):
    c = t("conversations").select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(37))).alias("place"))
    p = F.col("place")
    return c.select("conv_id", "turn", "place", assist.completion_context(F.col("text"), p, p % 11 == 3, p % 13 == 5, p % 17 == 7).alias("context"))


@query("c8_signatures", f"""WITH shown AS (SELECT s.name, concat(s.name, '(', coalesce((SELECT string_agg(concat('p', pos + 1, ': ', type), ', ' ORDER BY pos) FROM params p WHERE p.sid = s.sid), ''), ')', CASE WHEN s.value_type IS NOT NULL THEN concat(': ', s.value_type) ELSE '' END) AS label FROM symbols s WHERE s.kind = 'Function' OR s.kind IN ({_TYPES})),
  l AS (SELECT name, string_agg(label, '; ' ORDER BY label) AS labels FROM (SELECT DISTINCT name, label FROM shown) GROUP BY name),
  ch AS (SELECT call_id, i, substr(arguments, i, 1) AS c FROM (SELECT call_id, arguments, unnest(generate_series(1, length(arguments))) AS i FROM open_calls)),
  d AS (SELECT call_id, c, coalesce(sum(CASE WHEN c IN ('(', '[', '{{') THEN 1 WHEN c IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM ch),
  n AS (SELECT call_id, CAST(count(*) FILTER (c = ',' AND depth = 1) AS INT) AS active FROM d GROUP BY call_id)
  SELECT o.call_id, n.active, l.labels FROM open_calls o JOIN l USING (name) JOIN n USING (call_id)""")
def _(t):
    return assist.signatures(t("open_calls"), t("symbols"), t("params"))


@query("x5_removed_imports", "SELECT file, head + 1 AS start, head + 11 + n AS stop, '' AS new_text FROM import_texts WHERE clean UNION ALL SELECT file, head + 11 + n, length(text), '' FROM import_texts WHERE clean AND file % 3 = 0")
def _(t):
    x = t("import_texts")
    first = x.select("file", (F.col("head") + 1).alias("start"), (F.col("head") + 10 + F.col("n") - 1).alias("stop"))
    second = x.where("file % 3 = 0").select("file", (F.col("head") + 12 + F.col("n") - 1).alias("start"), (F.col("head") + 15 + F.col("n") - 1).alias("stop"))
    return assist.removed_imports(x, first.unionByName(second))


@query("x5_added_imports", "SELECT file, CAST(3 AS INT) AS line, concat('import c.', file % 7, chr(10)) AS new_text FROM import_texts WHERE clean AND file % 5 <> 0")
def _(t):
    x = t("import_texts")
    fqn = F.concat(F.lit("c."), F.col("file") % 7)
    return assist.added_import(x, x.select("file", fqn.alias("fqn"), F.lit(3).alias("line")), x.where("file % 5 = 0").select("file", fqn.alias("fqn")))


@query("x6_body_rewrite", "SELECT file, CASE form WHEN 0 THEN concat('fun f(a: Int = 1): Int { return ', size, ' }') WHEN 1 THEN concat('fun f(): Int = g(', size, ')') END AS text FROM functions")
def _(t):
    return t("functions").select("file", assist.rewritten_body(F.col("text")).alias("text"))


@query("s5_edit_between", "SELECT conv_id, turn, strlen(substr(text, 1, CAST(turn * 7 AS INT))) AS start, strlen(substr(text, 1, CAST(turn * 7 AS INT))) AS old_end, strlen(substr(text, 1, CAST(turn * 7 AS INT))) + 3 AS new_end FROM conversations")
def _(t):
    at = F.least(F.col("turn") * 7, F.length("text")).cast("int")
    new = F.concat(F.substring("text", F.lit(1), at), F.lit("☃"), F.substring(F.col("text"), at + 1, F.length("text")))
    e = t("conversations").select("conv_id", "turn", assist.edit_between(F.col("text"), new).alias("e"))
    return e.select("conv_id", "turn", "e.start", "e.old_end", "e.new_end")


# ---- sources over generated files




@query("s13_module_identities", "SELECT DISTINCT concat('g', p_size) AS grp, concat('a', p_partkey % 100) AS artifact FROM part UNION SELECT concat('h', p_size), 'core' FROM part")
def _(t):
    toml = F.concat(F.lit('[libraries]\na = "g'), "p_size", F.lit(":a"), F.col("p_partkey") % 100, F.lit(':1.0"\nb = { group = "h'), "p_size", F.lit('", name = "core" }\n'))
    return builds.module_identities(t("part").select(F.col("p_partkey").cast("string").alias("path"), toml.alias("text")))


@query("s10_scan_plan", "SELECT user_id AS root, CASE WHEN max(event_id) % 3 = 0 THEN 'cached' ELSE 'parse' END AS plan FROM events GROUP BY user_id")
def _(t):
    roots = t("events").groupBy(F.col("user_id").alias("root")).agg(F.max("event_id").alias("m")).select("root", logs.fingerprint(F.col("root").cast("string"), F.col("m").cast("string")).alias("fingerprint"), "m")
    return files.scan_plan(roots, roots.where("m % 3 = 0").select("fingerprint")).select("root", "plan")


@query("k8_telemetry_classes", "SELECT event_id, row_number() OVER (PARTITION BY root ORDER BY ts, event_id) = 1 AS cold, coalesce(lead(ts) OVER (PARTITION BY root ORDER BY ts, event_id) < ts + to_microseconds(CAST(round(wall_ms * 1000) AS BIGINT) * 60000), false) AS superseded FROM compile_runs")
def _(t):
    return logs.classified(t("compile_runs").withColumn("wall_us", F.round(F.col("wall_ms") * 1000).cast("bigint") * 60000))


@query("k7_ingested", "SELECT coordinate, batch, name, event_id FROM (SELECT *, max(batch) OVER (PARTITION BY coordinate) AS m FROM ingested) WHERE batch = m")
def _(t):
    return state.ingested(t("ingested"), ["coordinate"])
