"""Behaviour rules over order lines: an order is a caller, its line number the position of a call, and
the type of the part the method called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules as rl
from ..session import dealt
from ..rule_catalog import CHECKERS, CREDENTIAL_NAME_WORDS, RULES, SSL_OVERRIDE, SSL_PROCEED
from ..sources.reports import builtin_rules
from .registry import Tables, query, sql_values


def calls(t: Tables) -> DataFrame:
    lines = dealt(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_orderkey")
    parts = t.part.select("p_partkey", "p_name", "p_type")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.floor(F.col("l_orderkey") / 10).cast("long").alias("app_id"),
        F.col("l_orderkey").alias("caller"),
        F.col("l_linenumber").alias("seq"),
        F.lit("P").alias("callee_class"),
        F.col("p_type").alias("callee_method"),
        F.lit("()V").alias("descriptor"),
        F.array(F.col("p_name"), F.col("l_quantity").cast("int").cast("string")).alias("args"),
        F.array(F.col("l_returnflag")).alias("arg_methods"),
    )


CALLS_CTE = """calls AS (SELECT l_orderkey // 10 AS app_id, l_orderkey AS caller, l_linenumber AS seq, p_type AS method, p_name AS arg0,
    l_quantity::INT AS arg1, l_returnflag AS origin FROM lineitem JOIN part ON l_partkey = p_partkey)"""

PAIRS = [("standard then promo", "STANDARD", "PROMO"), ("small then large", "SMALL", "LARGE"), ("medium twice", "MEDIUM", "MEDIUM")]


def pair_rules(t: Tables) -> DataFrame:
    rows = [
        (crime, ["perm." + first.lower()], [{"class": "P", "method": m, "descriptor": "()V"} for m in (first, second)], float(i), [first.lower()])
        for i, (crime, first, second) in enumerate(PAIRS, 1)
    ]
    return t.spark.createDataFrame(rows, rl.RULE_SCHEMA)


PAIR_CTE = f"""{CALLS_CTE}, r(crime, a, b, score) AS (VALUES {sql_values([(c, a, b, float(i)) for i, (c, a, b) in enumerate(PAIRS, 1)])}),
    found AS (SELECT crime, app_id, caller, min(CASE WHEN method = a THEN seq END) AS first_seq, max(CASE WHEN method = b THEN seq END) AS second_seq,
      max(score)::DOUBLE AS score FROM calls JOIN r ON method = a OR method = b GROUP BY 1, 2, 3
      HAVING min(CASE WHEN method = a THEN seq END) IS NOT NULL AND max(CASE WHEN method = b THEN seq END) IS NOT NULL)"""


@query("behaviour_pairs", f"WITH {PAIR_CTE} SELECT *, first_seq < second_seq AS in_order FROM found")
def behaviour_pairs(t: Tables) -> DataFrame:
    return rl.behaviours(calls(t), pair_rules(t))


@query(
    "behaviour_summary",
    f"""WITH {PAIR_CTE} SELECT crime, app_id, count(*) AS callers, count(*) FILTER (first_seq < second_seq) AS ordered_callers,
        max(score) AS score, CASE crime WHEN 'standard then promo' THEN 'standard' WHEN 'small then large' THEN 'small' ELSE 'medium' END AS label FROM found GROUP BY 1, 2""",
)
def behaviour_summary(t: Tables) -> DataFrame:
    rules = pair_rules(t)
    summary = rl.rule_summary(rl.behaviours(calls(t), rules), rules)
    return summary.withColumn("label", F.array_join("label", ","))


@query(
    "behaviour_catalogue",
    """
    WITH c AS (SELECT l_orderkey // 10 AS app_id, l_orderkey AS caller, l_linenumber AS seq, p_brand AS method FROM lineitem JOIN part ON l_partkey = p_partkey),
    brands AS (SELECT DISTINCT p_brand FROM part),
    r AS (SELECT a.p_brand || ' then ' || b.p_brand AS crime, a.p_brand AS a, b.p_brand AS b FROM brands a, brands b WHERE a.p_brand <> b.p_brand),
    f AS (SELECT app_id, caller, method, min(seq) AS first_seq, max(seq) AS last_seq FROM c GROUP BY 1, 2, 3)
    SELECT crime, x.app_id, x.caller, x.first_seq, y.last_seq AS second_seq, x.first_seq < y.last_seq AS in_order
    FROM f x JOIN f y ON x.caller = y.caller AND x.app_id = y.app_id JOIN r ON x.method = r.a AND y.method = r.b
    """,
)
def behaviour_catalogue(t: Tables) -> DataFrame:
    """A rule for every two brands in this order, some hundreds: rules are a table, joined with the calls."""
    brands = t.part.select(F.col("p_brand").alias("a")).distinct()
    pairs = brands.groupBy().agg(F.array_sort(F.collect_list("a")).alias("all")).select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a <> b")

    def api(column: str):
        return F.struct(F.lit("P").alias("class"), F.col(column).alias("method"), F.lit("()V").alias("descriptor"))

    rules = pairs.select(F.concat("a", F.lit(" then "), "b").alias("crime"), F.array(api("a"), api("b")).alias("api"), F.lit(1.0).alias("score"))
    lines = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    made = lines.select(
        F.floor(F.col("l_orderkey") / 10).cast("long").alias("app_id"), F.col("l_orderkey").alias("caller"), F.col("l_linenumber").alias("seq"),
        F.lit("P").alias("callee_class"), F.col("p_brand").alias("callee_method"), F.lit("()V").alias("descriptor"),
    )
    return rl.behaviours(made, rules).drop("score")


@query(
    "behaviour_permission_gate",
    f"""WITH {PAIR_CTE} SELECT crime, app_id, caller FROM found WHERE (app_id % 2 = 0 AND crime = 'standard then promo')
        OR (app_id % 2 = 1 AND crime = 'small then large')""",
)
def behaviour_permission_gate(t: Tables) -> DataFrame:
    held = F.when(F.col("app_id") % 2 == 0, F.array(F.lit("perm.standard"), F.lit("perm.x"))).otherwise(F.array(F.lit("perm.small")))
    apps = t.lineitem.select(F.floor(F.col("l_orderkey") / 10).cast("long").alias("app_id")).distinct()
    permissions = apps.withColumn("permissions", held)
    return rl.behaviours(calls(t), pair_rules(t), permissions).select("crime", "app_id", "caller")


def call(method: str, **conditions) -> rl.Call:
    return rl.Call("P", method, "()V", **conditions)


def checker_sql(name: str, having: str) -> str:
    return f"SELECT '{name}' AS checker, app_id, caller FROM calls GROUP BY app_id, caller HAVING {having}"


def last(method: str, more: str = "true") -> str:
    return f"max(CASE WHEN method = '{method}' AND {more} THEN seq END)"


def first(method: str) -> str:
    return f"min(CASE WHEN method = '{method}' THEN seq END)"


@query(
    "missing_mitigation",
    f"WITH {CALLS_CTE} " + checker_sql("M1", f"{first('STANDARD')} < {last('PROMO')} AND NOT bool_or(method = 'ECONOMY')"),
)
def missing_mitigation(t: Tables) -> DataFrame:
    return rl.run_checkers(
        calls(t), [rl.Checker("M1", call("PROMO"), first=call("STANDARD"), mitigations=[call("ECONOMY")])]
    )


ARGUMENT_SQL = " UNION ALL ".join(
    [
        checker_sql("A1", f"{last('PROMO', chr(39) + 'x' + chr(39) + ' <> arg0 AND regexp_matches(arg0, ' + chr(39) + '^(red|blue)' + chr(39) + ')')} IS NOT NULL"),
        checker_sql("A2", f"{first('SMALL')} < {last('LARGE', 'arg1 NOT IN (1, 2, 3)')}"),
        checker_sql("A3", f"{last('MEDIUM', 'origin IN (' + chr(39) + 'R' + chr(39) + ')')} IS NOT NULL"),
    ]
)


@query("argument_keyword", f"WITH {CALLS_CTE} {ARGUMENT_SQL}")
def argument_keyword(t: Tables) -> DataFrame:
    return rl.run_checkers(
        calls(t),
        [
            rl.Checker("A1", call("PROMO", arg_pattern="^(red|blue)", arg_position=0)),
            rl.Checker("A2", call("LARGE"), first=call("SMALL"), min_args=2, arg_position=1, arg_lacks="^[123]$"),
            rl.Checker("A3", call("MEDIUM"), arg_method_in=["R"]),
            rl.Checker("A4", call("MEDIUM"), arg_method_in=["R"], enabled=False),
        ],
    )


@query(
    "co_occurrence",
    f"WITH {CALLS_CTE} " + checker_sql("C1", f"{last('PROMO')} IS NOT NULL AND bool_or(method = 'LARGE' AND arg1 > 40)"),
)
def co_occurrence(t: Tables) -> DataFrame:
    large = call("LARGE", arg_position=1, arg_pattern="^(4[1-9]|50)$")
    return rl.run_checkers(calls(t), [rl.Checker("C1", call("PROMO"), needs=[large])])


@query(
    "set_intersection",
    """
    WITH m AS (SELECT l_orderkey, list_sort(list_distinct(list_filter(list(l_returnflag || l_linestatus), lambda x: x IN ('RF', 'AO', 'XX')))) AS common
      FROM lineitem GROUP BY 1)
    SELECT l_orderkey, array_to_string(common, ',') AS common FROM m
    """,
)
def set_intersection(t: Tables) -> DataFrame:
    """Methods found that are allowed. The allowed ones are few, so a flag each replaces gathering a set."""
    allowed = ["AO", "RF", "XX"]
    pair = F.concat("l_returnflag", "l_linestatus")
    flags = t.lineitem.groupBy("l_orderkey").agg(*[F.bool_or(pair == a).alias(a) for a in allowed])
    found = F.array_compact(F.array(*[F.when(F.col(a), F.lit(a)) for a in allowed]))
    common = F.array_intersect(found, F.array(*[F.lit(a) for a in allowed]))
    return flags.select("l_orderkey", F.array_join(common, ",").alias("common"))


@query(
    "callers_of_callers",
    """
    SELECT DISTINCT s_name AS caller FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
    WHERE p_type = 'PROMO' AND p_size > 40 AND regexp_matches(s_name, '[1-7]$')
    """,
)
def callers_of_callers(t: Tables) -> DataFrame:
    named = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("caller"))
    edges = t.lineitem.select("l_suppkey", F.col("l_partkey").alias("callee")).join(named, "l_suppkey").select("caller", "callee")
    flagged = t.part.where("p_type = 'PROMO' AND p_size > 40").select(F.col("p_partkey").alias("callee"))
    return rl.callers_of(edges, flagged, "[1-7]$")


@query(
    "credential_callers",
    """
    SELECT DISTINCT p_name AS caller FROM part WHERE p_type = 'PROMO'
      AND regexp_matches(p_name, 'token|password|account|encrypt|authentication|authorization|id|key')
    """,
)
def credential_callers(t: Tables) -> DataFrame:
    edges = t.part.select(F.col("p_name").alias("caller"), F.col("p_type").alias("callee"))
    flagged = t.part.where("p_type = 'PROMO'").select(F.col("p_type").alias("callee"))
    return rl.callers_of(edges, flagged, "|".join(CREDENTIAL_NAME_WORDS))


@query(
    "class_hierarchy",
    """
    SELECT c_name AS name, n_name AS ancestor, 1 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT c_name, r_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_name, r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
    """,
)
def class_hierarchy(t: Tables) -> DataFrame:
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    tree = customers.select(F.col("c_name").alias("name"), F.col("n_name").alias("extends")).unionByName(
        nations.select(F.col("n_name").alias("name"), F.col("r_name").alias("extends"))
    )
    return rl.ancestors(tree)


@query(
    "enabled_rules",
    f"WITH {CALLS_CTE}, r(crime, a, b) AS (VALUES {sql_values(PAIRS)}) SELECT crime, count(*) AS calls FROM calls JOIN r ON method = a OR method = b GROUP BY 1",
)
def enabled_rules(t: Tables) -> DataFrame:
    """Calls each rule of the catalogue looks at; rules nothing refers to are not enabled."""
    catalogue = pair_rules(t).unionByName(builtin_rules(t.spark))
    apis = rl.rule_apis(catalogue).select("crime", "callee_class", "callee_method", "descriptor").distinct()
    hits = calls(t).join(apis, ["callee_class", "callee_method", "descriptor"])
    return hits.groupBy("crime").agg(F.count("*").alias("calls"))


@query(
    "call_degrees",
    """
    SELECT node, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (
      SELECT 's' || l_suppkey AS node, 1 AS o, 0 AS i FROM lineitem UNION ALL SELECT 'p' || l_partkey, 0, 1 FROM lineitem) e GROUP BY 1
    """,
)
def call_degrees(t: Tables) -> DataFrame:
    edges = t.lineitem.select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("caller"), F.concat(F.lit("p"), F.col("l_partkey")).alias("callee")
    )
    return rl.degrees(edges, "caller", "callee")


@query(
    "xref_rows",
    """
    SELECT conv_id AS app_id, md5(text) AS string_value, 'L' || role || ';' AS class_name, 'm' || turn AS method_name, 'read' AS access FROM conversations
    """,
)
def xref_rows(t: Tables) -> DataFrame:
    users = F.array(F.create_map(F.concat(F.lit("L"), F.col("role"), F.lit(";")), F.concat(F.lit("m"), F.col("turn"))))
    items = t.conversations.select(F.col("conv_id").alias("app_id"), F.md5("text").alias("string_value"), users.alias("users"))
    return rl.reference_rows(items, "string_value", "users", "read")


@query(
    "xref_call_edges",
    """
    SELECT l_suppkey AS app_id, 'O' || l_orderkey || '->m' || l_linenumber AS caller, l_partkey AS seq, 'C' || l_partkey AS callee_class,
      l_returnflag AS callee_method, '()V' AS descriptor FROM lineitem
    """,
)
def xref_call_edges(t: Tables) -> DataFrame:
    target = F.struct(
        F.concat(F.lit("C"), F.col("l_partkey")).alias("class_name"),
        F.col("l_returnflag").alias("method_name"),
        F.lit("()V").alias("descriptor"),
        F.col("l_partkey").alias("offset"),
    )
    method = F.struct(F.concat(F.lit("m"), F.col("l_linenumber")).alias("name"), F.array(target).alias("xref_to"))
    classes = t.lineitem.select(
        F.col("l_suppkey").alias("app_id"), F.concat(F.lit("O"), F.col("l_orderkey")).alias("name"), F.array(method).alias("methods")
    )
    return rl.call_edges(classes)


@query("builtin_checkers")
def builtin_checkers(t: Tables) -> DataFrame:
    """The built-in checkers over calls named after the built-in rules: one order, one caller."""
    targets = [c.target for c in CHECKERS] + [c.first for c in CHECKERS if c.first]
    names = F.array(
        *[
            F.struct(
                F.lit(c.callee_class).alias("callee_class"), F.lit(c.callee_method).alias("callee_method"),
                F.lit(c.descriptor or "()V").alias("descriptor"),
            )
            for c in targets
        ]
    )
    lines = dealt(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"), "l_orderkey")
    rows = lines.select(
        F.floor(F.col("l_orderkey") / 10).cast("long").alias("app_id"),
        F.col("l_orderkey").alias("caller"),
        F.col("l_linenumber").alias("seq"),
        F.element_at(names, (F.col("l_partkey") % len(targets) + 1).cast("int")).alias("_c"),
        F.array(F.lit("this"), F.col("l_returnflag"), F.lit("path"), F.lit("MD5")).alias("args"),
        F.array(F.lit("getIntent")).alias("arg_methods"),
    )
    return rl.run_checkers(rows.select("*", "_c.*").drop("_c"), CHECKERS)


@query(
    "overridden_certificate_checks",
    """
    SELECT DISTINCT 'CWE295' AS checker, l_orderkey AS app_id, 'C' || l_suppkey || '->onReceivedSslError' AS caller FROM lineitem
    WHERE l_returnflag = 'R' AND l_suppkey % 4 < 3
    """,
)
def overridden_certificate_checks(t: Tables) -> DataFrame:
    """A line is a call made in a class named after its supplier; three of four such classes descend from the web client."""
    proceed, override = rl.Call(*SSL_PROCEED), rl.Call(*SSL_OVERRIDE)
    returned = F.col("l_returnflag") == "R"
    own = F.concat(F.lit("C"), "l_suppkey")
    calls = t.lineitem.select(
        F.col("l_orderkey").alias("app_id"), own.alias("caller_class"), F.lit(override.callee_method).alias("caller_method"),
        F.lit(override.descriptor).alias("caller_descriptor"), F.lit(proceed.callee_class).alias("callee_class"),
        F.when(returned, proceed.callee_method).otherwise("cancel").alias("callee_method"), F.lit(proceed.descriptor).alias("descriptor"),
    )
    kind = F.col("l_suppkey") % 4
    base = F.lit(override.callee_class)
    chain = F.array(
        F.struct(own.alias("name"), F.when(kind == 0, base).when(kind == 3, "Object").otherwise(F.concat(own, F.lit("a"))).alias("extends")),
        F.struct(F.concat(own, F.lit("a")).alias("name"), F.when(kind == 1, base).otherwise(F.concat(own, F.lit("b"))).alias("extends")),
        F.struct(F.concat(own, F.lit("b")).alias("name"), base.alias("extends")),
    )
    hierarchy = t.lineitem.select(F.col("l_orderkey").alias("app_id"), F.inline(chain))
    return rl.overridden_certificate_checks(calls, hierarchy, proceed, override)


@query(
    "weak_random_credentials",
    """
    WITH users AS (
      SELECT l_orderkey FROM lineitem GROUP BY 1
      HAVING min(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) < max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END))
    SELECT DISTINCT 'CWE338' AS checker, o_custkey AS app_id, 'make_token_' || o_orderkey AS caller FROM orders JOIN users ON o_orderkey = l_orderkey
    WHERE o_orderpriority = '1-URGENT'
    """,
)
def weak_random_credentials(t: Tables) -> DataFrame:
    """An order is a method whose lines are its calls; another method, named by priority, calls it."""
    _, first, second = RULES["useMethodOfPRNG"]
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("app_id"), "o_orderpriority")
    method = F.concat(F.lit("m"), "o_orderkey")
    nothing = [F.array().cast("array<string>").alias(c) for c in ("args", "arg_methods")]
    inner = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    made = F.when(F.col("l_returnflag") == "A", first[1]).when(F.col("l_returnflag") == "R", second[1]).otherwise("other")
    spelled = F.when(F.col("l_returnflag") == "A", first[2]).otherwise(second[2])
    calls = inner.select(
        "app_id", method.alias("caller"), made.alias("callee"), F.col("l_linenumber").cast("long").alias("seq"), F.lit(first[0]).alias("callee_class"),
        made.alias("callee_method"), spelled.alias("descriptor"), *nothing,
    )
    name = F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", "make_token_").otherwise("run_"), "o_orderkey")
    outer = orders.select(
        "app_id", name.alias("caller"), method.alias("callee"), F.lit(0).cast("long").alias("seq"), F.lit("C").alias("callee_class"),
        method.alias("callee_method"), F.lit("()V").alias("descriptor"), *nothing,
    )
    return rl.weak_random_credentials(calls.unionByName(outer), rl.Call(*first), rl.Call(*second), CREDENTIAL_NAME_WORDS)
