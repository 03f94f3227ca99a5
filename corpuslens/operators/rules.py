"""Behaviour rules and checkers over call tables.

The call table is ``calls(app_id, caller, seq, callee_class, callee_method, descriptor,
args array<string>, arg_methods array<string>)``. Everything about one caller is decided by one
aggregation with conditions, so no pairs of calls are ever built: a rule needs the first position of
its first call and the last position of its second call, and flags say what else occurs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import unfold
from ..session import stored

RULE_SCHEMA = (
    "crime string, permission array<string>, "
    "api array<struct<class:string,method:string,descriptor:string>>, score double, label array<string>"
)


# --- rule catalogue ------------------------------------------------------------------------


def rule_apis(rules: DataFrame) -> DataFrame:
    """One row per rule and role: the two calls a rule looks for. The key of a rule is ``crime``."""
    return rules.select("crime", "score", F.posexplode("api").alias("role", "_api")).select(
        "crime",
        "score",
        "role",
        F.col("_api.class").alias("callee_class"),
        F.col("_api.method").alias("callee_method"),
        F.col("_api.descriptor").alias("descriptor"),
    )


def _rule_pairs(rules: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """The calls rules look for, numbered; per rule the numbers of its first and second call; whether a rule has several of these.

    They are stored, so that Spark knows how small they are before it joins the calls with them.
    """
    keys = ["callee_class", "callee_method", "descriptor"]
    roles = rule_apis(rules).where(F.col("role") < 2)
    apis = stored(roles.select(*keys).distinct().na.drop().withColumn("api", F.monotonically_increasing_id()), "rule-calls")
    numbered = roles.join(apis, keys)
    firsts = numbered.where("role = 0").select("crime", F.col("api").alias("first_api")).distinct()
    seconds = numbered.where("role = 1").select("crime", F.col("api").alias("second_api")).distinct()
    scores = roles.groupBy("crime").agg(F.max("score").alias("score"))
    pairs = stored(firsts.join(seconds, "crime").join(scores, "crime"), "rule-pairs")
    return apis, pairs, not pairs.groupBy("crime").count().where("count > 1").isEmpty()


def behaviours(calls: DataFrame, rules: DataFrame, app_permissions: DataFrame | None = None) -> DataFrame:
    """Rules whose two calls occur in one caller.

    ``in_order`` says whether the first call comes before a second one. With
    ``app_permissions(app_id, permissions)`` a rule counts only where the app has all it asks for.

    Calls shrink to one row per caller and known method before rules come in. A caller's methods then meet the rules of each
    first one where they are, so what is shuffled grows with the calls, however many rules there are.
    """
    apis, pairs, several = _rule_pairs(rules)
    hits = calls.join(apis, ["callee_class", "callee_method", "descriptor"])
    per_api = hits.groupBy("app_id", "caller", "api").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    per_caller = per_api.groupBy("app_id", "caller").agg(F.collect_list(F.struct("api", "first_seq", "last_seq")).alias("made"))
    by_first = per_caller.select(
        "app_id", "caller", F.col("made.api").alias("apis"), F.col("made.last_seq").alias("lasts"), F.explode("made").alias("_first")
    ).select("app_id", "caller", "apis", "lasts", F.col("_first.api").alias("first_api"), F.col("_first.first_seq").alias("first_seq"))
    place = F.array_position("apis", F.col("second_api"))
    found = (
        by_first.join(pairs, "first_api")
        .where(place > 0)
        .select("crime", "app_id", "caller", "first_seq", F.get("lasts", (place - 1).cast("int")).alias("second_seq"), "score")
        .where(F.col("first_seq").isNotNull() & F.col("second_seq").isNotNull())
    )
    if several:
        found = found.groupBy("crime", "app_id", "caller").agg(
            F.min("first_seq").alias("first_seq"), F.max("second_seq").alias("second_seq"), F.max("score").alias("score")
        )
    found = found.withColumn("in_order", F.col("first_seq") < F.col("second_seq"))
    if app_permissions is None:
        return found
    gated = found.join(rules.select("crime", "permission"), "crime").join(app_permissions, "app_id", "left")
    held = F.coalesce(F.col("permissions"), F.array().cast("array<string>"))
    asked = F.coalesce(F.col("permission"), F.array().cast("array<string>"))
    return gated.where(F.size(F.array_except(asked, held)) == 0).drop("permission", "permissions")


def rule_summary(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Occurrences per rule and app, with the labels of the rule."""
    counted = found.groupBy("crime", "app_id").agg(
        F.count("*").alias("callers"), F.count_if("in_order").alias("ordered_callers"), F.max("score").alias("score")
    )
    return counted.join(rules.select("crime", "label"), "crime")


# --- checkers ------------------------------------------------------------------------------


def _arguments(position: int | None) -> Column:
    return F.col("args") if position is None else F.array(F.get(F.col("args"), F.lit(position)))


@dataclass(frozen=True)
class Call:
    """A call to look for. An empty class stands for any class.

    With ``arg_pattern`` an argument has to match it (the one at ``arg_position``, if given).
    """

    callee_class: str
    callee_method: str
    descriptor: str | None = None
    arg_pattern: str | None = None
    arg_position: int | None = None

    def condition(self) -> Column:
        hit = F.col("callee_method") == self.callee_method
        if self.callee_class:
            hit = hit & (F.col("callee_class") == self.callee_class)
        if self.descriptor is not None:
            hit = hit & (F.col("descriptor") == self.descriptor.replace(" ", ""))
        if self.arg_pattern is not None:
            hit = hit & F.exists(_arguments(self.arg_position), lambda a: a.rlike(self.arg_pattern))
        return hit


@dataclass(frozen=True)
class Checker:
    """What makes a caller suspicious.

    The caller makes the ``target`` call (after ``first``, if given) with arguments that meet the
    ``arg_*`` conditions, makes one of ``needs``, and makes none of ``mitigations``.
    """

    name: str
    target: Call
    first: Call | None = None
    needs: Sequence[Call] = ()
    mitigations: Sequence[Call] = ()
    min_args: int = 0
    arg_lacks: str | None = None  # no argument of the target matches this pattern
    arg_position: int | None = None  # of the argument looked at
    arg_method_in: Sequence[str] = ()  # an argument comes from one of these methods
    arg_method_not_in: Sequence[str] = ()  # no argument comes from one of these
    arg_methods_only: Sequence[str] = ()  # arguments come from these methods only
    excused_by: Sequence[str] = ()  # an argument went through one of these methods ...
    excuse_void: str | None = None  # ... unless an argument matches this pattern
    enabled: bool = True

    def target_condition(self) -> Column:
        hit = self.target.condition()
        if self.min_args:
            hit = hit & (F.size("args") >= self.min_args)
        if self.arg_lacks is not None:
            found = F.exists(_arguments(self.arg_position), lambda a: a.rlike(self.arg_lacks))
            hit = hit & ~F.coalesce(found, F.lit(False))
        methods = F.col("arg_methods")
        if self.arg_method_in:
            hit = hit & F.arrays_overlap(methods, F.array(*[F.lit(m) for m in self.arg_method_in]))
        if self.arg_method_not_in:
            hit = hit & ~F.arrays_overlap(methods, F.array(*[F.lit(m) for m in self.arg_method_not_in]))
        if self.arg_methods_only:
            allowed = F.array(*[F.lit(m) for m in self.arg_methods_only])
            hit = hit & (F.size(F.array_except(methods, allowed)) == 0)
        if self.excused_by:
            excused = F.arrays_overlap(methods, F.array(*[F.lit(m) for m in self.excused_by]))
            if self.excuse_void is not None:
                excused = excused & ~F.exists("args", lambda a: a.rlike(self.excuse_void))
            hit = hit & ~excused
        return hit

    def calls(self) -> list[Call]:
        return [self.target, *([self.first] if self.first else []), *self.needs, *self.mitigations]


def _any_of(calls: Sequence[Call]) -> Column:
    return reduce(or_, [c.condition() for c in calls], F.lit(False))


def run_checkers(calls: DataFrame, checkers: Sequence[Checker]) -> DataFrame:
    """Findings ``(checker, app_id, caller)`` of all enabled checkers, from one shuffle of the calls.

    Methods no checker knows are dropped at the scan. Per caller the calls are combined into a few
    positions and flags per checker, before the shuffle as well as after it. Blanks in descriptors
    do not count.
    """
    active = [c for c in checkers if c.enabled]
    if not active:
        raise ValueError("no checker is enabled")
    methods = sorted({call.callee_method for c in active for call in c.calls()})
    relevant = calls.where(F.col("callee_method").isin(methods)).withColumn(
        "descriptor", F.replace(F.col("descriptor"), F.lit(" "), F.lit(""))
    )
    seq = F.col("seq")
    measures = []
    for i, c in enumerate(active):
        measures.append(F.max(F.when(c.target_condition(), seq)).alias(f"target_{i}"))
        if c.first:
            measures.append(F.min(F.when(c.first.condition(), seq)).alias(f"first_{i}"))
        if c.needs:
            measures.append(F.bool_or(_any_of(c.needs)).alias(f"needs_{i}"))
        if c.mitigations:
            measures.append(F.bool_or(_any_of(c.mitigations)).alias(f"mitigated_{i}"))
    per_caller = relevant.groupBy("app_id", "caller").agg(*measures)

    verdicts = []
    for i, c in enumerate(active):
        hit = F.col(f"target_{i}").isNotNull()
        if c.first:
            hit = hit & (F.col(f"first_{i}") < F.col(f"target_{i}"))
        if c.needs:
            hit = hit & F.col(f"needs_{i}")
        if c.mitigations:
            hit = hit & ~F.col(f"mitigated_{i}")
        verdicts.append(F.when(hit, F.lit(c.name)))
    found = F.array_distinct(F.array_compact(F.array(*verdicts)))
    return unfold(per_caller, ["app_id", "caller"], found, "checker").select("checker", "app_id", "caller")


# --- graph facts ---------------------------------------------------------------------------


def callers_of(edges: DataFrame, flagged: DataFrame, name_pattern: str) -> DataFrame:
    """Callers, one hop up, of flagged methods whose name matches: ``edges(caller, callee)``, ``flagged(callee)``."""
    return (
        edges.where(F.col("caller").rlike(name_pattern))
        .join(flagged.select("callee").distinct(), "callee", "left_semi")
        .select("caller")
        .distinct()
    )


def ancestors(hierarchy: DataFrame, within: Sequence[str] = (), of: DataFrame | None = None, until: str | None = None) -> DataFrame:
    """All superclasses of each class from ``hierarchy(name, extends)``, with the smallest number of steps to them.

    Each level is one join of the classes reached last with the table, stored before the next one, until
    nothing new is reached. In a cycle a class is an ancestor of itself, once. Classes that differ in the columns ``within`` have
    nothing to do with each other. Where only some classes are asked for, ``of(name)`` names them, and a class that is
    looked for, ``until``, is not followed beyond.
    """
    known = hierarchy.where(F.col("extends").isNotNull()).select(*within, "name", "extends")
    step = known.select(*within, F.col("name").alias("ancestor"), F.col("extends").alias("_next"))
    start = known if of is None else known.join(of.select(*within, "name").distinct(), [*within, "name"], "left_semi")
    level = stored(start.select(*within, "name", F.col("extends").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "ancestors")
    reached, depth = level, 1
    while True:
        last = level if until is None else level.where(F.col("ancestor") != until)
        if last.isEmpty():
            return reached
        depth += 1
        level = stored(
            last.join(step, [*within, "ancestor"])
            .select(*within, "name", F.col("_next").alias("ancestor"), F.lit(depth).alias("depth"))
            .distinct()
            .join(reached.select(*within, "name", "ancestor"), [*within, "name", "ancestor"], "left_anti"),
            "ancestors",
        )
        reached = reached.unionByName(level)


def overridden_certificate_checks(calls: DataFrame, hierarchy: DataFrame, proceed: Call, override: Call) -> DataFrame:
    """Findings ``(checker, app_id, caller)`` of handlers that go on after a certificate error (CWE295).

    A caller that makes the ``proceed`` call counts if it is the ``override`` method and its class descends
    from the override's class: ``calls(app_id, caller_class, caller_method, caller_descriptor, callee_class,
    callee_method, descriptor)``, ``hierarchy(app_id, name, extends)``. Classes of an app are looked up in that app only, and
    only classes of such callers are followed.
    """
    spelled = {c: F.replace(F.col(c), F.lit(" "), F.lit("")) for c in ("descriptor", "caller_descriptor")}
    callers = stored(
        calls.withColumns(spelled)
        .where(proceed.condition() & (F.col("caller_method") == override.callee_method))
        .where(F.col("caller_descriptor") == override.descriptor.replace(" ", ""))
        .select("app_id", "caller_class", "caller_method")
        .distinct(),
        "callers",
    )
    classes = callers.select("app_id", F.col("caller_class").alias("name"))
    above = ancestors(hierarchy.select("app_id", "name", "extends"), ["app_id"], classes, override.callee_class)
    heirs = above.where(F.col("ancestor") == override.callee_class).select("app_id", F.col("name").alias("caller_class"))
    return callers.join(heirs, ["app_id", "caller_class"], "left_semi").select(
        F.lit("CWE295").alias("checker"), "app_id", F.concat_ws("->", "caller_class", "caller_method").alias("caller")
    )


def weak_random_credentials(calls: DataFrame, first: Call, second: Call, words: Sequence[str]) -> DataFrame:
    """Findings ``(checker, app_id, caller)`` of methods named after credentials that call a method with weak
    random numbers (CWE338): ``calls(app_id, caller, callee, seq, ...)`` as for checkers, ``callee`` being the called method's full name."""
    users = run_checkers(calls, [Checker("CWE338", second, first=first)]).select("app_id", F.col("caller").alias("callee"))
    named = calls.where(F.col("caller").rlike("|".join(words))).select("app_id", "caller", "callee").distinct()
    return named.join(users, ["app_id", "callee"], "left_semi").select(F.lit("CWE338").alias("checker"), "app_id", "caller").distinct()


def call_edges(classes: DataFrame) -> DataFrame:
    """Call edges from nested class analyses ``classes(app_id, name, methods array<struct<name, xref_to
    array<struct<class_name, method_name, descriptor, offset>>>>)``."""
    methods = classes.select("app_id", "name", F.explode("methods").alias("_m"))
    return methods.select(
        "app_id",
        F.concat_ws("->", "name", F.col("_m.name")).alias("caller"),
        F.explode("_m.xref_to").alias("_x"),
    ).select(
        "app_id",
        "caller",
        F.col("_x.offset").alias("seq"),
        F.col("_x.class_name").alias("callee_class"),
        F.col("_x.method_name").alias("callee_method"),
        F.col("_x.descriptor").alias("descriptor"),
    )


def reference_rows(items: DataFrame, item_col: str, references_col: str, kind: str) -> DataFrame:
    """Who uses a string or field: a list of ``{class: method}`` maps as one row per reference."""
    return items.select("app_id", item_col, F.explode(references_col).alias("_map")).select(
        "app_id", item_col, F.explode("_map").alias("class_name", "method_name")
    ).withColumn("access", F.lit(kind))


def degrees(edges: DataFrame, caller: str, callee: str) -> DataFrame:
    """Outgoing and incoming calls per node, in one aggregation over both ends."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col(caller).alias("node"), F.lit(1).alias("outgoing"), F.lit(0).alias("incoming")),
                F.struct(F.col(callee).alias("node"), F.lit(0).alias("outgoing"), F.lit(1).alias("incoming")),
            )
        ).alias("_e")
    )
    return ends.groupBy(F.col("_e.node").alias("node")).agg(
        F.sum("_e.outgoing").alias("outgoing"), F.sum("_e.incoming").alias("incoming")
    )


# --- manifest facts ------------------------------------------------------------------------


def manifest_findings(components: DataFrame, receiver_calls: DataFrame | None = None) -> DataFrame:
    """Findings from manifest rows ``components(app_id, kind, name, exported, has_filter, debuggable)``.

    A debuggable app; an exported activity with an intent filter; an exported receiver whose
    ``onReceive`` does not look at the action (``receiver_calls(app_id, name)`` lists those that do).
    """
    finding = F.array_compact(
        F.array(
            F.when((F.col("kind") == "application") & F.col("debuggable"), F.lit("CWE489")),
            F.when((F.col("kind") == "activity") & F.col("exported") & F.col("has_filter"), F.lit("CWE926")),
            F.when((F.col("kind") == "receiver") & F.col("exported"), F.lit("CWE925")),
        )
    )
    found = components.select("app_id", "name", F.explode(finding).alias("checker"))
    if receiver_calls is None:
        return found
    verified = receiver_calls.select("app_id", "name", F.lit("CWE925").alias("checker"))
    return found.join(verified, ["app_id", "name", "checker"], "left_anti")
