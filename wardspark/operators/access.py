"""Role-based access over request logs, quotas and rate-limit replay."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wardspark.functions import regex
from wardspark.operators.policy import matching, policy_facts
from wardspark.operators.scan import finding, with_scalars
from wardspark.schema import FINDING_DDL
from wardspark.session import ensure_checkpoint_dir


@F.pandas_udf(StringType())
def _glob_regex(globs: pd.Series) -> pd.Series:
    return globs.map(regex.glob_regex, na_action="ignore")


def parse_permission(role: str, spec: str | Mapping[str, Any]) -> tuple[str, str, str, str]:
    """``model:gpt-4*`` or ``!tool:shell.*`` as (role, resource_type, pattern, effect)."""
    if isinstance(spec, Mapping):
        return role, str(spec.get("resource_type", "*")), str(spec.get("pattern", "*")), str(spec.get("effect", "allow"))
    text = spec.strip()
    effect, text = ("deny", text[1:]) if text.startswith("!") else ("allow", text)
    kind, colon, pattern = text.partition(":")
    return (role, kind.strip(), pattern.strip(), effect) if colon else (role, "*", text.strip(), effect)


def permissions_from_policy(spark: SparkSession, model_access: Mapping[str, Sequence[str]],
                            tool_access: Mapping[str, Sequence[str]]) -> DataFrame:
    """A policy's access lists as permission rows."""
    rows = [
        (role, kind, p.lstrip("!"), "deny" if p.startswith("!") else "allow")
        for kind, table in (("model", model_access), ("tool", tool_access))
        for role, patterns in table.items() for p in patterns
    ]
    return spark.createDataFrame(rows, "role string, resource_type string, pattern string, effect string")


def effective_roles(edges: DataFrame) -> DataFrame:
    """(role, inherits) edges closed under inheritance: (role, effective), every role reaching itself.

    Frontier expansion: each round joins only the pairs found last and keeps the new ones, so
    cycles end and the depth of the graph bounds the rounds. Lineage is cut by checkpoints.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    step = edges.select(F.col("role").alias("_via"), F.col("inherits").alias("effective")).distinct()
    names = edges.select("role").union(edges.select("inherits")).distinct()
    found = names.select("role", F.col("role").alias("effective")).checkpoint()
    frontier = found
    while True:
        reached = frontier.select("role", F.col("effective").alias("_via")).join(step, "_via").select("role", "effective").distinct()
        frontier = reached.join(found, ["role", "effective"], "left_anti").checkpoint()
        if frontier.isEmpty():
            return found
        found = found.union(frontier)


def effective_roles_sql(edges: DataFrame) -> DataFrame:
    """The same closure as one recursive query; the visited path is the cycle guard. For small role graphs."""
    return edges.sparkSession.sql(
        """
        WITH RECURSIVE reach(role, effective, path) AS (
          SELECT role, role, array(role) FROM (SELECT role FROM {e} UNION SELECT inherits FROM {e})
          UNION ALL
          SELECT r.role, e.inherits, array_append(r.path, e.inherits)
          FROM reach r JOIN {e} e ON r.effective = e.role
          WHERE NOT array_contains(r.path, e.inherits)
        )
        SELECT DISTINCT role, effective FROM reach
        """,
        e=edges,
    )


def audit_access(requests: DataFrame, permissions: DataFrame, closure: DataFrame | None = None, *, id_col: str = "event_id",
                 roles: str = "roles", superusers: Sequence[str] = ("admin",), default_effect: str = "deny") -> DataFrame:
    """(id, allowed, reason) for each request (id, roles, resource_type, resource).

    Superuser roles pass; a deny beats any allow; otherwise the default applies. Requests are
    first reduced to distinct (role, type, resource) triples, so glob matching runs once per
    triple however often it was asked. Whether the permission table is broadcast is Spark's choice.
    """
    asked = requests.select(id_col, roles, "resource_type", "resource")
    per_role = asked.select(id_col, "resource_type", "resource", F.explode(roles).alias("role"))
    triples = per_role.select("role", "resource_type", "resource").distinct()
    if closure is not None:
        wide = closure.select("role", F.col("effective").alias("_role"))
        triples_roles = triples.join(wide, "role", "left").withColumn("_role", F.coalesce("_role", "role"))
    else:
        triples_roles = triples.withColumn("_role", F.col("role"))
    rules = permissions.select(
        F.col("role").alias("_role"), F.col("resource_type").alias("_type"), "pattern", "effect",
        _glob_regex("pattern").alias("_re"),
    )
    matched = triples_roles.join(rules, "_role").filter(
        (F.col("_type").isin("*") | (F.col("_type") == F.col("resource_type"))) & F.expr("resource rlike _re")
    )
    label = F.concat_ws(":", "_type", "pattern")
    verdict = matched.groupBy("role", "resource_type", "resource").agg(
        F.min(F.when(F.col("effect") == "deny", label)).alias("_deny"),
        F.min(F.when(F.col("effect") == "allow", label)).alias("_allow"),
    )
    per_request = (
        per_role.join(verdict, ["role", "resource_type", "resource"])
        .groupBy(id_col).agg(F.min("_deny").alias("_deny"), F.min("_allow").alias("_allow"))
    )
    boss = F.coalesce(F.arrays_overlap(F.col(roles), F.lit(list(superusers))), F.lit(False))
    held = F.coalesce(F.array_join(roles, ", "), F.lit(""))
    fallback = F.concat(F.lit("no permission for "), "resource_type", F.lit(":"), "resource", F.lit(" (roles: "),
                        F.when(held == "", "none").otherwise(held), F.lit(")"))
    default = F.lit("default allow") if default_effect == "allow" else fallback
    return asked.join(per_request, id_col, "left").select(
        id_col,
        F.when(boss, True).when(F.col("_deny").isNotNull(), False).when(F.col("_allow").isNotNull(), True)
        .otherwise(F.lit(default_effect == "allow")).alias("allowed"),
        F.when(boss, "superuser role").when(F.col("_deny").isNotNull(), F.concat(F.lit("denied by "), "_deny"))
        .when(F.col("_allow").isNotNull(), F.concat(F.lit("allowed by "), "_allow")).otherwise(default).alias("reason"),
    )


def with_condition(requests: DataFrame, condition: Any, out: str = "holds", **principal: Column) -> DataFrame:
    """Add whether a permission's condition holds for the principal.

    Principal columns: roles, tenant, authenticated, principal_id, and attributes as ``tags``.
    """
    none = F.expr(f"cast(array() as array<{FINDING_DDL}>)")
    facts = policy_facts(none, stage=F.lit(None).cast("string"), **principal)
    return matching(requests, condition, facts, out)


def access_denials(requests: DataFrame, access: DataFrame, limits: DataFrame | None = None, *, id_col: str = "event_id",
                   require_authentication: bool = True, require_model: bool = True) -> DataFrame:
    """Refused requests with one reason: unauthenticated, then model access, then rate limit.

    ``access`` is (id, allowed, reason); ``limits`` is (id, allowed, scope, retry_after).
    """
    df = requests.join(access.select(id_col, F.col("allowed").alias("_ok"), F.col("reason").alias("_why")), id_col, "left")
    if limits is not None:
        df = df.join(limits.select(id_col, F.col("allowed").alias("_in_rate"), "scope"), id_col, "left")
    else:
        df = df.withColumns({"_in_rate": F.lit(True), "scope": F.lit(None).cast("string")})
    kind = (
        F.when(F.lit(require_authentication) & ~F.col("authenticated"), "unauthenticated")
        .when(F.lit(require_model) & ~F.coalesce("_ok", F.lit(True)), "model_forbidden")
        .when(~F.coalesce("_in_rate", F.lit(True)), "rate_limited")
    )
    text = (
        F.when(kind == "unauthenticated", "unauthenticated principal")
        .when(kind == "model_forbidden", F.concat(F.lit("model: "), "_why"))
        .when(kind == "rate_limited", F.concat(F.lit("rate limit exceeded for "), "scope"))
    )
    out = df.withColumns({"denial": kind, "denial_reason": text}).filter(F.col("denial").isNotNull())
    found = finding("access_control", "access_control", F.lit(True), score=F.lit(1.0), severity=F.lit("medium"),
                    action=F.lit("block"), summary=F.col("denial_reason"))
    return out.withColumn("finding", found).drop("_ok", "_why", "_in_rate")


def quota_lease(quotas: DataFrame, instances: DataFrame) -> DataFrame:
    """Each live instance's share of a fleet-wide quota: floor division, at least one."""
    live = instances.filter(F.col("status") == "healthy").agg(F.greatest(F.lit(1), F.count("*")).alias("_n"))
    share = lambda c: F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), F.col(c)) / F.col("_n"))).cast("int").alias(c)
    return with_scalars(quotas, live, "_n").select("scope", share("rpm"), share("burst"))


def charged_scopes(principal: str | None, tenant: str | None, roles: Sequence[str], model: str | None,
                   quotas: Mapping[str, Any]) -> list[str]:
    """Scopes with a quota, narrowest first, then the catch-all."""
    named = [f"principal:{principal}"] + ([f"tenant:{tenant}"] if tenant else [])
    named += [f"role:{r}" for r in roles] + ([f"model:{model}"] if model else [])
    return [s for s in named if s in quotas] + ["*"]


def charge(state: dict[str, tuple[float, float]], scopes: Sequence[str], now: float,
           quotas: Mapping[str, tuple[float, float]]) -> tuple[bool, str | None, float]:
    """Take one token from every scope or none; ``state`` is scope -> (tokens, last update).

    All buckets refill to ``now``; if one is short the request is refused and the others keep
    what they had, which is the same as charging in order and refunding.
    """
    fallback = quotas.get("*", (60.0, 10.0))
    for scope in scopes:
        rpm, burst = quotas.get(scope, fallback)
        tokens, seen = state.get(scope, (burst, now))
        tokens = min(burst, tokens + max(0.0, now - seen) * rpm / 60.0)
        state[scope] = (tokens, now)
        if tokens < 1.0:
            return False, scope, ((1.0 - tokens) * 60.0 / rpm if rpm > 0 else float("inf"))
    for scope in scopes:
        state[scope] = (state[scope][0] - 1.0, now)
    return True, None, 0.0


def quota_table(spec: Mapping[str, Mapping[str, int]]) -> dict[str, tuple[float, float]]:
    """scope -> (rpm, burst) with the usual defaults."""
    return {
        k: (float(v.get("rpm", 60)), float(v.get("burst", max(1, int(v.get("rpm", 60)) // 6)))) for k, v in spec.items()
    }


def replay_rate_limits(requests: DataFrame, spec: Mapping[str, Mapping[str, int]], *, id_col: str = "event_id",
                       instance: str = "instance_id", ts: str = "timestamp_ms") -> DataFrame:
    """(id, allowed, scope, retry_after) of each request under token buckets.

    Buckets belong to an instance, so instances replay independently. Within one, order
    matters: rows arrive sorted and are taken batch by batch, with the bucket state carried
    over, so memory holds a batch and the buckets and never a whole instance.
    """
    quotas = quota_table(spec)
    types = dict(requests.dtypes)
    cols = [id_col, instance, ts, "principal_id", "tenant", "roles", "model"]

    def replay(batches):
        current, state = object(), {}
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row[1] != current:
                    current, state = row[1], {}
                scopes = charged_scopes(row[3], row[4], list(row[5]) if row[5] is not None else [], row[6], quotas)
                out.append((row[0], *charge(state, scopes, row[2] / 1000.0, quotas)))
            yield pd.DataFrame(out, columns=[id_col, "allowed", "scope", "retry_after"])

    ordered = requests.select(*cols).repartition(instance).sortWithinPartitions(instance, ts, id_col)
    return ordered.mapInPandas(replay, f"{id_col} {types[id_col]}, allowed boolean, scope string, retry_after double")
