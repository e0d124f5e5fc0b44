"""Row-level access control: an ordered decision, its filter and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decision(today: str, row: str = "", user: str = "u_") -> Column:
    """First rule that denies, in a fixed order, or ``allow``. Columns of the row carry the prefix ``row``, those of
    the user ``user``. A null list holds nobody, a null date never expires, a null sensitivity is not restricted."""
    r, u = lambda c: F.col(row + c), lambda c: F.col(user + c)
    groups = F.coalesce(F.arrays_overlap(F.array_compact(r("acl_groups")), F.array_compact(u("acl_groups"))), F.lit(False))
    heard = F.coalesce(F.array_contains(r("audience"), "all") | F.array_contains(r("audience"), u("employment_type")), F.lit(False))
    starts = F.coalesce(F.nullif(r("effective_from"), F.lit("")), r("published_at"))
    return (
        F.when(~groups, "deny_acl")
        .when(~heard, "deny_audience")
        .when(F.coalesce(r("valid_until") < today, F.lit(False)), "deny_expired")
        .when(F.coalesce(starts > today, F.lit(False)), "deny_not_effective")
        .when(F.coalesce((r("sensitivity") == "restricted") & ~u("role").eqNullSafe(F.lit("hr_admin")), F.lit(False)), "deny_sensitivity")
        .otherwise("allow")
    )


def blocked(d: Column) -> Column:
    """Whether a decision is for lack of permission, not for time or audience."""
    return d.isin("deny_acl", "deny_sensitivity")


def users(profiles: DataFrame, prefix: str = "u_") -> DataFrame:
    """Profiles as the user side of :func:`decision`, one row of each employee."""
    fields = ["role", "dept", "acl_groups", "hire_date", "employment_type", "is_transfer"]
    return profiles.where("employee_no is not null").groupBy("employee_no").agg(*[F.min(f).alias(prefix + f) for f in fields])


def hidden(shown: DataFrame, chunks: DataFrame, people: DataFrame, today: str) -> DataFrame:
    """Rows of ``shown`` (id, employee_no, chunk_id) whose chunk the user may not see, or that is no chunk any more: the check
    before something is given out, made again on the chunks themselves."""
    attributes = chunks.select("chunk_id", "acl_groups", "audience", "valid_until", "effective_from", "published_at", "sensitivity")
    may = shown.join(people, "employee_no").join(attributes, "chunk_id").where(decision(today) == "allow").select("id", "chunk_id")
    return shown.join(may, ["id", "chunk_id"], "left_anti")


def scope(groups: Column) -> Column:
    """common, department or role: the widest class a document's groups give."""
    return F.when(F.array_contains(groups, "all_employees"), "common").when(F.exists(groups, lambda g: g.startswith("dept:")), "department").otherwise("role")


def visible_documents(chunks: DataFrame, people: DataFrame, today: str) -> DataFrame:
    """Documents each user may see, judged by the first chunk of the document: ``employee_no, scope, category, doc_id, title, doc_version``.

    Documents and users meet on a shared group, never all with all.
    """
    first = chunks.groupBy("doc_id").agg(F.min_by(F.struct(*chunks.columns), "chunk_ord").alias("c")).select("c.*")
    rows = first.withColumn("grp", F.explode("acl_groups"))
    mine = people.withColumn("grp", F.explode("u_acl_groups"))
    return (
        rows.join(mine, "grp").where(decision(today) == "allow")
        .select("employee_no", scope(F.col("acl_groups")).alias("scope"), "category", "doc_id", "title", "doc_version").distinct()
    )
