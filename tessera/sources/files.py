"""Markdown folders, JSON profiles and JSON-lines golden sets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.quality import WARNINGS, lint

FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n(.*)\z"
LISTS = ("audience", "acl_groups", "statutory")
DOCUMENT = (
    "doc_id string, title string, version string, category string, subcategory string, owner_dept string, approver string, sensitivity string, audience array<string>, acl_groups array<string>, "
    "published_at string, valid_until string, status string, demo_assumption boolean, supersedes string, doc_type string, authority_level string, effective_from string, statutory array<string>"
)
GOLDEN = "id string, user string, query string, type string, expected_docs array<string>, expected_behavior string, must_contain array<string>, must_not_contain array<string>, note string, summary_contains array<string>, summary_not_contains array<string>, actions_contain array<string>"
PROFILE = "employee_no string, display_name string, role string, dept string, acl_groups array<string>, hire_date string, employment_type string, is_transfer boolean"


def front_matter(block: str | None) -> str:
    """The YAML front matter as JSON; dates as ISO text, single values of list fields as lists; unreadable YAML as empty."""
    import yaml

    try:
        meta = yaml.safe_load(block or "") or {}
    except yaml.YAMLError:
        meta = {}
    if not isinstance(meta, dict):
        meta = {}
    plain = {k: ([str(x) for x in (v if isinstance(v, list) else [v])] if k in LISTS and v is not None else v if isinstance(v, bool) or v is None else str(v)) for k, v in meta.items()}
    return json.dumps(plain, ensure_ascii=False)


def markdown(spark: SparkSession, path: str, mode: str = "report") -> tuple[DataFrame, DataFrame]:
    """(documents, problems) of a folder of ``*.md``. All files are checked, then those published are kept, without
    the invalid ones; with ``mode="failfast"`` the first problem is raised instead."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("source_path"), F.col("value"))
    parts = raw.select("source_path", F.regexp_extract("value", FRONT, 1).alias("head"), F.regexp_extract("value", FRONT, 2).alias("body"))

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks:
            pdf["head"] = [front_matter(h) for h in pdf["head"]]
            yield pdf

    read = parts.mapInPandas(run, "source_path string, head string, body string").select("source_path", "body", F.from_json("head", DOCUMENT).alias("m")).select("source_path", "body", "m.*")
    docs = read.withColumn("doc_type", F.coalesce("doc_type", F.lit("안내문"))).withColumn("authority_level", F.coalesce("authority_level", F.lit("안내문"))).withColumn("effective_from", F.coalesce(F.nullif("effective_from", F.lit("")), "published_at"))
    problems = lint(docs)
    errors = problems.where(~F.col("problem").isin(*WARNINGS))
    if mode == "failfast" and (first := errors.orderBy("doc_id", "problem").first()):
        raise ValueError(f"{first.doc_id}@{first.version}: {first.problem}")
    bad = errors.select("doc_id", "version").distinct()
    kept = docs.alias("d").join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("d.version").eqNullSafe(F.col("b.version")), "left_anti")
    return kept.where("status = 'published'"), problems


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Users of a JSON object ``{"users": {number: profile}}``."""
    df = spark.read.schema(f"users map<string, struct<{', '.join(': '.join(c.split(' ', 1)) for c in PROFILE.split(', '))}>>").json(path, multiLine=True)
    return df.select(F.explode("users").alias("k", "u")).select("u.*")


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden items of a JSON-lines file; blank lines are skipped."""
    return spark.read.schema(GOLDEN).json(path).where("id is not null")
