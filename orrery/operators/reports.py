"""Reports of gate results and violations: rows are assembled in Spark, one JSON or XML text per row.

``sarif_results``, ``gitlab_issues`` and ``sonar_issues`` give a record per violation, for a
text sink; envelopes wrap what a caller has already bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity in other tools' words.
SARIF = {"error": "error", "warning": "warning", "info": "note", "hint": "none"}
GITLAB = {"error": "critical", "warning": "major", "info": "minor", "hint": "info"}
SONAR = {"error": "CRITICAL", "warning": "MAJOR", "info": "MINOR", "hint": "INFO"}


def _level(table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("severity")), F.lit("none"))


def _place() -> Column:
    return F.struct(F.struct(F.struct(F.col("file").cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))


def sarif_results(violations: DataFrame) -> DataFrame:
    return violations.select(F.to_json(F.struct(F.col("rule_id").cast("string").alias("ruleId"), _level(SARIF).alias("level"), F.array(_place()).alias("locations"))).alias("value"))


def gitlab_issues(violations: DataFrame) -> DataFrame:
    finger = F.md5(F.concat_ws(":", F.col("rule_id").cast("string"), F.col("file").cast("string"), F.col("line").cast("string")))
    where = F.struct(F.col("file").cast("string").alias("path"), F.struct(F.col("line").alias("begin")).alias("lines"))
    return violations.select(F.to_json(F.struct(F.col("rule_id").cast("string").alias("check_name"), _level(GITLAB).alias("severity"), finger.alias("fingerprint"), where.alias("location"))).alias("value"))


def sonar_issues(violations: DataFrame) -> DataFrame:
    where = F.struct(F.col("file").cast("string").alias("filePath"), F.struct(F.col("line").alias("startLine")).alias("textRange"))
    return violations.select(F.to_json(F.struct(F.lit("orrery").alias("engineId"), F.col("rule_id").cast("string").alias("ruleId"), _level(SONAR).alias("severity"), F.lit("CODE_SMELL").alias("type"), where.alias("primaryLocation"))).alias("value"))


def github_annotations(violations: DataFrame) -> DataFrame:
    word = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    return violations.select(F.concat(F.lit("::"), word, F.lit(" file="), F.col("file").cast("string"), F.lit(",line="), F.col("line").cast("string"), F.lit("::rule "), F.col("rule_id").cast("string")).alias("value"))


def junit_cases(gates: DataFrame) -> DataFrame:
    """A test case element per gate."""
    name = F.concat(F.lit('<testcase name="'), F.col("gate"), F.lit('" classname="project-'), F.col("project").cast("string"), F.lit('"'))
    failed = F.concat(name, F.lit('><failure message="score '), F.round("score", 2).cast("string"), F.lit('"/></testcase>'))
    return gates.select(F.when(F.col("passed"), F.concat(name, F.lit("/>"))).otherwise(failed).alias("value"))


def console_lines(gates: DataFrame) -> DataFrame:
    return gates.select(F.concat(F.when(F.col("passed"), "PASS ").otherwise("FAIL "), F.rpad("gate", 20, " "), F.format_number("score", 1)).alias("value"))


def html_rows(gates: DataFrame) -> DataFrame:
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    return gates.select(F.concat(F.lit("<tr>"), cell(F.col("gate")), cell(F.format_number("score", 1)), cell(F.when(F.col("passed"), "pass").otherwise("fail")), F.lit("</tr>")).alias("value"))


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


REPORTERS = {"sarif": sarif_results, "gitlab": gitlab_issues, "sonarqube": sonar_issues, "github": github_annotations, "junit": junit_cases, "console": console_lines, "html": html_rows, "json": json_rows}
