"""Facts that manifests, schemas and workflows declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, extension

#: By extension: what is declared, and the pattern whose first group names it.
_SCHEMAS = {
    "graphql": [("type", r"(?m)^\s*(?:extend\s+)?(?:type|interface|input|enum|union|scalar)\s+(\w+)")],
    "gql": [("type", r"(?m)^\s*(?:extend\s+)?(?:type|interface|input|enum|union|scalar)\s+(\w+)")],
    "proto": [("type", r"(?m)^\s*(?:message|enum)\s+(\w+)"), ("service", r"(?m)^\s*service\s+(\w+)"), ("rpc", r"(?m)^\s*rpc\s+(\w+)")],
    "prisma": [("type", r"(?m)^\s*(?:model|enum|type)\s+(\w+)")],
}


def _each(text: Column, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def contracts(files: DataFrame) -> DataFrame:
    """rel, kind (type, field, service, rpc, path) and name that schema files declare: GraphQL, Protocol Buffers, Prisma, Avro,
    JSON Schema and OpenAPI."""
    text, ext = F.col("text"), extension(F.col("rel"))
    empty = F.array().cast("array<struct<kind:string,name:string>>")
    found = empty
    for e, kinds in _SCHEMAS.items():
        found = F.when(ext == e, F.flatten(F.array(*[_each(text, k, p) for k, p in kinds]))).otherwise(found)
    avro = F.concat(_each(text, "type", r'"type"\s*:\s*"(?:record|enum)"\s*,\s*"name"\s*:\s*"(\w+)"'), _each(text, "field", r'\{\s*"name"\s*:\s*"(\w+)"\s*,\s*"type"'))
    found = F.when(ext == "avsc", avro).otherwise(found)
    # a JSON Schema names its properties, an OpenAPI document its paths
    properties = F.transform(F.coalesce(F.json_object_keys(F.get_json_object(text, "$.properties")), F.array().cast("array<string>")), lambda n: F.struct(F.lit("field").alias("kind"), n.alias("name")))
    paths = F.transform(F.coalesce(F.json_object_keys(F.get_json_object(text, "$.paths")), F.array().cast("array<string>")), lambda n: F.struct(F.lit("path").alias("kind"), n.alias("name")))
    found = F.when((ext == "json") & text.contains('"$schema"'), properties).when((ext == "json") & text.contains('"openapi"'), paths).otherwise(found)
    found = F.when(ext.isin("yaml", "yml") & text.rlike(r"(?m)^(openapi|swagger)\s*:"), _each(text, "path", r"(?m)^\s{2}(/[^\s:]*)\s*:")).otherwise(found)
    return files.filter("text IS NOT NULL").select("rel", F.explode(F.array_distinct(found)).alias("x")).select("rel", "x.kind", "x.name")


def scripts(files: DataFrame) -> DataFrame:
    """name (what a person would type), command and rel of package scripts and of make and just targets."""
    name = F.lower(base_name(F.col("rel")))
    npm = files.filter(name == "package.json").select("rel", F.explode(F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>")).alias("script", "command")).select(F.concat(F.lit("npm run "), "script").alias("name"), "command", "rel")
    tool = F.when(name.isin("makefile", "gnumakefile"), "make ").when(name == "justfile", "just ")
    recipes = files.withColumn("tool", tool).filter("tool IS NOT NULL").select("rel", "tool", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^([A-Za-z0-9][\w-]*)[^:=\n]*:(?!=)"), 1)).alias("target"))
    return npm.unionByName(recipes.select(F.concat("tool", "target").alias("name"), F.concat("tool", "target").alias("command"), "rel")).distinct()


def ci_steps(lines: DataFrame) -> DataFrame:
    """rel, job, step (from 0 within a job), kind (run or uses), command and line of workflow files. A run block's lines are
    steps of their own; comments are none."""
    flow = lines.filter(F.col("rel").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$")).select("rel", F.col("line_no").alias("line"), "text", F.length(F.regexp_extract("text", r"^(\s*)", 1)).alias("indent"))
    w = Window.partitionBy("rel").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    job = F.regexp_extract("text", r"^  ([A-Za-z0-9_-]+):\s*$", 1)
    marked = flow.withColumn("job", F.last(F.when(job != "", job), ignorenulls=True).over(w))
    block = F.col("text").rlike(r"^\s*(-\s+)?run:\s*[|>][+-]?\s*$")
    head = F.last(F.when(F.col("text").rlike(r"^\s*(-\s+)?[\w-]+:"), F.struct(block.alias("block"), "indent")), ignorenulls=True).over(w)
    marked = marked.withColumn("head", head)
    single = F.regexp_extract("text", r"^\s*(?:-\s+)?run:\s*([^|>\s].*)$", 1)
    uses = F.regexp_extract("text", r"^\s*(?:-\s+)?uses:\s*(\S+)", 1)
    inside = F.col("head.block") & (F.col("indent") > F.col("head.indent")) & ~block & (F.trim("text") != "") & ~F.trim("text").startswith("#")
    command = F.when(uses != "", uses).when(single != "", single).when(inside, F.trim("text"))
    rows = marked.select("rel", "job", F.when(uses != "", "uses").otherwise("run").alias("kind"), command.alias("command"), "line").filter("command IS NOT NULL AND job IS NOT NULL")
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("rel", "job").orderBy("line")) - 1)


def step_kind(command: Column) -> Column:
    """validation, release, setup or control: what a step of a workflow is for. The first that fits."""
    return (
        F.when(command.rlike(r"(?i)\b(test|pytest|vitest|jest|clippy|lint|typecheck|tsc|check|verify|playwright)\b"), "validation")
        .when(command.rlike(r"(?i)\b(publish|release|deploy|push|upload)\b"), "release")
        .when(command.rlike(r"(?i)\b(install|setup|checkout|cache|ci)\b|^actions/"), "setup")
        .otherwise("control")
    )
