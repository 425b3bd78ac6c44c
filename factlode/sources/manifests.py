"""Build manifests: the dependencies that they declare, and what these say about a project."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names in dependencies and what they speak for.
CUES = {
    "web": "fastapi flask django starlette express koa nestjs gin-gonic spring-boot-starter-web spring-webmvc actix-web rocket axum rails sinatra",
    "messaging": "kafka pulsar rabbitmq amqp pika nats",
    "cache": "redis",
    "rpc": "grpc protobuf thrift",
    "data": "sqlalchemy psycopg hibernate spring-data gorm diesel mongoose prisma sequelize mysql postgres sqlite mongodb",
    "frontend": "react vue svelte @angular next",
}
_NAME = re.compile(r"[^<>=!~ \[;@]+")


def _plain(lines) -> list[str]:
    names = []
    for line in lines:
        body = str(line).partition("#")[0].strip()
        m = _NAME.match(body)
        if m and not body.startswith("-"):
            names.append(m[0])
    return names


def _toml(text: str) -> list[str]:
    doc = tomllib.loads(text)
    poetry = doc.get("tool", {}).get("poetry", {}).get("dependencies", {})
    return _plain(doc.get("project", {}).get("dependencies", [])) + [k for k in poetry if k.lower() != "python"] + list(doc.get("dependencies", {}))


def _package(text: str) -> list[str]:
    doc = json.loads(text)
    return [k for part in ("dependencies", "devDependencies", "require") for k in doc.get(part) or {}]


def read(path: str, text: str) -> list[str]:
    """Dependencies of one manifest, by its name; a broken one has none."""
    name = path.rsplit("/", 1)[-1].lower()
    try:
        if re.fullmatch(r"requirements.*\.txt", name):
            return _plain(text.splitlines())
        if name in ("pyproject.toml", "cargo.toml"):
            return _toml(text)
        if name in ("package.json", "composer.json"):
            return _package(text)
        patterns = {
            "pom.xml": r"<artifactId>\s*([^<\s]+)\s*</artifactId>", "go.mod": r"(?m)^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+v[\d.]",
            "gemfile": r"""(?m)^\s*gem\s+['"]([^'"]+)['"]""",
        }
        if name in patterns:
            return re.findall(patterns[name], text)
        if name.endswith((".gradle", ".gradle.kts")):
            return re.findall(r"""(?:implementation|api|compile|runtimeOnly)\s*[('"]+([^'")]+)""", text)
        if name.endswith(".csproj"):
            return re.findall(r'<PackageReference\s+Include="([^"]+)"', text)
    except (ValueError, AttributeError):
        return []
    return []


def dependencies(files: DataFrame) -> DataFrame:
    """(path, dependency) of manifests among files (path, text), each once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, d.strip()) for p, t in zip(batch["path"], batch["text"], strict=True) for d in read(p, t or "") if d.strip()]
            yield pd.DataFrame(rows, columns=["path", "dependency"])

    named = files.filter(F.lower(F.regexp_extract("path", "([^/]*)$", 1)).rlike(r"^(requirements.*\.txt|pyproject\.toml|cargo\.toml|package\.json|composer\.json|pom\.xml|go\.mod|gemfile|.*\.gradle(\.kts)?|.*\.csproj)$"))
    return named.select("path", "text").mapInPandas(run, "path string, dependency string").distinct()


def cues(found: DataFrame) -> DataFrame:
    """(path, dependency, cue): what parts of dependency names speak for. The cue table is a constant of this module."""
    table = [(cue, part) for cue, parts in CUES.items() for part in parts.split()]
    rules = found.sparkSession.createDataFrame(table, "cue string, part string")
    return found.join(F.broadcast(rules), F.lower("dependency").contains(F.col("part"))).select("path", "dependency", "cue").distinct()
