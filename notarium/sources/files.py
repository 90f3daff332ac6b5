"""Directories, documents, manifests, status and issue files."""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.people import Aliases
from ..functions.text import FORMATS


def glob_regex(pattern: str) -> re.Pattern:
    """A glob with ** and * as a pattern for whole paths; **/ may be nothing, and /** at the end too."""
    out, i = "", 0
    tail = pattern.endswith("/**")
    body = pattern[:-3] if tail else pattern
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return re.compile(rf"\A{out}{'(?:/.*)?' if tail else ''}\Z")


def walk(root: str, include: list[str] | None = None, exclude: list[str] | None = None, extensions: list[str] | None = None) -> Iterator[dict]:
    """Files under root as path (relative), absolute_path and mtime_ms.

    In this order: no segment may begin with a dot, the extension must be listed, no exclude may match, one include
    must, and it must be a file.
    """
    wanted = [e.lower().lstrip(".") for e in extensions or sorted(FORMATS)]
    inside = [glob_regex(p if p == "**" else f"{p}/**") for p in include or ["**"]]
    outside = [glob_regex(f"{p}/**") for p in exclude or []] + [glob_regex("**/node_modules/**")]
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if not f.startswith("."))
        for name in sorted(names):
            whole = os.path.join(folder, name)
            path = os.path.relpath(whole, root).replace(os.sep, "/")
            if name.startswith(".") or name.rpartition(".")[2].lower() not in wanted:
                continue
            if any(p.match(path) for p in outside) or not any(p.match(path) for p in inside) or not os.path.isfile(whole):
                continue
            yield {"path": path, "absolute_path": whole, "mtime_ms": os.stat(whole).st_mtime_ns / 1e6}


def walked(spark: SparkSession, root: str, **options) -> DataFrame:
    return spark.createDataFrame(list(walk(root, **options)), "path string, absolute_path string, mtime_ms double")


def ingest_files(root: str, recursive: bool = False) -> list[str]:
    """Files of a known format in a directory: one level, or all."""
    found = glob.glob("**/*" if recursive else "*", root_dir=root, recursive=recursive, include_hidden=True)
    return sorted(os.path.join(root, f) for f in found if f.rpartition(".")[2].lower() in FORMATS and os.path.isfile(os.path.join(root, f)))


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_path, content, file_hash) of whole files, the hash over their bytes."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("file_hash"))


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues from a JSON file that holds an array or one object."""
    return spark.read.schema(schemas.ISSUE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_statuses(spark: SparkSession, root: str) -> DataFrame:
    """projects/*/github/status.json, without folders that begin with _; what can't be read is skipped."""
    if not os.path.isdir(f"{root}/projects"):
        raise FileNotFoundError(f"{root}/projects")
    files = [f for f in sorted(glob.glob(f"{root}/projects/*/github/status.json")) if not f.split("/")[-3].startswith("_")]
    schema = schemas.STATUS + ", _corrupt_record STRING"
    if not files:
        return spark.createDataFrame([], schema).drop("_corrupt_record")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(files).persist()
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record")


def read_manifest(path: str) -> tuple[str | None, dict[str, float]]:
    """last_run and mtimes by path; an absent file is empty, a broken one is an error."""
    if not os.path.exists(path):
        return None, {}
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return data.get("last_run"), {p: e["mtime_ms"] for p, e in data.get("files", {}).items()}


def write_manifest(path: str, files: dict[str, float], last_run: str | None) -> None:
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump({"last_run": last_run, "files": {p: {"mtime_ms": m} for p, m in files.items()}}, f, indent=2)
        f.write("\n")
    os.replace(f"{path}.tmp", path)


def read_aliases(path: str | None, root: str | None = None) -> Aliases:
    """Aliases from a YAML file, relative to root; no file is named: none.  Only lists of aliases and of dropped names count."""
    if not path:
        return Aliases({})
    import yaml

    with open(os.path.join(root or ".", path), encoding="utf-8") as f:
        data = yaml.safe_load(f)
    if not isinstance(data, dict):
        return Aliases({})
    lists = lambda x: [str(v) for v in x] if isinstance(x, list) else []
    people = {str(k): {"aliases": lists(v.get("aliases") if isinstance(v, dict) else None)} for k, v in data.items() if k != "_drop"}
    return Aliases(people, lists(data.get("_drop")))


def front_matter_type(content: str) -> str | None:
    """The type that a document's front matter names, if it is a plain string; broken front matter names none."""
    lines = content.split("\n")
    if lines[0].strip() != "---" or "---" not in lines[1:]:
        return None
    block = "\n".join(lines[1 : lines.index("---", 1)])
    try:
        import yaml

        data = yaml.safe_load(block)
        value = data.get("type") if isinstance(data, dict) else None
        return value if isinstance(value, str) else None
    except ImportError:
        m = re.search(r"^type:[ \t]*(['\"]?)([^\n'\"#\[\]{}]+)\1[ \t]*$", block, re.M)
        return m[2].strip() if m and not re.fullmatch(r"[\d.]+|true|false|null|~", m[2].strip()) else None
    except Exception:
        return None
