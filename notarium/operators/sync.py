"""Incremental directory sync: plans from a manifest, roots, and the bookkeeping of a run."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..sources.files import read_manifest, walk, write_manifest


def sync_plan(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) with status new, changed, unchanged or deleted; changed means another mtime, not a later one."""
    now, then = current.select("path", F.col("mtime_ms").alias("now")), manifest.select("path", F.col("mtime_ms").alias("then"))
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("then"), "unchanged").otherwise("changed")
    return now.join(then, "path", "full_outer").select("path", status.alias("status"))


def deleted_paths(current: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.select("path").join(current.select("path"), "path", "left_anti")


def overlapping_roots(roots: list[str]) -> list[tuple[str, str]]:
    """Pairs of roots of which one holds the other."""
    whole = [os.path.abspath(r) for r in roots]
    inside = lambda a, b: a == b or a.startswith(b.rstrip(os.sep) + os.sep)
    return [(roots[i], roots[j]) for i in range(len(whole)) for j in range(i + 1, len(whole)) if inside(whole[i], whole[j]) or inside(whole[j], whole[i])]


@dataclass(frozen=True)
class Root:
    """A directory to sync and which of its files count."""

    path: str
    include: tuple[str, ...] = ("**",)
    exclude: tuple[str, ...] = ()
    extensions: tuple[str, ...] = (".md", ".pdf", ".txt")


def resolve_roots(settings: dict) -> list[Root]:
    """The main root and the additional ones of the settings, absolute, each with its own patterns; they must be disjoint."""

    def root(path: object, options: dict, what: str) -> Root:
        if not isinstance(path, str) or not path.strip():
            raise ValueError(f"{what} must be a path that isn't empty")
        given = {k: tuple(options[k]) for k in ("include", "exclude", "extensions") if options.get(k) is not None}
        return Root(os.path.abspath(path), **given)

    main = root(settings.get("vaultRoot"), settings.get("indexSync") or {}, "vaultRoot")
    more = settings.get("additionalRoots")
    if more is not None and not isinstance(more, list):
        raise ValueError("additionalRoots must be a list")
    roots = [main, *(root(r.get("root"), r, "root of additionalRoots") for r in more or [])]
    if pairs := overlapping_roots([r.path for r in roots]):
        raise ValueError(f"roots overlap: {pairs[0][0]} and {pairs[0][1]}")
    return roots


@dataclass
class SyncResult:
    new: int = 0
    changed: int = 0
    deleted: int = 0
    unchanged: int = 0
    failures: list[tuple[str, str]] = field(default_factory=list)

    def __add__(self, other: SyncResult) -> SyncResult:
        return SyncResult(self.new + other.new, self.changed + other.changed, self.deleted + other.deleted, self.unchanged + other.unchanged, self.failures + other.failures)


def sync(
    root: str, manifest_path: str, ingest: Callable[[str, bool], bool], delete: Callable[[str], None], now: str,
    *, include: list[str] | None = None, exclude: list[str] | None = None, extensions: list[str] | None = None, force: bool = False, dry_run: bool = False,
) -> SyncResult:
    """Bring an index up to date with a directory.

    ingest(path, replace) tells whether it worked; delete(path) raises where it did not.  A failed file keeps its old
    entry out of the manifest, a failed deletion keeps it in; last_run moves on only without failures.  force begins
    from an empty manifest: all files are replaced, and files that have gone are not deleted.
    """
    last_run, known = read_manifest(manifest_path)
    if force:
        last_run, known = None, {}
    files = {f["path"]: f["mtime_ms"] for f in walk(root, include, exclude, extensions)}
    plan = {p: "new" if p not in known else "unchanged" if known[p] == m else "changed" for p, m in files.items()}
    gone = [p for p in known if p not in files]
    result = SyncResult(*(sum(s == x for s in plan.values()) for x in ("new", "changed")), len(gone), sum(s == "unchanged" for s in plan.values()))
    if dry_run:
        return result
    after = {p: m for p, m in files.items() if plan[p] == "unchanged"}
    for path, status in plan.items():
        if status == "unchanged":
            continue
        try:
            done = ingest(path, force or status == "changed")
        except Exception as e:
            done, reason = False, str(e)
        else:
            reason = "not ingested"
        if done:
            after[path] = files[path]
        else:
            result.failures.append((path, reason))
    for path in gone:
        try:
            delete(path)
        except Exception as e:
            after[path] = known[path]
            result.failures.append((path, str(e)))
    write_manifest(manifest_path, after, last_run if result.failures else now)
    return result


def sync_roots(roots: list[str], run: Callable[[str], SyncResult]) -> SyncResult:
    """The sum over roots that must not overlap; a root that fails is one failure and does not stop the others."""
    if not roots:
        raise ValueError("no roots")
    if pairs := overlapping_roots(roots):
        raise ValueError(f"roots overlap: {pairs[0][0]} and {pairs[0][1]}")
    total = SyncResult()
    for root in roots:
        try:
            total += run(root)
        except Exception as e:
            total += SyncResult(failures=[(root, str(e))])
    return total
