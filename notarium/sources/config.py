"""Settings: defaults under a JSON file, lists from the environment, secrets."""

from __future__ import annotations

import copy
import json
import os

# The keys of a settings file, and what holds where it says nothing.  (The name of the server and the tools'
# descriptions are texts of our own.)
DEFAULTS = {
    "serverName": "notarium",
    "vaultRoot": None,
    "peopleFile": None,
    "categories": ["status", "cost", "date", "contact", "preference", "metric", "location", "definition"],
    "embedder": {"url": "https://api.openai.com/v1/embeddings", "model": "text-embedding-3-small", "dimensions": 1536, "apiKey": "env:OPENAI_API_KEY"},
    "metadataExtractor": {"enabled": True, "url": "https://api.openai.com/v1/chat/completions", "model": "gpt-4o-mini", "apiKey": "env:OPENAI_API_KEY"},
    "tools": {
        "search_context": {"description": "Captures and current facts nearest in meaning to a query."},
        "lookup_fact": {"description": "The value of one fact, now or on a day.", "keyExamples": ["project_status", "deploy_date"]},
        "search_facts": {"description": "Facts by domain, category or words."},
        "capture_thought": {"description": "Keep a thought, with its vector and metadata."},
        "save_fact": {
            "description": "Save a fact; earlier values stay in its history.", "keyExamples": ["project_status", "next_milestone_date"],
            "currencies": None, "units": None, "peopleDescription": "Names of the people concerned",
        },
        "list_recent": {"description": "The latest captures."},
        "context_stats": {"description": "Counts of captures and facts."},
        "ingest_document": {"description": "Read a file or a directory into the knowledge base."},
        "project_pulse": {"description": "The present state of all repositories, latest first."},
    },
    "indexSync": None,
    "additionalRoots": None,
}
# The domains and types of captures where the environment names none.
DOMAINS = ["general", "project", "reference"]
CAPTURE_TYPES = ["thought", "decision", "analysis", "note", "meeting", "insight", "plan", "reference", "review"]


def merged(defaults: dict, given: dict) -> dict:
    """Defaults with what is given: dicts merge, all else replaces, null too; unknown keys are left out."""
    out = copy.deepcopy(defaults)
    for k, v in given.items():
        if k in out:
            out[k] = merged(out[k], v) if isinstance(out[k], dict) and isinstance(v, dict) else v
    return out


def settled(settings: dict) -> dict:
    """Settings in which an empty list of currencies or units is none."""
    save = (settings.get("tools") or {}).get("save_fact") or {}
    for k in ("currencies", "units"):
        if save.get(k) == []:
            save[k] = None
    return settings


def load(path: str) -> dict:
    """Settings of a file; an absent file gives the defaults, a broken one an error."""
    if not os.path.exists(path):
        return settled(merged(DEFAULTS, {}))
    with open(path, encoding="utf-8") as f:
        return settled(merged(DEFAULTS, json.load(f)))


def env_list(name: str, fallback: list[str]) -> list[str]:
    return [x for x in (p.strip() for p in os.environ.get(name, "").split(",")) if x] or fallback


def secret(value: str) -> str:
    """env:NAME stands for a variable of the environment, which must be set."""
    if not value.startswith("env:"):
        return value
    if not os.environ.get(value[4:]):
        raise KeyError(f"{value[4:]} is not set")
    return os.environ[value[4:]]
