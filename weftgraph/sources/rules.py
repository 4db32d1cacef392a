"""Context rules: front matter of rule files, and which rules a path meets."""

from __future__ import annotations

import re

from weftgraph.functions.text import glob_regex


def front_matter(text: str) -> tuple[dict, str]:
    """(settings, body): the small part of YAML that rule files use."""
    m = re.match(r"^---\s*\n(.*?)\n---\s*\n?(.*)$", text, re.S)
    if not m:
        return {}, text
    out: dict = {}
    key = None
    for line in m[1].split("\n"):
        if item := re.match(r"^\s+-\s+(.*)$", line):
            if key is not None:
                out.setdefault(key, [])
                if isinstance(out[key], list):
                    out[key].append(item[1].strip().strip("\"'"))
        elif pair := re.match(r"^([\w-]+)\s*:\s*(.*)$", line):
            key, value = pair[1], pair[2].strip()
            if value in ("true", "false"):
                out[key] = value == "true"
            elif value.startswith("["):
                out[key] = [x.strip().strip("\"'") for x in value.strip("[]").split(",") if x.strip()]
            elif value:
                out[key] = value.strip("\"'")
            else:
                out[key] = []
    return out, m[2]


def load(files: dict[str, str]) -> list[dict]:
    """Rules of {path: text}: front matter for .mdc, always-on for AGENTS.md and CLAUDE.md."""
    rules = []
    for path, text in sorted(files.items()):
        meta, body = front_matter(text)
        globs = meta.get("globs", [])
        globs = [g.strip() for g in globs.split(",")] if isinstance(globs, str) else globs
        always = bool(meta.get("alwaysApply")) or path.rsplit("/", 1)[-1] in ("AGENTS.md", "CLAUDE.md")
        rules.append({"path": path, "description": meta.get("description", ""), "globs": globs, "always": always, "body": body})
    return rules


def rules_for(rules: list[dict], path: str) -> list[dict]:
    """Rules that a path meets: those that always apply first, then those of fewest globs."""
    hit = [r for r in rules if r["always"] or any(re.search(glob_regex(g), path) for g in r["globs"])]
    return sorted(hit, key=lambda r: (not r["always"], len(r["globs"]), r["path"]))
