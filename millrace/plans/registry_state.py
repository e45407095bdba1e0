"""A registry of artifacts: what a pipeline has made, where, and whether it is still there."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path


class Artifacts:
    """Entries by name in a JSON file, replaced as a whole so that a reader never sees half of it."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.entries: dict[str, dict] = json.loads(self.path.read_text()) if self.path.exists() else {}

    def register(self, name: str, path: str, kind: str, **metadata) -> dict:
        self.entries[name] = {"path": path, "type": kind, "created_at": time.strftime("%Y-%m-%dT%H:%M:%S"), "metadata": metadata}
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps(self.entries, ensure_ascii=False, indent=1))
        os.replace(part, self.path)
        return self.entries[name]

    def get(self, name: str) -> dict | None:
        return self.entries.get(name)

    def verify(self, name: str) -> bool:
        entry = self.get(name)
        return bool(entry) and os.path.exists(entry["path"])

    def list(self, kind: str | None = None) -> list[str]:
        return sorted(n for n, e in self.entries.items() if kind is None or e["type"] == kind)

    def preflight(self, names: list[str]) -> list[str]:
        """Names that are missing or whose files are."""
        return [n for n in names if not self.verify(n)]

    def summary(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for e in self.entries.values():
            out[e["type"]] = out.get(e["type"], 0) + 1
        return out
