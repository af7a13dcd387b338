"""Run-time settings and the user's watch list and aliases (small, kept by the driver)."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# The defaults.
DEFAULT_REPORT_DIR = "reports"
DEFAULT_STRATEGY_DIR = "."
DEFAULT_PORT = 3003


@dataclass(frozen=True)
class Settings:
    report_dir: str = DEFAULT_REPORT_DIR
    strategy_dir: str = DEFAULT_STRATEGY_DIR
    port: int = DEFAULT_PORT

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """REPORT_DIR before REPORTS_DIR; blanks count as unset; a port needs leading digits above 0."""
        env = os.environ if env is None else env
        get = lambda *names: next((env[n].strip() for n in names if (env.get(n) or "").strip()), None)
        digits = ""
        for c in get("PORT") or "":
            if not c.isdecimal():
                break
            digits += c
        return cls(get("REPORT_DIR", "REPORTS_DIR") or DEFAULT_REPORT_DIR, get("STRATEGY_DIR") or DEFAULT_STRATEGY_DIR, int(digits or 0) or DEFAULT_PORT)


def _unique(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v.strip() for v in values if v.strip()))


@dataclass
class UserConfig:
    """``watchlist`` and ``aliases`` in a JSON file; any fault in it restores the defaults."""

    path: Path
    watchlist: list[dict] = field(default_factory=list)
    aliases: list[dict] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | Path) -> UserConfig:
        path = Path(path)
        try:
            held = json.loads(path.read_text(encoding="utf-8"))
            return cls(path, held.get("watchlist", []), held.get("aliases", []))
        except (OSError, ValueError, AttributeError):
            fresh = cls(path)
            fresh.save()
            return fresh

    def save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps({"watchlist": self.watchlist, "aliases": self.aliases}, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")

    def add_watch(self, name: str, aliases: list[str] = (), note: str | None = None) -> UserConfig:
        item = next((w for w in self.watchlist if w["name"] == name), None)
        if item:
            item["aliases"] = _unique([*item["aliases"], *aliases])
            if note is not None:
                item["note"] = note
        else:
            item = {"id": f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:12]}", "name": name, "aliases": _unique([name, *aliases])}
            if note is not None:
                item["note"] = note
            item["createdAt"] = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
            self.watchlist.append(item)
        self.save()
        return self

    def remove_watch(self, watch_id: str) -> UserConfig:
        self.watchlist = [w for w in self.watchlist if w["id"] != watch_id]
        self.save()
        return self

    def add_alias(self, canonical: str, aliases: list[str]) -> UserConfig:
        entry = next((a for a in self.aliases if a["canonical"] == canonical), None)
        if entry:
            entry["aliases"] = _unique([*entry["aliases"], *aliases, canonical])
        else:
            self.aliases.append({"canonical": canonical, "aliases": _unique([canonical, *aliases])})
        self.save()
        return self

    def expand(self, query: str) -> list[str]:
        """The first alias entry that names the query, else the query alone."""
        from ..functions.text import normalize_literal as norm

        for entry in self.aliases:
            names = [entry["canonical"], *entry["aliases"]]
            if norm(query) in map(norm, names):
                return names
        return [query]

    def watch_frame(self, spark: SparkSession) -> DataFrame:
        from ..functions.text import normalize_literal as norm

        rows = [(w["id"], w["name"], [norm(a) for a in (w["name"], *w["aliases"])]) for w in self.watchlist]
        return spark.createDataFrame(rows, "watch_id string, name string, norm_aliases array<string>")


def split_aliases(text: str) -> list[str]:
    import re

    return [a for a in re.split(r"[,\s，]+", text) if a]
