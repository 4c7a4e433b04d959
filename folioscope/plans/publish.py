"""Answers as files: one generation at a time, validated, behind an atomic manifest.

Generations are for serving: each answer is small and bounded by its
operator's caps, and is written by the driver to the folder that the web
server reads. Tables of any size go through write_table().
"""

from __future__ import annotations

import csv
import fcntl
import hashlib
import json
import os
import re
import shutil
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

# --- Fixed values: the names that may be read, as the contract of the files gives them.
NAME = re.compile(r"^(?:[a-z-]+/)?[\w-]+\.json$", re.ASCII)
# --- End of fixed values.
#: Most rows of one answer file.
MAX_ROWS = 100_000


def write_table(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Any answer as Parquet, whatever its size."""
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def export_csv(df: DataFrame, path: str | Path) -> int:
    """One answer as a file for spreadsheets, which the driver writes: a byte order mark, all cells quoted, CRLF; null is empty. Rows of an answer are bounded."""
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows: write_csv() or write_table() take them")
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        lines = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\r\n")
        lines.writerow(df.columns)
        lines.writerows(["" if v is None else v for v in r] for r in rows)
    return len(rows)


def write_csv(df: DataFrame, path: str) -> None:
    """(series, category, value) and the like for spreadsheets: all cells quoted, CRLF."""
    df.write.options(header=True, quoteAll=True, lineSep="\r\n").csv(path)


def write_json(path: Path, payload) -> None:
    """Whole or not at all: a temporary file beside it, then a rename."""
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(f".{path.name}.{os.getpid()}")
    with temporary.open("w", encoding="utf-8") as out:
        json.dump(payload, out, ensure_ascii=False, sort_keys=True, default=str)
        out.flush()
        os.fsync(out.fileno())
    os.replace(temporary, path)


def rows_of(df: DataFrame) -> list[dict]:
    """Rows of a small answer; a larger one is an error, not a cut."""
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"an answer of more than {MAX_ROWS} rows isn't served as one file; use write_table()")
    return [r.asDict(recursive=True) for r in rows]


class Store:
    """<root>/generations/<id>/..., <root>/manifest.json; two generations are kept."""

    def __init__(self, root: str | Path, keep: int = 2):
        self.root, self.keep = Path(root), keep

    def publish(self, answers: dict[str, DataFrame], required: tuple[str, ...] = (), check: Callable[[str, list], None] | None = None) -> str:
        """Writes every answer to a staging folder, validates, then switches the manifest. Empty answers get no file."""
        self.root.mkdir(parents=True, exist_ok=True)
        with (self.root / ".lock").open("w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            staging = self.root / ".staging"
            shutil.rmtree(staging, ignore_errors=True)
            sums: dict[str, str] = {}
            for name, df in sorted(answers.items()):
                if not NAME.fullmatch(name):
                    raise ValueError(f"not a name of an answer: {name}")
                if rows := rows_of(df):
                    if check:
                        check(name, rows)
                    write_json(staging / name, rows)
                    sums[name] = hashlib.sha256((staging / name).read_bytes()).hexdigest()
            if missing := [n for n in required if n not in sums]:
                raise ValueError(f"required answers are missing: {missing}")
            for name in sums:
                json.loads((staging / name).read_text("utf-8"))
            generation = hashlib.sha256(json.dumps(sums, sort_keys=True).encode()).hexdigest()[:16]
            target = self.root / "generations" / generation
            target.parent.mkdir(exist_ok=True)
            if target.exists():
                shutil.rmtree(staging)
            else:
                os.replace(staging, target)
            before = self.manifest()
            history = [generation, *[g for g in before.get("history", []) if g != generation]][: self.keep]
            write_json(self.root / "manifest.json", {"generation": generation, "history": history, "files": sums})
            for old in target.parent.iterdir():
                if old.name not in history:
                    shutil.rmtree(old)
            return generation

    def manifest(self) -> dict:
        path = self.root / "manifest.json"
        return json.loads(path.read_text("utf-8")) if path.exists() else {}

    def read(self, name: str):
        """An answer of the published generation; only well-formed names inside it."""
        manifest = self.manifest()
        if not NAME.fullmatch(name) or name not in manifest.get("files", {}):
            return None
        base = (self.root / "generations" / manifest["generation"]).resolve()
        path = (base / name).resolve()
        return json.loads(path.read_text("utf-8")) if path.is_relative_to(base) else None


def accepted(envelope: dict, site_id: int, revision: str, profile: str) -> list:
    """Rows of an offline input, or none unless it was made for exactly this site, revision and profile."""
    same = (envelope.get("siteId"), envelope.get("revision"), envelope.get("profile")) == (site_id, revision, profile)
    return envelope.get("rows", []) if same else []
