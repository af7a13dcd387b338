"""Refreshing a checked-out tree of notes before ingestion; not a Spark operator.

``runner(args, cwd, timeout)`` returns (stdout, stderr) and raises on failure, so
tests and other tools can stand in for git.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

Runner = Callable[[list[str], str, float], tuple[str, str]]
PULL_TIMEOUT, LOCAL_TIMEOUT = 120.0, 30.0
CREDENTIAL_SIGNS = ("could not read Username for", "Permission denied (publickey)", "Authentication failed")


@dataclass(frozen=True)
class SyncResult:
    success: bool
    directory: str
    stdout: str
    stderr: str
    started_at: str
    finished_at: str


def run_git(args: list[str], cwd: str, timeout: float) -> tuple[str, str]:
    done = subprocess.run(["git", *args], cwd=cwd, timeout=timeout, capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr or f"git ended with {done.returncode}")
    return done.stdout, done.stderr


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def refresh(directory: str, runner: Runner = run_git) -> SyncResult:
    """Fast-forward pull.  Where only FETCH_HEAD cannot be written, equal local and remote heads count as success."""
    began = _now()
    git = lambda timeout, *args: runner(["-c", f"safe.directory={directory}", *args], directory, timeout)
    ended = lambda ok, out, err: SyncResult(ok, directory, out, err, began, _now())
    try:
        return ended(True, *git(PULL_TIMEOUT, "pull", "--ff-only"))
    except Exception as fault:  # whatever the runner raises is an outcome here
        said = str(fault)
    if any(sign in said for sign in CREDENTIAL_SIGNS):
        return ended(False, "", f"当前服务器没有可用的拉取凭据。\n目录：{directory}\n原始错误：\n{said.strip()}")
    if not (".git/FETCH_HEAD" in said and "Operation not permitted" in said):
        return ended(False, "", said)
    try:
        branch = git(LOCAL_TIMEOUT, "rev-parse", "--abbrev-ref", "HEAD")[0].strip()
        if branch in ("", "HEAD"):
            return ended(False, "", "FETCH_HEAD is not writable and the checkout is on no named branch")
        local = git(LOCAL_TIMEOUT, "rev-parse", "HEAD")[0].strip()
        remote = (git(PULL_TIMEOUT, "ls-remote", "--heads", "origin", branch)[0].split() or [""])[0]
    except Exception as fault:
        return ended(False, "", f"FETCH_HEAD is not writable and the remote could not be verified\n{fault}")
    if local and local == remote:
        return ended(True, "Already up to date; local and remote heads verified equal.", said)
    return ended(False, "", f"FETCH_HEAD is not writable\nLocal {branch}: {local or '-'}\nRemote origin/{branch}: {remote or '-'}")
