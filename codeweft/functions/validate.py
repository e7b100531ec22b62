"""Checks of arguments before a plan is built. All raise ValueError."""

from __future__ import annotations

from pathlib import Path

# Folders no scan may begin in.
SYSTEM_DIRS = ("/bin", "/boot", "/dev", "/etc", "/lib", "/lib64", "/proc", "/root", "/run", "/sbin", "/sys", "/usr", "/var")
RELATIONSHIP_TYPES = ("CALLS", "CONTAINS", "IMPORTS", "INHERITS")
LABELS = ("Repository", "File", "Module", "Class", "Function", "Method", "Import")


def repository_path(path: str | None, forbidden: tuple[str, ...] = SYSTEM_DIRS) -> Path:
    """An existing folder that is neither the root nor one of ``forbidden``, under whatever name."""
    if path is None or not str(path).strip():
        raise ValueError("a path is needed")
    p = Path(str(path).strip()).resolve()
    if not p.is_dir():
        raise ValueError(f"no folder: {p}")
    if p == Path(p.anchor) or p in {Path(x).resolve() for x in forbidden} or str(p) in forbidden:
        raise ValueError(f"not to be scanned: {p}")
    return p


def identifier(value: str | None, longest: int = 1000) -> str:
    """A non-blank id without NUL or steps upwards."""
    if value is None or not value.strip():
        raise ValueError("an id is needed")
    if "\0" in value or "../" in value or "..\\" in value:
        raise ValueError("an id holds no NUL and no ../")
    if len(value) > longest:
        raise ValueError(f"an id has at most {longest} characters")
    return value.strip()


def repository_identity(repo_id: str | None = None) -> tuple[str, str]:
    """(id, name): the prefix is added if absent; nothing given means repo::default."""
    text = (repo_id or "").strip()
    name = text.removeprefix("repo::") or "default"
    return f"repo::{name}", name


def type_list(text: str | None) -> list[str]:
    """Types of a comma-separated list, without repeats; blank means all four."""
    parts = list(dict.fromkeys(t.strip().upper() for t in (text or "").split(",") if t.strip()))
    if wrong := [t for t in parts if t not in RELATIONSHIP_TYPES]:
        raise ValueError(f"unknown relationship types: {wrong}")
    return parts or list(RELATIONSHIP_TYPES)


def label(text: str | None) -> str | None:
    """The label a text means, letter case aside; None stays None."""
    if text is None:
        return None
    for x in LABELS:
        if x.lower() == text.strip().lower():
            return x
    raise ValueError(f"unknown label: {text}")


def direction(text: str | None) -> str:
    """incoming, outgoing or both; blank means both."""
    clean = (text or "both").strip().lower() or "both"
    if clean not in ("incoming", "outgoing", "both"):
        raise ValueError("direction is incoming, outgoing or both")
    return clean
