"""Settings and keys: files of NAME=value lines, and a JSON file of a user's choices."""

from __future__ import annotations

import json
import os
from pathlib import Path


def _pair(line: str) -> tuple[str, str] | None:
    """A line's name and value, None for a comment or anything else: one name, which "export" may precede, before the first "="."""
    before, mark, value = line.partition("=")
    words = before.split()
    if len(words) == 2 and words[0] == "export":
        del words[0]
    if not mark or len(words) != 1 or not _is_name(words[0]):
        return None
    return words[0], value


def _is_name(word: str) -> bool:
    return word.isascii() and word.isidentifier()


def _unquoted(value: str) -> str:
    value = value.strip()
    quoted = len(value) > 1 and value[0] in "'\"" and value[-1] == value[0]
    return value[1:-1] if quoted else value


def _lines(path: Path) -> list[str]:
    return path.read_text(encoding="utf-8-sig", errors="replace").splitlines() if path.is_file() else []


def read_env(path: str | Path) -> dict[str, str]:
    """The pairs of a file; no file has none. The last of equal names counts."""
    return {name: _unquoted(value) for name, value in filter(None, map(_pair, _lines(Path(path))))}


def _store(path: Path, lines: list[str]) -> None:
    part = path.with_name(path.name + ".part")
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as out:
        out.write("".join(f"{x}\n" for x in lines))
    os.replace(part, path)


def set_key(path: str | Path, name: str, value: str) -> None:
    """Replaces the pair where it stands, or appends it; other lines stay. Only the owner may read the file."""
    if not _is_name(name) or "\n" in value:
        raise ValueError("a name of letters, digits and _, and a value on one line")
    lines = _lines(Path(path))
    spots = [i for i, line in enumerate(lines) if (_pair(line) or [None])[0] == name]
    if spots:
        lines[spots[0]] = f"{name}={value}"
        lines = [x for i, x in enumerate(lines) if i not in spots[1:]]
    else:
        lines.append(f"{name}={value}")
    _store(Path(path), lines)


def unset_key(path: str | Path, name: str) -> bool:
    lines = _lines(Path(path))
    left = [x for x in lines if (_pair(x) or [None])[0] != name]
    if len(left) < len(lines):
        _store(Path(path), left)
    return len(left) < len(lines)


def masked(value: str) -> str:
    return f"{value[:4]}...{value[-4:]}" if len(value) >= 12 else "*" * 8


def load_choices(path: str | Path) -> dict:
    """A user's choices; a missing or damaged file has none."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def save_choices(path: str | Path, changes: dict) -> dict:
    """Changes laid over what is stored."""
    every = load_choices(path) | changes
    _store(Path(path), json.dumps(every, indent=2).splitlines())
    return every


_FALSE, _TRUE = {"0", "false", "no", "off", "f", "n"}, {"1", "true", "yes", "on", "t", "y"}


def _like(default: object, given: str) -> object:
    """The given text as a value of the default's type."""
    if isinstance(default, bool):
        if given.strip().lower() not in _FALSE | _TRUE:
            raise ValueError(f"{given!r} is neither true nor false")
        return given.strip().lower() in _TRUE
    return type(default)(given)


def settled(defaults: dict, prefix: str, env_file: str | Path = ".env") -> dict:
    """The settings: an environment variable PREFIX_NAME comes before one in the file, and that before the default.

    Names' case doesn't matter; a value takes its default's type, and one that can't is an error. Other names are ignored.
    """
    every = {k.lower(): v for k, v in (read_env(env_file) | dict(os.environ)).items()}
    lower = {k: f"{prefix}{k}".lower() for k in defaults}
    return {k: _like(v, every[lower[k]]) if lower[k] in every else v for k, v in defaults.items()}


def key_of(name: str, settings: dict) -> str:
    """A key from the settings, or where that is empty from the environment variable of its upper-case name; else ""."""
    return str(settings.get(name.lower()) or "") or os.environ.get(name.upper(), "")
