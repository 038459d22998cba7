"""Names and options of sources."""

from __future__ import annotations

import os
from collections.abc import Iterable
from urllib.parse import urlsplit

#: Files taken for recordings.
EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".m4v", ".webm", ".mpg", ".mpeg")


def is_stream(source: str) -> bool:
    return "://" in source


def base_name(source: str) -> str:
    """A file's name without folder and ending; for a stream cam_ and the last part of its host."""
    if is_stream(source):
        host = urlsplit(source).hostname or "stream"
        return f"cam_{host.rsplit('.', 1)[-1]}"
    return os.path.splitext(os.path.basename(source))[0]


def named(sources: Iterable[str]) -> list[tuple[str, str]]:
    """(name, source) in order; a name that is taken already gets the next free _2, _3 and so on."""
    used: set[str] = set()
    out = []
    for source in sources:
        name = base = base_name(source)
        n = 1
        while name in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name)
        out.append((name, source))
    return out


def resolve(given: list[str] | None = None, folder: str | None = None, configured: list[str] | None = None) -> list[tuple[str, str]]:
    """Sources by precedence: given ones, a folder's recordings in order, configured ones. Local files must exist."""
    if given:
        sources = given
    elif folder:
        sources = sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.lower().endswith(EXTENSIONS))
    else:
        sources = configured or []
    missing = [s for s in sources if not is_stream(s) and not os.path.exists(s)]
    if missing:
        raise FileNotFoundError(f"no such source: {', '.join(missing)}")
    return named(sources)


def transport_options(transport: str | None = "tcp", timeout_ms: float | None = 5000, **more: object) -> str:
    """Options of a stream reader as key;value pairs joined by a bar; the timeout is given in microseconds, under both its names.

    No transport and no (or a zero) timeout give no option; nothing at all gives an empty text.
    """
    pairs: dict[str, object] = {"rtsp_transport": transport} if transport else {}
    if timeout_ms and timeout_ms > 0:
        pairs |= {"timeout": int(timeout_ms * 1000), "stimeout": int(timeout_ms * 1000)}
    pairs |= more
    return "|".join(f"{k};{v}" for k, v in pairs.items())
