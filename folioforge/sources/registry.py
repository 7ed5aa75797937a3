"""The registry of libraries and the settings: two small JSON files, changed by pure functions of their content."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

#: Settings with their defaults, and the themes there are.
DEFAULTS = {
    "theme": "dark",
    "ollama_host": "http://localhost:11434",
    "default_extract_model": "qwen2.5:7b-instruct",
    "default_embed_model": "nomic-embed-text",
    "max_ctx_tokens": 32768,
}
THEMES = ("dark", "light")

#: A registry as a value: the active name, and (name, path) in order.
State = tuple[str | None, tuple[tuple[str, str], ...]]
EMPTY: State = (None, ())


def _checked(state: State, name: str) -> str:
    if name not in dict(state[1]):
        raise KeyError(name)
    return name


def _without(state: State, name: str) -> State:
    rest = tuple(x for x in state[1] if x[0] != name)
    return (rest[0][0] if rest else None) if state[0] == name else state[0], rest


#: What each change makes of a registry.  Renaming moves a library to the end and keeps it active.
CHANGES: dict[str, Callable[..., State]] = {
    "register": lambda s, name, path: (s[0], tuple({**dict(s[1]), name: path}.items())),
    "activate": lambda s, name: (_checked(s, name), s[1]),
    "unregister": _without,
    "rename": lambda s, old, new: (new if s[0] == old else s[0], (*(x for x in s[1] if x[0] not in (_checked(s, old), new)), (new, dict(s[1])[old]))),
    "ensure": lambda s, name, path: (s[0] or name, tuple({**dict(s[1]), name: dict(s[1]).get(name, path)}.items())),
}


def changed(state: State, change: str, *arguments: str) -> State:
    return CHANGES[change](state, *arguments)


def read_json(path: str) -> dict:
    """The object in a file; empty where there is none."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        return {}
    return data if isinstance(data, dict) else {}


def write_json(path: str, data: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2, ensure_ascii=False)
    os.replace(f"{path}.new", path)


def load(path: str) -> State:
    data = read_json(path)
    libraries = data.get("libraries")
    return data.get("active"), tuple(libraries.items()) if isinstance(libraries, dict) else ()


def store(path: str, change: str, *arguments: str) -> State:
    """Applies a change to the file and gives the new registry."""
    state = changed(load(path), change, *arguments)
    write_json(path, {"active": state[0], "libraries": dict(state[1])})
    return state


def served(path: str, name: str, where: str) -> str:
    """At start-up: the library is registered, and the path of whichever is active comes back."""
    active, libraries = store(path, "ensure", name, where)
    return dict(libraries)[active]


def overlaid(stored: dict) -> dict:
    """Defaults overlaid with stored values; unknown keys are left out, an unknown theme is reset."""
    data = DEFAULTS | {k: v for k, v in stored.items() if k in DEFAULTS}
    return data if data["theme"] in THEMES else data | {"theme": DEFAULTS["theme"]}


def settings(path: str) -> dict:
    return overlaid(read_json(path))


def update_settings(path: str, **values) -> dict:
    write_json(path, overlaid(settings(path) | values))
    return settings(path)
