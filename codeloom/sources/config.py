"""Project configuration: a JSON file in the project's dot-directory."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass
from typing import Any

FOLDER = ".codeloom"
CONFIG = f"{FOLDER}/config.json"
#: What is scanned, and what never is.
INCLUDE = ("**/*.lua", "**/*.js", "**/*.jsx", "**/*.ts", "**/*.tsx")
EXCLUDE = (f"{FOLDER}/**", "**/*.d.ts", "node_modules/", "dist/", "build/", "coverage/", ".next/", ".vite/")


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = INCLUDE
    exclude: tuple[str, ...] = EXCLUDE
    databaseDir: str = f"{FOLDER}/graph"


def _patterns(value: Any, name: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) and x.strip() for x in value):
        raise ValueError(f"config.{name} must be a list of patterns")
    return tuple(value)


def validate(value: Any) -> Config:
    """A checked configuration; the default excludes always come first, once each."""
    if not isinstance(value, dict):
        raise ValueError("the config must be an object")
    include = _patterns(value.get("include"), "include")
    exclude = _patterns(value.get("exclude"), "exclude")
    folder = value.get("databaseDir")
    if not include:
        raise ValueError("config.include must not be empty")
    if not isinstance(folder, str) or not folder.strip():
        raise ValueError("config.databaseDir must be a path")
    return Config(include, tuple(dict.fromkeys((*EXCLUDE, *exclude))), folder)


def read(root: str) -> Config | None:
    try:
        with open(os.path.join(root, CONFIG), encoding="utf-8") as f:
            return validate(json.load(f))
    except FileNotFoundError:
        return None


def required(root: str) -> Config:
    found = read(root)
    if found is None:
        raise FileNotFoundError(f"the project isn't initialised: {os.path.join(root, CONFIG)} is missing")
    return found


def write(root: str) -> Config:
    """Create the configuration with .gitignore's lines; one that exists stays as it is."""
    found = read(root)
    if found is not None:
        return found
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            ignored = [x for x in map(str.strip, f.read().splitlines()) if x and not x.startswith("#")]
    except FileNotFoundError:
        ignored = []
    config = Config(exclude=tuple(dict.fromkeys((*EXCLUDE, *ignored))))
    os.makedirs(os.path.join(root, FOLDER), exist_ok=True)
    with open(os.path.join(root, CONFIG), "w", encoding="utf-8") as f:
        json.dump({k: list(v) if isinstance(v, tuple) else v for k, v in asdict(config).items()}, f, indent=2)
        f.write("\n")
    return config


def compiler_paths(root: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """baseUrl and the path patterns, in their order, of tsconfig.json or jsconfig.json."""
    for name in ("tsconfig.json", "jsconfig.json"):
        at = os.path.join(root, name)
        if os.path.exists(at):
            with open(at, encoding="utf-8") as f:
                text = re.sub(r"/\*.*?\*/", "", f.read(), flags=re.S)
            text = re.sub(r"(^|[^:])//.*$", r"\1", text, flags=re.M)
            options = json.loads(text).get("compilerOptions") or {}
            return options.get("baseUrl") or ".", [(k, list(v)) for k, v in (options.get("paths") or {}).items()]
    return ".", []
