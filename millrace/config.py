"""Layered settings: merging, overrides from environment and command line, references, fingerprints."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping, Sequence
from typing import Any

from millrace.sources.sets import fingerprint

_REFERENCE = re.compile(r"\$\{([^}]+)\}")


def merged(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Layers over each other, later ones before earlier: mappings are merged, null takes a key away, a key with a
    leading + adds its list to what is there, anything else replaces."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            if key.startswith("+"):
                key = key[1:]
                out[key] = [*out.get(key, []), *value]
            elif value is None:
                out.pop(key, None)
            elif isinstance(value, Mapping):
                base = out.get(key)
                out[key] = merged(base if isinstance(base, Mapping) else {}, value)
            else:
                out[key] = value
    return out


def parsed(text: str) -> Any:
    """JSON where the text is JSON, else the text itself."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def nested(path: Sequence[str], value: Any) -> dict[str, Any]:
    for key in reversed(path):
        value = {key: value}
    return value


def from_environment(prefix: str, environment: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Settings of variables such as PREFIX_a__b=1, which is a.b."""
    env = os.environ if environment is None else environment
    found = (nested(k[len(prefix) + 1 :].split("__"), parsed(v)) for k, v in sorted(env.items()) if k.startswith(f"{prefix}_"))
    return merged(*found)


def from_arguments(arguments: Sequence[str]) -> dict[str, Any]:
    """Settings of arguments such as a.b=1."""
    if wrong := [a for a in arguments if "=" not in a]:
        raise ValueError(f"no setting: {wrong[0]!r}")
    return merged(*(nested(a.split("=", 1)[0].split("."), parsed(a.split("=", 1)[1])) for a in arguments))


def resolved(config: Mapping[str, Any], environment: Mapping[str, str] | None = None) -> dict[str, Any]:
    """The settings with ${a.b} replaced by that setting and ${ENV:NAME} or ${ENV:NAME/default} by the variable. A text
    that is one reference takes the value as it is. Unknown names and circles are errors."""
    env = os.environ if environment is None else environment

    def look(name: str, open_: tuple[str, ...]) -> Any:
        if name.startswith("ENV:"):
            key, slash, default = name[4:].partition("/")
            if key not in env and not slash:
                raise KeyError(name)
            return parsed(env.get(key, default))
        if name in open_:
            raise ValueError(f"circle: {' > '.join([*open_, name])}")
        at: Any = config
        for key in name.split("."):
            at = at[key]
        return fill(at, (*open_, name))

    def fill(value: Any, open_: tuple[str, ...]) -> Any:
        if isinstance(value, Mapping):
            return {k: fill(v, open_) for k, v in value.items()}
        if isinstance(value, list):
            return [fill(v, open_) for v in value]
        if not isinstance(value, str):
            return value
        if whole := _REFERENCE.fullmatch(value):
            return look(whole[1], open_)
        return _REFERENCE.sub(lambda m: str(look(m[1], open_)), value)

    return fill(config, ())


def config_fingerprint(config: Mapping[str, Any], without: Sequence[str] = ("paths", "logs", "run_tag")) -> str:
    """Fingerprint of the settings that decide results: those named are left out wherever they stand."""
    prune = lambda x: {k: prune(v) for k, v in x.items() if k not in without} if isinstance(x, Mapping) else [prune(v) for v in x] if isinstance(x, list) else x
    return fingerprint(prune(config))
