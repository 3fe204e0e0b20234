"""Settings of a dataset as one flat table of rules, by dotted path; whatever breaks a rule is named by its path."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any, NamedTuple


class ConfigError(ValueError):
    """A setting that is unknown or breaks its rule."""


class Rule(NamedTuple):
    default: Any
    holds: Callable[[Any], bool]
    says: str


def _among(*names: str) -> tuple:
    return (lambda x: x in names), "one of " + ", ".join(names)


def _share(default: float) -> Rule:
    return Rule(default, lambda x: isinstance(x, (int, float)) and 0 <= x <= 1, "a share between 0 and 1")


def _text() -> Rule:
    return Rule(None, lambda x: x is None or bool(str(x).strip()), "a column name")


# What each augmentation policy switches on.
POLICIES: dict[str, dict[str, Any]] = {
    "none": {},
    "natural_default": {"crop": (0.6, 1.0), "hflip": True, "rot": 15, "bc": 0.3, "channel_jitter": 0.10, "noise": 0.02},
    "dermoscopy_default": {"crop": (0.7, 1.0), "hflip": True, "vflip": True, "rot": 180, "bc": 0.2, "channel_jitter": 0.0, "noise": 0.01},
    "satellite_default": {"crop": (0.6, 1.0), "hflip": True, "vflip": True, "rot90": True, "bc": 0.2, "channel_jitter": 0.05, "noise": 0.02},
}

RULES: dict[str, Rule] = {
    "loader": Rule("csv", *_among("csv", "imagefolder", "shapes")),
    "path_column": _text(),
    "label_column": _text(),
    "group_column": _text(),
    "image_size": Rule(128, lambda x: isinstance(x, int) and x > 0, "a positive whole number"),
    "augmentation": Rule("none", *_among(*POLICIES)),
    "splits.train": _share(0.8),
    "splits.val": _share(0.1),
    "splits.test": _share(0.1),
    "splits.seed": Rule(0, lambda x: isinstance(x, int), "a whole number"),
}

#: Rules over several settings: the path they are reported under, what must hold, and how it is said.
TOGETHER: list[tuple[str, Callable[[dict], bool], str]] = [
    ("splits", lambda s: abs(sum(s[f"splits.{n}"] for n in ("train", "val", "test")) - 1) <= 1e-6, "shares that sum to 1"),
    ("path_column", lambda s: s["loader"] != "csv" or s["path_column"] is not None, "given for the csv loader"),
]


def _flat(values: Mapping, at: str = "") -> dict[str, Any]:
    out = {}
    for name, value in values.items():
        path = f"{at}{name}"
        out |= _flat(value, path + ".") if isinstance(value, Mapping) else {path: value}
    return out


class Settings:
    """Values by dotted path, checked as a whole; ``settings.splits.seed`` and ``settings["splits.seed"]`` are the same."""

    def __init__(self, values: Mapping | None = None):
        given = _flat(values or {})
        strange = [path for path in given if path not in RULES]
        if strange:
            raise ConfigError(f"{strange[0]}: unknown; there are {', '.join(RULES)}")
        self._values = {path: given.get(path, rule.default) for path, rule in RULES.items()}
        broken = [(path, rule.says) for path, rule in RULES.items() if not rule.holds(self._values[path])]
        broken = broken or [(path, says) for path, holds, says in TOGETHER if not holds(self._values)]
        if broken:
            raise ConfigError("; ".join(f"{path}: must be {says}" for path, says in broken))

    def __getitem__(self, path: str):
        return self._values[path]

    def __getattr__(self, name: str):
        values = self.__dict__.get("_values", {})
        if name in values:
            return values[name]
        below = {path[len(name) + 1 :]: v for path, v in values.items() if path.startswith(name + ".")}
        if not below:
            raise AttributeError(name)
        return type("Section", (), below)

    def override(self, path: str, value: Any) -> Settings:
        """A copy with one value replaced, checked anew."""
        if path not in RULES:
            raise KeyError(f"no field {path!r}; there are {', '.join(RULES)}")
        return Settings(self._values | {path: value})


def policy(name: str) -> dict[str, Any]:
    """What an augmentation policy switches on; an unknown name is an error of its field."""
    return dict(POLICIES[Settings({"augmentation": name, "loader": "shapes"})["augmentation"]])


def normalization(channels: int, mean: tuple[float, ...] = (), std: tuple[float, ...] = ()) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Mean and deviation of each channel; what is not given is one half."""
    return tuple(mean) or (0.5,) * channels, tuple(std) or (0.5,) * channels


def backend(settings: Mapping[str, str], needed: tuple[str, ...] = ("metadata.url", "metadata.key"), forced: str = "metadata.document") -> str:
    """``document`` when it is forced or a credential is missing, else ``tables``."""
    return "document" if settings.get(forced) in ("1", "true") or not all(settings.get(name) for name in needed) else "tables"
