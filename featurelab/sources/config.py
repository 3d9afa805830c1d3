"""Run configuration from a YAML-like mapping."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

METRICS = ("rmse", "mae", "auc", "logloss", "f1", "accuracy")


@dataclass(frozen=True)
class Config:
    data_path: str
    target: str
    metric: str = "rmse"
    date_col: str | None = None
    exclude_columns: tuple[str, ...] = ()
    categorical_columns: tuple[str, ...] = ()
    n_folds: int = 5
    random_seed: int = 42
    time_budget_minutes: int = 60
    min_delta: float = 0.001
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {', '.join(METRICS)}")
        if self.n_folds < 2:
            raise ValueError("n_folds must be 2 or more")

    @property
    def higher_is_better(self) -> bool:
        return self.metric in ("auc", "f1", "accuracy")


def from_mapping(values: dict) -> Config:
    """Unknown keys are kept in `extra`; lists become tuples."""
    known = {f.name for f in fields(Config)} - {"extra"}
    clean = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}
    return Config(**clean, extra={k: v for k, v in values.items() if k not in known})


def load(path: str) -> Config:
    """A flat YAML file of scalars and lists ("- item" lines or [a, b])."""
    values: dict = {}
    key = None
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = _uncommented(line).rstrip()
            if not line or line.lstrip().startswith("#"):
                continue
            if line.lstrip().startswith("- ") and key:
                if not isinstance(values.get(key), list):
                    values[key] = []
                values[key].append(_scalar(line.lstrip()[2:]))
            elif not line.startswith(" ") and ":" in line:
                key, _, rest = line.partition(":")
                key, rest = key.strip(), rest.strip()
                values[key] = [_scalar(x) for x in rest[1:-1].split(",") if x.strip()] if rest.startswith("[") else _scalar(rest) if rest else None
    return from_mapping({k: v for k, v in values.items() if v is not None})


def _uncommented(line: str) -> str:
    """The line up to a # that begins a word outside quotes."""
    quote = ""
    for i, ch in enumerate(line):
        before = line[i - 1] if i else " "
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"" and before in " \t[,":
            quote = ch
        elif ch == "#" and before in " \t":
            return line[:i]
    return line


def dump(values: dict) -> str:
    """A flat mapping as load() reads it; texts that would be read as something else are quoted."""
    def scalar(v) -> str:
        if v is None or isinstance(v, bool):
            return {None: "null", True: "true", False: "false"}[v]
        text = str(v)
        plain = not isinstance(v, str) or (_scalar(text) == text and _uncommented(text) == text and text == text.strip() and not text.startswith("[") and "," not in text)
        return text if plain else f'"{text}"'

    lines = [f"{k}: [{', '.join(map(scalar, v))}]" if isinstance(v, list | tuple) else f"{k}: {scalar(v)}" for k, v in values.items()]
    return "\n".join(lines) + "\n"


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.lower() in ("null", "~", ""):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text
