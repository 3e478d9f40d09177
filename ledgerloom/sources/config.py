"""Configuration: file values over defaults, environment over both; coerced to the kind of the default."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

PREFIX = "LEDGERLOOM_"


@dataclass(frozen=True)
class Config:
    engine: str = "auto"
    confidence_threshold: float = 0.3
    y_tolerance: float = 60.0
    product_accept: float = 0.85
    customer_accept: float = 0.80
    top_products: int = 5
    top_customers: int = 3
    as_of_year: int = 2026
    audit_enabled: bool = True
    retention_days: int = 90
    api_base_url: str = ""
    engines: tuple[str, ...] = field(default=("gemini", "claude", "easyocr", "tesseract"))


def coerced(text: str, like: object) -> object:
    if isinstance(like, bool):
        return text.strip().lower() in ("true", "1", "yes", "on")
    if isinstance(like, tuple):
        return tuple(x.strip() for x in text.split(",") if x.strip())
    return type(like)(text)


def load(path: str | None = None, environ: Mapping[str, str] | None = None) -> Config:
    """Unknown keys are ignored, and so are empty variables."""
    out, known = Config(), asdict(Config())
    if path and Path(path).exists():
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        out = replace(out, **{k: tuple(v) if isinstance(v, list) else v for k, v in told.items() if k in known})
    env = os.environ if environ is None else environ
    return replace(out, **{k: coerced(env[PREFIX + k.upper()], v) for k, v in known.items() if env.get(PREFIX + k.upper())})


def issues(c: Config) -> list[str]:
    out = [f"{k} must be from 0 to 1" for k in ("confidence_threshold", "product_accept", "customer_accept") if not 0 <= getattr(c, k) <= 1]
    out += [f"{k} must be positive" for k in ("y_tolerance", "top_products", "top_customers", "retention_days") if getattr(c, k) <= 0]
    return out + ([] if c.engine == "auto" or c.engine in c.engines else [f"unknown engine {c.engine}"])


def choose_engine(wanted: str, available: list[str], c: Config | None = None) -> str | None:
    """The wanted engine, by name or the start of a name; with auto the first of the configured order that is there."""
    order = (c or Config()).engines
    if wanted != "auto":
        return next((a for a in available if a == wanted or a.startswith(wanted)), None)
    return next((a for e in order for a in available if a.startswith(e)), available[0] if available else None)
