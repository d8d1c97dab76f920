"""Settings that follow from the machine or from text."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, fields

# Memory in GB that one page and each further page at a time take.
_BASE_GB, _PAGE_GB = 1.0, 0.75


def pages_at_once(memory_gb: float, cpus: int) -> int:
    """How many pages fit the memory, at least one and at most one per processor."""
    return max(1, min(cpus, math.floor((memory_gb - _BASE_GB) / _PAGE_GB)))


def retention_days(value: str | None, default: int) -> int:
    """Whole days, halves rounded up, none below 0; the default for what isn't a number."""
    try:
        number = float(value) if value is not None and value.strip() else float(default)
    except ValueError:
        return default
    return max(0, math.floor(number + 0.5)) if math.isfinite(number) else default


@dataclass(frozen=True)
class Settings:
    """Limits of the document plan; the operators take them as parameters."""

    blank_max_chars: int = 15
    blank_max_ink: float = 0.002
    window: int = 12
    step: int = 6
    review_confidence: str = "0.80"
    filename_pattern: str = "{title} {date}"
    no_date_label: str = "undated"
    drop_blank_pages: bool = True
    metadata_max_chars: int = 24_000
    ocr_chunk_pages: int = 50
    split: bool = True
    naming: bool = True
    upload: bool = False
    text_source: str = "service"

    @property
    def single_documents_first(self) -> bool:
        """Files that someone is waiting for go ahead of stacks."""
        return not self.split

    @property
    def asks_a_model(self) -> bool:
        """Whether files of this input depend on the account of a service, and so on its pause gate."""
        return self.text_source == "service" if self.upload else self.naming

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = "") -> Settings:
        """Settings by the names of their fields in upper case behind prefix; blank ones keep their default, others are checked."""
        found = {}
        for field in fields(cls):
            raw = env.get(f"{prefix}{field.name}".upper().replace("-", "_"), "").strip()
            if raw:
                found[field.name] = _parsed(field.name, raw, type(field.default))
        made = cls(**found)
        if made.step > made.window:
            raise ValueError("STEP must not be larger than WINDOW: pages between windows would not be seen")
        if "{title}" not in made.filename_pattern:
            raise ValueError("FILENAME_PATTERN must hold {title}")
        return made


#: The least that whole-number settings may be.
_LEAST = {"window": 2, "step": 1, "ocr_chunk_pages": 1, "metadata_max_chars": 1000}


def _parsed(name: str, raw: str, kind: type) -> object:
    try:
        if kind is bool:
            return {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}[raw.lower()]
        value = kind(raw)
    except (ValueError, KeyError):
        raise ValueError(f"{name.upper()} must be a {'yes or no' if kind is bool else 'number'}, got {raw!r}") from None
    if kind is float and not math.isfinite(value):
        raise ValueError(f"{name.upper()} must be a finite number, got {raw!r}")
    if kind in (int, float) and value < _LEAST.get(name, 0):
        raise ValueError(f"{name.upper()} must be at least {_LEAST.get(name, 0)}, got {raw}")
    return value
