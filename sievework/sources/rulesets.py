"""Rule sets in YAML, read and checked on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from sievework.functions.regex import Rx

#: The score of a rule that names none, by category.
CATEGORY_SCORES = {"injection": 0.35, "sensitive_data": 0.2, "policy": 0.2}
#: Syntax that Python reads and Java does not.
_PYTHON_ONLY = re.compile(r"\(\?P[<=>]|\(\?\(")


@dataclass(frozen=True)
class RegexRule:
    rule_id: str
    flag: str
    category: str
    score: float
    pattern: str
    description: str = ""

    @property
    def rx(self) -> Rx:
        return Rx(self.pattern, "i")


def parse_rule(raw: Any, number: int, max_pattern_length: int = 2048) -> RegexRule:
    if not isinstance(raw, dict):
        raise ValueError(f"Regex rule #{number} must be a mapping.")
    name = str(raw.get("id") or raw.get("name") or "").strip()
    flag, pattern = str(raw.get("flag") or "").strip(), str(raw.get("pattern") or "")
    if not name:
        raise ValueError(f"Regex rule #{number} is missing 'id'.")
    for field, value in (("flag", flag), ("pattern", pattern)):
        if not value:
            raise ValueError(f"Regex rule '{name}' is missing '{field}'.")
    if len(pattern) > max_pattern_length:
        raise ValueError(f"Regex rule '{name}' pattern is too long ({len(pattern)}; max {max_pattern_length}).")
    category = str(raw.get("category") or "policy").strip()
    score = float(raw.get("score", CATEGORY_SCORES.get(category, 0.2)))
    if not 0 < score <= 1:
        raise ValueError(f"Regex rule '{name}' score must be > 0 and <= 1.")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"Regex rule '{name}' has an invalid pattern: {e}") from e
    if _PYTHON_ONLY.search(pattern):
        raise ValueError(f"Regex rule '{name}' has an invalid pattern: it uses syntax that Java's expressions lack")
    return RegexRule(name, flag, category, score, pattern, str(raw.get("description") or ""))


def load_rules(path: str | Path, max_bytes: int = 256_000, max_rules: int = 500, max_pattern_length: int = 2048) -> tuple[RegexRule, ...]:
    """The rules of a YAML file, in order; sizes are checked before anything is parsed."""
    import yaml

    if min(max_bytes, max_rules, max_pattern_length) <= 0:
        raise ValueError("Limits of regex rule sets must be positive.")
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"Regex rule set not found: {path}")
    if path.stat().st_size > max_bytes:
        raise ValueError(f"Regex rule set is too large ({path.stat().st_size} bytes; max {max_bytes}).")
    data = yaml.safe_load(path.read_text(encoding="utf-8"))
    found = data.get("rules") if isinstance(data, dict) else None
    if not isinstance(found, list):
        raise ValueError("Regex rule set must hold a list 'rules'.")
    if len(found) > max_rules:
        raise ValueError(f"Regex rule set has too many rules ({len(found)}; max {max_rules}).")
    return tuple(parse_rule(raw, n, max_pattern_length) for n, raw in enumerate(found, 1))
