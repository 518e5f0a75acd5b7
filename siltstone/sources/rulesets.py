"""Loading rule sets."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from siltstone.functions.rules import RuleSet, violations


def load_rules(text: str, fmt: str = "json") -> dict[str, RuleSet]:
    """``{table: {column: {rule: value}}}`` from ``{"validation": {table: {"columns": …}}}`` text.

    An empty document is an error. YAML is read where a YAML package is installed.
    """
    if fmt == "yaml":
        import yaml

        loaded: Mapping[str, Any] | None = yaml.safe_load(text)
    else:
        loaded = json.loads(text) if text.strip() else None
    if not loaded:
        raise ValueError("the rule set is empty")
    rule_sets = {table: body["columns"] for table, body in loaded["validation"].items()}
    for columns in rule_sets.values():
        for name, rules in columns.items():
            violations_known(name, rules)
    return rule_sets


def violations_known(name: str, rules: Mapping[str, Any]) -> None:
    """Raise early, on the driver, for a rule nobody knows."""
    violations(name, {rule: None for rule in rules})


def read_rules(path: str) -> dict[str, RuleSet]:
    """Rule sets from a small driver-side file, by its suffix."""
    file = Path(path)
    return load_rules(file.read_text(encoding="utf-8"), "yaml" if file.suffix in (".yml", ".yaml") else "json")
