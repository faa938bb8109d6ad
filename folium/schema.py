"""Entity schemas and evaluation rules, read from YAML or JSON on the driver."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from .functions.similarity import MATCH_TYPES, MatchType, Score


@dataclass(frozen=True)
class Rule:
    """How a field is compared: strict, or by a match type (fuzzy, or a registered one) from a similarity on; normalised or raw."""

    match_type: str = "strict"
    normalization: bool = True
    similarity_threshold: float = 0.95

    @property
    def fuzzy(self) -> bool:
        return self.match_type in MATCH_TYPES

    @property
    def kind(self) -> MatchType | None:
        return MATCH_TYPES.get(self.match_type)

    @property
    def score(self) -> Score | None:
        return self.kind.score if self.kind else None


@dataclass(frozen=True)
class EntitySchema:
    """Names and types of an entity's fields; a type is `string` or starts with `array[`."""

    fields: dict[str, str] = field(default_factory=lambda: {"name": "string"})
    entity_name: str | None = None
    doc_id_field: str = "doc_id"
    entities_field: str = "authors"

    @property
    def arrays(self) -> list[str]:
        return [f for f, kind in self.fields.items() if kind.startswith("array[")]


@dataclass(frozen=True)
class EvalConfig:
    """Everything an evaluation needs to know."""

    schema: EntitySchema
    rules: dict[str, Rule] = field(default_factory=dict)
    key_field: str = "name"
    reporting_modes: tuple[str, ...] = ("strict",)
    harsh_penalty: bool = True
    task_name: str = ""

    def rule(self, name: str) -> Rule:
        return self.rules.get(name, Rule())

    @property
    def array_fields(self) -> list[str]:
        return [f for f in self.schema.arrays if f != self.key_field]

    @property
    def scalar_fields(self) -> list[str]:
        return [f for f in self.schema.fields if f != self.key_field and f not in self.schema.arrays]

    @property
    def entity_slug(self) -> str:
        name = self.schema.entity_name or self.schema.entities_field or "entity"
        return re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower() or "entity"


def schema_from(data: dict) -> EntitySchema:
    """From the dictionary form of a schema file."""
    fields = {k: (v.get("type", "string") if isinstance(v, dict) else str(v)) for k, v in data.get("fields", {}).items()}
    return EntitySchema(fields, data.get("entity_name"), data.get("doc_id_field", "doc_id"), data.get("entities_field", "authors"))


def config_from(data: dict, schema: EntitySchema) -> EvalConfig:
    """From the dictionary form of a configuration file; no reporting modes means strict."""
    rules = {k: Rule(v.get("match_type", "strict"), bool(v.get("normalization", True)), float(v.get("similarity_threshold", 0.95))) for k, v in (data.get("field_eval_rules") or {}).items()}
    modes = tuple(m for m in data.get("reporting_modes") or () if m in ("strict", "fuzzy")) or ("strict",)
    harsh = bool((data.get("combined_eval") or {}).get("harsh_penalty", True))
    return EvalConfig(schema, rules, data.get("key_field", "name"), modes, harsh, data.get("task_name", ""))


def load_config(path: str) -> EvalConfig:
    """Reads a YAML or JSON configuration; its schema path is relative to it."""
    data = _load(path)
    where = data["entity_schema_path"]
    where = where if os.path.isabs(where) else os.path.join(os.path.dirname(os.path.abspath(path)), where)
    return config_from(data, schema_from(_load(where)))


def load_prompt(path: str) -> str:
    """A prompt text without white space at its ends."""
    with open(path, encoding="utf-8") as f:
        return f.read().strip()


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)
