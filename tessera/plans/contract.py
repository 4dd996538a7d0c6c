"""Data contracts: fields, clauses and metadata, with YAML and dbt forms. All of it is small and lives on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import yaml

# Fixed severities of field checks.
SEVERITY = {"required": "CRITICAL", "type": "CRITICAL", "range": "CRITICAL", "enum": "HIGH", "format": "HIGH", "pattern": "HIGH", "drift": "MEDIUM"}
_CLAUSE_SEVERITY = {"error": "CRITICAL", "warn": "WARNING", "warning": "WARNING", "info": "LOW"}
_DBT_TYPE = {"integer": "int", "number": "float", "string": "string", "boolean": "boolean"}
_WRITTEN = ("type", "required", "format", "pattern", "minimum", "maximum", "enum", "description")


@dataclass
class FieldRule:
    type: str | None = None
    required: bool = False
    format: str | None = None
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    enum: list | None = None
    description: str | None = None
    stats: dict[str, float] | None = None

    def as_dict(self) -> dict[str, Any]:
        return {name: getattr(self, name) for name in _WRITTEN if getattr(self, name) not in (None, False)}


@dataclass
class Clause:
    id: str
    rule: dict[str, Any]
    severity: str = "error"
    description: str = ""

    @property
    def level(self) -> str:
        return _CLAUSE_SEVERITY.get(self.severity, "HIGH")


@dataclass
class Contract:
    id: str
    version: str = "1.0.0"
    fields: dict[str, FieldRule] = field(default_factory=dict)
    clauses: list[Clause] = field(default_factory=list)
    meta: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Contract:
        rules = d.get("fields") or d.get("schema") or {}
        known = set(FieldRule.__dataclass_fields__)
        fields = {n: FieldRule(**{k: v for k, v in (r or {}).items() if k in known}) for n, r in rules.items()}
        clauses = [Clause(c["id"], c["rule"], c.get("severity", "error"), c.get("description", "")) for c in d.get("clauses") or []]
        version = str(d.get("schema_version") or (d.get("info") or {}).get("version") or "1.0.0")
        meta = {k: v for k, v in d.items() if k not in ("id", "fields", "schema", "clauses", "schema_version", "info")}
        return cls(d["id"], version, fields, clauses, meta)

    def as_dict(self) -> dict[str, Any]:
        clauses = [{"id": c.id, "severity": c.severity, "description": c.description, "rule": c.rule} for c in self.clauses]
        return {"id": self.id, "schema_version": self.version, "fields": {n: r.as_dict() for n, r in sorted(self.fields.items())}, "clauses": clauses} | self.meta

    @classmethod
    def from_yaml(cls, text: str) -> Contract:
        return cls.from_dict(yaml.safe_load(text))

    def to_yaml(self) -> str:
        return yaml.safe_dump(self.as_dict(), sort_keys=False, allow_unicode=True)

    def to_dbt(self) -> str:
        """The dbt schema file of the same fields; an integer is an int and a number a float there."""
        columns = []
        for name, rule in sorted(self.fields.items()):
            tests: list[Any] = ["not_null"] if rule.required else []
            if rule.enum:
                tests.append({"accepted_values": {"values": list(rule.enum)}})
            columns.append({"name": name, "data_type": _DBT_TYPE.get(rule.type or "string", "string"), "tests": tests})
        return yaml.safe_dump({"version": 2, "models": [{"name": self.id.replace("-", "_"), "columns": columns}]}, sort_keys=False)
