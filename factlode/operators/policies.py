"""Traceability policies: the built-in ones, and the validation of a workspace's own."""

from __future__ import annotations

import hashlib

from .trace import MISSING, SEVERITY, Policy, Stage

# Built-in policies.
BUILTIN = {
    "generic-engineering": {
        "stages": [
            {"stage": "requirement", "entity_types": ["requirement", "business-rule", "constraint"], "required": True, "requires_evidence": False},
            {"stage": "design", "entity_types": ["design", "decision", "workflow"], "required": False, "requires_evidence": False},
            {"stage": "interface", "entity_types": ["interface", "data-model"], "required": False, "requires_evidence": False},
            {"stage": "implementation", "entity_types": ["code-component", "code-symbol", "configuration", "database-object", "message-topic"], "required": True, "requires_evidence": False},
            {"stage": "verification", "entity_types": ["acceptance-criterion", "test-case"], "required": True, "requires_evidence": False},
            {"stage": "evidence", "entity_types": ["test-result"], "required": False, "requires_evidence": True},
        ],
        "transitions": [
            {"from": "requirement", "to": "design", "relations": ["refines", "derived-from"]},
            {"from": "requirement", "to": "interface", "relations": ["refines", "contains", "derived-from"]},
            {"from": "requirement", "to": "implementation", "relations": ["implements", "partially-implements"]},
            {"from": "design", "to": "interface", "relations": ["refines", "contains"]},
            {"from": "design", "to": "implementation", "relations": ["implements", "partially-implements"]},
            {"from": "interface", "to": "implementation", "relations": ["implements", "partially-implements", "configures"]},
            {"from": "implementation", "to": "verification", "relations": ["verifies"]},
            {"from": "requirement", "to": "verification", "relations": ["verifies"]},
            {"from": "verification", "to": "evidence", "relations": ["evidenced-by", "verifies"]},
        ],
    },
    "api-service": {
        "stages": [
            {"stage": "requirement", "entity_types": ["requirement", "business-rule"], "required": True, "requires_evidence": False},
            {"stage": "design", "entity_types": ["design", "decision", "constraint", "workflow"], "required": False, "requires_evidence": False},
            {"stage": "interface", "entity_types": ["interface", "data-model"], "required": True, "requires_evidence": False},
            {"stage": "implementation", "entity_types": ["code-component", "code-symbol", "configuration", "database-object", "message-topic"], "required": True, "requires_evidence": False},
            {"stage": "verification", "entity_types": ["acceptance-criterion", "test-case"], "required": True, "requires_evidence": False},
            {"stage": "evidence", "entity_types": ["test-result"], "required": True, "requires_evidence": True},
        ],
        "transitions": [
            {"from": "requirement", "to": "design", "relations": ["refines", "derived-from"]},
            {"from": "requirement", "to": "interface", "relations": ["refines", "contains"]},
            {"from": "design", "to": "interface", "relations": ["refines", "contains"]},
            {"from": "interface", "to": "implementation", "relations": ["implements", "partially-implements", "configures"]},
            {"from": "implementation", "to": "verification", "relations": ["verifies"]},
            {"from": "verification", "to": "evidence", "relations": ["evidenced-by", "verifies"]},
        ],
    },
    "event-driven-service": {
        "stages": [
            {"stage": "requirement", "entity_types": ["requirement", "business-rule"], "required": True, "requires_evidence": False},
            {"stage": "design", "entity_types": ["design", "decision", "workflow"], "required": False, "requires_evidence": False},
            {"stage": "interface", "entity_types": ["interface", "message-topic", "data-model"], "required": True, "requires_evidence": False},
            {"stage": "implementation", "entity_types": ["code-component", "code-symbol", "configuration", "database-object"], "required": True, "requires_evidence": False},
            {"stage": "verification", "entity_types": ["acceptance-criterion", "test-case"], "required": True, "requires_evidence": False},
            {"stage": "evidence", "entity_types": ["test-result"], "required": False, "requires_evidence": True},
        ],
        "transitions": [
            {"from": "requirement", "to": "design", "relations": ["refines", "derived-from"]},
            {"from": "requirement", "to": "interface", "relations": ["refines", "contains"]},
            {"from": "design", "to": "interface", "relations": ["refines", "contains"]},
            {"from": "interface", "to": "implementation", "relations": ["implements", "partially-implements", "publishes", "consumes", "configures"]},
            {"from": "implementation", "to": "verification", "relations": ["verifies"]},
            {"from": "verification", "to": "evidence", "relations": ["evidenced-by", "verifies"]},
        ],
    },
    "batch-processing": {
        "stages": [
            {"stage": "requirement", "entity_types": ["requirement", "business-rule"], "required": True, "requires_evidence": False},
            {"stage": "workflow", "entity_types": ["workflow", "batch-job"], "required": True, "requires_evidence": False},
            {"stage": "data", "entity_types": ["data-model", "database-object"], "required": False, "requires_evidence": False},
            {"stage": "implementation", "entity_types": ["code-component", "code-symbol", "configuration"], "required": True, "requires_evidence": False},
            {"stage": "verification", "entity_types": ["acceptance-criterion", "test-case"], "required": True, "requires_evidence": False},
            {"stage": "evidence", "entity_types": ["test-result"], "required": False, "requires_evidence": True},
        ],
        "transitions": [
            {"from": "requirement", "to": "workflow", "relations": ["refines", "derived-from", "contains"]},
            {"from": "workflow", "to": "data", "relations": ["reads", "writes", "contains", "refines"]},
            {"from": "workflow", "to": "implementation", "relations": ["implements", "partially-implements"]},
            {"from": "data", "to": "implementation", "relations": ["implements", "configures"]},
            {"from": "implementation", "to": "verification", "relations": ["verifies"]},
            {"from": "verification", "to": "evidence", "relations": ["evidenced-by", "verifies"]},
        ],
    },
    "japanese-v-model": {
        "stages": [
            {"stage": "requirement", "entity_types": ["requirement", "business-rule"], "required": True, "requires_evidence": False},
            {"stage": "design", "entity_types": ["design", "decision", "constraint"], "required": True, "requires_evidence": False},
            {"stage": "interface", "entity_types": ["interface", "data-model"], "required": False, "requires_evidence": False},
            {"stage": "implementation", "entity_types": ["code-component", "code-symbol", "configuration", "database-object", "message-topic"], "required": True, "requires_evidence": False},
            {"stage": "verification", "entity_types": ["test-case", "acceptance-criterion"], "required": True, "requires_evidence": False},
            {"stage": "test-result", "entity_types": ["test-result"], "required": True, "requires_evidence": True},
        ],
        "transitions": [
            {"from": "requirement", "to": "design", "relations": ["refines", "derived-from"]},
            {"from": "design", "to": "interface", "relations": ["refines", "contains"]},
            {"from": "design", "to": "implementation", "relations": ["implements", "partially-implements"]},
            {"from": "interface", "to": "implementation", "relations": ["implements", "partially-implements", "configures"]},
            {"from": "implementation", "to": "verification", "relations": ["verifies"]},
            {"from": "verification", "to": "test-result", "relations": ["evidenced-by", "verifies"]},
        ],
    },
}


def read(declared: dict, **rules) -> Policy:
    """A policy from its stages and transitions, as in BUILTIN; rules are further fields of Policy. Errors are raised together."""
    stages = [Stage(s["stage"], tuple(s["entity_types"]), s.get("required", False), s.get("requires_evidence", False)) for s in declared.get("stages", [])]
    transitions = [(t["from"], t["to"], tuple(t["relations"])) for t in declared.get("transitions", [])]
    errors = [f"no entity types in stage {s.name}" for s in stages if not s.entity_types]
    errors += [f"no relations from {a} to {b}" for a, b, names in transitions if not names]
    known = [s.name for s in stages]
    errors += [f"unknown stage {n}" for a, b, _ in transitions for n in (a, b) if n not in known]
    errors += [f"unknown stage name {n}" for n in known[1:] if n not in MISSING]
    errors += [f"stage {n} is given twice" for n in {n for n in known if known.count(n) > 1}]
    errors += [f"a transition may not go from {a} back to {b}" for a, b, _ in transitions if a in known and b in known and known.index(a) >= known.index(b)]
    levels = {*SEVERITY.values(), "critical"}
    errors += [f"unknown severity {v}" for v in rules.get("severities", {}).values() if v not in levels]
    if not stages or not stages[0].required:
        errors.append("the first stage must be required")
    reached = set(known[:1])
    for _ in known:
        reached |= {b for a, b, _ in transitions if a in reached}
    errors += [f"required stage {s.name} can't be reached" for s in stages if s.required and s.name not in reached]
    if errors:
        raise ValueError("; ".join(errors))
    canonical = "\n".join([*(f"{s}" for s in stages), *(f"{t}" for t in sorted(transitions)), *(f"{k}={v}" for k, v in sorted(rules.items()))])
    return Policy(tuple(stages), tuple(transitions), checksum=hashlib.sha256(canonical.encode()).hexdigest(), **rules)


def builtin(name: str, **rules) -> Policy:
    """A built-in policy by name."""
    return read(BUILTIN[name], **rules)
