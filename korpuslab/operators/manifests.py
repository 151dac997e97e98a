"""Identities and manifests of runs: one table says what each kind is made of.

Inputs are plain mappings. Equal inputs have one identity, however their keys are
ordered and whether their sequences are lists or tuples.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import PurePath
from typing import Any


@dataclass(frozen=True)
class Kind:
    schema: str
    id_field: str
    prefix: str
    fields: tuple[str, ...]


#: The names of the inputs of each kind, which enter its digest, and the prefix of its identity.
KINDS = {
    "transcription": Kind("korpuslab-transcription/v1", "transcription_run_id", "tr-", ("source_fingerprints", "benchmark_content_id", "model_repository", "model_revision", "dependency_lock_hash", "decoding_settings", "seed", "device_policy")),
    "evaluation": Kind("korpuslab-evaluation/v1", "evaluation_id", "ev-", ("hypothesis_checksums", "eligibility_manifest_checksum", "normalizer_version", "baseline_config_hash", "audit_disposition_hash", "decision_gate_config_hash")),
}


def _default(value: Any) -> Any:
    """What JSON has no form for: paths, and mappings and sets that are no dictionaries or lists."""
    if isinstance(value, PurePath):
        return value.as_posix()
    if isinstance(value, Mapping):
        return dict(value)
    raise TypeError(f"{type(value).__name__} has no place in a manifest")


def canonical(value: Any) -> str:
    """JSON without spaces, keys as text in order, beyond ASCII as it is."""
    plain = json.loads(json.dumps(value, default=_default, ensure_ascii=False))
    return json.dumps(plain, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def checked(kind: str, inputs: Mapping[str, Any]) -> dict[str, Any]:
    """The inputs in the order of their kind; none may be absent or unknown."""
    fields = KINDS[kind].fields
    if odd := sorted(set(fields).symmetric_difference(inputs)):
        raise ValueError(f"a {kind} manifest is not made of these inputs: {', '.join(odd)}")
    return {name: inputs[name] for name in fields}


def identity(kind: str, inputs: Mapping[str, Any]) -> str:
    return KINDS[kind].prefix + hashlib.sha256(canonical(checked(kind, inputs)).encode()).hexdigest()[:24]


def manifest(kind: str, inputs: Mapping[str, Any], created_at: str, own_id: str | None = None) -> dict[str, Any]:
    """The inputs with a schema tag, the identity (or the caller's own) and the caller's time."""
    tag = KINDS[kind]
    return {"schema_version": tag.schema, tag.id_field: own_id or identity(kind, inputs), "created_at": created_at, **json.loads(canonical(checked(kind, inputs)))}
