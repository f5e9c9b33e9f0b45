"""Which scans run at which boundary, and running them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from wardspark.operators import detectors as _detectors  # noqa: F401 - fills the registry
from wardspark.operators.policy import Policy
from wardspark.operators.scan import REGISTRY, Detector, ScanInput, run_scans

# Scans of each boundary, in reporting order.
_RUNTIME = ("code_execution", "token_flow", "secrets", "prompt_injection", "authority_claim")
STAGE_SCANS = {
    "input": ("resource_abuse", "secrets", "pii", "banned_topics", "prompt_injection", "authority_claim", "trajectory"),
    "output": ("secret_leakage", "system_prompt_leakage", "unsafe_output", "pii", "banned_topics", "groundedness"),
    "stream": ("secret_leakage", "system_prompt_leakage", "unsafe_output", "banned_topics", "prompt_injection"),
    "tool_call": _RUNTIME,
    "tool_result": _RUNTIME,
    "retrieval": ("prompt_injection", "authority_claim", "secrets", "token_flow"),
    "memory_write": ("token_flow", "prompt_injection", "secrets", "pii"),
    "memory_read": (),
    "tool_definition": ("tool_poisoning", "secrets"),
}


def tuned(name: str, det: Detector, policy: Policy | None) -> dict[str, Any]:
    """Scan options after a policy's overrides; a policy may tune a scan, never enable one."""
    opts = dict(det.options)
    spec = dict(policy.detectors.get(name, {})) if policy else {}
    if "threshold" in spec:
        opts["threshold"] = spec["threshold"]
    if "action" in spec:
        opts["override_action"] = spec["action"]
    opts.update(spec.get("options") or {})
    return opts


def scan_all(
    df: DataFrame,
    data: ScanInput,
    *,
    policy: Policy | None = None,
    names: Sequence[str] | None = None,
    options: Mapping[str, Mapping[str, Any]] | None = None,
    out: str = "findings",
) -> DataFrame:
    """Run a boundary's scans; findings end up in one array column, in order. No shuffle."""
    scans = []
    for name in names if names is not None else STAGE_SCANS.get(data.stage, ()):
        det = REGISTRY[name]
        wanted = (options or {}).get(name)
        if data.stage not in det.stages or not (det.enabled or wanted is not None):
            continue
        scans.append(det.build(data, {**tuned(name, det, policy), **(wanted or {})}))
    return run_scans(df, scans, out)
