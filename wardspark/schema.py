"""Table schemas, one place for readers, ``from_json`` and tests."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN_DDL = "struct<start:int,end:int,label:string>"
FINDING_DDL = (
    "struct<detector:string,detected:boolean,score:double,severity:string,action:string,"
    "summary:string,category:string,spans:array<struct<start:int,end:int,label:string>>,"
    "evidence:string,elapsed_ms:double,error:string,threats:array<string>>"
)
TRACE_DDL = (
    "struct<policy_id:string,policy_version:string,rule_id:string,matched:boolean,"
    "action:string,elapsed_ms:double,note:string>"
)
CELL_DDL = (
    "struct<threat:string,likelihood:int,impact:int,score:int,band:string,"
    "residual_likelihood:int,residual_score:int,residual_band:string,mitigated:boolean,detectors:array<string>>"
)
RISK_DDL = (
    "struct<likelihood:int,impact:int,score:int,band:string,inherent_score:int,inherent_band:string,"
    f"primary:string,action:string,threats:array<{CELL_DDL}>>"
)
AUDIT_EVENT_DDL = (
    "event_id string, correlation_id string, timestamp_ms bigint, stage string, action string, "
    "severity string, application string, environment string, sdk_version string, schema_version string, "
    "instance_id string, session_id string, principal_id string, principal_roles array<string>, tenant string, "
    "model string, provider string, trace_id string, span_id string, policy_version string, "
    f"findings array<{FINDING_DDL}>, policy_traces array<{TRACE_DDL}>, prompt string, response string, "
    "redacted_fields array<string>, latency_ms double, tokens_in int, tokens_out int, error string, "
    f"tags map<string,string>, threats array<string>, risk {RISK_DDL}"
)


def audit_event_schema() -> T.StructType:
    """The audit event as shipped, parsed without a running session."""
    return T.StructType.fromDDL(AUDIT_EVENT_DDL)
