"""Reports of collected metrics, as mappings and as Markdown."""

from __future__ import annotations

from datetime import datetime, timezone

from panelwright.operators.sampling import GATE


def now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat().replace("+00:00", "Z")


def can_enter(metrics: dict | None) -> bool:
    """Whether metrics open the gate; what is missing or no number closes it."""
    try:
        reached = all(float(metrics[c]) >= least for c, least in GATE.items())
    except (TypeError, KeyError, ValueError):
        return False
    return reached and str(metrics.get("coverage_conclusion", "")).strip().lower() == "sufficient"


def with_gate(report: dict) -> dict:
    """The report with its gate computed anew: open only if the formal run is complete and its metrics suffice."""
    gate = dict(report.get("stage_gate", {}))
    done = bool(gate.get("complete", report.get("execution", {}).get("complete", False)))
    return report | {"stage_gate": gate | {"complete": done, "can_enter": done and can_enter(report.get("metrics"))}}


def feasibility_report(mode: str, seed: int, counts: dict, histogram: dict, metrics: dict, lineage: dict, manifests: list[dict], complete: bool) -> dict:
    return with_gate({"created": now(), "mode": mode, "seed": seed, "candidates": counts, "monthly": histogram, "execution": {"complete": complete}, "metrics": metrics, "lineage": lineage, "inputs": manifests})


def run_summary(mode: str, totals: dict, shards: list[dict], outputs: list[dict]) -> dict:
    return {"created": now(), "mode": mode, "totals": totals, "shards": shards, "outputs": outputs}


def markdown(title: str, report: dict) -> str:
    """Scalars as a list, mappings as sections, lists of mappings as tables."""
    lines = [f"# {title}", ""]
    lines += [f"- {k}: {v}" for k, v in report.items() if not isinstance(v, (dict, list))]
    for k, v in report.items():
        if isinstance(v, dict):
            lines += ["", f"## {k}", "", *[f"- {a}: {b}" for a, b in v.items()]]
        elif isinstance(v, list):
            lines += ["", f"## {k}", ""]
            if v and all(isinstance(x, dict) for x in v):
                columns = list(dict.fromkeys(c for x in v for c in x))
                lines += ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(str(x.get(c, "")) for c in columns) + " |" for x in v]]
            else:
                lines += [f"- {x}" for x in v]
    return "\n".join(lines) + "\n"
