"""The ledger of a skill's versions: one small JSON document, appended to by each decision about an edit."""

from __future__ import annotations

import json
from pathlib import Path

from corpusforge.sources.catalog import InterchangeError


def load_ledger(path: str) -> dict | None:
    """The ledger at path, or None where there is none yet."""
    place = Path(path)
    if not place.exists():
        return None
    try:
        found = json.loads(place.read_text(encoding="utf-8"))
        versions = {v["version"] for v in found["iterations"]}
        sound = isinstance(found["skill_name"], str) and found["current_best"] in versions
    except (OSError, ValueError, KeyError, TypeError) as error:
        raise InterchangeError(f"{path} isn't a ledger") from error
    if not sound:
        raise InterchangeError(f"{path} names no best version of its own")
    return found


def _version(number: int, parent: str | None, rate: float, grade: str, best: bool) -> dict:
    return {"version": f"v{number}", "parent": parent, "expectation_pass_rate": rate, "grading_result": grade, "is_current_best": best}


def with_decision(ledger: dict | None, skill: str, decision: dict, started_at: str) -> dict:
    """A new ledger with the decision (accepted, before and after held-out rates) as its last version.

    The first decision also makes the baseline v0. An accepted edit becomes the best; a rejected one leaves the best as it is.
    """
    if ledger is not None and ledger["skill_name"] != skill:
        raise InterchangeError(f"the ledger is that of {ledger['skill_name']}, not of {skill}")
    past = [_version(0, None, decision["before"], "baseline", True)] if ledger is None else ledger["iterations"]
    best = "v0" if ledger is None else ledger["current_best"]
    won = bool(decision["accepted"])
    new = _version(len(past), best, decision["after"], "won" if won else "lost", won)
    kept = [{**v, "is_current_best": False} if won else v for v in past]
    return {"started_at": started_at if ledger is None else ledger["started_at"], "skill_name": skill, "current_best": new["version"] if won else best, "iterations": [*kept, new]}


def write_ledger(ledger: dict, path: str) -> None:
    Path(path).write_text(json.dumps(ledger, indent=2, sort_keys=True) + "\n", encoding="utf-8")
