"""Configuration packs: rules, the evidence library and playbooks, read from YAML by the driver.

Packs are a few hundred entries that compile into plans as constants; only
their validated rows become DataFrames.  A missing or broken file gives an
empty pack, never an error.
"""

from __future__ import annotations

import json
import logging
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The packs that come with the library.
HOME = Path(__file__).resolve().parent.parent / "packs"
log = logging.getLogger(__name__)

EVIDENCE = "rule_id string, acceptable_evidence array<string>, acceptable_substitutes array<string>, closure_logic string, waivable boolean, waiver_guidance string, notes string"
PLAYBOOK = "playbook string, regimes array<string>, hard_stops array<string>, evidence array<struct<code:string,label:string>>"


def mapping(path: str | Path) -> dict:
    """The file's root mapping; without a YAML library, its JSON subset is read."""
    try:
        from yaml import safe_load as load
    except ImportError:
        load = json.loads
    try:
        found = load(Path(path).read_text("utf-8")) or {}
    except Exception as e:  # noqa: BLE001  whatever is wrong with the file, the pack is empty
        log.error("%s can't be read: %s", path, e)
        return {}
    if not isinstance(found, dict):
        log.error("%s: the root is no mapping", path)
        return {}
    return found


def rule_list(path: str | Path) -> list:
    rules = mapping(path).get("rules", [])
    if not isinstance(rules, list):
        log.error("%s: 'rules' is no list", path)
        return []
    return rules


def _evidence(rule_id: str, entry: dict | None) -> tuple:
    """One entry in today's terms; older names are read where those are missing."""
    e = entry or {}
    first = lambda *names, other: next((e[n] for n in names if e.get(n)), other)
    return rule_id, list(first("acceptable_evidence", "primary", other=[])), list(first("acceptable_substitutes", "substitutes", other=[])), first("closure_logic", other="any_of"), bool(e.get("waivable", True)), first("waiver_guidance", "notes", other=""), first("notes", other="")


def evidence_library(spark: SparkSession, path: str | Path) -> DataFrame:
    """A row for each rule; of a rule in both parts of the file, the legacy part's."""
    root = mapping(path)
    parts = [root.get("rules") or root.get("by_rule"), root.get("evidence_options")]
    rows = {k: _evidence(k, v) for part in parts if isinstance(part, dict) for k, v in part.items()}
    return spark.createDataFrame(list(rows.values()), EVIDENCE)


@lru_cache(maxsize=16)
def _playbooks(path: str) -> tuple:
    found = mapping(path).get("playbooks", [])
    return tuple((p.get("id"), [r.upper() for r in p.get("regimes", [])], p.get("hard_stops", []), [(e.get("code"), e.get("label")) for e in p.get("required_evidence", [])]) for p in found if isinstance(p, dict))


def playbooks(spark: SparkSession, path: str | Path) -> DataFrame:
    """A row for each playbook, its regimes in upper case; a file is read once in a process."""
    return spark.createDataFrame(list(_playbooks(str(path))), PLAYBOOK)
