"""Registered queries: operators bound to tables, each with its SQL."""

from . import changes, deltas, evidence, findings, gates, reports, scalar, selection, streams, verdicts  # noqa: F401
from .catalog import QUERIES, SQL, comparable

for _name, _kinds in {
    "prj7_prj8_set3_resolve_key": {"lists": ("sources", "conflicts", "mentioned")},
    "prj9_prj10_credits": {"lists": ("authors", "reviewers")},
    "prj18_identifiers": {"lists": ("ids",)},
    "src1_changes": {"lists": ("labels",)},
    "src2_trailers": {"lists": ("trailers",)},
    "src21_git_log": {"lists": ("parents",)},
    "src32_commit_list": {"lists": ("paths",)},
    "agg1_agg2_triage": {"lists": ("subsystems", "surfaces")},
    "agg8_related_tickets": {"days": ("last_changed",)},
    "agg9_experts": {"days": ("latest",)},
    "agg9_expert_totals": {"days": ("latest",)},
    "agg24_recommend": {"lists": ("reasons", "waiting_on")},
    "agg35_first_linked_day": {"days": ("day",)},
    "agg40_emails": {"lists": ("emails",)},
    "agg41_provenance": {"lists": ("models",), "times": ("newest",)},
    "fuz4_win10_win11_issues": {"lists": ("spread", "lenses", "locations", "members")},
    "jon20_author_keys": {"lists": ("authors",)},
    "win7_baseline": {"days": ("day",)},
    "win8_keep_newest": {"times": ("ts",)},
    "win13_group_order": {"lists": ("groups",)},
}.items():
    comparable(_name, **_kinds)
