"""Rules over functions, tests and calls, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import clamp, weighted

# Patterns of entry points, tried in this order after the export flag.
ENTRY_NAMES = "^(main|createApp|createServer|Application|WebApplication|gin\\.Default|cli|run_cli|parse_args)$"
ENTRY_FILES = "(?i)(main|index|app|server|boot|startup)\\."
ENTRY_IN_FILES = "(?i)^(main|run|start|init|bootstrap|app|createapp|createserver|application|default)$"
ENTRY_TESTS = "(?i)^(test|it_|spec_)"

# Gaps in error handling: kind -> (CWE, severity).
ERROR_GAPS = {"empty_catch": (390, "high"), "generic_catch": (396, "medium"), "unhandled": (248, "high"), "swallowed": (390, "medium"), "unhandled_async": (248, "high")}


def entry_point(name: Column, path: Column, exported: Column) -> Column:
    """Why a function is an entry point, or null."""
    return (
        F.when(exported, "exported").when(path.rlike(ENTRY_FILES) & name.rlike(ENTRY_IN_FILES), "main").when(name.rlike(ENTRY_NAMES), "main").when(name.rlike(ENTRY_TESTS), "test")
    )


def test_quality(breadth: Column, depth: Column, assertions: Column, mocks: Column, isolation: Column, freshness: Column, stability: Column) -> Column:
    """Weighted mean of seven dimensions; assertions a test (three are enough), mocks as a share of calls (best at .3)."""
    density = F.least(F.lit(1.0), assertions / 3.0)
    mocked = F.greatest(F.lit(0.0), 1.0 - F.abs(mocks - 0.3) * 2.0)
    return clamp(weighted((0.25, breadth), (0.15, depth), (0.15, density), (0.10, mocked), (0.15, isolation), (0.10, freshness), (0.10, stability)))


def test_smells(lines: Column, assertions: Column, sources: Column, mocks: Column, sleeps: Column, branches: Column) -> Column:
    """Names of the smells that a test's measures show."""
    rules = [
        ("empty", lines <= 1), ("no_assertion", assertions == 0), ("sleep", sleeps), ("conditional", branches), ("too_long", lines > 50),
        ("many_assertions", assertions > 5), ("eager", sources > 10), ("no_source_call", sources == 0), ("many_mocks", mocks > 5),
    ]
    return F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)), lambda x: x.isNotNull())
