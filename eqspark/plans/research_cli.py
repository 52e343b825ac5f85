"""Options of a research plan, as a command line gives them."""

from __future__ import annotations

import argparse
import re

BUDGETS = (5, 15, 30, 60, 120)
#: preset: (budgets, repeats).
PRESETS = {"quick": ([15, 30], 1), "full": ([5, 15, 30, 60], 5)}
CAPACITIES = (20, 40)


def positive(text: str) -> int:
    if not re.fullmatch(r"[0-9]+", text) or int(text) == 0:
        raise argparse.ArgumentTypeError("a positive integer is needed")
    return int(text)


def budget(text: str) -> int:
    value = positive(text)
    if value not in BUDGETS:
        raise argparse.ArgumentTypeError(f"one of {', '.join(map(str, BUDGETS))} is needed")
    return value


def capacities(text: str) -> list[int]:
    values = [positive(x) for x in text.split(",")]
    if any(x not in CAPACITIES for x in values) or len(set(values)) != len(values):
        raise argparse.ArgumentTypeError("unique values of 20 and 40 are needed")
    return sorted(values)


def profile(text: str) -> tuple[str, int]:
    case, _, seconds = text.partition(":")
    if not case or not seconds or ":" in seconds:
        raise argparse.ArgumentTypeError("case:budget is needed")
    return case, budget(seconds)


class _Once(argparse.Action):
    def __call__(self, parser, namespace, values, option=None):
        if getattr(namespace, self.dest) is not None:
            raise argparse.ArgumentError(self, "may be given only once")
        setattr(namespace, self.dest, values)


def parse(args: list[str], cases: list[str], output: str = "research-output") -> argparse.Namespace:
    """Options with budgets, max_filters and repeats resolved. A bad option raises ``ValueError``."""
    parser = argparse.ArgumentParser(exit_on_error=False, add_help=False, allow_abbrev=False)
    parser.add_argument("--preset", choices=list(PRESETS), default="quick")
    parser.add_argument("--capacity", type=capacities, default=[])
    parser.add_argument("--oracle-120", dest="longest", action="store_true")
    parser.add_argument("--repeats", type=positive)
    parser.add_argument("--profile", type=profile, action=_Once)
    parser.add_argument("--output-dir", default=output)
    parser.add_argument("--write-baseline", action="store_true")
    parser.add_argument("--baseline-implementation-commit")
    parser.add_argument("--test-mode", action="store_true")
    try:
        options, rest = parser.parse_known_args(args[1:] if args[:1] == ["--"] else args)
    except argparse.ArgumentError as bad:
        raise ValueError(str(bad)) from bad
    if rest:
        raise ValueError(f"unknown option: {rest[0]}")
    if options.profile and options.profile[0] not in cases:
        raise ValueError("--profile needs one of the plan's cases")
    if options.test_mode and options.write_baseline:
        raise ValueError("--test-mode cannot be combined with --write-baseline")
    if options.write_baseline and not options.baseline_implementation_commit:
        raise ValueError("--write-baseline needs --baseline-implementation-commit")
    budgets, repeats = PRESETS[options.preset]
    options.cases, options.budgets, options.max_filters, options.repeats = list(cases), budgets, [10, *options.capacity], options.repeats or repeats
    return options
