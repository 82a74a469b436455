"""One validator for all declarations: rules are data, and every broken one is told."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from typing import Any, NamedTuple


class Rule(NamedTuple):
    """Something that must hold, how it reads, and what it raises where it doesn't."""

    holds: Any
    says: str
    raises: type[Exception] = ValueError


def enforce(what: str, rules: Iterable[Rule]) -> None:
    """Raise one error that lists all broken rules; errors of type come before errors of value."""
    broken = [rule for rule in rules if not rule.holds]
    if broken:
        worst = next((r.raises for r in broken if r.raises is TypeError), broken[0].raises)
        raise worst(f"{what}: " + "; ".join(r.says for r in broken))


def fields(holder: Any, checks: Mapping[str, tuple[Callable[[Any], Any], str]]) -> Iterable[Rule]:
    """A rule for each field that ``checks`` has a condition on."""
    for name, (holds, says) in checks.items():
        value = getattr(holder, name)
        yield Rule(holds(value), f"{name} {says}, not {value!r}")


def one_of(*values: str) -> tuple[Callable[[Any], bool], str]:
    return (lambda v: v in values), f"is one of {', '.join(values)}"


def at_least(least: float) -> tuple[Callable[[Any], bool], str]:
    return (lambda v: v >= least), f"is {least} or more"


def optional(check: tuple[Callable[[Any], Any], str]) -> tuple[Callable[[Any], Any], str]:
    return (lambda v: v is None or check[0](v)), f"{check[1]} or None"


def distinct(names: Iterable[str], what: str) -> Rule:
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    return Rule(not twice, f"{what} come up once each, these do not: {twice}")


def known(names: Iterable[Any], there: Iterable[Any], what: str, raises: type[Exception] = ValueError) -> Rule:
    strange = sorted(set(names).difference(there), key=str)
    return Rule(not strange, f"no {what} {strange}", raises)
