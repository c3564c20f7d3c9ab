"""Rules as data: a YAML file, hot-reloadable, turned into one projection."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession

_HERE = os.path.join(os.path.dirname(os.path.dirname(__file__)), "rules")
DEFAULT_FILE = os.path.join(_HERE, "rules.yaml")
FALLBACK_FILE = os.path.join(_HERE, "fallback.yaml")


@dataclass(frozen=True)
class Rule:
    pattern: str
    weight: float
    label: str
    tags: tuple[str, ...] = ()
    case_sensitive: bool = False

    @property
    def java(self) -> str:
        """Java form: Unicode classes, and letters of all scripts match without case."""
        return ("(?U)" if self.case_sensitive else "(?iU)") + self.pattern


def needed_literals(pattern: str) -> list[str]:
    """Lower-case literals of which at least one stands in every text that the pattern
    finds; empty if there is no such list.  They gate the pattern cheaply."""
    from re import _constants as c
    from re import _parser

    def of(seq) -> list[str] | None:
        best: list[str] | None = None
        run = ""

        def offer(lits: list[str] | None) -> None:
            nonlocal best
            if lits and all(lits) and (best is None or worth(lits) > worth(best)):
                best = lits

        for op, av in [*seq, (None, None)]:
            if op is c.LITERAL:
                run += chr(av).lower()
                continue
            offer([run] if run else None)
            run = ""
            if op is c.SUBPATTERN:
                offer(of(av[3]))
            elif op is c.BRANCH:
                each = [of(x) for x in av[1]]
                offer([lit for x in each for lit in x] if all(each) else None)
            elif op is c.MAX_REPEAT and av[0] > 0:
                offer(of(av[2]))
        return best

    def worth(lits: list[str]) -> int:
        return 4 * min(map(len, lits)) - len(lits)

    try:
        return of(_parser.parse(pattern)) or []
    except re.error:
        return []


def parse_rules(text: str) -> list[Rule]:
    """Rules in a YAML text.  A rule without or with a broken pattern is skipped; weight
    defaults to 0.5, label to the first 30 characters of the pattern."""
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError:
        return []
    entries = (doc or {}).get("rules") if isinstance(doc, dict) else None
    rules = []
    for e in entries or []:
        p = e.get("pattern") if isinstance(e, dict) else None
        if not p:
            continue
        try:
            re.compile(p)
            w = float(e.get("weight", 0.5))
        except (re.error, TypeError, ValueError):
            continue
        rules.append(Rule(p, w, str(e.get("label") or p[:30]), tuple(e.get("tags") or ()), bool(e.get("case_sensitive"))))
    return rules


class RuleSource:
    """Rules of a file, read again when it changes.  A missing file gives the fallback
    rules, an empty or unreadable one keeps what was there."""

    def __init__(self, path: str = DEFAULT_FILE) -> None:
        self.path, self.stamp, self.current = path, None, []

    def rules(self) -> list[Rule]:
        try:
            stamp = os.stat(self.path).st_mtime_ns
        except OSError:
            if not self.current:
                self.current = load_rules(FALLBACK_FILE)
            return self.current
        if stamp != self.stamp:
            with open(self.path, encoding="utf-8") as f:
                found = parse_rules(f.read())
            self.stamp = stamp
            if found or not self.current:
                self.current = found or load_rules(FALLBACK_FILE)
        return self.current


def load_rules(path: str = DEFAULT_FILE) -> list[Rule]:
    with open(path, encoding="utf-8") as f:
        return parse_rules(f.read())


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table (pattern, weight, label, tags)."""
    return spark.createDataFrame(
        [(r.pattern, r.weight, r.label, list(r.tags)) for r in rules], "pattern string, weight double, label string, tags array<string>"
    )
