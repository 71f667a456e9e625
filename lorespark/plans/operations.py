"""Operations by name over a knowledge base: permission, audit, and records made from fields.

``Operations`` is a registry of callables with typed parameters.  A call is
checked against a permission first; that it ran, failed or was refused becomes
a row of the audit table, written as one file a flush.  Operations that write
hold the changed base afterwards, so the next call sees it.
"""

from __future__ import annotations

import datetime
import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import tracking
from ..sources.store import confined
from .search import ALLOWED_STATUSES, KnowledgeBase

AUDIT = "at timestamp, operation string, action string, result string, duration_ms long, error string"
#: Calls whose audit rows are held before they are written.
FLUSH = 64
#: Operations that leave no audit rows.
QUIET = ("help", "initial")
DECISION = "context string, options array<string>, rationale string, outcome string"


class Refused(PermissionError):
    """The operation isn't permitted."""


def page_text(fields: dict, body: str = "") -> str:
    """A page as text: frontmatter of the fields that are given, then the body."""
    given = {k: v for k, v in fields.items() if v is not None and v != []}
    return f"---\n{yaml.safe_dump(given, sort_keys=False, allow_unicode=True)}---\n{body}"


def path_of(page_id: str) -> str:
    """The file of a page id: ``wiki:decisions:x`` is ``decisions/x.md``."""
    return confined(page_id.removeprefix("wiki:").replace(":", "/") + ".md")


@dataclass
class Operations:
    """Named operations over ``base``; ``permitted`` says by name which may run, ``audit`` is a folder for the log."""

    base: KnowledgeBase
    permitted: Callable[[str], bool] | None = None
    audit: str | None = None
    registry: dict[str, tuple[str, Callable]] = field(default_factory=dict)
    held: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        for name, about, run in (
            ("decision.create", "Record a decision", self.create_decision), ("decision.get", "Read a decision", self.get_decision),
            ("task.create", "Create a task", self.create_task), ("task.update", "Change a task's fields, append notes", self.update_task), ("page.delete", "Delete a page", self.delete_page),
            ("skill.fire", "Skills that an event triggers", self.fire), ("template.render", "Fill a template page", self.render),
        ):
            self.register(name, about, run)

    @property
    def spark(self) -> SparkSession:
        return self.base.pages.sparkSession

    def register(self, name: str, about: str, run: Callable) -> None:
        self.registry[name] = about, run

    def described(self) -> DataFrame:
        """``(operation, about, parameters)`` of all operations that may run."""
        rows = [(n, a, str(inspect.signature(f))) for n, (a, f) in sorted(self.registry.items()) if self.permitted is None or self.permitted(n)]
        return self.spark.createDataFrame(rows, "operation string, about string, parameters string")

    def call(self, operation: str, **arguments):
        """Run an operation; unknown names go to the base's own (``search.query``, ``graph.path``, ...).

        Raises ``Refused`` where it isn't permitted, ``TypeError`` where arguments
        don't fit.  Lazy results count as done when they are planned.
        """
        if self.permitted is not None and not self.permitted(operation):
            self._note(operation, "refused", 0, None)
            raise Refused(f"{operation} is not permitted")
        run = self.registry[operation][1] if operation in self.registry else lambda **a: self.base.call(operation, **a)
        began = time.monotonic()
        try:
            inspect.signature(run).bind(**arguments)
            result = run(**arguments)
        except Exception as e:
            self._note(operation, "error", int(1000 * (time.monotonic() - began)), f"{type(e).__name__}: {e}")
            raise
        self._note(operation, "ok", int(1000 * (time.monotonic() - began)), None)
        return result

    def _note(self, operation: str, result: str, duration_ms: int, error: str | None) -> None:
        action = operation.partition(".")[2] or "unknown"
        if self.audit is None or operation in QUIET:
            return
        self.held.append((datetime.datetime.now(datetime.UTC), operation, action, result, duration_ms, error))
        if len(self.held) >= FLUSH:
            self.flush()

    def flush(self) -> None:
        """Write the audit rows that are held, as one file."""
        if self.held and self.audit is not None:
            self.spark.createDataFrame(self.held, AUDIT).coalesce(1).write.mode("append").parquet(self.audit)
            self.held = []

    def log(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(AUDIT).parquet(self.audit)

    # ---- records -----------------------------------------------------------

    def _write(self, page_id: str, fields: dict, body: str) -> None:
        self.base = self.base.changed(self.spark.createDataFrame([(path_of(page_id), page_text(fields, body))], "path string, content string"))

    def _page(self, page_id: str, page_type: str) -> DataFrame:
        return self.base.pages.where((F.col("id") == page_id) & (F.col("page_type") == page_type))

    def _new(self, page_id: str, page_type: str, status: str) -> None:
        if status not in ALLOWED_STATUSES.get(page_type, ALLOWED_STATUSES["other"]):
            raise ValueError(f"status {status} is not allowed for {page_type} pages")
        if not self.base.pages.where(F.col("id") == page_id).isEmpty():
            raise ValueError(f"{page_id} exists")

    def create_decision(self, id: str, title: str, context: str, rationale: str, options: list[str] | None = None, outcome: str | None = None, content: str = "", status: str = "draft") -> DataFrame:
        """Record a decision as a page; returns ``(id, title, status)``."""
        self._new(id, "decision", status)
        nested = {"context": context, "rationale": rationale} | ({"options": options} if options else {}) | ({"outcome": outcome} if outcome is not None else {})
        self._write(id, {"title": title, "type": "decision", "status": status, "decision": nested}, content)
        return self._page(id, "decision").select("id", "title", "status")

    def get_decision(self, id: str) -> DataFrame:
        """``(id, title, status, context, options, rationale, outcome, content)`` of a decision; raises where there is none."""
        found = self._page(id, "decision")
        if found.isEmpty():
            raise LookupError(f"no decision {id}")
        d = F.from_json(F.element_at("unknown", F.lit("decision")), DECISION)
        return found.select("id", "title", "status", d["context"].alias("context"), d["options"].alias("options"), d["rationale"].alias("rationale"), d["outcome"].alias("outcome"), F.col("body").alias("content"))

    def create_task(self, id: str, title: str, status: str = "todo", priority: str | None = None, assignee: str | None = None, parent: str | None = None, tags: list[str] | None = None, acceptance_criteria: list[str] | None = None, estimate: int | None = None, content: str = "") -> DataFrame:
        """Create a task page; returns ``(id, title, status)``."""
        self._new(id, "task", status)
        criteria = [{"text": c, "checked": False} for c in acceptance_criteria or []]
        self._write(id, {"title": title, "type": "task", "status": status, "priority": priority, "assignee": assignee, "parent": parent, "tags": tags, "estimate": estimate, "acceptance_criteria": criteria}, content)
        return self._page(id, "task").select("id", "title", "status")

    def update_task(self, id: str, fields: dict | None = None, notes: str | None = None, check: int | None = None, uncheck: int | None = None) -> DataFrame:
        """Set fields of a task's frontmatter, append notes to its body, check or uncheck a criterion (from 0)."""
        row = self._page(id, "task").select("content").first()
        if row is None:
            raise LookupError(f"no task {id}")
        _, block, body = row["content"].split("---", 2)
        known = (yaml.safe_load(block) or {}) | (fields or {})
        for at, done in ((check, True), (uncheck, False)):
            if at is not None:
                known["acceptance_criteria"][at] = {**known["acceptance_criteria"][at], "checked": done}
        body = body.strip("\n") + (f"\n\n{notes}" if notes else "")
        self._write(id, known, body)
        return self._page(id, "task")

    def delete_page(self, id: str) -> DataFrame:
        self.base = self.base.changed(gone=[id])
        return self.base.pages.select("id")

    def fire(self, event: str) -> DataFrame:
        """``(id, title, instructions)`` of the skill pages with the event among their ``events``, in id order."""
        events = F.from_json(F.element_at("unknown", F.lit("events")), "array<string>")
        skills = self.base.pages.where(F.element_at("unknown", F.lit("skill")).isNotNull()).withColumn("events", F.coalesce(events, F.array().cast("array<string>")))
        return tracking.skills_for(skills, event).select("id", "title", F.col("body").alias("instructions"))

    def render(self, id: str, values: dict[str, str]) -> DataFrame:
        """``(id, text, missing)``: a page's body with ``{{names}}`` filled, and the names without a value."""
        found = self.base.pages.where(F.col("id") == id)
        names = text.template_variables(F.col("body"))
        filled = F.col("body")
        for name, value in values.items():
            spots = F.concat(F.lit(r"\{\{\s*"), F.lit(r"\Q" + name + r"\E"), F.lit(r"\s*\}\}"))
            filled = F.regexp_replace(filled, spots, F.lit(value.replace("\\", "\\\\").replace("$", "\\$")))
        return found.select("id", filled.alias("text"), F.array_except(names, F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")).alias("missing"))


def json_rows(result: DataFrame) -> DataFrame:
    """An operation's result as one JSON document a row."""
    return result.select(F.to_json(F.struct(*result.columns)).alias("value"))


