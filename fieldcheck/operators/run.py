"""A whole validation run: from the tables of a survey to published decisions, for the interviews that changed since the run before."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldcheck.functions.stored import stored
from fieldcheck.operators import attributes, catalog, changes, decisions, issues, select
from fieldcheck.operators.outliers import Check
from fieldcheck.sources.publish import publish, published

#: System tables: action log, counts of diagnostics, comments. All other tables are about interviews.
ACTIONS, DIAGNOSTICS, COMMENTS = "interview__actions", "interview__diagnostics", "interview__comments"


@dataclass(frozen=True)
class Settings:
    """What a run looks at: statuses to act on, when an interview is complete, which types of issues reject, which actions count, checks, and language."""

    statuses: tuple[int, ...] = (select.COMPLETED, select.APPROVED_BY_SUPERVISOR, select.APPROVED_BY_HEADQUARTERS)
    complete: str = "interview_result = 1"
    reject_types: tuple[int, ...] = (issues.REJECT,)
    actions: tuple = (changes.COMPLETED,)
    checks: dict[str, list[Check]] | None = None
    unanswered_allowed: int = 0
    language: str = "en"


def interviews_of_interest(tables: dict[str, DataFrame], tracker: DataFrame | None, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(digests of all interviews, completed interviews among those that changed since ``tracker``)."""
    digests = stored(changes.event_digests(tables[ACTIONS], settings.actions))
    updated = digests.select("interview__id") if tracker is None else changes.updated_by_digest(tracker, digests)
    homes = tables["households"].join(updated, "interview__id", "left_semi")
    return digests, stored(select.completed(homes, settings.statuses, settings.complete))


def recommendations(tables: dict[str, DataFrame], cases: DataFrame, settings: Settings, labels: DataFrame | None = None) -> dict[str, DataFrame]:
    """Attributes, issues and the nine decision tables for ``cases``; outliers are sought among their rows, against the groups of all interviews."""
    about = {k: df for k, df in tables.items() if k not in (ACTIONS, COMMENTS)}
    own = select.filter_tables({k: df for k, df in tables.items() if k != ACTIONS}, cases, sieved=True)
    comments = own.pop(COMMENTS)
    stats = select.interview_stats(own[DIAGNOSTICS])
    attribs = stored(attributes.create_attributes(own))
    found = stored(
        issues.all_issues(
            issues.attribute_issues(attribs, issues.LOGICAL, settings.language),
            catalog.outlier_issues(own, about, settings.checks, settings.language, labels),
            issues.unanswered_issues(cases, stats, settings.unanswered_allowed, settings.language),
        )
    )
    decided = decisions.create_decisions(cases, found, comments, stats, settings.reject_types, by_message=True)
    return {"attribs": attribs, "issues": found, **decided}


def validate(
    spark: SparkSession, tables: dict[str, DataFrame], folder: str, version: str, settings: Settings = Settings(), labels: DataFrame | None = None
) -> dict[str, DataFrame] | None:
    """Run all steps and publish the results as ``version`` in ``folder``; what was published, or None if there is nothing to do, and then nothing is published.

    Digests of action logs are compared with the tracker of the version published last; interviews that are new or changed, of a listed
    status and complete are checked. Published are the tracker of all interviews, interviews_validated, attribs, issues and the nine decision tables, to_reject_api as CSV too, for
    editing by hand. All appear at once (see ``publish``): a run that fails changes nothing, and the next one does the same interviews again.
    """
    tracker = published(spark, folder, "tracker")
    digests, cases = interviews_of_interest(tables, tracker, settings)
    if cases.isEmpty():
        return None
    out = {"tracker": digests, "interviews_validated": cases, **recommendations(tables, cases, settings, labels)}
    publish(spark, out, folder, version, for_editing=("to_reject_api",))
    return out


def decided_rows(found: dict[str, DataFrame], kinds: Iterable[str] = ("reject", "review", "follow_up")) -> DataFrame:
    """(decision, interview__id, reject_comment, interview__status) of the decision tables of a run."""
    frames = [found[f"to_{k}_api"].selectExpr(f"'{k}' as decision", *decisions.API) for k in kinds]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
