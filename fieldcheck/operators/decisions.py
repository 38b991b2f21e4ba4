"""Decisions: which interviews to reject, review or follow up, and checks of edited rejection lists.

The rules of has_comments, decide, rejection_messages and persistent are this library's own reading of what each asks for; see their docstrings.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.semantics import in_list
from fieldcheck.functions.stored import stored
from fieldcheck.operators.issues import COMMENT, REVIEW, SYSTEM
from fieldcheck.operators.select import APPROVED_BY_HEADQUARTERS, APPROVED_BY_SUPERVISOR, COMPLETED

API = ("interview__id", "reject_comment", "interview__status")
STATUSES = (COMPLETED, APPROVED_BY_SUPERVISOR, APPROVED_BY_HEADQUARTERS)
ID_PATTERN = "^[0-9a-f]{32}$|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
#: What stands between the messages of one comment.
SEPARATOR = " ## "
#: Role of comments that came with a rejection.
HEADQUARTERS = 3
ISSUE_COLUMNS = ("issue_type", "issue_desc", "issue_comment", "issue_vars", "issue_loc")


def has_comments(comments: DataFrame, issues: DataFrame, cases: DataFrame) -> DataFrame:
    """interview__id of cases with a comment on the whole interview (variable null) or on a variable of one of their issues.

    issue_vars holds names separated by commas or bars. Comments of headquarters don't count: they are earlier rejections.
    """
    comments = comments.where(~in_list(F.col("role"), [HEADQUARTERS]))
    named = issues.select("interview__id", F.explode(F.split("issue_vars", r"[,|]\s*")).alias("variable")).distinct()
    whole = comments.where("variable is null").select("interview__id")
    on_issue = comments.where("variable is not null").join(named, ["interview__id", "variable"], "left_semi").select("interview__id")
    return cases.select("interview__id").join(whole.unionByName(on_issue), "interview__id", "left_semi")


def decide(cases: DataFrame, issues: DataFrame, reject_types: Iterable[int], commented: DataFrame, stats: DataFrame) -> DataFrame:
    """Cases with a column action: "reject", "review" or null.

    A case is a candidate if it has an issue of a rejecting type, or, where SYSTEM is one, a positive count of
    invalid answers. Without a comment it is rejected, with one reviewed; an issue of type REVIEW
    asks for a review too, unless the case is rejected.
    """
    reject_types = list(reject_types)
    flags = issues.groupBy("interview__id").agg(
        F.bool_or(in_list(F.col("issue_type"), reject_types)).alias("_bad"), F.bool_or(F.col("issue_type") == REVIEW).alias("_look")
    )
    spoke = commented.select("interview__id").distinct().withColumn("_spoke", F.lit(True))
    invalid = stats.select("interview__id", (F.col("Invalid") > 0).alias("_invalid"))
    joined = reduce(lambda df, x: df.join(x, "interview__id", "left"), (flags, spoke, invalid), cases)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    bad = yes("_bad") | (yes("_invalid") if SYSTEM in reject_types else F.lit(False))
    action = F.when(bad & ~yes("_spoke"), "reject").when(bad | yes("_look"), "review")
    return joined.withColumn("action", action).drop("_bad", "_look", "_spoke", "_invalid")


def rejection_messages(chosen: DataFrame, issues: DataFrame) -> DataFrame:
    """API rows: the distinct messages of the interview's issues in order, joined; comments on questions only aren't among them."""
    texts = issues.where(F.col("issue_type") != COMMENT).groupBy("interview__id").agg(
        F.array_join(F.array_sort(F.collect_set("issue_comment")), SEPARATOR).alias("reject_comment")
    )
    return chosen.select("interview__id", "interview__status").join(texts, "interview__id", "left").select(*API)


def persistent(comments: DataFrame, to_reject: DataFrame) -> DataFrame:
    """``to_reject`` with a column persists: whether headquarters have commented on the whole interview with the very same message."""
    earlier = comments.where(F.col("variable").isNull() & (F.col("role") == HEADQUARTERS)).select("interview__id", F.col("comment").alias("reject_comment")).distinct().withColumn("persists", F.lit(True))
    return to_reject.join(earlier, ["interview__id", "reject_comment"], "left").select(*to_reject.columns, F.coalesce("persists", F.lit(False)).alias("persists"))


def message_index(comments: DataFrame) -> DataFrame:
    """(interview__id, message): the distinct messages that headquarters have sent about a whole interview, each earlier comment split into its messages."""
    earlier = comments.where(F.col("variable").isNull() & (F.col("role") == HEADQUARTERS))
    said = earlier.select("interview__id", F.explode(F.split("comment", SEPARATOR, -1)).alias("message"))
    return said.select("interview__id", F.trim("message").alias("message")).where("message <> ''").distinct()


def sent_before(comments: DataFrame, to_reject: DataFrame) -> DataFrame:
    """``to_reject`` with n_messages, n_sent (how many of them headquarters have sent before), and persists, whether there is one.

    Messages are compared one by one, whatever comment they came in and in whichever order. They are joined with the index of earlier ones by a hash and by
    themselves, so an interview with many comments is split over tasks. An interview without messages has none that persists.
    """
    own = to_reject.select("interview__id", F.explode(F.split("reject_comment", SEPARATOR, -1)).alias("message"))
    own = own.select("interview__id", F.trim("message").alias("message")).where("message <> ''").distinct().withColumn("_h", F.xxhash64("message"))
    known = message_index(comments).withColumn("_h", F.xxhash64("message")).withColumn("_sent", F.lit(1))
    counts = own.join(known, ["interview__id", "_h", "message"], "left").groupBy("interview__id").agg(F.count("*").alias("n_messages"), F.count("_sent").alias("n_sent"))
    joined = to_reject.join(counts, "interview__id", "left")
    number = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_messages", "n_sent")]
    return joined.select(*to_reject.columns, *number, F.coalesce(F.col("n_sent") > 0, F.lit(False)).alias("persists"))


def create_decisions(
    cases: DataFrame, issues: DataFrame, comments: DataFrame, stats: DataFrame, reject_types: Iterable[int], by_message: bool = False
) -> dict[str, DataFrame]:
    """Nine frames: to_{reject, review, follow_up}_{ids, issues, api}.

    Rejections whose message was sent before are followed up instead; with ``by_message``, those with one message at least that was sent before, in whichever comment. What was decided
    and what is said about each interview are stored once, for all nine. Issues to reject are of the rejecting types or COMMENT, those to review of the
    rejecting types or REVIEW, those to follow up of any type.
    """
    reject_types = list(reject_types)
    cases = cases.select("interview__id", "interview__key", "interview__status")
    decided = decide(cases, issues, reject_types, has_comments(comments, issues, cases), stats).where("action is not null")
    said = rejection_messages(decided, issues).join(decided.select("interview__id", "action"), "interview__id")
    said = stored(said.join(cases.select("interview__id", "interview__key"), "interview__id"))
    rejected = said.where("action = 'reject'").select(*API)
    split = stored((sent_before if by_message else persistent)(comments, rejected).select(*API, "persists"))
    reject, follow = split.where("not persists").drop("persists"), split.where("persists").drop("persists")
    named = said.select(*cases.columns)
    review = said.where("action = 'review'")
    reject_ids = reject.select("interview__id").join(named, "interview__id")
    follow_ids = follow.select("interview__id").join(named, "interview__id")

    def with_issues(ids: DataFrame, types: list[int] | None) -> DataFrame:
        joined = ids.select(*cases.columns).join(issues, ["interview__id", "interview__key"])
        kept = joined.where(F.col("issue_type").isin(types)) if types else joined
        return kept.select(*cases.columns, *ISSUE_COLUMNS)

    return {
        "to_reject_ids": reject_ids,
        "to_reject_issues": with_issues(reject_ids, [*reject_types, COMMENT]),
        "to_reject_api": reject,
        "to_review_ids": review.select(*cases.columns),
        "to_review_issues": with_issues(review, [*reject_types, REVIEW]),
        "to_review_api": review.select(*API),
        "to_follow_up_ids": follow_ids.select("interview__id", "interview__key"),
        "to_follow_up_issues": with_issues(follow_ids, None),
        "to_follow_up_api": follow,
    }


def list_violations(edited: DataFrame) -> DataFrame:
    """(interview__id, violation) of an edited rejection list; a row may have several.

    Wrong columns, or a wrong order of them, are a ValueError, as no row could be read then.
    """
    if tuple(edited.columns) != API:
        raise ValueError(f"a rejection list has the columns {API} in this order, not {tuple(edited.columns)}")
    bad_id = ~F.coalesce(F.col("interview__id").rlike(ID_PATTERN), F.lit(False))
    bad_status = ~F.coalesce(F.col("interview__status").isin(*STATUSES), F.lit(False))
    no_text = F.coalesce(F.trim("reject_comment"), F.lit("")) == ""
    hits: list[Column] = [F.when(bad_id, "interview__id"), F.when(bad_status, "interview__status"), F.when(no_text, "reject_comment")]
    return edited.select("interview__id", F.explode(F.array_compact(F.array(*hits))).alias("violation"))


def rejection_worklist(edited: DataFrame, statuses: Iterable[int]) -> DataFrame:
    """Rows to act on: those of a listed status."""
    return edited.where(F.col("interview__status").isin(*statuses)).select(*API)
