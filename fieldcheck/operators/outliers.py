"""Outliers by group-wise median and deviation: any number of checks of one table in one pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from fieldcheck.functions.semantics import baseline_log, checked_log, group_key, in_list, number
from fieldcheck.functions.templates import compiled
from fieldcheck.functions.text import number_text
from fieldcheck.operators import check_texts, messages
from fieldcheck.operators.thresholds import deviation_thresholds, with_limits

ISSUES = (
    "interview__id string, interview__key string, issue_type int, issue_desc string, issue_comment string, issue_vars string, issue_loc string"
)
#: Type of an issue that comments on the question itself.
COMMENT = 2


@dataclass(frozen=True)
class Check:
    """One measure of a table, compared within the groups of ``by`` (none: over all rows)."""

    var: str
    by: tuple[str, ...] = ()
    exclude: tuple[float, ...] = ()
    transform: str = "log"
    n_mad: float = 2
    min_obs: int = 30
    bounds: str = "upper"
    type: int = 2
    message: str = "outlier"
    table: str = ""

    def __post_init__(self) -> None:
        if self.var in self.by:
            raise ValueError(f"{self.var} can't be grouped by itself")
        if self.transform not in ("none", "log") or self.bounds not in ("upper", "lower", "both"):
            raise ValueError(f"unknown transform or bounds: {self.transform!r}, {self.bounds!r}")

    @property
    def id(self) -> str:
        return f"{self.table}{'.' if self.table else ''}{self.var}|{','.join(self.by)}"


def of_check(checks: list[Check], column: str, values: list) -> Column:
    """A value by check_id: one literal if all have the same one, a chain over the values if they are few, else a constant map."""
    ids: dict = {}
    for k, v in zip(checks, values, strict=True):
        ids.setdefault(v, []).append(k.id)
    if len(ids) == 1:
        return F.lit(next(iter(ids)))
    if len(ids) > 8:
        return F.try_element_at(F.create_map(*[F.lit(x) for k, v in zip(checks, values, strict=True) for x in (k.id, v)]), F.col(column))
    return reduce(lambda w, vi: w.when(F.col(column).isin(vi[1]), F.lit(vi[0])), ids.items(), F.when(F.lit(False), F.lit(values[0])))


def beyond(checks: list[Check]) -> Column:
    """Whether a row of check_id, value, n_obs, ll, ul is an outlier of its check."""
    above = F.col("value") > F.col("ul")
    below = (F.col("value") < F.col("ll")) & (F.col("ll") < F.col("ul"))
    rule = {"upper": above, "lower": below, "both": above | below}
    bounds, least = of_check(checks, "check_id", [k.bounds for k in checks]), of_check(checks, "check_id", [k.min_obs for k in checks])
    kinds = sorted({k.bounds for k in checks})
    hit = rule[kinds[0]] if len(kinds) == 1 else reduce(lambda w, b: w.when(bounds == b, rule[b]), kinds, F.when(F.lit(False), F.lit(False)))
    return hit & (F.col("n_obs") >= least)


def long_measures(df: DataFrame, checks: list[Check], keep: list[str], checked: bool) -> DataFrame:
    """One row per row and check: ``keep``, check_id, key, raw, value (transformed); the table is read once.

    On the checked side excluded values go and zero has a logarithm of minus infinity; on the baseline both are null.
    """
    missing = {c for k in checks for c in (k.var, *k.by)} - set(df.columns)
    if missing:
        raise ValueError(f"columns that checks need are missing: {sorted(missing)}")

    numbers = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}

    def one(k: Check) -> Column:
        raw = number(F.col(k.var))
        gone = in_list(raw, k.exclude)
        if checked:
            value = checked_log(raw) if k.transform == "log" else raw
        else:
            raw = F.when(~gone, raw)
            value = baseline_log(raw) if k.transform == "log" else raw
        return F.struct(
            F.lit(k.id).alias("check_id"), group_key((F.col(c) for c in k.by), numbers.issuperset(k.by)).alias("key"), raw.alias("raw"), value.alias("value"), gone.alias("gone")
        )

    rows = df.select(*keep, F.explode(F.array(*[one(k) for k in checks])).alias("m")).select(*keep, "m.*")
    return (rows.where("not gone") if checked else rows).drop("gone")


def number_bits(checks: list[Check]) -> int:
    """Bits of a group's number that hold the place of its check."""
    return max(1, (len(checks) - 1).bit_length())


def whole_columns(*frames: DataFrame) -> set[str]:
    """Columns that hold whole numbers in each of the frames that has them."""
    every = {f.name for df in frames for f in df.schema}
    return every - {f.name for df in frames for f in df.schema if not isinstance(f.dataType, IntegralType)}


def numbered_columns(df: DataFrame, checks: dict[int, Check], bits: int, checked: bool, whole: set[str], seed: int) -> dict[int, dict[str, Column]]:
    """_group, _twin, raw and value of each check of ``numbered_measures``."""
    missing = {c for k in checks.values() for c in (k.var, *k.by)} - set(df.columns)
    if missing:
        raise ValueError(f"columns that checks need are missing: {sorted(missing)}")
    out = {}
    for at, k in checks.items():
        raw = number(F.col(k.var))
        gone = in_list(raw, k.exclude)
        log = checked_log if checked else baseline_log
        parts = [F.col(b).cast("bigint" if b in whole else "string") for b in k.by]
        parts += [reduce(lambda a, b: a + b, [F.when(F.col(b).isNull(), F.lit(1 << n)).otherwise(F.lit(0)) for n, b in enumerate(k.by)])] if k.by else []
        group = F.shiftleft(F.xxhash64(F.lit(seed), F.lit(at), *parts), bits).bitwiseOR(F.lit(at).cast("bigint"))
        out[at] = {"_group": group, "_twin": F.xxhash64(F.lit(-1 - seed), F.lit(at), *parts), "raw": raw, "value": F.when(~gone, log(raw) if k.transform == "log" else raw)}
    return out


def numbered_measures(df: DataFrame, checks: dict[int, Check], bits: int, keep: list[str], checked: bool, whole: set[str], seed: int) -> DataFrame:
    """``long_measures`` whose groups are numbers: ``keep``, _group, _twin, raw, value; ``checks`` by their place, excluded values being null on both sides.

    _group is a hash of the check and the key with the check's place in its last bits, _twin another hash of them. Parts are equal where those of ``group_key`` are: ``whole`` columns by
    their number, others by their text, and which of them are null counts too. Rows become one for each check by an expansion, without an array of structures.
    """
    found = numbered_columns(df, checks, bits, checked, whole, seed)
    columns = [c.alias(f"{name}:{at}") for at, own in found.items() for name, c in own.items()]
    branches = [f"({', '.join(f'`{name}:{at}`' for name in own)}) as `{at}`" for at, own in found.items()]
    wide = df.select(*keep, *columns)
    return df.sparkSession.sql(f"select * from {{wide}} unpivot include nulls ((_group, _twin, raw, value) for _at in ({', '.join(branches)}))", wide=wide).drop("_at")


def thresholds(full: DataFrame, checks: list[Check]) -> DataFrame:
    """(check_id, key, n_obs, med, mad, ll, ul) of all checks over all interviews."""
    values = long_measures(full, checks, [], checked=False).select("check_id", "key", "value")
    return deviation_thresholds(values, ["check_id", "key"], of_check(checks, "check_id", [float(k.n_mad) for k in checks]))


def flagged(target: DataFrame, full: DataFrame, checks: list[Check], keep: list[str]) -> DataFrame:
    """Outliers of ``target`` against the groups of ``full``: ``keep``, check_id, key, raw, value, n_obs, med, ll, ul.

    A group counts from min_obs values on. Bounds are strict; a null on either side flags nothing. Lower
    bounds ask for a deviation above zero, upper ones don't. The key is a string without nulls, so thresholds join by plain equality.
    """
    rows = long_measures(target, checks, keep, checked=True).where("value is not null")
    joined = with_limits(rows, thresholds(full, checks), ["check_id", "key"])
    return joined.where(beyond(checks)).drop("mad")


def identify_outliers(target: DataFrame, full: DataFrame, checks: list[Check], questions: bool = True, language: str = "en") -> DataFrame:
    """Issues of all outliers, ISSUES columns: one of the check's type and, with ``questions``, one that comments on the question.

    The latter has issue_loc: the row's roster ids (columns ending in __id but interview__id) in brackets, null without any.
    """
    ids = [c for c in target.columns if c.endswith("__id") and c != "interview__id"]
    keep = ["interview__id", "interview__key", *ids]
    rows = flagged(target, full, checks, keep)
    loc = F.concat(F.lit("["), F.concat_ws(", ", *[F.col(c).cast("string") for c in ids]), F.lit("]")) if ids else F.lit(None).cast("string")
    back = F.when(of_check(checks, "check_id", [k.transform == "log" for k in checks]), F.exp("ul")).otherwise(F.col("ul"))
    text = [messages.text(f"{k.message}.comment", language) for k in checks]
    desc = [messages.text(f"{k.message}.desc", language).format(var=k.var) for k in checks]
    comment = F.concat(
        of_check(checks, "check_id", [t.format(var=k.var) for k, t in zip(checks, text, strict=True)]),
        F.lit(" "),
        number_text(F.col("raw"), language),
        F.lit(" ("),
        F.lit(messages.text("outlier.limit", language)),
        F.lit(" "),
        number_text(back, language),
        F.lit(", n = "),
        F.col("n_obs").cast("string"),
        F.lit(")"),
    )
    return issue_rows(rows, checks, of_check(checks, "check_id", desc), comment, loc, questions)


def issue_rows(rows: DataFrame, checks: list[Check], desc: Column, comment: Column, loc: Column, questions: bool) -> DataFrame:
    """ISSUES rows of outliers: one of the check's type and, with ``questions``, one with the place of the question."""
    kinds = F.array(
        F.struct(of_check(checks, "check_id", [k.type for k in checks]).alias("issue_type"), F.lit(None).cast("string").alias("issue_loc")),
        *([F.struct(F.lit(COMMENT).alias("issue_type"), loc.alias("issue_loc"))] if questions else []),
    )
    return rows.withColumn("kind", F.explode(kinds)).select(
        "interview__id",
        "interview__key",
        F.col("kind.issue_type").cast("int").alias("issue_type"),
        desc.alias("issue_desc"),
        comment.alias("issue_comment"),
        of_check(checks, "check_id", [k.var for k in checks]).alias("issue_vars"),
        F.col("kind.issue_loc").alias("issue_loc"),
    )


def described(rows: DataFrame, checks: list[Check], what: Column, language: str) -> tuple[Column, Column]:
    """(desc, comment) of ``flagged`` rows: what is checked, its value, the group's figures on the scale of the answer, and the arguments of the check."""
    of = lambda value: of_check(checks, "check_id", [value(k) for k in checks])
    logs = [k.transform == "log" for k in checks]
    answer = (lambda c: F.exp(c)) if all(logs) else (lambda c: F.when(of_check(checks, "check_id", logs), F.exp(c)).otherwise(F.col(c)))
    fields = {
        "what": what, "value": F.col("raw"), "n_obs": F.col("n_obs"), "med": answer("med"), "ll": answer("ll"), "ul": answer("ul"),
        "var": of(lambda k: k.var), "by": of(lambda k: ", ".join(k.by) or "-"), "transform": of(lambda k: k.transform), "bounds": of(lambda k: k.bounds),
        "n_mad": of(lambda k: f"{k.n_mad:g}"), "min_obs": of(lambda k: str(k.min_obs)), "exclude": of(lambda k: ", ".join(f"{x:g}" for x in k.exclude) or "-"),
    }
    return tuple(compiled(t[language], language, row=fields) for t in (check_texts.DESC, check_texts.COMMENT))
