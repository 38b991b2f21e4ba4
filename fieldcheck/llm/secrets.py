"""Secret scans: patterns, then ownership frequency of the values over the whole corpus (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .tables import table

#: Base kinds in their order. The pattern finds matches from the left; a match shorter than what the kind
#: asks for is dropped afterwards. The part is the group that holds the value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Further candidates: long runs of a credential's characters. They count only with a digit, both cases
#: and a single owner.
RUN = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "owned")
#: From this many distinct owners on, a value is a widely copied example.
EXAMPLE_OWNERS = 3


#: Items of a list that are run through at once; see ``_running``.
_BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, merge) -> Column:
    """array<int>: each item merged with all before it.

    A list can only be grown by copying it, so blocks of _BLOCK items are run through, then the last ones of the blocks, and those are merged
    into the block behind: for n items about n * _BLOCK + (n / _BLOCK) ** 2 steps.
    """
    none = F.array().cast("array<int>")

    def run(items):
        return F.aggregate(items, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(merge(F.get(acc, F.size(acc) - 1), x)))))

    def blocks(v):
        number = F.floor((F.size(v) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), number), lambda b: run(F.slice(v, b * _BLOCK + 1, _BLOCK)))

    def joined(bs):
        before = run(F.transform(bs, lambda b: F.get(b, F.size(b) - 1)))
        own = lambda b, i, ends: F.when(i == 0, b).otherwise(_let(F.get(ends, i - 1), lambda end: F.transform(b, lambda x: merge(end, x))))
        return _let(before, lambda ends: F.flatten(F.transform(bs, lambda b, i: own(b, i, ends))))

    return _let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(_let(blocks(v), joined)))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of all matches: pieces between matches and matches give the offsets."""
    kind = "array<struct<start: int, value: string>>"
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(values):
        steps = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(values), F.lit(0))), values, lambda g, v: g + F.length(v))
        return _let(_running(steps, lambda a, b: a + b), lambda ends: F.zip_with(values, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), v.alias("value"))).cast(kind))

    return F.when(text.rlike(pattern), _let(found, placed)).otherwise(F.array().cast(kind))


def _spans(text: Column, kind: int, pattern: str, value, keep) -> Column:
    """array<struct<start, kind, end, value>>; kind as its number, so that spans sort by start, then kind."""
    return F.transform(
        F.filter(_matches(text, pattern), lambda m: keep(m["value"])),
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(kind).alias("kind"),
            (m["start"] + F.length(m["value"])).alias("end"),
            F.sha2(value(m["value"]), 256).alias("value"),
        ),
    )


def candidates(text: Column) -> Column:
    """All candidate spans of a text, sorted; value is the hash of the credential itself."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    secret = lambda v: F.regexp_extract(v, ASSIGN, 2)
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    return F.array_sort(
        F.concat(
            _spans(text, 0, ASSIGN, secret, lambda v: F.length(secret(v)) >= 8),
            _spans(text, 1, ACCESS, lambda v: v, lambda v: F.lit(True)),
            _spans(text, 2, HEX, lambda v: v, lambda v: F.lit(True)),
            _spans(text, 3, RUN, lambda v: v, mixed),
        )
    )


def secret_spans(docs: DataFrame, doc: str = "doc_id", owner: str = "source", repository: str = "lang", name: str = "secrets") -> DataFrame:
    """One row per row of ``docs``: its ``doc``, and spans array<struct<start, kind, end, live>>, sorted.

    Base spans are every match of the three patterns; live tells whether the value is specific to few
    owners or, held by EXAMPLE_OWNERS distinct owners or more, a widely copied example. Spans of the
    fourth kind are added: long runs of mixed case with digits that overlap no base span, held by one owner in one repository of that owner.
    Owners are the values of ``owner``, repositories those of (``owner``, ``repository``); a null is an owner
    of its own. Start and end are code points, end exclusive. A null text has no spans.

    Candidate hashes are first made distinct by owner and repository, then counted, so that a value on a
    third of all rows costs one row per task; texts are read once and never shuffled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    rows = docs.select(
        F.col(doc).alias("doc"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(owner).cast("string"), F.lit("\u0000")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("\u0000")).alias("repository"),
        candidates(F.col("text")).alias("spans"),
    )
    rows = scratch.table(rows, "candidates")
    each = rows.where("size(spans) > 0").select("row", "owner", "repository", F.explode("spans").alias("span"))
    held = (
        each.groupBy(F.col("span.value").alias("value"), "owner", "repository").agg(F.lit(1).alias("one"))
        .groupBy("value", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )
    judged = each.withColumn("value", F.col("span.value")).join(held, "value", "left").groupBy("row").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("span.start").alias("start"),
                    F.col("span.kind").alias("kind"),
                    F.col("span.end").alias("end"),
                    (F.col("owners") < EXAMPLE_OWNERS).alias("live"),
                    ((F.col("owners") == 1) & (F.col("repositories") == 1)).alias("sole"),
                )
            )
        ).alias("judged")
    )
    # spans are sorted, so a run overlaps a base span if one before it ends behind its start, or the next one starts before its end
    ends = _running(F.transform("judged", lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(-1)), F.greatest)
    starts = F.reverse(_running(F.reverse(F.transform("judged", lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(2**31 - 1))), F.least))
    free = lambda s, i, before, ahead: (F.get(before, i) <= s["start"]) & (F.get(ahead, i) >= s["end"])
    own = lambda before, ahead: F.filter("judged", lambda s, i: (s["kind"] < 3) | (s["sole"] & free(s, i, before, ahead)))
    some = F.exists("judged", lambda s: s["sole"] & (s["kind"] == 3))
    kept = F.when(some, _let(ends, lambda before: _let(starts, lambda ahead: own(before, ahead)))).otherwise(F.filter("judged", lambda s: s["kind"] < 3))
    final = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["live"].alias("live")))
    empty = F.array().cast("array<struct<start: int, kind: int, end: int, live: boolean>>")
    return rows.select("doc", "row").join(judged, "row", "left").select(
        F.col("doc").alias(doc), F.coalesce(final, empty).alias("spans")
    )


def masked(docs: DataFrame, mask: str, owner: str = "source", repository: str = "lang") -> DataFrame:
    """``docs`` with every live span of its column text replaced by ``mask``; overlapping spans by one mask.

    Rows are matched to their spans by a hash of all that the scan reads, so equal rows are masked alike.
    """
    key = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in ("text", owner, repository)]), 256)
    docs = docs.withColumn("_key", key)
    found = secret_spans(docs, doc="_key", owner=owner, repository=repository, name="masking")
    live = F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = found.select("_key", live.alias("_live")).where("size(_live) > 0").dropDuplicates(["_key"])
    # each span has the text between it and the end of those before it; a span that starts before that end adds none
    reach = _running(F.transform("_live", lambda s: s["end"]), F.greatest)
    kind = "array<struct<at: int, start: int>>"
    pieces = lambda ends: F.filter(F.transform("_live", lambda s, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("at"), s["start"].alias("start"))), lambda c: c["start"] >= c["at"]).cast(kind)

    def cut(some):
        """Texts of a block of pieces, out of the stretch of text that they lie in, as a piece is found by counting from the start."""
        first = F.get(some, F.lit(0))["at"]
        stretch = F.substring(F.col("text"), first + 1, F.get(some, F.size(some) - 1)["start"] - first)
        return _let(stretch, lambda part: _let(first, lambda at: F.transform(some, lambda c: F.substring(part, c["at"] - at + 1, c["start"] - c["at"]))))

    def put_together(ends):
        tail = F.substring(F.col("text"), F.get(ends, F.size(ends) - 1) + 1, F.length("text"))
        blocks = lambda cs: F.transform(F.sequence(F.lit(0), F.floor((F.size(cs) - 1) / _BLOCK).cast("int")), lambda b: cut(F.slice(cs, b * _BLOCK + 1, _BLOCK)))
        return F.array_join(F.concat(_let(pieces(ends), lambda cs: F.flatten(blocks(cs))), F.array(tail)), mask)

    walk = _let(reach, put_together)
    return docs.join(found, "_key", "left").withColumn("text", F.when(F.col("_live").isNull(), F.col("text")).otherwise(walk)).drop("_key", "_live")


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of whole documents; a source is an owner, a language of a source a repository."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def _sql_matches(kind: int, pattern: str, keep: str, value: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
select row, doc_id, owner, repository, s.start as start, {kind} as kind, s.start + length(s.v) as "end", {value} as value
from (select row, doc_id, owner, repository, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
        'start': cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint),
        'v': m[i]}})) as s
      from (select row, doc_id, owner, repository, regexp_extract_all(text, '{quoted}') as m, regexp_split_to_array(text, '{quoted}') as g from doc))
where {keep}"""


_ASSIGN_RE2 = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+)"""
_PART = "regexp_extract(s.v, '" + ASSIGN.replace("'", "''") + "', 2)"

OP5_SQL = f"""
with doc as (
  select row_number() over () as row, doc_id, coalesce(text, '') as text, coalesce(source, '') as owner, coalesce(lang, '') as repository
  from documents),
span as (
  {" union all ".join([
      _sql_matches(0, _ASSIGN_RE2, f"length({_PART}) >= 8", _PART),
      _sql_matches(1, ACCESS, "true", "s.v"),
      _sql_matches(2, HEX, "true", "s.v"),
      _sql_matches(3, RUN, "regexp_matches(s.v, '[0-9]') and regexp_matches(s.v, '[a-z]') and regexp_matches(s.v, '[A-Z]')", "s.v"),
  ])}),
held as (select value, count(distinct owner) as owners, count(distinct (owner, repository)) as repositories from span group by value),
kept as (
  select span.*, owners < {EXAMPLE_OWNERS} as live from span join held using (value)
  where kind < 3 or (owners = 1 and repositories = 1 and not exists (
    select 1 from span b where b.row = span.row and b.kind < 3 and b.start < span."end" and span.start < b."end"))),
listed as (
  select row, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
         count(*) filter (live) as n_live,
         string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || "end", ',' order by start, kind, "end") filter (kind < 3) as base,
         string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || "end", ',' order by start, kind, "end") as spans
  from kept group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live
from doc left join listed on doc.row = listed.row
"""
