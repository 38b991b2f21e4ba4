"""Texts with placeholders, compiled to column expressions.

``{name}`` stands for a field, ``{name:format}`` for a field in a format, ``{{`` and ``}}`` for braces. Fields known when the plan is made are filled in there;
the others are columns, read row by row. Whatever is wrong with a template is an error when it is compiled, not when rows are read.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldcheck.functions.semantics import INF, shown
from fieldcheck.functions.text import MARKS, number_text


def _number(decimals: int):
    def text(value: Column, language: str) -> Column:
        value = value.cast("double")
        rest = F.when(value == INF, "∞").when(value == -INF, "-∞").otherwise(number_text(value, language, decimals))
        return F.coalesce(rest, F.lit("NA"))

    return text


#: Formats of fields by name: text as it is, numbers with two decimals, and whole numbers, with the marks of the language. A null reads NA.
FORMATS = {"": lambda value, language: shown(value), "number": _number(2), "whole": _number(0)}


def placeholders(template: str) -> list[tuple[str, str, str]]:
    """(text before, field, format) of each placeholder; text that no placeholder follows at once has an empty field."""
    out = []
    try:
        for before, field, form, conversion in Formatter().parse(template):
            if conversion or field == "" or (form or "") not in FORMATS:
                raise ValueError(f"wrong placeholder {{{field or ''}{':' + form if form else ''}}} in {template!r}; formats are {sorted(FORMATS)}")
            out.append((before, field or "", form or ""))
    except ValueError as error:
        raise ValueError(f"not a template: {template!r}: {error}") from None
    return out


def compiled(template: str, language: str, plan: Mapping[str, object] | None = None, row: Mapping[str, Column] | None = None) -> Column:
    """The text of each row. ``plan`` has fields known now, in no format but the plain one; ``row`` has columns.

    ValueError for a placeholder that neither has, for a language without number format, and for a template that can't be read.
    """
    plan, row = plan or {}, row or {}
    if language not in MARKS:
        raise ValueError(f"no number format for language {language!r}; there are {sorted(MARKS)}")
    parts: list[str | Column] = [""]
    for before, field, form in placeholders(template):
        more: list[str | Column] = [before]
        if field in plan and not form:
            more.append(str(plan[field]))
        elif field in row:
            more.append(FORMATS[form](row[field], language))
        elif field in plan:
            raise ValueError(f"{{{field}:{form}}} in {template!r} is known to the plan and has no format")
        elif field:
            raise ValueError(f"no field {field!r} for {template!r}; there are {sorted({*plan, *row})}")
        for x in more:
            if isinstance(x, str) and isinstance(parts[-1], str):
                parts[-1] += x
            else:
                parts.append(x)
    columns = [F.lit(x) if isinstance(x, str) else x for x in parts if not isinstance(x, str) or x]
    return F.concat(*columns) if len(columns) > 1 else columns[0] if columns else F.lit("")


def decode_map(labels, datasets: list[str] | None = None) -> Column:
    """All labels as one value, a map from ``dataset.variable=code``, for ``label_of``; a subquery that is run once and joins nothing.

    ``labels`` has dataset, variable, code, label: the value labels of a questionnaire, which its size bounds. Of several labels of a code the least one counts.
    """
    if datasets is not None:
        labels = labels.where(F.col("dataset").isin(datasets))
    labels = labels.where("dataset is not null and variable is not null and code is not null and label is not null")
    key = _code_key(F.concat_ws(".", "dataset", "variable"), F.col("code"))
    one = labels.groupBy(key.alias("key")).agg(F.min("label").alias("label"))
    return one.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "label"))))).scalar()


def _code_key(name: Column, code: Column) -> Column:
    return F.concat(name, F.lit("="), code.cast("double").cast("string"))


def label_of(decoder: Column, dataset: str, variable: str, code: Column) -> Column:
    """The label of a code, the code itself as text where it has none, null for a null."""
    return label_by_name(decoder, F.lit(f"{dataset}.{variable}"), code)


def label_by_name(decoder: Column, name: Column, code: Column) -> Column:
    """``label_of`` for a column of names ``dataset.variable``."""
    number = code.cast("double")
    plain = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("bigint").cast("string")).otherwise(code.cast("string"))
    return F.coalesce(F.try_element_at(decoder, _code_key(name, code)), plain)


def compiled_by_key(templates: Mapping[str, str], codes: Mapping[str, Mapping[str, tuple[str, int]]], key: Column, decoder: Column, values: Column) -> Column:
    """The text of each row's own template, of any number of them: ``templates`` by the value of ``key``, whose placeholders are coded fields.

    ``codes`` has for each template and field the name of its labels (``dataset.variable``) and the place of its code in the array ``values``. All templates
    become one constant, so the expression is as long for a hundred as for one. ValueError for a placeholder that has no code, or has a format.
    """
    table = {}
    for name, template in templates.items():
        parts, text = [], ""
        for before, field, form in placeholders(template):
            text += before
            if field and (form or field not in codes[name]):
                raise ValueError(f"no coded field {field!r} for {template!r}; there are {sorted(codes[name])}")
            if field:
                parts.append({"before": text, "label": codes[name][field][0], "at": codes[name][field][1]})
                text = ""
        table[name] = {"parts": parts, "tail": text}
    shape = "map<string, struct<parts: array<struct<before: string, label: string, at: int>>, tail: string>>"
    own = F.try_element_at(F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), shape), key)
    most = max((len(t["parts"]) for t in table.values()), default=0)
    parts = [F.get(own["parts"], F.lit(n)) for n in range(most)]  # null behind a template's last one
    texts = [F.coalesce(F.concat(p["before"], F.coalesce(label_by_name(decoder, p["label"], F.get(values, p["at"])), F.lit("NA"))), F.lit("")) for p in parts]
    return F.concat(*texts, own["tail"])


def with_labels(df, labels, dataset: str, columns: Mapping[str, str]):
    """Add the labels of any number of coded columns: ``columns`` has the new name of each, and the variable, which is also the column. One subquery, no join."""
    decoder = decode_map(labels, [dataset])
    return df.withColumns({out: label_of(decoder, dataset, variable, F.col(variable)) for out, variable in columns.items()})
