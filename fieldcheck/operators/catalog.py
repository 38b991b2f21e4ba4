"""The survey's outlier checks: which measures of which tables, within which groups."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.stored import stored
from fieldcheck.functions.templates import compiled_by_key, decode_map, placeholders
from fieldcheck.operators import check_texts, derive
from fieldcheck.operators.outliers import Check, beyond, described, issue_rows, number_bits, numbered_columns, numbered_measures, whole_columns
from fieldcheck.operators.thresholds import GROUP, NORMAL, deviations_by_number

# Names of tables, measures and grouping columns of the questionnaire.
AREA = ("admin1", "urb_rur")
MATERIALS = ("hh11_q12", "hh11_q13", "hh11_q14")
ROOMS = "hh11_q15"

CHECKS: dict[str, list[Check]] = {
    "households": [
        Check("hh11_q04", ("hh11_q04_tu", *AREA, *MATERIALS, ROOMS)),
        Check("hh11_q05", ("hh11_q05_tu", *AREA, *MATERIALS, ROOMS)),
        Check("hh11_q09", (*AREA, *MATERIALS, ROOMS)),
        Check("hh11_q11", (*AREA, *MATERIALS, ROOMS)),
        Check(ROOMS, (*AREA, *MATERIALS)),  # not by itself
        Check("daily_elec_exp"),
        Check("hh12_q09"),
        Check("hh12_q16"),
        Check("hh12_q24", ("hh12_q23", "hh12_q24_tu")),
        Check("hh12_q25", ("hh12_q23", *AREA)),
        Check("hh13_q04", ("hh13_q02", *AREA)),
        Check("hh13_q18a", ("hh13_q17", *AREA)),
        Check("hh15a_q18", ("hh15a_q17",)),
    ],
    "r_assets": [Check(v, ("r_assets__id",)) for v in ("hh14_q03", "hh14_q05", "hh14_q06")],
    "r_business": [Check("hh15b_q19"), Check("hh15b_q20", ("hh15b_q1_code",))],
    "r_income": [Check("hh17_q03", ("r_income__id",))],
    "hh02_q17_edu_expense": [Check("hh02_q17", ("hh02_q17_edu_expense__id",))],
    "services_roster": [Check(v, ("services_roster__id",)) for v in ("hh03a_q31", "hh03a_q33")],
    "members": [
        *(Check(v) for v in ("hh02_q14", "hh03a_q13", "hh03a_q15", "hh03a_q18", "hh03a_q23", "hh03a_q25", "hh03d_q08", "hh04_q34")),
        Check("hh04_q40_amount", ("hh04_q40_unit",)),
        Check("hh04_q41_amount", ("hh04_q41_unit",)),
        *(Check(v) for v in ("hh07_q04", "hh07_q06", "hh07_q08", "hh07_q010", "hh07_q012", "hh07_q14", "hh07_q16")),
    ],
    "food_consumption_at_home": [
        Check("hh08_q05_amount", ("hh08_q05_unit", "food_consumption_at_home__id")),
        Check("hh08_q10_amount", ("hh08_q10_unit", "food_consumption_at_home__id")),
        Check("unit_purchase_price", ("hh08_q10_unit", "food_consumption_at_home__id")),
    ],
    "non_food_7_days": [Check("hh09a_q03", ("non_food_7_days__id",))],
    "non_food_30_days": [Check("hh09b_q03", ("non_food_30_days__id",))],
    "non_food_6_months": [Check("hh09c_q03", ("non_food_6_months__id",))],
    "non_food_12_months": [Check("hh09d_q03", ("non_food_12_months__id",))],
    "r_seed_type": [Check("unit_price", ("r_seed05__id", "r_seed_type__id", "ag05_q06_unit", "ag05_q08"))],
    "r_crop_inputs": [Check("ag06_q03_quantity", ("r_crop_inputs__id", "ag06_q03_unit"))],
    "ag08r_labor": [Check(v, ("ag08r_labor__id",)) for v in ("ag08_q03", "ag08_q09")],
    "lv_roster": [
        Check(v, ("lv_roster__id",))
        for v in (
            "ag10_q04", "ag10_q05", "ag10_q08", "ag10_q10", "ag10_q12", "ag10_q13", "ag10_q14", "unit_price_bought", "ag10_q16", "ag10_q17",
            "unit_price_sold", "ag10_q19", "unit_price_slaughtered", "ag10_q23", "ag10_q24", "ag10_q27",
            "ag12_q03", "ag12_q04", "ag12_q05", "unit_price_liters_per_anim", "unit_price_milk_sold", "ag12_q19",
        )
    ],
    "lvstk_id": [Check(v, ("lvstk_id__id",)) for v in ("ag11_q05", "ag11_q06", "ag11_q07", "ag11_q08")],
    "r_aglabor_nonhh": [Check(v, ("r_aglabor_nonhh__id",)) for v in ("ag13_q03", "hourly_rate")],
    "ag_assets": [Check(v, ("ag_assets__id",)) for v in ("ag15_q05", "ag15_q06")],
}

#: Checks of plots and crops.
LAND_CHECKS: dict[str, list[Check]] = {
    "plots": [
        Check("ag02_q07_size", ("ag02_q07_unit",)),
        Check("amt_fertilizer_type1", ("ag02_q16b1_unit",)),
        Check("amt_fertilizer_type2", ("ag02_q16c1_unit",)),
        Check("amt_pest_herb_type1", ("ag02_q18b1_unit",)),
        Check("amt_pest_herb_type2", ("ag02_q18c1_unit",)),
    ],
    "crops": [
        Check("amt_seed_temp_non_veg", ("r_crop__id", "ag03_q05_unit")),
        Check("amt_seed_temp_veg", ("r_crop__id", "ag03_q10_unit")),
        Check("num_plants", ("r_crop__id",)),
        Check("amt_seed_tree_perm", ("r_crop__id", "ag03_q21_unit")),
    ],
}

#: Daily rates and ratios that checks use: table -> name -> columns.
DAILY = {"households": {"daily_elec_exp": ("hh12_q06", "hh12_q06b"), "daily_trash_exp": ("hh13_q18a", "hh13_q18b")}}
RATIOS = {
    "food_consumption_at_home": {"unit_purchase_price": ("hh08_q11", "hh08_q10_amount")},
    "r_seed_type": {"unit_price": ("ag05_q07", "ag05_q06_amount")},
    "lv_roster": {
        "unit_price_bought": ("ag10_q15", "ag10_q14"),
        "unit_price_sold": ("ag10_q18", "ag10_q17"),
        "unit_price_slaughtered": ("ag10_q21", "ag10_q19"),
        "unit_price_liters_per_anim": ("ag12_q13", "ag12_q12"),
        "unit_price_milk_sold": ("ag12_q16", "ag12_q15"),
    },
    "r_aglabor_nonhh": {"hourly_rate": ("ag13_q06", "ag13_q05b")},
    "plots": {
        "amt_fertilizer_type1": ("ag02_q16b1_qty", "ag02_q07_size"),
        "amt_fertilizer_type2": ("ag02_q16c1_qty", "ag02_q07_size"),
        "amt_pest_herb_type1": ("ag02_q18b1_qty", "ag02_q07_size"),
        "amt_pest_herb_type2": ("ag02_q18c1_qty", "ag02_q07_size"),
    },
    "crops": {
        "amt_seed_temp_non_veg": ("ag03_q05_quantity", "ag02_q07_size"),
        "amt_seed_temp_veg": ("ag03_q10_quantity", "ag02_q07_size"),
        "num_plants": ("ag03_q17", "ag02_q07_size"),
        "amt_seed_tree_perm": ("ag03_q21_quantity", "ag02_q07_size"),
    },
}


def with_measures(tables: dict[str, DataFrame], checks: dict[str, list[Check]] | None = None) -> dict[str, DataFrame]:
    """Tables with derived measures: all of them, or those that ``checks`` use."""
    out = dict(tables)
    used = lambda name, var: checks is None or any(k.var == var for k in checks.get(name, []))
    if "crops" in out and any(used("crops", var) for var in RATIOS["crops"]):
        out["crops"] = derive.with_parent(out["crops"], out["plots"], ["interview__id", "r_parcel__id", "r_plot__id"], ["ag02_q07_size"])
    for name, rates in DAILY.items():
        if name in out:
            out[name] = derive.with_daily_rates(out[name], {var: of for var, of in rates.items() if used(name, var)})
    for name, ratios in RATIOS.items():
        if name in out:
            out[name] = derive.with_ratios(out[name], {var: of for var, of in ratios.items() if used(name, var)})
    return out


def _place(df: DataFrame) -> Column:
    """The roster ids of a row in brackets, null without any."""
    ids = [c for c in df.columns if c.endswith("__id") and c != "interview__id"]
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.col(c).cast("string") for c in ids]), F.lit("]")) if ids else F.lit(None).cast("string")


def limits_by_number(full: dict[str, DataFrame], checks: dict[str, list[Check]], whole: dict[str, set[str]]) -> tuple[int, DataFrame, set[int], set[int]]:
    """(seed, (_group, check_id, n_obs, med, ll, ul) of groups that have the values their check asks for, places of checks with small groups, and with large ones)."""
    every = [k for some in checks.values() for k in some]
    bits, places = number_bits(every), _places(checks)

    def asked(some: Collection[int] | None) -> dict[str, dict[int, Check]]:
        return {t: own for t, k in places.items() if (own := {n: c for n, c in k.items() if some is None or n in some})}

    def values(seed: int, some: Collection[int] | None) -> DataFrame:
        return reduce(DataFrame.unionByName, [numbered_measures(full[t], own, bits, [], False, whole[t], seed) for t, own in asked(some).items()])

    def wide(seed: int, some: Collection[int] | None) -> list[DataFrame]:
        found = [(t, numbered_columns(full[t], own, bits, False, whole[t], seed)) for t, own in asked(some).items()]
        return [full[t].select(*[c[x].alias(f"{x}:{n}") for n, c in columns.items() for x in ("_group", "value")]) for t, columns in found]

    seed, found, small, large = deviations_by_number(values, wide, (1 << bits) - 1)
    at = F.col("_group").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    of = lambda value: F.get(F.array(*[F.lit(value(k)) for k in every]), at)
    width = of(lambda k: float(k.n_mad)) * (F.col("deviation") * NORMAL)
    limits = found.where(F.col("n") >= of(lambda k: k.min_obs)).select(
        "_group", of(lambda k: k.id).alias("check_id"), F.col("n").alias("n_obs"), F.col("median").alias("med"), (F.col("median") - width).alias("ll"), (F.col("median") + width).alias("ul")
    )
    return seed, stored(limits), small, large


def _places(checks: dict[str, list[Check]]) -> dict[str, dict[int, Check]]:
    """Checks of each table by their place among all."""
    n = count()
    return {t: {next(n): k for k in some} for t, some in checks.items()}


def flagged_by_number(filtered: dict[str, DataFrame], full: dict[str, DataFrame], checks: dict[str, list[Check]], coded: dict[str, list[str]]) -> DataFrame:
    """Outliers of all checks of all tables: interview__id, interview__key, _loc, _codes, check_id, raw, n_obs, med, ll, ul.

    Limits are stored, so Spark knows their size. Where they are many, those of groups of more than GROUP values, which are few, are joined apart, so the rows of
    such a group are not shuffled. What a row shows of itself is put together for outliers only.
    """
    every = [k for some in checks.values() for k in some]
    whole = {t: whole_columns(full[t], filtered[t]) for t in checks}
    seed, limits, small, large = limits_by_number(full, checks, whole)
    if not small | large:  # no values at all
        small = set(range(len(every)))
    if limits.count() <= GROUP:
        joins = [(small | large, limits, None)]
    else:
        few = stored(limits.where(F.col("n_obs") > GROUP))
        joins = [(large, few, None), (small, limits.where(F.col("n_obs") <= GROUP), few.select("_group") if small & large else None)]
    frames = []
    for t, places in _places(checks).items():
        df = filtered[t]
        keep = list(dict.fromkeys(["interview__id", "interview__key", *(c for c in df.columns if c.endswith("__id")), *coded[t]]))
        codes = F.array(*[F.col(c).cast("double") for c in coded[t]]).cast("array<double>")
        for which, of, without in joins:
            own = {n: k for n, k in places.items() if n in which}
            if own:
                rows = numbered_measures(df, own, number_bits(every), keep, True, whole[t], seed).where("value is not null")
                rows = rows if without is None else rows.join(without, "_group", "left_anti")
                rows = rows.join(of, "_group").where(beyond(every))
                frames.append(rows.select("interview__id", "interview__key", _place(df).alias("_loc"), codes.alias("_codes"), "check_id", "raw", "n_obs", "med", "ll", "ul"))
    return reduce(DataFrame.unionByName, frames)


def outlier_issues(
    filtered: dict[str, DataFrame], full: dict[str, DataFrame], checks: dict[str, list[Check]] | None = None, language: str = "en", labels: DataFrame | None = None
) -> DataFrame:
    """Issues of all checks of all tables in one pass: their rows against the groups of all interviews.

    Measures of all tables become rows of one long table; groups are (check, key), so there is one pass for thresholds and one for outliers, however many tables
    and checks there are. Texts name what is checked in ``language``; roster items and units in them are decoded by ``labels`` (dataset, variable, code,
    label; the dataset is the table), where given.
    """
    checks = {**CHECKS, **{k: v for k, v in LAND_CHECKS.items() if k in full}} if checks is None else checks
    filtered, full = with_measures(filtered, checks), with_measures(full, checks)
    checks = {t: [replace(k, table=t) for k in some] for t, some in checks.items()}
    texts = {k.id: check_texts.what(k.var, language) for some in checks.values() for k in some}
    fields = {i: [f for _, f, _ in placeholders(t) if f] for i, t in texts.items()}
    coded = {t: sorted({f for k in some for f in fields[k.id] if f in full[t].columns}) for t, some in checks.items()}
    every = [k for some in checks.values() for k in some]
    rows = flagged_by_number(filtered, full, checks, coded)
    decoder = decode_map(labels, list(checks)) if labels is not None else F.lit(None).cast("map<string,string>")
    places = {t: {c: (f"{t}.{c}", n) for n, c in enumerate(cs)} for t, cs in coded.items()}
    what = compiled_by_key(texts, {k.id: places[t] for t, some in checks.items() for k in some}, F.col("check_id"), decoder, F.col("_codes"))
    rows = rows.withColumn("_what", what)
    desc, comment = described(rows, every, F.col("_what"), language)
    return issue_rows(rows, every, desc, comment, F.col("_loc"), True)
