"""What the survey's checks look at, as templates: each placeholder is a coded column of the check's table, shown by its label."""

from __future__ import annotations

LANGUAGES = ("en", "fr")

ASSET, FOOD, SERVICE, ANIMAL, HERD = "{r_assets__id}", "{food_consumption_at_home__id}", "{services_roster__id}", "{lv_roster__id}", "{lvstk_id__id}"
SEED = "{r_seed05__id} ({r_seed_type__id}, {ag05_q06_unit})"

#: measure -> (English, French).
WHAT: dict[str, tuple[str, str]] = {
    # dwelling
    "hh11_q04": ("rent the dwelling would bring, for its unit of time", "loyer que rapporterait le logement, pour son unité de temps"),
    "hh11_q05": ("rent paid, for its unit of time", "loyer payé, pour son unité de temps"),
    "hh11_q09": ("cost of repairing the dwelling", "coût des réparations du logement"),
    "hh11_q11": ("cost of improving the dwelling", "coût des améliorations du logement"),
    "hh11_q15": ("rooms of the dwelling", "pièces du logement"),
    # energy, water, refuse, loans
    "daily_elec_exp": ("spending on electricity a day", "dépense d'électricité par jour"),
    "hh12_q09": ("light bulbs in use", "ampoules utilisées"),
    "hh12_q16": ("power cuts of the last week", "coupures de courant de la dernière semaine"),
    "hh12_q24": ("time spent fetching {hh12_q23} ({hh12_q24_tu})", "temps passé à chercher : {hh12_q23} ({hh12_q24_tu})"),
    "hh12_q25": ("spending on {hh12_q23} in the last month", "dépense du dernier mois pour : {hh12_q23}"),
    "hh13_q04": ("time spent fetching water from {hh13_q02}", "temps passé à chercher l'eau : {hh13_q02}"),
    "hh13_q18a": ("spending on refuse taken by {hh13_q17}", "dépense pour les ordures : {hh13_q17}"),
    "hh15a_q18": ("loan for the business from {hh15a_q17}", "prêt pour l'entreprise, de : {hh15a_q17}"),
    # goods, businesses, other income
    "hh14_q03": (f"pieces owned of {ASSET}", f"unités possédées de : {ASSET}"),
    "hh14_q05": (f"price paid for {ASSET}", f"prix payé pour : {ASSET}"),
    "hh14_q06": (f"price hoped for when selling {ASSET}", f"prix espéré à la vente de : {ASSET}"),
    "hh15b_q19": ("staff from outside the household", "personnel hors du ménage"),
    "hh15b_q20": ("profit of the business", "profit de l'entreprise"),
    "hh17_q03": ("income from {r_income__id}", "revenu tiré de : {r_income__id}"),
    # schooling, health, work
    "hh02_q17": ("schooling costs for {hh02_q17_edu_expense__id}", "frais de scolarité pour : {hh02_q17_edu_expense__id}"),
    "hh02_q14": ("scholarship", "bourse d'études"),
    "hh03a_q31": (f"price of {SERVICE}", f"prix de : {SERVICE}"),
    "hh03a_q33": (f"travel costs for {SERVICE}", f"frais de déplacement pour : {SERVICE}"),
    "hh03a_q13": ("travel costs for a consultation", "frais de déplacement pour une consultation"),
    "hh03a_q15": ("price of a consultation", "prix d'une consultation"),
    "hh03a_q18": ("spending on medicines", "dépense de médicaments"),
    "hh03a_q23": ("price of a stay in hospital", "prix d'un séjour à l'hôpital"),
    "hh03a_q25": ("travel costs for a stay in hospital", "frais de déplacement pour un séjour à l'hôpital"),
    "hh03d_q08": ("visits before birth", "visites avant la naissance"),
    "hh04_q34": ("hours of work in the last week", "heures de travail de la dernière semaine"),
    "hh04_q40_amount": ("pay per {hh04_q40_unit}", "salaire par {hh04_q40_unit}"),
    "hh04_q41_amount": ("profit per {hh04_q41_unit}", "profit par {hh04_q41_unit}"),
    # meals away from home
    "hh07_q04": ("spending on breakfasts elsewhere", "dépense de petits déjeuners à l'extérieur"),
    "hh07_q06": ("spending on lunches elsewhere", "dépense de déjeuners à l'extérieur"),
    "hh07_q08": ("spending on dinners elsewhere", "dépense de dîners à l'extérieur"),
    "hh07_q010": ("spending on snacks elsewhere", "dépense de goûters à l'extérieur"),
    "hh07_q012": ("spending on hot drinks elsewhere", "dépense de boissons chaudes à l'extérieur"),
    "hh07_q14": ("spending on soft drinks elsewhere", "dépense de boissons sans alcool à l'extérieur"),
    "hh07_q16": ("spending on alcohol elsewhere", "dépense d'alcool à l'extérieur"),
    # food and other goods
    "hh08_q05_amount": (f"{FOOD} eaten, in {{hh08_q05_unit}}", f"consommation de : {FOOD}, en {{hh08_q05_unit}}"),
    "hh08_q10_amount": (f"{FOOD} bought, in {{hh08_q10_unit}}", f"achat de : {FOOD}, en {{hh08_q10_unit}}"),
    "unit_purchase_price": (f"price of {FOOD} per {{hh08_q10_unit}}", f"prix de : {FOOD}, par {{hh08_q10_unit}}"),
    "hh09a_q03": ("spending of a week on {non_food_7_days__id}", "dépense d'une semaine pour : {non_food_7_days__id}"),
    "hh09b_q03": ("spending of a month on {non_food_30_days__id}", "dépense d'un mois pour : {non_food_30_days__id}"),
    "hh09c_q03": ("spending of half a year on {non_food_6_months__id}", "dépense d'un semestre pour : {non_food_6_months__id}"),
    "hh09d_q03": ("spending of a year on {non_food_12_months__id}", "dépense d'un an pour : {non_food_12_months__id}"),
    # fields
    "unit_price": (f"price of seed: {SEED}", f"prix des semences : {SEED}"),
    "ag06_q03_quantity": ("{r_crop_inputs__id} used, in {ag06_q03_unit}", "emploi de : {r_crop_inputs__id}, en {ag06_q03_unit}"),
    "ag08_q03": ("paid workers ({ag08r_labor__id})", "ouvriers payés ({ag08r_labor__id})"),
    "ag08_q09": ("unpaid helpers ({ag08r_labor__id})", "aides non payées ({ag08r_labor__id})"),
    "ag02_q07_size": ("size of the plot, in {ag02_q07_unit}", "taille de la parcelle, en {ag02_q07_unit}"),
    "amt_fertilizer_type1": ("first fertiliser per area, in {ag02_q16b1_unit}", "premier engrais par surface, en {ag02_q16b1_unit}"),
    "amt_fertilizer_type2": ("second fertiliser per area, in {ag02_q16c1_unit}", "second engrais par surface, en {ag02_q16c1_unit}"),
    "amt_pest_herb_type1": ("first pesticide per area, in {ag02_q18b1_unit}", "premier pesticide par surface, en {ag02_q18b1_unit}"),
    "amt_pest_herb_type2": ("second pesticide per area, in {ag02_q18c1_unit}", "second pesticide par surface, en {ag02_q18c1_unit}"),
    "amt_seed_temp_non_veg": ("seed of {r_crop__id} per area, in {ag03_q05_unit}", "semences de : {r_crop__id}, par surface, en {ag03_q05_unit}"),
    "amt_seed_temp_veg": ("vegetable seed of {r_crop__id} per area, in {ag03_q10_unit}", "semences maraîchères de : {r_crop__id}, par surface, en {ag03_q10_unit}"),
    "num_plants": ("plants of {r_crop__id} per area", "plants de : {r_crop__id}, par surface"),
    "amt_seed_tree_perm": ("planting stock of {r_crop__id} per area, in {ag03_q21_unit}", "matériel de plantation de : {r_crop__id}, par surface, en {ag03_q21_unit}"),
    # animals
    "ag10_q04": (f"{ANIMAL} kept now", f"{ANIMAL} : élevés actuellement"),
    "ag10_q05": (f"{ANIMAL} of foreign breed", f"{ANIMAL} : de race étrangère"),
    "ag10_q08": (f"{ANIMAL} kept for others", f"{ANIMAL} : élevés pour autrui"),
    "ag10_q10": (f"{ANIMAL} owned but kept by others", f"{ANIMAL} : possédés mais confiés"),
    "ag10_q12": (f"{ANIMAL} kept a year ago", f"{ANIMAL} : élevés il y a un an"),
    "ag10_q13": (f"{ANIMAL} born", f"{ANIMAL} : naissances"),
    "ag10_q14": (f"{ANIMAL} bought", f"{ANIMAL} : achetés"),
    "unit_price_bought": (f"{ANIMAL}: price paid for one", f"{ANIMAL} : prix d'achat de l'unité"),
    "ag10_q16": (f"{ANIMAL} received as gifts", f"{ANIMAL} : reçus en don"),
    "ag10_q17": (f"{ANIMAL} sold alive", f"{ANIMAL} : vendus vivants"),
    "unit_price_sold": (f"{ANIMAL}: price of one sold alive", f"{ANIMAL} : prix de vente de l'unité vivante"),
    "ag10_q19": (f"{ANIMAL} slaughtered", f"{ANIMAL} : abattus"),
    "unit_price_slaughtered": (f"{ANIMAL}: price of one slaughtered", f"{ANIMAL} : prix de vente de l'unité abattue"),
    "ag10_q23": (f"{ANIMAL} lost to illness", f"{ANIMAL} : perdus par maladie"),
    "ag10_q24": (f"{ANIMAL} lost to other causes", f"{ANIMAL} : perdus par d'autres causes"),
    "ag10_q27": (f"{ANIMAL} gone astray or stolen", f"{ANIMAL} : égarés ou volés"),
    "ag12_q03": (f"{ANIMAL}: periods of laying", f"{ANIMAL} : périodes de ponte"),
    "ag12_q04": (f"{ANIMAL} that lay eggs", f"{ANIMAL} : pondeuses"),
    "ag12_q05": (f"{ANIMAL}: eggs of one period", f"{ANIMAL} : œufs d'une période"),
    "unit_price_liters_per_anim": (f"{ANIMAL}: litres of milk of one", f"{ANIMAL} : litres de lait de l'unité"),
    "unit_price_milk_sold": (f"{ANIMAL}: price of a litre of milk", f"{ANIMAL} : prix du litre de lait"),
    "ag12_q19": (f"{ANIMAL}: litres of milk made into other goods", f"{ANIMAL} : litres de lait transformés"),
    "ag11_q05": (f"{HERD}: spending on feed", f"{HERD} : dépense d'alimentation"),
    "ag11_q06": (f"{HERD}: spending on breeding", f"{HERD} : dépense de reproduction"),
    "ag11_q07": (f"{HERD}: spending on prevention", f"{HERD} : dépense de prévention"),
    "ag11_q08": (f"{HERD}: spending on cures", f"{HERD} : dépense de soins"),
    "ag13_q03": ("paid herders ({r_aglabor_nonhh__id})", "bergers payés ({r_aglabor_nonhh__id})"),
    "hourly_rate": ("pay of herders per hour ({r_aglabor_nonhh__id})", "salaire horaire des bergers ({r_aglabor_nonhh__id})"),
    "ag15_q05": ("farm tools: pieces of {ag_assets__id}", "outils agricoles : unités de {ag_assets__id}"),
    "ag15_q06": ("farm tools: value of {ag_assets__id}", "outils agricoles : valeur de {ag_assets__id}"),
}

#: Texts of issues. Fields of the row: what, value, n_obs, med, ll, ul, all on the scale of the answer; of the plan: var, by, transform, bounds, n_mad, min_obs, exclude.
DESC = {
    "en": "Unusual value of {what} [{var} = {value:number}; n = {n_obs}; median {med:number}; limits {ll:number} to {ul:number}; scale: {transform}; {n_mad} deviations; "
    "{min_obs} values at least; bounds: {bounds}; by: {by}; left out: {exclude}]",
    "fr": "Valeur inhabituelle de {what} [{var} = {value:number} ; n = {n_obs} ; médiane {med:number} ; limites {ll:number} à {ul:number} ; échelle : {transform} ; {n_mad} écarts ; "
    "au moins {min_obs} valeurs ; bornes : {bounds} ; par : {by} ; exclues : {exclude}]",
}
COMMENT = {
    "en": "{what}: {value:number} is unusual among {n_obs:whole} answers. Correct it if it is wrong, or say in a comment why it is right.",
    "fr": "{what} : {value:number} est inhabituel parmi {n_obs:whole} réponses. Corrigez la valeur si elle est fausse, ou dites en commentaire pourquoi elle est juste.",
}


def what(var: str, language: str) -> str:
    """The template of what a measure is; the measure's own name if there is none."""
    if language not in LANGUAGES:
        raise ValueError(f"no texts in language {language!r}; there are {LANGUAGES}")
    return WHAT[var][LANGUAGES.index(language)] if var in WHAT else var
