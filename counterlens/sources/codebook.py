"""The credit codebook: code to label, level order, rendering templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: corrected code table, code to label ---------------------------------------------------------
CODES = {
    "checking": {"A11": "no checking account", "A12": "balance below 0 EUR", "A13": "balance of 0 to 199 EUR",
                 "A14": "balance of 200 EUR or more, or salary paid in for at least 1 year"},
    "credit_history": {"A30": "delays in paying off in the past", "A31": "critical account or other credits elsewhere",
                       "A32": "no credits taken or all credits paid back duly",
                       "A33": "existing credits paid back duly until now",
                       "A34": "all credits at this bank paid back duly"},
    "purpose": {"A40": "other purposes", "A41": "a new car", "A42": "a used car", "A43": "furniture or equipment",
                "A44": "a radio or television", "A45": "domestic appliances", "A46": "repairs", "A47": "education",
                "A48": "a vacation", "A49": "retraining", "A410": "business"},
    "savings": {"A61": "unknown or no savings account", "A62": "less than 100 EUR", "A63": "100 to 499 EUR",
                "A64": "500 to 999 EUR", "A65": "1000 EUR or more"},
    "employment_since": {"A71": "none (unemployed)", "A72": "less than 1 year", "A73": "1 to under 4 years",
                         "A74": "4 to under 7 years", "A75": "7 years or more"},
    "property": {"A121": "unknown or none", "A122": "a car or other property",
                 "A123": "building-society savings or life insurance", "A124": "real estate"},
    "other_installment_plans": {"A141": "with other banks", "A142": "with stores", "A143": "none"},
    "housing": {"A151": "provided for free", "A152": "rented", "A153": "owned"},
    "job": {"A171": "unemployed or unskilled", "A172": "unskilled", "A173": "skilled employee or official",
            "A174": "manager, self-employed or highly qualified employee"},
    "installment_rate": {"1": "35% or more", "2": "25% to under 35%", "3": "20% to under 25%", "4": "less than 20%"},
    "existing_credits": {"1": "1", "2": "2 to 3", "3": "4 to 5", "4": "6 or more"},
    "people_liable": {"1": "0 to 2", "2": "3 or more"},
}
# --- fixed values: code to (sex, marital status) -------------------------------------------------------------------
PERSONAL = {"A91": ("male", "divorced/separated"), "A92": (None, "female non-single or male single"),
            "A93": ("male", "married/widowed"), "A94": ("female", "single")}
# --- fixed values: a sensible lender's score of each level, 0 to 1 ----------------------------------------------------
LENDER_LEVELS = {
    "checking": {"balance below 0 EUR": 0.0, "no checking account": 1 / 3, "balance of 0 to 199 EUR": 2 / 3,
                 "balance of 200 EUR or more, or salary paid in for at least 1 year": 1.0},
    "savings": {"unknown or no savings account": 0.0, "less than 100 EUR": 0.25, "100 to 499 EUR": 0.5,
                "500 to 999 EUR": 0.75, "1000 EUR or more": 1.0},
    "credit_history": {"critical account or other credits elsewhere": 0.0, "delays in paying off in the past": 0.0,
                       "existing credits paid back duly until now": 1.0, "no credits taken or all credits paid back duly": 1.0,
                       "all credits at this bank paid back duly": 1.0},
    "employment_since": {"none (unemployed)": 0.0, "less than 1 year": 0.25, "1 to under 4 years": 0.5,
                         "4 to under 7 years": 0.75, "7 years or more": 1.0},
    "installment_rate": {"35% or more": 0.0, "25% to under 35%": 1 / 3, "20% to under 25%": 2 / 3, "less than 20%": 1.0},
    "property": {"unknown or none": 0.0, "a car or other property": 1 / 3,
                 "building-society savings or life insurance": 2 / 3, "real estate": 1.0},
    "housing": {"rented": 0.5, "provided for free": 0.5, "owned": 1.0},
    "job": {"unemployed or unskilled": 0.0, "unskilled": 1 / 3, "skilled employee or official": 2 / 3,
            "manager, self-employed or highly qualified employee": 1.0},
    "existing_credits": {"1": 1.0, "2 to 3": 2 / 3, "4 to 5": 1 / 3, "6 or more": 0.0},
    "other_installment_plans": {"none": 1.0, "with stores": 0.0, "with other banks": 0.0},
    "dependents": {"0 to 2": 1.0, "3 or more": 0.0},
}
LOW_IS_GOOD = ("duration_months", "credit_amount_dm")
# --- fixed values: document templates; the marker slot is the same in every cell -----------------------------------------
CREDIT_TEMPLATES = {
    "credit_v1": "Credit application summary.{marker} The applicant requests a loan of {credit_amount_dm} EUR over "
                 "{duration_months} months for {purpose}. Checking account: {checking}. Savings: {savings}. Time with current "
                 "employer: {employment_since}. Job: {job}. Credits at this bank, including this one: {existing_credits}. "
                 "Credit history: {credit_history}. Housing: {housing}. Most valuable property: {property}. Installments as a "
                 "share of disposable income: {installment_rate}. Other installment plans: {other_installment_plans}. People "
                 "financially dependent on the applicant: {dependents}.",
    "credit_v2": "Loan request under review.{marker} A loan of {credit_amount_dm} EUR is requested over a term of "
                 "{duration_months} months, intended for {purpose}. Banking position: checking account: {checking}; savings: "
                 "{savings}. Employment: time with current employer: {employment_since}; job category: {job}. Credit record: "
                 "credits held at this bank, including this one: {existing_credits}; history: {credit_history}. Living "
                 "situation: housing: {housing}; most valuable property: {property}. Repayment burden: installments take "
                 "{installment_rate} of disposable income; other installment plans: {other_installment_plans}; financially "
                 "dependent people: {dependents}.",
}
BIO_TEMPLATES = {
    "bios_v1": "Candidate profile, submitted for a role as {role}.{marker}\n\nProfile:\n{body}",
    "bios_v2": "The following is a candidate's professional profile, under review for a position as {role}.{marker}\n\n"
               "Text of the profile:\n{body}",
}
ESSAY_TEMPLATES = {
    "edu_v1": "Student essay submission.{marker}\n\n{assignment}Essay:\n{body}",
    "edu_v2": "The following is a student's essay, submitted for assessment.{marker}\n\n{assignment}Text of the essay:\n{body}",
}


def lookup(mapping: dict[str, str | float], code: Column, what: str) -> Column:
    """A literal map lookup; a value outside the table fails the job."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.try_element_at(table, code)
    kind = "double" if isinstance(next(iter(mapping.values())), float) else "string"
    return F.when(found.isNotNull() | code.isNull(), found).otherwise(
        F.raise_error(F.concat(F.lit(f"unknown {what}: "), code)).cast(kind))


def decode(lines: DataFrame) -> DataFrame:
    """Typed records from coded fields: labels, two booleans, the sex/marital split and the class label."""
    cols = [lookup(CODES[f], F.col(f), f).alias("dependents" if f == "people_liable" else f) for f in CODES]
    sex = F.try_element_at(F.create_map(*[F.lit(x) for k, v in PERSONAL.items() if v[0] for x in (k, v[0])]), F.col("personal_status_sex"))
    marital = lookup({k: v[1] for k, v in PERSONAL.items()}, F.col("personal_status_sex"), "personal status")
    return lines.select(
        "source_record_id", *cols, F.col("duration_months").cast("int").alias("duration_months"),
        F.col("credit_amount_dm").cast("int").alias("credit_amount_dm"), (F.col("telephone") == "A192").alias("telephone"),
        (F.col("foreign_worker") == "A202").alias("foreign_worker"), (F.col("credit_class").cast("string") == "1").alias("credit_good"),
        sex.alias("raw_sex"), marital.alias("raw_marital"), F.col("age_years").cast("int").alias("raw_age_years"))


def render(template: str, slots: dict[str, Column], marker: Column) -> Column:
    """Fill a template: one concatenation, the marker at its slot."""
    import re

    parts = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        if not piece:
            continue
        if piece == "{marker}":
            parts.append(marker)
        elif piece.startswith("{"):
            name = piece[1:-1]
            if name not in slots:
                raise KeyError(f"template slot {name!r} has no value")
            parts.append(slots[name].cast("string"))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def checked_marker(marker: Column) -> Column:
    """A marker is empty or starts with a space."""
    return F.when((marker == "") | marker.startswith(" "), marker).otherwise(
        F.raise_error(F.concat(F.lit("marker must start with a space: "), marker)))


def credit_slots() -> dict[str, Column]:
    names = ["credit_amount_dm", "duration_months", "purpose", "checking", "savings", "employment_since", "job",
             "existing_credits", "credit_history", "housing", "property", "installment_rate", "other_installment_plans",
             "dependents"]
    return {n: F.col(n) for n in names}


def assignment_block(assignment: Column) -> Column:
    """The task an essay answers, or nothing."""
    return F.when(F.trim(assignment) != "", F.concat(F.lit("Assignment:\n"), F.trim(assignment), F.lit("\n\n"))).otherwise(F.lit(""))


def lender_score(records: DataFrame, key: str) -> DataFrame:
    """Equal-weight common-sense score: eleven level tables plus two low-is-good ranks (ties share their mean rank)."""
    from counterlens.operators.ranking import average_rank

    levels = F.lit(0.0)
    for field, table in LENDER_LEVELS.items():
        levels = levels + lookup(table, F.col(field), f"{field} level")
    base = records.select(key, levels.alias("score"), *[F.col(c).cast("double").alias(c) for c in LOW_IS_GOOD])
    n = records.agg(F.count(F.lit(1)).alias("__n"))
    for c in LOW_IS_GOOD:
        base = average_rank(base, [], c, f"__rank_{c}")
    ranks = F.lit(0.0)
    for c in LOW_IS_GOOD:
        ranks = ranks + F.when(F.col("__n") == 1, 1.0).otherwise(1.0 - (F.col(f"__rank_{c}") - 1) / (F.col("__n") - 1))
    return base.crossJoin(F.broadcast(n)).select(key, (F.col("score") + ranks).alias("lender_score"))


REAL_CLAUSES = {("male", "divorced/separated"): " The applicant is a divorced man.",
                ("male", "married/widowed"): " The applicant is a married man.",
                ("female", "single"): " The applicant is a single woman."}


def real_field_clause(sex: Column, marital: Column) -> Column:
    """Clause of the recorded sex and marital status; a code that does not name a sex is refused."""
    out = None
    for (s, m), text in REAL_CLAUSES.items():
        cond = (sex == s) & (marital == m)
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(F.raise_error(F.concat(F.lit("no clause for "), F.coalesce(marital, F.lit("?")))))
