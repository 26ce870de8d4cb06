"""Named drop rules, drop reasons and the reports that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterlens.functions import text as T

Rule = tuple[str, Column]


def flagged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One boolean per rule (a null predicate does not trip it) and ``dropped`` if any trips."""
    out = df.select("*", *[F.coalesce(c, F.lit(False)).alias(f"rule:{n}") for n, c in rules])
    hit = F.lit(False)
    for n, _ in rules:
        hit = hit | F.col(f"`rule:{n}`")
    return out.withColumn("dropped", hit)


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The records that trip no rule."""
    return flagged(df, rules).filter(~F.col("dropped")).select(*df.columns)


def rule_report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``n_in``, ``n_out`` and one count per rule (a record counts under every rule it trips), as rows."""
    f = flagged(df, rules).agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(~F.col("dropped")).alias("n_out"),
        *[F.count_if(F.col(f"`rule:{n}`")).alias(n) for n, _ in rules])
    names = ["n_in", "n_out"] + [n for n, _ in rules]
    return f.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in names])).alias("e")
                    ).select("e.rule", "e.n")


def observed_rules(df: DataFrame, rules: list[Rule], name: str = "rules"):
    """The kept records and an Observation that fills with the report when they are written: one pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    f = flagged(df, rules).observe(
        seen, F.count(F.lit(1)).alias("n_in"), F.count_if(~F.col("dropped")).alias("n_out"),
        *[F.count_if(F.col(f"`rule:{n}`")).alias(n) for n, _ in rules])
    return f.filter(~F.col("dropped")).select(*df.columns), seen


def first_reason(reasons: list[Rule]) -> Column:
    """The first reason that applies, null for a kept record."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in reasons])


def reason_report(df: DataFrame, reason: str, group: str) -> DataFrame:
    """Drops per reason and group; ``kept`` for records without a reason."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason"), group).agg(F.count(F.lit(1)).alias("n"))


# ---- rule sets -------------------------------------------------------------------------------------------------
def credit_record_rules() -> list[Rule]:
    skilled = F.col("job").isin("skilled employee or official", "manager, self-employed or highly qualified employee")
    return [("unemployed_with_skilled_or_management_job", (F.col("employment_since") == "none (unemployed)") & skilled),
            ("owned_housing_without_real_estate", (F.col("housing") == "owned") & (F.col("property") != "real estate"))]


def credit_factorial_rules() -> list[Rule]:
    return [("single_level_with_3_or_more_dependents", F.col("dependents") == "3 or more")]


def hiring_rules(body: str = "bio_text") -> list[Rule]:
    """Texts that fit both ages: no early year, no long career, no retirement."""
    t = F.col(body)
    years = F.regexp_extract_all(t, F.lit(f"(?i)(?=\\d){T.LEFT}(\\d{{1,2}})\\+?\\s*(?:-\\s*)?(?:plus\\s+)?years?{T.RIGHT}"), F.lit(1))
    in_words = (f"(?i)(?=[dfnte])(?:{T.LEFT}(?:nine|ten|eleven|twelve|fifteen|twenty|thirty|forty){T.RIGHT}[\\p{{L}}\\p{{N}}_\\s-]{{0,12}}"
                f"{T.LEFT}years?{T.RIGHT}|{T.LEFT}decades?{T.RIGHT})")
    return [("mentions_year_before_2014", F.rlike(t, F.lit(f"(?=[12]){T.LEFT}(?:19\\d\\d|200\\d|201[0-3]){T.RIGHT}"))),
            ("mentions_more_than_8_years", F.exists(years, lambda y: y.cast("int") > 8)),
            ("mentions_many_years_in_words", F.rlike(t, F.lit(in_words))),
            ("mentions_retirement", T.mentions(t, "retire(?:d|ment)", starts="r"))]


# --- fixed values: essay prompts that presuppose no pupil, and the pupil cues -------------------------------------
NEUTRAL_PROMPTS = ["Does the electoral college work?", "Facial action coding system", "Exploring Venus",
                   "Driverless cars", "\"A Cowboy Who Rode the Waves\"", "Car-free cities", "The Face on Mars"]
PUPIL_CUES = [
    ("mentions_own_school_life", "(?:my|our)\\s+(?:teacher|teachers|school|schools|class|classes|classmate|classmates|"
                                 "principal|homeroom|parents|mom|dad)"),
    ("names_a_school_stage", "(?:elementary|middle school|high school|junior high|primary school|grade school)"),
    ("states_own_grade", "(?:sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|[6-9]th|1[0-2]th)\\s+grade"),
    ("speaks_as_a_pupil", "(?:we|us)\\s+(?:kids|students|teens|teenagers)|as\\s+a\\s+(?:kid|teen|teenager|student)"),
    ("mentions_school_routine", "(?:homework|recess|detention|report card)"),
    ("addresses_a_school_authority", "dear\\s+(?:principal|teacher|mr|mrs|ms|superintendent)"),
]
CUE_STARTS = dict(zip([n for n, _ in PUPIL_CUES], ("mo", "emhjpg", "sent6-91", "wua", "hrd", "d")))
OWN_MONEY = (f"(?i)(?=[mo]){T.LEFT}(?:my|our)\\s+(?:family|parents|mom|dad|household){T.RIGHT}[^.]{{0,40}}"
             f"{T.LEFT}(?:poor|rich|wealthy|afford|money|income|broke|struggl)[\\p{{L}}\\p{{N}}_]*")


def essay_rules(body: str = "essay_text", prompt: str = "prompt_id", prompts: list[str] | None = NEUTRAL_PROMPTS
                ) -> list[Rule]:
    rules: list[Rule] = []
    if prompts:
        rules.append(("prompt_presupposes_a_pupil", F.col(prompt).isNull() | ~F.col(prompt).isin(prompts)))
    rules += [(n, T.mentions(body, p, starts=CUE_STARTS[n])) for n, p in PUPIL_CUES]
    rules.append(("mentions_own_household_money", F.rlike(F.col(body), F.lit(OWN_MONEY))))
    rules.append(("ends_with_a_signoff", T.ends_with_signoff(body)))
    return rules


# ---- first names in a text ------------------------------------------------------------------------------------------
def first_name_hits(df: DataFrame, key: str, body: str, names: DataFrame, name: str = "name") -> DataFrame:
    """Per text the first listed first name used as a person's: rows (key, first_name) for texts with a hit.

    Candidates are capitalised mixed-case words not next to a place or institution cue. They leave the text in one
    narrow pass; only candidates meet the list, which is broadcast when its counted size allows."""

    runs = df.select(key, F.regexp_extract_all(F.col(body), F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)).alias("r"))
    n = F.size("r")

    def at(i: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("r"), i), F.lit(""))

    def candidate(w: Column, i: Column) -> Column:
        pos = i + 1
        before, after = F.when(pos > 1, at(pos - 1)).otherwise(""), F.when(pos < n, at(pos + 1)).otherwise("")
        prev = F.when(pos > 2, at(pos - 2)).otherwise("")
        nxt = F.when(pos + 1 < n, at(pos + 2)).otherwise("")
        # \z, as $ also matches before a last line break; and white space without the vertical tab
        inside = ~F.rlike(before, F.lit("[\\p{L}\\p{N}_]\\z")) & ~F.rlike(after, F.lit("^[\\p{L}\\p{N}_]"))
        named = F.rlike(w, F.lit("^[A-Z][A-Za-z]*[a-z][A-Za-z]*\\z"))
        place = F.rlike(before, F.lit("^\\.?[\\t\\n\\f\\r ]*\\z")) & F.lower(prev).isin(T.PLACE_BEFORE)
        body_after = F.rlike(after, F.lit("^[\\t\\n\\f\\r ]+\\z")) & F.lower(nxt).isin(T.PLACE_AFTER)
        return F.when(named & inside & ~before.endswith("-") & ~place & ~body_after, F.struct(pos.alias("pos"), w.alias("w")))

    hits = (runs.select(key, F.explode(F.filter(F.transform("r", candidate), lambda x: x.isNotNull())).alias("c"))
            .select(key, "c.pos", "c.w", F.lower("c.w").alias("__l")))
    listed = names.select(F.lower(F.col(name)).alias("__l")).distinct()
    return (hits.join(listed, "__l").groupBy(key)
            .agg(F.min_by("w", "pos").alias("first_name")))


# ---- label leaks, mixes, placeholders ---------------------------------------------------------------------------------
def label_leak(df: DataFrame, value: str, label: str) -> DataFrame:
    """How well one field alone predicts a boolean label: best accuracy and the range of P(label | value)."""
    per = df.groupBy(value).agg(F.count_if(F.col(label)).alias("y"), F.count_if(~F.col(label)).alias("n"))
    share = F.round(F.col("y") / (F.col("y") + F.col("n")), 3)
    return per.agg(F.round(F.sum(F.greatest("y", "n")) / F.sum(F.col("y") + F.col("n")), 4).alias("single_field_accuracy"),
                   F.min(share).alias("p_min"), F.max(share).alias("p_max"))


def stage_mix(df: DataFrame, group: str, after: Column, used: Column) -> DataFrame:
    """Per group: loaded, left after the rules, used; keep rate and shares. One pass over stage flags."""
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("loaded"), F.count_if(after).alias("after_rules"),
                                F.count_if(used).alias("used"))
    every = Window.partitionBy(F.lit(0))
    return per.select(group, "loaded", "after_rules", "used", F.round(F.col("after_rules") / F.col("loaded"), 4).alias("keep_rate"),
                      F.round(F.col("loaded") / F.sum("loaded").over(every), 4).alias("share_loaded"),
                      F.coalesce(F.round(F.col("used") / F.when(F.sum("used").over(every) > 0, F.sum("used").over(every)), 4),
                                 F.lit(0.0)).alias("share_used"))


def placeholder_report(df: DataFrame, body: str, label: str, pattern: str = T.PLACEHOLDER) -> DataFrame:
    """Texts with each placeholder token, by class."""
    tokens = df.select(label, F.explode(F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(0)))).alias("token"))
    return tokens.groupBy("token").agg(F.count_if(F.col(label)).alias("strong"), F.count_if(~F.col(label)).alias("weak"))


def cap_limit(counts: DataFrame, size: str, cap: float) -> DataFrame:
    """The largest per-group size at which no group exceeds ``cap`` of the capped pool: one row (``limit``), null
    when no group is over it. ``counts`` has one row per group."""
    desc = Window.partitionBy(F.lit(0)).orderBy(F.col(size).desc())
    c = counts.select(size, F.row_number().over(desc).alias("k"),
                      F.sum(size).over(Window.partitionBy(F.lit(0))).alias("total"),
                      F.sum(size).over(desc.rowsBetween(Window.unboundedPreceding, 0)).alias("top"),
                      F.lead(size).over(desc).alias("next"))
    m = F.when(cap * F.col("k") < 1, F.floor(F.lit(cap) * (F.col("total") - F.col("top")) / (1 - cap * F.col("k"))))
    c = c.withColumn("m", F.coalesce(m, F.first(size).over(desc)))
    fits = F.col("next").isNull() | (F.col("m") >= F.col("next"))
    return c.agg(F.when(F.max(size) > cap * F.max("total"),
                        F.min_by(F.least("m", size), F.when(fits, F.col("k")))).cast("long").alias("limit"))
