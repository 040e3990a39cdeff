"""Row rules, entry handling and short texts built from columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitframe.functions.columns import row_sum
from visitframe.scaling import col

Rule = tuple[str, Column, Column]

# Entry names by section.
HISTORY_ITEMS = ["htn_ever", "chol_ever", "diabetes_ever", "mi_ever", "afib_ever", "chf_ever", "revasc_ever", "bypass_ever",
                 "pacemaker_ever", "othercvd_ever", "stroke_ever", "tia_ever"]
MED_ITEMS = ["med_bp", "med_lipid", "med_diabetes", "med_anticoag"]
RISK_ITEMS = ["htn_ever", "chol_ever", "diabetes_ever", "smoke_ever"]


def check_rows(df: DataFrame, rules: Sequence[Rule], out: str = "checks") -> DataFrame:
    """Array of (level, message) for every rule that fires on a row; unknown inputs never fire."""
    found = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(level).alias("level"), msg.alias("message"))) for level, cond, msg in rules]
    return df.withColumn(out, F.filter(F.array(*found), lambda x: x.isNotNull()))


def entry_rules(z_cols: Sequence[str] = ()) -> list[Rule]:
    """Rules on one entry against reference columns joined to it.

    Expected reference columns: `ref_low_z_normal`, `ref_score_p99` (of the entered status),
    `ref_age_lo`, `ref_age_hi`, `ref_educ_lo`.
    """
    c, lit = F.col, F.lit
    lowest = F.least(*[c(z) for z in z_cols]) if len(z_cols) > 1 else (c(z_cols[0]) if z_cols else lit(None).cast("double"))
    score, status = c("score"), c("status")
    return [
        ("check", (status == "Normal") & (lowest < c("ref_low_z_normal")), lit("Test scores are far below expectation although the status is Normal.")),
        ("check", score > c("ref_score_p99"), F.format_string("Score %.1f is above the 99th percentile (%.1f) of this status.", score, c("ref_score_p99"))),
        ("note", (status == "MCI") & (score == 0) & ~(score > c("ref_score_p99")), lit("A score of 0 is uncommon with this status.")),
        ("note", status.isNull() != score.isNull(), lit("Only one of status and score is given.")),
        ("check", score > 5, lit("A score above 5 lies outside the range this model applies to.")),
        ("note", lowest <= -5, lit("A test score is at the lowest usable value.")),
        ("note", ~c("age").between(c("ref_age_lo"), c("ref_age_hi")), F.format_string("Age %.0f is outside the usual range.", c("age"))),
        ("note", c("educ_years") < c("ref_educ_lo"), lit("Education is below the usual range, so adjusted scores are unreliable.")),
        ("check", c("bp_sys") <= c("bp_dia"), lit("Systolic pressure must be above diastolic.")),
        ("check", (c("smoke_years") > 0) & (c("smoke_years") > c("age") - 8), lit("Smoking years do not fit the age.")),
        ("note", ((c("amyloid_positive") == 1) & (c("centiloids") < 10)) | ((c("amyloid_positive") == 0) & (c("centiloids") > 40)),
         lit("Amyloid status and amount disagree.")),
    ]


def to_features(df: DataFrame, values: str = "values", sections: str = "sections") -> DataFrame:
    """A batch of screen entries (name → text, section → on/off) as feature columns; empty or switched-off entries stay null."""
    v, on = F.col(values), F.col(sections)
    has = lambda k: v[k].isNotNull() & (v[k] != "")
    sec = lambda s: F.coalesce(on[s], F.lit(False))
    number = lambda k: F.when(has(k), v[k].cast("double"))
    truth = lambda k: F.coalesce(F.lower(v[k]).isin("true", "1", "yes"), F.lit(False)).cast("int")
    yes_no = lambda k: F.when(v[k] == "Yes", 1).when(v[k] == "No", 0)
    out = {"age": number("age"), "female": (v["sex"] == "Female").cast("int"), "educ_years": number("educ_years"),
           "hispanic": yes_no("hispanic"), "lives_alone": yes_no("lives_alone")}
    stated = F.coalesce(v["race"], F.lit("Not stated")) != "Not stated"
    for r in ("White", "Black", "Asian"):
        out[f"race_{r.lower()}"] = F.when(stated, (v["race"] == r).cast("int"))
    heart = sec("heart")
    for k in [*HISTORY_ITEMS, "smoke_ever"]:
        out[k] = F.when(heart, truth(k))
    out["smoke_years"] = F.when(heart, F.when(truth("smoke_ever") == 0, F.lit(0.0)).otherwise(number("smoke_years")))
    any_med = has("med_count")
    for k in MED_ITEMS:
        any_med = any_med | (truth(k) == 1)
    for k in MED_ITEMS:
        out[k] = F.when(heart & any_med, truth(k))
    for k in ("med_count", "bp_sys", "bp_dia", "heart_rate", "bmi"):
        out[k] = F.when(heart, number(k))
    assess = sec("assessment")
    out["status"] = F.when(assess & v["diagnosis"].isin("Normal", "Impaired, not MCI", "MCI"), v["diagnosis"])
    out["score"] = F.when(assess, number("CDRSUM"))
    for k in ("gds", "npi_count", "tests_failed_cognitive"):
        out[k] = F.when(sec("tests"), number(k))
    genes, untested = sec("genes"), F.coalesce(v["apoe"], F.lit("Not tested")) == "Not tested"
    out["apoe_e4_count"] = F.when(genes & ~untested, v["apoe"].cast("double"))
    out["apoe_unknown"] = F.when(genes, untested.cast("int"))
    out["family_history"] = F.when(genes, yes_no("family_history"))
    pet = sec("pet") & has("centiloids")
    out["centiloids"] = F.when(pet, number("centiloids"))
    out["amyloid_positive"] = F.when(pet, F.coalesce(v["amyloid_status"] == "Positive", F.lit(False)).cast("int"))
    df = df.withColumns(out)
    return df.withColumns({"pulse_pressure": F.col("bp_sys") - F.col("bp_dia"), "vascular_risk_count": row_sum(RISK_ITEMS, 3),
                           "is_mci": (F.col("status") == "MCI").cast("int"),
                           "is_impaired_not_mci": (F.col("status") == "Impaired, not MCI").cast("int")})


def combo(flags: dict[str, Column], base: str) -> Column:
    """`base + A + B` for the flags that are set."""
    return F.concat_ws(" + ", F.lit(base), *[F.when(c, F.lit(name)) for name, c in flags.items()])


def id_hits(df: DataFrame, pattern: str) -> DataFrame:
    """Rows in which any text column holds something shaped like an identifier."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    hit = F.lit(False)
    for c in text:
        hit = hit | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return df.where(hit)


def id_guard(df: DataFrame, pattern: str) -> DataFrame:
    """The table itself, or an error at run time if an identifier would leave."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    bad = lambda c: F.col(c).rlike(pattern)
    return df.withColumns({c: F.when(bad(c), F.raise_error(F.lit(f"identifier in column {c}")).cast("string")).otherwise(F.col(c)) for c in text})


def percent_text(p: str | Column) -> Column:
    return F.when(col(p) < 0.01, "under 1%").otherwise(F.concat(F.bround(col(p) * 100).cast("int").cast("string"), F.lit("%")))


def describe_item(name: str | Column, value: str | Column) -> Column:
    """One model input in words: level text for z-scores, yes/no for flags, the number otherwise."""
    n, v = col(name), col(value)
    level = F.when(v <= -2, "well below").when(v <= -1, "below").when(v < 1, "about as").otherwise("above")
    flag = (v.isin(0.0, 1.0) & n.rlike("(_ever|female|hispanic|lives_alone|family_history)$")) | n.rlike("^(med_|race_)")
    plain = F.regexp_replace(F.format_string("%.2f", v.cast("double")), r"\.?0+$", "")
    text = F.regexp_replace(n, "_", " ")
    return (F.when(n.startswith("z_"), F.concat(F.regexp_replace(n, "^z_", ""), F.lit(" score "), level, F.lit(" expected")))
            .when(flag, F.concat(text, F.lit(": "), F.when(v == 1, "yes").otherwise("no")))
            .otherwise(F.concat(text, F.lit(" of "), plain)))


def first_sentences(c: str | Column, n: int = 2, limit: int = 320) -> Column:
    """First n sentences; longer text is cut at the last space before `limit`."""
    s = F.array_join(F.slice(F.split(F.trim(col(c)), r"(?<=[.!?])\s+"), 1, n), " ")
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, limit), r" [^ ]*$", ""), F.lit(" ...")))


def shape_flags(df: DataFrame) -> DataFrame:
    """Matrix text and whether the file count equals slices × frames."""
    expected = F.col("n_slices") * F.col("n_frames")
    return df.withColumns({
        "matrix": F.coalesce(F.when(F.col("header_ok"), F.format_string("%dx%dx%d", F.col("rows").cast("long"), F.col("cols").cast("long"),
                                                                        F.col("n_slices").cast("long"))), F.lit("unreadable")),
        "expected_files": expected,
        "file_count_matches": F.coalesce((expected == F.col("n_files")) & (expected > 0), F.lit(False))})


def design_view(df: DataFrame, design: str, cols: Sequence[str]) -> DataFrame:
    """Put the strict or the `_nearest` columns under one set of names."""
    if design == "strict":
        return df.drop(*[f"{c}_nearest" for c in cols])
    return df.drop(*cols).withColumnsRenamed({f"{c}_nearest": c for c in cols})
