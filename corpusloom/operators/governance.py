"""Advisory bands, gaps between mix layers and cap decisions, each in full."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Patterns, what they measure, limits of warn and hold.
BANDS = [
    ("single_template_dominance", "above", 0.50, 0.75),
    ("single_base_family_dominance", "above", 0.50, 0.75),
    ("recipe_repetition", "above", 0.50, 0.75),
    ("degradation_skew", "above", 0.60, 0.85),
    ("font_skew", "whole", 0.70, 1.00),
    ("style_control_skew", "control", 0.80, None),
    ("condition_control_skew", "control", 0.80, None),
    ("seed_contiguity_risk", "reached", 1.00, None),
    ("duplicate_text", "above", 0.05, 0.20),
    ("near_duplicate_text", "above", 0.10, 0.25),
    ("text_feature_gap", "none", 0.00, None),
    ("unreviewed_stratum", "none", 0.00, None),
    ("coverage_sidecar_gap", "any", 0.00, None),
    ("synthetic_artifact_repetition", "repeated", 1.00, None),
]
#: Fixed value: least samples of non-default controls.
LEAST_NON_DEFAULT = 5


def skew_bands(metrics: DataFrame) -> DataFrame:
    """(pattern, stratum, value, level) of metrics (pattern, stratum, value, non_default, claimed, strict, tiny).

    value: a share, or a count of strata or dimensions; non_default: samples with other controls than the default;
    claimed: the purpose makes the claim the band is about, without it the level is ok; strict: what turns a warning
    without a hold limit into one (coverage claimed, no limitation stated, use beyond a dry run); tiny: a fixture or smoke
    test, whose findings are info.  Null values and patterns without a band have no row; null flags are false."""
    table = metrics.sparkSession.createDataFrame(BANDS, "pattern string, kind string, warn double, hold double")
    rows = metrics.where("value IS NOT NULL").join(F.broadcast(table), "pattern")
    v, kind = F.col("value"), F.col("kind")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    over = F.when(kind == "reached", v >= F.col("warn")).when(kind == "none", v <= 0).when(kind == "control", (v > F.col("warn")) | F.coalesce(F.col("non_default") < LEAST_NON_DEFAULT, F.lit(False))).otherwise(v > F.col("warn"))
    far = F.when(kind == "whole", v >= F.col("hold")).when(kind == "above", v > F.col("hold")).when(kind == "control", F.coalesce(F.col("non_default") == 0, F.lit(False))).otherwise(over & flag("strict"))
    level = F.when(~flag("claimed"), "ok").when(~(over | far), "ok").when(flag("tiny"), "info").when(far, "hold").otherwise("warn")
    return rows.select("pattern", "stratum", "value", level.alias("level"))


# Layers in order, and gap reasons.
LAYERS = ("requested", "observed", "reviewed", "capped", "released")
OVER_REASON = {
    "template_id": "overrepresented_template", "recipe_id": "overrepresented_template", "base_family": "overrepresented_base_family",
    "degradation_preset": "degradation_or_font_skew", "font_id": "degradation_or_font_skew", "source_corpus": "source_corpus_skew",
}
SPARSE_REASON = {"persona": "insufficient_non_default_style_coverage", "condition": "insufficient_non_default_condition_coverage"}
PROFILE_REASONS = (
    "seed_concentration", "coverage_report_missing", "s6c_warning_unresolved", "review_sidecar_missing", "utility_evidence_missing",
    "domain_shift_unmeasured", "downstream_profile_missing", "governance_dependency_missing", "forbidden_claim_risk",
)


def profile_gaps(strata: DataFrame, profile: DataFrame) -> DataFrame:
    """(reason, layer, dimension, stratum, n, share): gaps of a profile, of its strata and as a whole.

    strata: dimension, stratum, class (required, preferred, excluded or null), max_share, max_n, least_n, is_default, and a
    count for each layer but the first, null where the layer does not exist yet; requested may be null too.
    profile: reason, broken; a row for each of PROFILE_REASONS that was judged, other names raise no gap.
    A required stratum is missing in a layer that exists but does not hold it; an excluded one that is observed, or a
    count above max_n, conflicts with the caps; shares are of the observed layer's dimension."""
    total = strata.groupBy("dimension").agg(F.sum("observed").alias("__t"), F.sum(F.when(~F.col("is_default"), F.col("observed"))).alias("__other"), F.max("least_n").alias("__least"))
    rows = strata.join(total, "dimension").withColumn("share", T.ratio(F.col("observed"), F.col("__t")))
    n = F.col("observed")
    name = lambda d: F.coalesce(*[F.when(F.col("dimension") == k, r) for k, r in d.items()])
    gap = lambda cond, reason, layer, count: F.when(cond, F.struct(reason.alias("reason"), F.lit(layer).alias("layer"), count.cast("long").alias("n")))
    # a stratum that was never observed is a gap of the observed layer, not one more of each later layer
    found: list[Column] = [gap((F.col("class") == "required") & (F.col(c) == 0) & ((F.lit(c == "observed")) | (n > 0)) & F.lit(c != "reviewed"), F.lit("missing_stratum"), c, F.col(c)) for c in LAYERS[1:]]
    found += [
        gap((F.col("class") == "required") & (n > 0) & (F.col("reviewed") == 0), F.lit("unreviewed_requested_stratum"), "reviewed", F.col("reviewed")),
        gap((F.col("share") > F.col("max_share")) & name(OVER_REASON).isNotNull(), name(OVER_REASON), "observed", n),
        gap((n > F.col("max_n")) | ((F.col("class") == "excluded") & (n > 0)), F.lit("cap_conflict"), "observed", n),
        gap(F.col("requested") > F.col("max_n"), F.lit("cap_conflict"), "requested", F.col("requested")),
    ]
    own = rows.select("dimension", "stratum", "share", F.explode(F.array_compact(F.array(*found))).alias("g")).select("g.reason", "g.layer", "dimension", "stratum", "g.n", "share")
    other = F.coalesce("__other", F.lit(0))
    sparse = total.where(name(SPARSE_REASON).isNotNull() & (other < F.col("__least"))).select(name(SPARSE_REASON).alias("reason"), F.lit("observed").alias("layer"), "dimension", F.lit(None).cast("string").alias("stratum"), other.alias("n"), T.ratio(other, F.col("__t")).alias("share"))
    whole = profile.where(F.col("broken") & F.col("reason").isin(*PROFILE_REASONS)).select("reason", F.lit("profile").alias("layer"), *[F.lit(None).cast(t).alias(c) for c, t in (("dimension", "string"), ("stratum", "string"), ("n", "long"), ("share", "double"))])
    return own.unionByName(sparse).unionByName(whole)


# Dimensions whose caps have a reason of their own, and statuses of purposes.
CAP_REASON = {
    "document_family": "family_or_template_cap_exceeded", "base_family": "family_or_template_cap_exceeded",
    "template_id": "family_or_template_cap_exceeded", "recipe_id": "family_or_template_cap_exceeded",
    "persona": "style_or_condition_cap_exceeded", "condition": "style_or_condition_cap_exceeded",
    "degradation_preset": "degradation_or_font_cap_exceeded", "font_id": "degradation_or_font_cap_exceeded",
}
ADMIT = {"diagnostic": "diagnostic_only", "dry_run": "admit_for_dry_run", "utility": "admit_for_utility_evaluation", "release": "admit_for_release"}
#: Findings of a slice and the reason each gives; the first two reject, the others hold.
EVIDENCE = {
    "leakage": "leakage_or_contamination_risk", "distorted": "source_composition_distortion", "unreviewed": "review_evidence_insufficient",
    "utility_unmeasured": "utility_evidence_unmeasured", "shift_unmeasured": "domain_shift_unmeasured", "shift_risk": "domain_shift_risk", "ungoverned": "governance_dependency_missing",
}


def cap_status(slices: DataFrame, strata: DataFrame) -> DataFrame:
    """(slice, n, share, admitted, status, reasons) of slices of synthetic items under a release profile.

    slices: slice, purpose, n, others (items of other sources), max_n, max_share, and a boolean for each name in EVIDENCE;
    strata: slice, dimension, n, max_n of the strata that the profile caps.  A null cap does not bind, null flags are false.
    Diagnostic slices are admitted as such only.  Leakage or a distorted source mix rejects; missing evidence holds;
    then a slice over a cap is admitted reduced to the most items that fit (admitted), or rejected if none do; others are
    admitted for their purpose; an unknown purpose holds.  reasons are sorted; within_release_profile_cap if no cap is passed."""
    over = strata.where("n > max_n").groupBy("slice").agg(F.collect_set(F.coalesce(*[F.when(F.col("dimension") == k, r) for k, r in CAP_REASON.items()], F.lit("source_composition_distortion"))).alias("__strata"), F.max(F.col("n") - F.col("max_n")).alias("__most"))
    rows = slices.join(over, "slice", "left").withColumn("share", T.ratio(F.col("n"), F.col("n") + F.col("others")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    # n / (n + others) <= max_share holds up to this many items
    fit = F.when(F.col("max_share") < 1, F.floor(F.round(F.col("max_share") * F.col("others") / (1 - F.col("max_share")), 9)))
    over_n, over_s = F.coalesce(F.col("n") > F.col("max_n"), F.lit(False)), F.coalesce(F.col("n") > fit, F.lit(False))
    cut = F.coalesce(F.col("__strata"), F.array().cast("array<string>"))
    capped = F.concat(F.when(over_s, F.array(F.lit("synthetic_percentage_cap_exceeded"))).otherwise(F.array().cast("array<string>")), F.when(over_n, F.array(F.lit("synthetic_absolute_cap_exceeded"))).otherwise(F.array().cast("array<string>")), cut)
    # strata of one dimension are disjoint, those of several are not: the greatest surplus of one stratum has to go at least
    admitted = F.greatest(F.lit(0), F.least(F.col("n") - F.coalesce("__most", F.lit(0)), F.col("max_n"), fit))
    evidence = F.array_compact(F.array(*[F.when(flag(c), r) for c, r in EVIDENCE.items()]))
    reject = flag("leakage") | flag("distorted")
    hold = reduce(lambda a, b: a | b, [flag(c) for c in list(EVIDENCE)[2:]])
    purpose = F.coalesce(*[F.when(F.col("purpose") == k, s) for k, s in ADMIT.items()], F.lit("hold"))
    status = F.when(F.col("purpose") == "diagnostic", "diagnostic_only").when(reject, "reject").when(hold, "hold").when((F.size(capped) > 0) & (admitted == 0), "reject").when(F.size(capped) > 0, "admit_reduced").otherwise(purpose)
    reasons = F.array_sort(F.array_distinct(F.concat(evidence, F.when(F.size(capped) == 0, F.array(F.lit("within_release_profile_cap"))).otherwise(capped))))
    return rows.select("slice", "n", "share", F.when(status.startswith("admit"), admitted).otherwise(0).cast("long").alias("admitted"), status.alias("status"), reasons.alias("reasons"))
