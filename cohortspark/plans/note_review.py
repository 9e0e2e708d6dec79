"""Rule-based screening of clinical notes: flags, scores, encounter labels and a review queue."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import (
    alternatives,
    alternatives_in,
    case_insensitive,
    extract_snippet,
    is_plain,
    literals_in,
    mentions,
    normalize_text,
    parse_flexible_datetime,
    search_text,
)
from ..functions.semantics import any_flag, count_where, flag, sum_or_zero
from ..operators.quantiles import null_safe_join
from ..sources.io import ensure_columns, optional_column, require_columns
from ..sources.lookups import CONCEPTS, concept_groups, concept_patterns

ENCOUNTER = ["MRN", "HAR"]
HANDP_COLUMNS = ["MRN", "HAR", "NOTE_ID", "NOTE_TEXT"]
RADIOLOGY_COLUMNS = [*HANDP_COLUMNS, "PROC_NAME"]

# Chest patterns, score weights, signal groups, encounter flags and queue columns.
CHEST_PROCEDURE = "chest|lung|thorax|pe chest|cta pe|ild"
CHEST_TEXT = "chest|lung|pulmonary|pneumon"
SCORE_WEIGHTS = {
    "ici_agent": 3,
    "irae_general": 2, "irae_pneumonitis": 2, "irae_myocarditis": 2, "irae_hepatitis": 2, "irae_colitis": 2,
    "irae_nephritis": 2,
    "irae_endocrine": 1, "irae_neuro": 1, "irae_hlh": 1,
    "treatment_steroid": 1, "treatment_rescue": 2,
    "radiology_supportive_pneumonitis": 2,
    "qualifier_favoring": 1, "qualifier_uncertainty": 0,
}
PRIORITY_SCORE = 3
ICI_GROUPS = ["ici_agent", "ici_general"]
IRAE_GROUPS = [
    "irae_general", "irae_pneumonitis", "irae_myocarditis", "irae_hepatitis", "irae_colitis", "irae_nephritis",
    "irae_endocrine", "irae_neuro", "irae_hlh",
]
COMPETING_GROUPS = ["competing_infection", "competing_progression", "competing_edema", "competing_aspiration"]
ENCOUNTER_FLAGS = {
    "encounter_any_ici_exposure": "candidate_ici_exposure_note",
    "encounter_explicit_ici_agent": "any_ici_agent",
    "encounter_any_irae_signal": "candidate_irae_note",
    "encounter_pneumonitis_signal": "any_irae_pneumonitis",
    "encounter_cardiac_signal": "any_irae_myocarditis",
    "encounter_hepatitis_signal": "any_irae_hepatitis",
    "encounter_colitis_signal": "any_irae_colitis",
    "encounter_renal_signal": "any_irae_nephritis",
    "encounter_endocrine_signal": "any_irae_endocrine",
    "encounter_neurologic_signal": "any_irae_neuro",
    "encounter_hlh_signal": "any_irae_hlh",
    "encounter_competing_infection": "any_competing_infection",
    "encounter_competing_progression": "any_competing_progression",
    "encounter_competing_edema": "any_competing_edema",
    "encounter_competing_aspiration": "any_competing_aspiration",
    "encounter_steroid_signal": "any_treatment_steroid",
    "encounter_rescue_signal": "any_treatment_rescue",
    "encounter_radiology_supportive": "any_radiology_supportive_pneumonitis",
}
HIGH_LABEL = "high_priority_ici_irae_review"
MODERATE_LABEL = "moderate_priority_possible_ici_irae"
QUEUE_COLUMNS = [
    "MRN", "HAR", "note_source", "NOTE_ID", "NOTE_CSN_ID", "note_datetime",
    "NOTE_TYPE", "PROC_NAME", "AUTHOR_SERV", "rule_score", "llm_priority_note",
    "encounter_rule_label",
    "snippet_ici_agent", "snippet_ici_general",
    "snippet_irae_general", "snippet_irae_pneumonitis", "snippet_irae_myocarditis",
    "snippet_competing_infection", "snippet_competing_progression",
    "snippet_radiology_supportive_pneumonitis",
    "NOTE_TEXT",
]


def radiology_filter(notes: DataFrame) -> DataFrame:
    """Chest procedures, or texts that speak of the chest."""

    def speaks(text: Column, pattern: str) -> Column:
        return F.exists(F.array(normalize_text(text)), lambda clean: mentions(clean, pattern))  # cleaned once

    return notes.filter(speaks(F.col("PROC_NAME"), CHEST_PROCEDURE) | speaks(F.col("NOTE_TEXT"), CHEST_TEXT))


def dictionary_flags(
    notes: DataFrame, concepts: Iterable[tuple] = CONCEPTS, domain: str = "all", native: bool = False
) -> DataFrame:
    """``any_<group>`` on the normalized text and ``snippet_<group>`` on the raw text.

    A match that spans a line break therefore sets the flag and leaves the
    snippet empty. Groups of other domains are 0 and missing. ``native`` keeps Python out of the plan.
    """
    concepts = list(concepts)
    patterns = concept_patterns(concepts, domain)
    split = {group: alternatives(pattern) for group, pattern in patterns.items()}
    literals = dict.fromkeys(x for parts in split.values() for _, words in parts or [] for x in words)
    cleaned = (
        notes.withColumn("note_text_clean", normalize_text(F.col("NOTE_TEXT")))
        .withColumn("__search", search_text(F.col("note_text_clean")))
        # Literals are searched once a note, whatever the number of groups and columns that ask for them.
        .withColumn("__literals", literals_in(F.col("__search"), literals, native))
        .drop("__search")
    )
    # Lower case makes two signs of a dotted capital I, which case-insensitive search equates with i.
    dotted = F.col("note_text_clean").contains("\u0307")
    columns: dict[str, Column] = {}
    for group in concept_groups(concepts):
        if group not in patterns:
            columns[f"any_{group}"] = F.lit(0)
            columns[f"snippet_{group}"] = F.lit(None).cast("string")
        elif split[group] is None:
            columns[f"any_{group}"] = F.col("note_text_clean").rlike(case_insensitive(patterns[group])).cast("int")
            columns[f"snippet_{group}"] = extract_snippet(F.col("NOTE_TEXT"), patterns[group])
        else:
            # Most notes hold the literals of no alternative, most others those of one or two.
            plain = [part for part in split[group] if is_plain(part[0])]
            other = [part for part in split[group] if not is_plain(part[0])]
            some, left = (alternatives_in(F.col("__literals"), parts) for parts in (split[group], other))
            found = F.when(left != "", F.rlike("note_text_clean", case_insensitive(left)).cast("int")).otherwise(0)
            columns[f"any_{group}"] = F.when(alternatives_in(F.col("__literals"), plain) != "", 1).otherwise(found)
            columns[f"snippet_{group}"] = F.when(
                some != "", extract_snippet(F.col("NOTE_TEXT"), F.when(dotted, F.lit(patterns[group])).otherwise(some))
            )
    return cleaned.withColumns(columns).drop("__literals")


def note_datetime(notes: DataFrame) -> Column:
    """First readable of the note, finalizing and service times; absent columns count as missing."""
    names = ["NOTE_DTTM", "FINALIZING_DTTM", "SERVICE_DTTM"]
    return F.coalesce(*[parse_flexible_datetime(optional_column(notes, name)) for name in names])


def _any_group(groups: list[str]) -> Column:
    return F.greatest(*[F.col(f"any_{g}") for g in groups])


def score_note(notes: DataFrame) -> DataFrame:
    score = sum((F.col(f"any_{group}") * weight for group, weight in SCORE_WEIGHTS.items()), F.lit(0))
    both = (F.col("candidate_ici_exposure_note") == 1) & (F.col("candidate_irae_note") == 1)
    imaging = (F.col("note_source") == "radiology") & (F.col("any_radiology_supportive_pneumonitis") == 1)
    return notes.withColumn("rule_score", score).withColumn(
        "llm_priority_note", flag((F.col("rule_score") >= PRIORITY_SCORE) | both | imaging)
    )


def note_level(
    notes: DataFrame, note_source: str, domain: str, concepts: Iterable[tuple] = CONCEPTS, native: bool = False
) -> DataFrame:
    """One scored row per note of a source."""
    flagged = dictionary_flags(notes.withColumn("note_source", F.lit(note_source)), concepts, domain, native)
    return score_note(
        flagged.withColumns(
            {
                "candidate_ici_exposure_note": _any_group(ICI_GROUPS),
                "candidate_irae_note": _any_group(IRAE_GROUPS),
                "note_datetime": note_datetime(notes),
            }
        )
    )


def all_notes(
    handp: DataFrame | None, radiology: DataFrame | None, concepts: Iterable[tuple] = CONCEPTS, native: bool = False
) -> DataFrame:
    """Both sources scored and stacked; columns of one source are missing in the other."""
    concepts = list(concepts)
    parts = []
    if handp is not None:
        require_columns(handp, HANDP_COLUMNS, "H&P notes")
        parts.append(note_level(handp, "handp", "all", concepts, native))
    if radiology is not None:
        require_columns(radiology, RADIOLOGY_COLUMNS, "radiology notes")
        parts.append(note_level(radiology_filter(radiology), "radiology", "radiology", concepts, native))
    if not parts:
        raise ValueError("No note source given.")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    defaults = {}
    for group in concept_groups(concepts):
        defaults[f"any_{group}"] = F.lit(0)
        defaults[f"snippet_{group}"] = F.lit(None).cast("string")
    return ensure_columns(out, defaults)


def first_nonmissing(columns: list[str], order: Column) -> Column:
    """Aggregate: first non-empty value, looking through one column after the other, each in row order."""
    firsts = []
    for name in columns:
        value = F.when(F.col(name) != "", F.col(name))
        firsts.append(F.min(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))["v"])
    return F.coalesce(*firsts)


def row_order() -> Column:
    """Source, then time with missing last, then note id."""
    return F.struct(
        F.col("note_source"), F.col("note_datetime").isNull(), F.col("note_datetime"), F.col("NOTE_ID")
    )


def encounter_level(notes: DataFrame) -> DataFrame:
    """One row per encounter; every aggregate is combined before the shuffle."""
    examples: Mapping[str, list[str]] = {
        "example_ici_snippet": ICI_GROUPS,
        "example_irae_snippet": IRAE_GROUPS,
        "example_competing_snippet": COMPETING_GROUPS,
    }
    out = notes.groupBy(*ENCOUNTER).agg(
        F.count(F.lit(1)).alias("n_notes"),
        sum_or_zero(F.col("llm_priority_note")).alias("n_llm_priority_notes"),
        F.min("note_datetime").alias("first_note_datetime"),
        F.max("note_datetime").alias("last_note_datetime"),
        *[any_flag(F.col(source) == 1).alias(name) for name, source in ENCOUNTER_FLAGS.items()],
        F.max("rule_score").alias("max_rule_score"),
        *[
            first_nonmissing([f"snippet_{g}" for g in groups], row_order()).alias(name)
            for name, groups in examples.items()
        ],
    )
    return rule_label(out)


def rule_label(encounters: DataFrame) -> DataFrame:
    def on(name: str) -> Column:
        return F.col(f"encounter_{name}") == 1

    exposed, signal = on("any_ici_exposure"), on("any_irae_signal")
    competing = (
        on("competing_infection") | on("competing_progression") | on("competing_edema") | on("competing_aspiration")
    )
    label = (
        F.when(exposed & (signal | on("radiology_supportive")), HIGH_LABEL)
        .when(signal | (exposed & (on("steroid_signal") | on("rescue_signal"))), MODERATE_LABEL)
        .when(~exposed & ~signal & competing, "competing_diagnosis_only")
        .otherwise("low_signal")
    )
    return encounters.withColumn("encounter_rule_label", label).withColumn(
        "encounter_llm_priority", F.col("encounter_rule_label").isin(HIGH_LABEL, MODERATE_LABEL).cast("int")
    )


def top_k_per_group(
    df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank_in_group"
) -> DataFrame:
    """Rows ranked 1..k in each group; surplus rows are cut in each task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def review_queue(
    notes: DataFrame, encounters: DataFrame, max_handp: int = 2, max_radiology: int = 3
) -> DataFrame:
    """Highest-scored notes of the priority encounters, per source.

    Notes are ranked before the join: ranks are within an encounter, so the
    join with whole encounters does not change them, and it then moves only a
    few notes per encounter.
    """
    order = [F.desc("rule_score"), F.asc_nulls_last("note_datetime"), F.asc("NOTE_ID")]
    top = top_k_per_group(notes, [*ENCOUNTER, "note_source"], order, max(max_handp, max_radiology))
    kept = top.filter(
        ((F.col("note_source") == "handp") & (F.col("rank_in_group") <= max_handp))
        | ((F.col("note_source") == "radiology") & (F.col("rank_in_group") <= max_radiology))
    )
    priority = encounters.filter(F.col("encounter_llm_priority") == 1).select(*ENCOUNTER, "encounter_rule_label")
    queue = null_safe_join(kept, priority, ENCOUNTER)
    return queue.select(*[c for c in QUEUE_COLUMNS if c in queue.columns])


def extraction_summary(notes: DataFrame, encounters: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of totals."""
    label = F.col("encounter_rule_label")
    note_totals = notes.agg(
        F.count(F.lit(1)).alias("n_notes_total"),
        count_where(F.col("note_source") == "handp").alias("n_handp_notes"),
        count_where(F.col("note_source") == "radiology").alias("n_radiology_notes"),
    )
    encounter_totals = encounters.agg(
        F.struct(
            F.count(F.lit(1)).alias("n_encounters"),
            count_where(label == HIGH_LABEL).alias("n_high_priority"),
            count_where(label == MODERATE_LABEL).alias("n_moderate_priority"),
        ).alias("e")
    )
    queued = queue.agg(F.count(F.lit(1)).alias("n"))
    return (
        note_totals.withColumn("e", encounter_totals.scalar())
        .withColumn("n_llm_queue_notes", queued.scalar())
        .select("n_notes_total", "n_handp_notes", "n_radiology_notes", "e.*", "n_llm_queue_notes")
    )
