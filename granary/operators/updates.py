"""Cell values of accepted edits, as a map of column name to new value for ``sinks.merge_updates``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edits as E
from ..functions import text as T

# Fixed values of the data model: list columns that grow, and the field of an edit that holds what is new.
GROWING = [("common_failure_modes", "new_common_failure_modes"), ("borderline_cases", "new_borderline_cases")]


def build(rows: DataFrame, edit: str = "edit", translation: str = "translation") -> DataFrame:
    """``rows`` with ``updates``: the cells that a row's edit and translation (struct columns) change.

    Prompts get the new sentence in the place of the old, lists and the boundary grow, distractors and notes are set, and
    rubric bodies are put in for the dimensions that both languages have. Texts of the translation are flattened. A row
    whose prompts have no boundary sentence has null updates: it has no place for the edit.
    """
    en, ru = (lambda n: F.col(edit)[n]), (lambda n: F.col(translation)[n + "_ru"])
    none = F.create_map().cast("map<string,string>")
    bodies, bodies_ru = F.coalesce(en("rubric_updates"), none), F.coalesce(ru("rubric_updates"), none)
    shared = F.array_intersect(F.map_keys(bodies), F.map_keys(bodies_ru))
    languages = [
        ("", en, T.strip, E.sentence_en, bodies),
        ("_ru", ru, T.flatten, E.sentence_ru, bodies_ru),
    ]
    cells: dict[str, Column] = {}
    found = F.lit(True)
    for end, said, clean, sentence, new in languages:
        prompt = F.col("final_prompt_text" + end)
        old = sentence(prompt)["sentence"]
        found = found & old.isNotNull()
        cells["final_prompt_text" + end] = E.splice_first(prompt, old, clean(said("new_trap_sentence")))
        rule = F.concat(F.lit("- boundary rule: "), clean(said("internal_source_boundary_rule")))
        cells["internal_source_boundary" + end] = E.append_bullets(F.col("internal_source_boundary" + end), F.array(rule))
        for column, field in GROWING:
            cells[column + end] = E.append_bullets(F.col(column + end), said(field))
        cells["optional_distractors" + end] = F.when(F.size(en("optional_distractors")) > 0, E.bullets(said("optional_distractors")))
        cells["boundary_notes" + end] = clean(F.coalesce(said("boundary_notes"), F.lit("")))
        both = F.transform_values(F.map_filter(new, lambda k, _: F.array_contains(shared, k)), lambda _, v: clean(v))  # noqa: B023
        for d in E.DIMENSIONS:
            cells[d + end] = F.element_at(both, d)
        cells["fixed_criteria_0_2_each" + end] = F.when(F.size(shared) > 0, E.compose(F.col("fixed_criteria_0_2_each" + end), both))
    every = F.map_from_arrays(F.array(*map(F.lit, cells)), F.array(*cells.values()))
    return rows.withColumn("updates", F.when(found, F.map_filter(every, lambda _, v: v.isNotNull())))
