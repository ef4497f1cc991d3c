"""Fixed, versioned table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _B, _D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()
_SA, _DA = T.ArrayType(_S), T.ArrayType(_D)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


BLOCK = _struct(
    schema_version=_I, id=_S, source_type=_S, source_file=_S, page=_L, source_order=_L, block_order=_L,
    block_type=_S, raw_text=_S, corrected_text=_S, bbox=_DA, legibility=_S, status=_S, warnings=_SA,
    source_refs=_SA, source_hash=_S,
)
SEGMENT = _struct(
    schema_version=_I, source_block_id=_S, source_file=_S, page=_L, source_order=_L, block_type=_S,
    source_text=_S, source_sha256=_S, translated_text=_S, translation_sha256=_S, status=_S, model=_S,
    prompt_sha256=_S, termbase_sha256=_S,
)
APPROVED = _struct(
    schema_version=_I, source_block_id=_S, source_file=_S, page=_L, source_order=_L, block_type=_S,
    source_text=_S, source_sha256=_S, draft_translation=_S, draft_translation_sha256=_S,
    corrected_translation=_S, final_translation_sha256=_S, status=_S, model=_S, prompt_sha256=_S,
    termbase_sha256=_S,
)
FRAGMENT = _struct(
    id=_S, text=_S, bbox=_DA, block_index=_I, line_index=_I, direction=_DA, font_sizes=_DA,
)
LAYOUT_BLOCK = _struct(
    type=_S, fragment_ids=_SA, include_in_text=_B, reason=_S, text=_S, warnings=_SA, recovered_fragment_ids=_SA,
)
LAYOUT = _struct(blocks=T.ArrayType(LAYOUT_BLOCK))
PAGE_FRAGMENTS = _struct(page=_L, page_size=_DA, fragments=T.ArrayType(FRAGMENT))
PAGE_LAYOUT = _struct(page=_L, reconstructed_blocks=T.ArrayType(LAYOUT_BLOCK))
OCR_BLOCK = _struct(type=_S, text=_S, bbox=_DA, legibility=_S)
OCR_RESULT = _struct(source_image=_S, ocr=_struct(blocks=T.ArrayType(OCR_BLOCK), warnings=_SA))
TERM_ENTRY = _struct(
    candidate_id=_S, source_term=_S, translation=_S, category=_S, status=_S, note=_S, variants=_SA,
    occurrences=_L, block_ids=_SA, locations=_SA, example=_S, origin=_S, source_verified=_B,
)
TERMBASE = _struct(schema_version=_I, project_id=_S, entries=T.ArrayType(TERM_ENTRY))
GLOSSARY_ROW = _struct(
    status=_S, source_term=_S, translation=_S, category=_S, note=_S, variants=_S, occurrences=_S,
    locations=_S, example=_S, candidate_id=_S,
)
MANIFEST = _struct(
    schema_version=_I, project_id=_S, name=_S, profile=_S, source_language=_S, target_language=_S,
    source_file=_S, created_at=_S,
)
JOB = _struct(
    job_id=_S, project_id=_S, kind=_S, status=_S, progress_message=_S, progress_current=_L, progress_total=_L,
    error=_S, created_at=_S, started_at=_S, finished_at=_S, updated_at=_S,
)
TRANSLATION_RESPONSE = _struct(translations=T.ArrayType(_struct(id=_S, text=_S)))


def with_project(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("project_id", _S, True), *schema.fields])
