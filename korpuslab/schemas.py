"""Column layouts of the tables the engine reads and writes; text files are read as strings and cast."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "strings": T.ArrayType(T.StringType()), "map": T.MapType(T.StringType(), T.StringType()),
}


def _layout(text: str) -> T.StructType:
    """A layout from "name kind, name kind"; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(","))])


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


CLIPS = _strings("client_id", "path", "sentence", "locale", "split")
TERMS = _strings("term_id", "term_family", "canonical_term", "aliases", "category")
LEXICON = _strings("canonical_term", "aliases", "source_id", "source_uri", "frozen_before_authoring")
SENTENCES = _strings("sentence_id", "split", "term_id", "term_family", "text", "reference", "suffix", "negative_control")
PROMPTS = _strings("prompt_id", "split", "prompt")
ELIGIBILITY = _layout("speaker_id string, consent_status string, usage_scope string, provenance string, qc_state string, eligibility string, extras map")
MENTION = _layout(
    "mention_id string, utterance_id string, term_id string, canonical_term string, surface string, accepted_aliases strings, suffix string, term_family string, category string, "
    "surface_start int, surface_end int, multi_token boolean, version string"
)
REQUEST = _layout("protocol_version string, transcription_run_id string, utterance_id string, engine string, audio_path string, output_dir string, model_revision string, decoding map")
RESULT = _layout("protocol_version string, transcription_run_id string, utterance_id string, engine string, status string, transcript string, output_checksum string, error_reason string")
#: One row for each thing that happened to a job; the state of a job is a fold over its events.
LEDGER_EVENT = _layout("seq bigint, transcription_run_id string, utterance_id string, engine string, event string, at double, reason string, result_json string, output_checksum string, peak_vram_mb double, batch bigint")
EVALUATION_ROW = _layout(
    "id string, source_dataset string, source_record string, audio_id string, speaker_id string, asr_engine string, asr_revision string, hypothesis_raw string, hypothesis_normalized string, "
    "reference_raw string, reference_normalized string, wer_before double, pair_type string, domain string, is_identity boolean"
)
