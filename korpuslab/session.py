"""Sessions with the settings the engine expects, and its functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from korpuslab.functions import edit, text

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "korpuslab", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def register(spark: SparkSession) -> None:
    """Make the library's functions callable from SQL under their own names.

    Arrow functions: nfkc, edit_counts, edit_script, char_distance, and the table function edit_steps for lateral joins.
    SQL functions over them: collapse_space, normalize_tr, normalize_tr_for_wer, wer_tokens, classify_before_after,
    speaker_pseudonym. Each gives what the column form gives.
    """
    spark.udf.register("nfkc", text._nfkc)
    spark.udf.register("edit_counts", edit._counts)
    spark.udf.register("edit_script", edit._script)
    spark.udf.register("char_distance", edit._distance)
    spark.udtf.register("edit_steps", edit.EditSteps)
    spaces = text._SPACES
    plain = lambda more: f"lower(translate(nfkc(t), '{_quoted(text.VARIANTS + spaces + more)}', concat('{_quoted(text.PLAIN)}', repeat(' ', {len(spaces + more)}))))"
    single = lambda t: f"trim(regexp_replace({t}, '  +', ' '))"
    functions = {
        "collapse_space(t STRING) RETURNS STRING": single(f"translate(t, '{_quoted(spaces)}', repeat(' ', {len(spaces)}))"),
        "normalize_tr(t STRING) RETURNS STRING": single(plain("")),
        "normalize_tr_for_wer(t STRING) RETURNS STRING": single(plain(text._PUNCTUATION)),
        "wer_tokens(t STRING) RETURNS ARRAY<STRING>": "array_remove(split(normalize_tr_for_wer(t), ' '), '')",
        "classify_before_after(r STRING, b STRING, a STRING) RETURNS STRING": """CASE
            WHEN NOT normalize_tr_for_wer(b) = normalize_tr_for_wer(r) AND normalize_tr_for_wer(a) = normalize_tr_for_wer(r) THEN 'improved'
            WHEN normalize_tr_for_wer(b) = normalize_tr_for_wer(r) AND NOT normalize_tr_for_wer(a) = normalize_tr_for_wer(r) THEN 'damaged'
            WHEN normalize_tr_for_wer(b) = normalize_tr_for_wer(r) AND normalize_tr_for_wer(a) = normalize_tr_for_wer(r) AND NOT (b = r AND a = r) THEN 'orthographic_only'
            ELSE 'unchanged' END""",
        "speaker_pseudonym(v STRING, c STRING) RETURNS STRING": "concat('spk-', substring(sha2(concat_ws('|', v, c), 256), 1, 16))",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
