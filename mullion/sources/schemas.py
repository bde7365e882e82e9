"""Explicit schemas; nothing is inferred."""

from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

_text = lambda *names: [StructField(n, StringType()) for n in names]

PROBLEMS = StructType(
    [StructField("ordinal", LongType())]
    + _text("task_id", "dataset", "prompt", "question_content", "starter_code", "entry_point", "test", "public_test_cases", "metadata", "contest_date", "platform", "question_id", "question_title")
)
RESPONSES = StructType(_text("task_id", "mode", "raw_response") + [StructField("total_tokens", LongType())] + _text("gen_error"))
TEST_CASES = ArrayType(StructType(_text("testtype", "input", "output")))
MODE_RESULT = StructType(
    [StructField("pass", BooleanType())]
    + _text("err")
    + [StructField(n, LongType()) for n in ("think_tokens", "total_tokens", "post_think_tokens")]
    + [StructField("answer_channel_bloat", BooleanType())]
    + [StructField(n, LongType()) for n in ("code_lines", "code_comment_lines", "code_comment_tokens")]
    + [StructField("comment_bloat", BooleanType())]
    + _text("raw_response", "extracted_think", "extracted_code", "extraction_method", "extraction_issue")
    + [StructField("entry_point_found", BooleanType())]
    + _text("failure_type")
)
RESULT_ROWS = StructType([StructField("ordinal", LongType()), StructField("task_id", StringType()), *[StructField(m, MODE_RESULT) for m in ("free", "fsm", "prompt_terse")]])
