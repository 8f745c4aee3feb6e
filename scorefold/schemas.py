"""Explicit schemas of the tables the operators read: nothing is inferred from files."""

from pyspark.sql import types as T

S, D, I, L, B, DT, TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DateType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, S) for n in names])


# situation reports are text until dates and numbers are coerced
REPORT_TEXT = _strings("incident_id", "name", "state", "start_year", "report_date", "personnel", "acres", "new_acres", "pct", "cost", "aerial", "terrain", "cause")
USAGE = _struct(prompt_tokens=L, completion_tokens=L, output_tokens=L, max_out=I, stop_reason=S, completion_tokens_details=_struct(reasoning_tokens=L))
TOOL_CALL = _struct(sql=S, rows=I, chars=I, truncated=B, error=S, seconds=D)
RESPONSE = _struct(
    item_id=S, raw=S, prediction_num=D, prediction_str=S, prediction_bool=B, probability=D, call=B, correct=B, abstained=B, failure=S, error=S, target=D, persistence=D,
    label=S, offset_seconds=I, bucket=S, applicability=D, analogue_ids=T.ArrayType(S), tool_calls=T.ArrayType(TOOL_CALL), n_tool_calls=I, usage=USAGE, served_model=S, started=TS)
TEMP_SUMMARY = _struct(min=D, max=D, mean=D, std=D, top3_mean=D, pct_over_200=D, pct_over_400=D)
QUESTION = _struct(question_id=S, category=S, question=S, options=T.ArrayType(S), answer=S, applicability_score=D, temp_summary=TEMP_SUMMARY, rgb_path=S, image_id=S)
TOLERANCE = _struct(rule=S, rel_tol=D, abs_floor=D, abs_tol=D)
QUERY_ITEM = _struct(
    item_id=S, family=S, tier=S, question=S, options=T.ArrayType(S), answer_num=D, answer_str=S, answer_type=S, tolerance=TOLERANCE, reference_query=S,
    reference_params=T.ArrayType(S), memorization_risk=S, state=S, years=_struct(lo=I, hi=I))
EVENT_RECORD = _struct(record_id=L, state=S, year=I, discovered=S, doy=I, cause=S, cause_class=S, size=D, size_class=S, name=S, county=S, county_code=S, complex_name=S)
FRAME = _struct(item_id=S, sequence=S, event_name=S, camera=S, date=DT, offset_seconds=I, ladder_target=I, label=S, pixels=T.ArrayType(T.FloatType()))
WINDOW = _struct(item_id=S, split=S, label=I, fold=I, target_date=DT, sample=I, window_start=DT, window_end=DT, daily=T.MapType(S, T.ArrayType(D)), static=T.MapType(S, D))
MODEL = _struct(stem=S, label=S, vendor=S, weights=S, tier=S, cap=I, tools=B)
WORK = _struct(id=S, kind=S, task_categories=T.ArrayType(S), n_models=S)
