"""Physical model of traces: one wide table of records, values as canonical JSON text.

A value is text plus a kind derived from it (``null``, ``bool``, ``int``,
``float``, ``str``, ``array``, ``object``).  A missing value is SQL NULL, an
explicit null is the text ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four record types of a trace file.
PRE, POST, EXCEPTION, STATE = "function_call (pre)", "function_call (post)", "function_call (post) (exception)", "state_change"

#: A line of a trace file as it is read; nested values stay variants until they become text.
RAW = """
time BIGINT, type STRING, process_id BIGINT, thread_id BIGINT, meta_vars VARIANT, func_call_id STRING, function STRING,
is_bound_method BOOLEAN, obj_id BIGINT, args VARIANT, kwargs VARIANT, proxy_obj_names ARRAY<ARRAY<STRING>>, stack_trace ARRAY<STRING>,
return_values VARIANT, exception STRING, exception_msg STRING, var_name STRING, var_type STRING, mode STRING, dump_loc STRING, attributes VARIANT
"""

RECORDS = """
trace_id STRING, source_file STRING, line_no BIGINT, time_ns BIGINT, type STRING, process_id BIGINT, thread_id BIGINT, step BIGINT, stage STRING,
func_call_id STRING, function STRING, is_bound_method BOOLEAN, obj_id BIGINT, args_json STRING, kwargs_json STRING, return_json STRING,
exception STRING, exception_msg STRING, proxy_obj_names ARRAY<ARRAY<STRING>>, var_name STRING, var_type STRING, mode STRING, dump_loc STRING,
meta_vars MAP<STRING,STRING>, attributes MAP<STRING,STRING>
"""

PARAM = """STRUCT<param_type STRING, api_full_name STRING, exception STRING, arguments STRING, var_type STRING, var_name STRING, attr_name STRING,
pre_value STRING, post_value STRING, const_value STRING, name STRING, index BIGINT, type STRING, additional_path STRING, api_name STRING, is_input BOOLEAN>"""

INVARIANTS = f"text_description STRING, relation STRING, params ARRAY<{PARAM}>, precondition STRING, num_positive_examples BIGINT, num_negative_examples BIGINT"

#: Identity of a thread of execution, of a variable, and order of records.
PT = ("trace_id", "process_id", "thread_id")
VAR = ("trace_id", "process_id", "var_name", "var_type")
ORDER = ("time_ns", "source_file", "line_no")


def kind_of(value: Column) -> Column:
    """Kind of a canonical JSON text; NULL for a missing value."""
    head = F.substring(value, 1, 1)
    return (
        F.when(value.isNull(), None).when(value == "null", "null").when(value.isin("true", "false"), "bool")
        .when(head == '"', "str").when(head == "[", "array").when(head == "{", "object")
        .when(value.rlike("^-?[0-9]+$"), "int").otherwise("float")
    )


def number_of(value: Column) -> Column:
    """Numeric value of an int or float text, else NULL."""
    return F.when(kind_of(value).isin("int", "float"), value.try_cast("double"))


def text_map(variant: Column) -> Column:
    """Map of canonical JSON texts of a variant object."""
    return F.transform_values(variant.cast("map<string,variant>"), lambda _, v: F.to_json(v))
