"""Table schemas shared by the sources and the operators.

Times are integer nanoseconds: sums of BIGINT are exact and do not depend on the
order in which Spark adds them up.  ``idx`` is the position of an event in its file;
it breaks ties wherever file order is part of the meaning of an operator.
"""

from __future__ import annotations

from pyspark.sql import types as T

_call_frame = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("function_name", T.StringType()),
])

CALL_LOC = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("col", T.LongType()),
    T.StructField("frames", T.ArrayType(_call_frame)),
])

# One profiler file: a JSON object with a header and the event list.
RAW_TRACE = T.StructType([
    T.StructField("deviceProperties", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("numSms", T.LongType()),
    ]))),
    T.StructField("distributedInfo", T.StructType([
        T.StructField("rank", T.IntegerType()),
        T.StructField("world_size", T.IntegerType()),
    ])),
    T.StructField("traceEvents", T.ArrayType(T.StructType([
        T.StructField("ph", T.StringType()),
        T.StructField("cat", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("pid", T.StringType()),
        T.StructField("tid", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.DecimalType(20, 3)),
        T.StructField("dur", T.DecimalType(20, 3)),
        T.StructField("args", T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("labels", T.StringType()),
            T.StructField("External id", T.LongType()),
            T.StructField("stack", T.StructType([
                T.StructField("stack_traces", T.ArrayType(T.StringType())),
            ])),
            T.StructField("CallFrom", T.StringType()),
            T.StructField("Python id", T.LongType()),
            T.StructField("Python parent id", T.LongType()),
        ])),
    ]))),
])

# The event fact table every trace operator reads.
EVENT = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("ph", T.StringType()),
    T.StructField("cat", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("pid", T.StringType()),
    T.StructField("tid", T.StringType()),
    T.StructField("ts_ns", T.LongType()),
    T.StructField("dur_ns", T.LongType()),
    T.StructField("flow_id", T.StringType()),
    T.StructField("external_id", T.LongType()),
    T.StructField("py_id", T.LongType()),
    T.StructField("py_parent_id", T.LongType()),
    T.StructField("call_from", T.StringType()),
    T.StructField("arg_name", T.StringType()),
    T.StructField("arg_labels", T.StringType()),
    T.StructField("stack_traces", T.ArrayType(T.StringType())),
])

THREAD_KEY = ("trace_id", "pid", "tid")
DEVICE_CATS = ("kernel", "gpu_memcpy", "gpu_memset")
MODULE_PREFIX = "nn.Module:"
