"""Skew-safe ordered scan per key.

``Window.partitionBy(key).orderBy(...)`` puts every row of a key into one task,
so one URL or domain holding a third of the log would run in a single task.
Here the rows are range-partitioned on ``(key, order…)``; a hot key is therefore
spread over many consecutive partitions.  Each partition is scanned locally
(vectorised pandas over Arrow batches), and only the first key run of a
partition needs the state carried over from the partitions before it.  Those
carries are computed from one summary row per partition (a table bounded by
the number of partitions, never by the data) and applied with a broadcast join.

Outputs per row:
* ``_rn``           – 1-based position of the row within its key,
* ``prev_<c>``      – value of ``c`` in the previous row of the key (lag 1),
* ``<out>``         – running max over the key of ``value - slope * _rn``
                      for every ``(out, value, slope)`` in ``cummax``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.session import materialize


def _local_scan_fn(lag_cols, cummax, schema_names):
    def fn(it):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        prev_key = None
        rn_carry = 0
        last_vals = {c: None for c in lag_cols}
        cm_carry = {out: -math.inf for out, _, _ in cummax}
        first_key = None
        in_first_run = True
        held = None
        batch_no = 0
        for pdf in it:
            if len(pdf) == 0:
                continue
            k = pdf["_k"]
            newrun = k.ne(k.shift())
            cont = prev_key is not None and k.iloc[0] == prev_key
            newrun.iloc[0] = not cont
            if first_key is None:
                first_key = k.iloc[0]
            run_id = newrun.cumsum()
            rn = pdf.groupby(run_id, sort=False).cumcount().astype("int64") + 1
            first_run_mask = run_id == run_id.iloc[0]
            if cont:
                rn = rn.where(~first_run_mask, rn + rn_carry)
            out = pdf.copy()
            out["_rn"] = rn.astype("int64")
            for c in lag_cols:
                prev = pdf[c].shift()
                prev = prev.astype(object).where(~newrun, None)
                if cont:
                    prev.iloc[0] = last_vals[c]
                out[f"prev_{c}"] = prev.where(pd.notna(prev), None)
            for name, value, slope in cummax:
                x = pdf[value].astype("float64") - slope * out["_rn"].astype("float64")
                cm = x.groupby(run_id, sort=False).cummax()
                if cont:
                    cm = cm.where(~first_run_mask, np.maximum(cm, cm_carry[name]))
                out[name] = cm
            # rows belonging to the first key run of the partition
            if in_first_run and (batch_no == 0 or cont):
                out["_first_run"] = first_run_mask.values
                if not first_run_mask.all():
                    in_first_run = False
            else:
                in_first_run = False
                out["_first_run"] = False
            batch_no += 1
            out["_pid"] = pid
            out["_last_row"] = False
            out["_fk"] = None
            # carry to the next batch
            prev_key = k.iloc[-1]
            rn_carry = int(out["_rn"].iloc[-1])
            for c in lag_cols:
                last_vals[c] = pdf[c].iloc[-1]
            for name, _, _ in cummax:
                cm_carry[name] = float(out[name].iloc[-1])
            if held is not None:
                yield held[schema_names]
            held = out
        if held is not None:
            held.loc[held.index[-1], "_last_row"] = True
            held["_fk"] = held["_fk"].astype(object)
            held.loc[held.index[-1], "_fk"] = first_key
            yield held[schema_names]

    return fn


def ordered_scan(df: DataFrame, key, order: list[str], lag_cols: list[str] | None = None,
                 cummax: list[tuple[str, str, float]] | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """Per-key ordered scan robust to hot keys (see module docstring).

    ``order`` must make rows of a key totally ordered (end it with an id)."""
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    lag_cols = list(lag_cols or [])
    cummax = list(cummax or [])
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = keys + list(order)

    keyed = df.withColumn("_k", F.to_json(F.struct(*[F.col(c) for c in keys])))
    ranged = keyed.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols)

    fields = list(keyed.schema.fields)
    fields.append(T.StructField("_rn", T.LongType(), False))
    for c in lag_cols:
        fields.append(T.StructField(f"prev_{c}", keyed.schema[c].dataType, True))
    for name, _, _ in cummax:
        fields.append(T.StructField(name, T.DoubleType(), True))
    fields += [T.StructField("_first_run", T.BooleanType(), False),
               T.StructField("_pid", T.IntegerType(), False),
               T.StructField("_last_row", T.BooleanType(), False),
               T.StructField("_fk", T.StringType(), True)]
    schema = T.StructType(fields)
    local = ranged.mapInPandas(_local_scan_fn(lag_cols, cummax, [f.name for f in fields]), schema)
    # Cut lineage: the local pass is read twice (summary + fix-up) and must not
    # be recomputed; checkpoint() writes to the shared spark.checkpoint.dir.
    local = materialize(local, "ordered-scan")

    summary_cols = ["_pid", "_k", "_fk", "_rn", "_first_run"] + lag_cols + [c for c, _, _ in cummax]
    # At most one row per partition: a bounded, driver-sized table.
    summary = sorted(local.filter("_last_row").select(*summary_cols).collect(), key=lambda r: r["_pid"])

    carries = []
    end_state = None  # (key, global count, last lag values, global cummax values)
    for r in summary:
        pid = r["_pid"]
        fk = r["_fk"]
        carry = end_state if (end_state is not None and fk is not None and end_state[0] == fk) else None
        if carry is not None:
            carries.append((pid, carry[0], carry[1], *carry[2], *carry[3]))
        c = carry[1] if carry is not None else 0
        single_run = bool(r["_first_run"])
        count = r["_rn"] + (c if single_run else 0)
        cms = []
        for (name, _, slope), cm_prev in zip(cummax, (carry[3] if carry else [None] * len(cummax))):
            v = r[name]
            if single_run and carry is not None:
                v = max(cm_prev, v - slope * c)
            cms.append(v)
        end_state = (r["_k"], count, [r[c2] for c2 in lag_cols], cms)

    carry_fields = [T.StructField("_pid", T.IntegerType()), T.StructField("_ck", T.StringType()),
                    T.StructField("_cn", T.LongType())]
    carry_fields += [T.StructField(f"_cl_{c}", keyed.schema[c].dataType) for c in lag_cols]
    carry_fields += [T.StructField(f"_cm_{name}", T.DoubleType()) for name, _, _ in cummax]
    carry_df = spark.createDataFrame(carries, T.StructType(carry_fields))

    joined = local.join(F.broadcast(carry_df), "_pid", "left")
    has = F.col("_first_run") & F.col("_ck").isNotNull()
    out = joined
    for c in lag_cols:
        out = out.withColumn(f"prev_{c}", F.when(has & (F.col("_rn") == 1), F.col(f"_cl_{c}"))
                             .otherwise(F.col(f"prev_{c}")))
    for name, _, slope in cummax:
        out = out.withColumn(name, F.when(has, F.greatest(F.col(f"_cm_{name}"),
                                                          F.col(name) - F.lit(slope) * F.col("_cn")))
                             .otherwise(F.col(name)))
    out = out.withColumn("_rn", F.when(has, F.col("_rn") + F.col("_cn")).otherwise(F.col("_rn")))
    drop = ["_k", "_fk", "_first_run", "_pid", "_last_row", "_ck", "_cn"] + [f"_cl_{c}" for c in lag_cols] + \
        [f"_cm_{name}" for name, _, _ in cummax]
    return out.drop(*drop)
