"""Incremental versions of the profile, the point-in-time features and the scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from visitframe.functions.rules import Rule, check_rows
from visitframe.operators.profile import profile, unpivot
from visitframe.session import scratch_path


def run_available(query_writer, name: str, spark, offsets: str | None = None) -> None:
    """Run a stream over everything that has arrived, then stop. A given `offsets` folder continues an earlier run."""
    q = query_writer.option("checkpointLocation", offsets or scratch_path(spark, f"{name}-offsets")).trigger(availableNow=True).start()
    q.awaitTermination()


def profile_stream(stream: DataFrame, out: str, codes: Sequence[str], categories: Sequence[str]) -> Callable[[], tuple[DataFrame, DataFrame]]:
    """Write each batch's additive counts; returns a function that reads the merged profile and category counts.

    A batch that is run again overwrites its own part, so counts are never doubled.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        profile(df, codes).select("variable", "n_rows", "n_blank", "n_coded").write.mode("overwrite").parquet(f"{out}/profile/batch={number}")
        cells = unpivot(df, [], categories, "string").groupBy("variable", F.coalesce("value", F.lit("(blank)")).alias("value")).agg(F.count("*").alias("n"))
        cells.write.mode("overwrite").parquet(f"{out}/categories/batch={number}")

    run_available(stream.writeStream.foreachBatch(batch), "profile", spark)

    def merged() -> tuple[DataFrame, DataFrame]:
        p = spark.read.parquet(f"{out}/profile").groupBy("variable").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_blank", "n_coded")])
        c = spark.read.parquet(f"{out}/categories").groupBy("variable", "value").agg(F.sum("n").alias("n"))
        return p, c

    return merged


FEATURE_SCHEMA = "entity_id long, visit_date date, visit_id long, visit_no long, years double, ever_high int, carried double, delta_score double, slope_score double, late boolean"
#: one call of the stream's step handles all entities of a bucket; an entity's state is one fixed-size record in its bucket's row
BUCKETS = 2_000
STATE = [("entity", "i8"), ("first_day", "i4"), ("last_day", "i4"), ("last_id", "i8"), ("n_visits", "i8"), ("ever", "i4"), ("carried", "f8"), ("n", "i8"),
         ("sx", "f8"), ("sy", "f8"), ("sxx", "f8"), ("sxy", "f8")]


def features_stream(stream: DataFrame, high: float = 30.0) -> DataFrame:
    """Point-in-time features with a fixed-size state per entity.

    State holds the first day, the last position, the sticky flag, the last known
    value and five slope sums. A visit that arrives behind the position already
    emitted would change later rows; it is passed through marked `late`. Entities are dealt
    to buckets, since a call per entity costs far more than the rows it sees. One call
    sees a bucket's rows of one micro-batch, so the trigger bounds its memory.
    Input: entity_id, visit_date, visit_id, score.
    """
    names = [c.split()[0] for c in FEATURE_SCHEMA.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        states = {r[0]: r[1:] for r in np.frombuffer(state.get[0], STATE).tolist()} if state.exists else {}
        pdf = pd.concat([b for b in batches]).sort_values(["entity_id", "visit_date", "visit_id"])
        days = pd.to_datetime(pdf["visit_date"]).to_numpy().astype("datetime64[D]").astype(np.int64).tolist()
        known = pdf["score"].notna().tolist()
        out = []
        for entity, date, d, vid, score, is_known in zip(pdf["entity_id"].tolist(), pdf["visit_date"].tolist(), days, pdf["visit_id"].tolist(), pdf["score"].tolist(), known):
            s = states.get(entity)
            first, last, last_id, visits, ever, carried, n, sx, sy, sxx, sxy = (d, None, None, 0, 0, 0.0, 0, 0.0, 0.0, 0.0, 0.0) if s is None else s
            if last is not None and (d, vid) < (last, last_id):
                out.append((entity, date, vid, None, None, None, None, None, None, True))
                continue
            years = (d - first) / 365.25
            delta = slope = None
            if is_known:
                score = float(score)
                delta = score - carried if n else None
                ever = max(ever, int(score > high))
                carried, n, sx, sy, sxx, sxy = score, n + 1, sx + years, sy + score, sxx + years * years, sxy + years * score
                den = n * sxx - sx * sx
                if n >= 2 and den > 1e-9:
                    slope = max(min((n * sxy - sx * sy) / den, 10.0), -10.0)
            states[entity] = (first, d, vid, visits + 1, ever, carried, n, sx, sy, sxx, sxy)
            # nothing is known of the score before its first value
            out.append((entity, date, vid, visits + 1, years, ever if n else None, carried if n else None, delta, slope, False))
        state.update((np.array([(e, *s) for e, s in states.items()], STATE).tobytes(),))
        res = pd.DataFrame(out, columns=names)
        yield res.astype({"visit_no": "Int64", "ever_high": "Int32", "visit_id": "int64", "entity_id": "int64"})

    dealt = stream.select("entity_id", "visit_date", "visit_id", "score", F.pmod(F.xxhash64("entity_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    return dealt.groupBy("bucket").applyInPandasWithState(step, FEATURE_SCHEMA, "entities binary", "append", GroupStateTimeout.NoTimeout)


def score_stream(stream: DataFrame, references: DataFrame, on: str, rules: Sequence[Rule]) -> DataFrame:
    """Plausibility checks on arriving rows, with reference values joined from a static table."""
    return check_rows(stream.join(references, on, "left"), rules)
