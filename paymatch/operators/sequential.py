"""Order-dependent balance consumption: approve in arrival order as long as the order's balance lasts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OUT = T.StructType([T.StructField("company_id", T.StringType()), T.StructField("po_number", T.StringType()),
                     T.StructField("document_id", T.StringType()), T.StructField("accepted", T.BooleanType()), T.StructField("remaining", T.LongType())])


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (company, order, arrival); the state is one order's balance, carried across Arrow batches."""
    current, left = None, 0
    for pdf in batches:
        accepted, rest = [], []
        for company, po, amount, start in zip(pdf["company_id"], pdf["po_number"], pdf["amount"], pdf["start"]):
            if (company, po) != current:
                current, left = (company, po), int(start)
            ok = int(amount) <= left
            if ok:
                left -= int(amount)
            accepted.append(ok)
            rest.append(left)
        yield pd.DataFrame({"company_id": pdf["company_id"], "po_number": pdf["po_number"], "document_id": pdf["document_id"], "accepted": accepted, "remaining": rest})


def consume_balances(requests: DataFrame, balances: DataFrame) -> DataFrame:
    """Per order of a company a fold over (arrival_ts, document_id): accept what still fits, skip what does not.

    An order whose requests all fit is settled by a running sum.  Only orders that run over need the fold, because there a
    skipped request must not consume balance; it streams over sorted partitions with constant state, so no order's
    requests are ever collected; the sort spills.
    """
    key = ["company_id", "po_number"]
    x = requests.join(balances.select(*key, F.col("remaining").alias("start")), key).select(*key, "arrival_ts", "document_id", "amount", "start")
    over = x.groupBy(*key).agg(((F.sum("amount") > F.min("start")) | (F.min("amount") < 0)).alias("over"))
    x = x.join(over, key)
    fits = x.filter("not over").select(*key, "document_id", F.lit(True).alias("accepted"), (F.col("start") - F.sum("amount").over(
        W.partitionBy(*key).orderBy("arrival_ts", "document_id").rowsBetween(W.unboundedPreceding, 0))).alias("remaining"))
    folded = x.filter("over").repartition(*key).sortWithinPartitions(*key, "arrival_ts", "document_id").select(*key, "document_id", "amount", "start")
    return fits.unionByName(folded.mapInPandas(_fold, _OUT))
