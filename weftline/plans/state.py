"""What is kept between runs: plans, verdicts, and which files are done.

All are tables below a folder that Spark reads and writes; a plan also is one JSON text for
people and other tools. Writes are committed as a whole by Spark.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.verify import CACHE_KEY, VERDICTS

_S = T.StringType()
#: Fields of a proposal in a plan, in order.
PROPOSAL = T.StructType([
    T.StructField("proposal_id", _S), T.StructField("kind", _S), T.StructField("tu_index", T.LongType()), T.StructField("accepted", T.BooleanType()),
    T.StructField("confidence", _S), T.StructField("verdict", _S), T.StructField("src_parts", T.ArrayType(_S)), T.StructField("tgt_parts", T.ArrayType(_S)),
    *(T.StructField(n, _S) for n in ("rule", "message", "before_src", "after_src", "before_tgt", "after_tgt", "original_src", "original_tgt")),
])


def plan_rows(proposals: DataFrame, accepted: Column | None = None) -> DataFrame:
    """file_id and the fields of a plan's proposal; texts that a proposal lacks are '', parts []."""
    have = {"proposal_id": "id"} | {f.name: f.name for f in PROPOSAL.fields if f.name in proposals.columns}
    blank = {"tu_index": F.lit(-1), "src_parts": F.array().cast("array<string>"), "tgt_parts": F.array().cast("array<string>"), "accepted": accepted if accepted is not None else F.lit(True)}
    out = []
    for f in PROPOSAL.fields:
        empty = blank.get(f.name, F.lit(""))
        value = F.coalesce(F.col(have[f.name]), empty) if f.name in have and not (f.name == "accepted" and accepted is not None) else empty
        out.append(value.cast(f.dataType).alias(f.name))
    return proposals.select("file_id", *out)


def plan_json(plan: DataFrame, totals: DataFrame) -> DataFrame:
    """file_id, json: one text a file, for plans that a person or another tool reads. totals: file_id, total_tus.

    A file's proposals meet in one row here; ``write_plan`` keeps them as rows.
    """
    each = plan.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("tu_index", "proposal_id", F.struct(*[f.name for f in PROPOSAL.fields]).alias("p")))).alias("x"))
    both = totals.join(each, "file_id", "left")
    body = F.struct(F.col("file_id").alias("input_path"), "total_tus", F.coalesce(F.transform("x", lambda x: x["p"]), F.array().cast(T.ArrayType(PROPOSAL))).alias("proposals"))
    return both.select("file_id", F.to_json(body).alias("json"))


def plan_of_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """file_id, total_tus and the proposals of plan texts. Unknown fields are refused."""
    known = {f.name for f in PROPOSAL.fields}

    def strict(batches):
        for batch in batches:
            for text in batch[column]:
                body = json.loads(text)
                odd = (set(body) - {"input_path", "total_tus", "proposals"}) | {k for p in body.get("proposals", ()) for k in set(p) - known}
                if odd:
                    raise ValueError(f"a plan has no fields {sorted(odd)}")
            yield batch

    checked = texts.select(column).mapInPandas(strict, f"{column} string")
    schema = T.StructType([T.StructField("input_path", _S), T.StructField("total_tus", T.LongType()), T.StructField("proposals", T.ArrayType(PROPOSAL))])
    return checked.select(F.from_json(column, schema).alias("p")).select(F.col("p.input_path").alias("file_id"), "p.total_tus", F.explode_outer("p.proposals").alias("x")).select("file_id", "total_tus", "x.*")


def write_plan(plan: DataFrame, totals: DataFrame, path: str) -> None:
    """The plan as JSON rows, by file; with the number of units of each file."""
    plan.write.mode("overwrite").json(f"{path}/proposals")
    totals.select("file_id", "total_tus").write.mode("overwrite").json(f"{path}/files")


def read_plan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The proposals and the files' numbers of units."""
    strict = {"mode": "FAILFAST"}
    rows = spark.read.options(**strict).schema(T.StructType([T.StructField("file_id", _S), *PROPOSAL.fields])).json(f"{path}/proposals")
    return rows, spark.read.options(**strict).schema("file_id string, total_tus long").json(f"{path}/files")


def accepted_of(plan: DataFrame) -> DataFrame:
    """file_id, id of the proposals to apply; with what the plan found out about them."""
    return plan.where("accepted").select("file_id", F.col("proposal_id").alias("id"), "confidence", "verdict")


# ---- verdicts ----

KEY_TEXT = T.StructType([T.StructField(k, T.ArrayType(_S) if k.endswith("_parts") else _S) for k in sorted(CACHE_KEY)])


def valid_cache(rows: DataFrame) -> DataFrame:
    """key, verdict, summary of rows. A key is a digest (see functions.verify.cache_key), or JSON of the seven fields, which becomes one; other keys, and JSON whose parts are no lists, go. Unknown verdicts are WARN."""
    fields = F.from_json("key", KEY_TEXT)
    kinds = F.from_json("key", "map<string, string>")
    whole = F.col("key").startswith("{") & fields.isNotNull()
    for part in ("src_parts", "tgt_parts"):
        whole = whole & F.coalesce(kinds[part].startswith("["), kinds[part].isNull())
    key = F.when(F.col("key").rlike("^[0-9a-f]{64}$"), F.col("key")).when(whole, F.sha2(F.to_json(fields), 256))
    verdict = F.upper(F.trim("verdict"))
    return rows.select(key.alias("key"), F.when(verdict.isin(*VERDICTS), verdict).otherwise("WARN").alias("verdict"), F.coalesce("summary", F.lit("Cached verdict")).alias("summary")).where("key IS NOT NULL")


def merge_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; where both know a key, the new one's."""
    both = old.select("key", "verdict", "summary", F.lit(0).alias("age")).unionByName(new.select("key", "verdict", "summary", F.lit(1).alias("age")))
    return both.groupBy("key").agg(F.max_by(F.struct("verdict", "summary"), "age").alias("v")).select("key", "v.verdict", "v.summary")


def write_cache(rows: DataFrame, path: str) -> None:
    rows.select("key", "verdict", "summary").write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Empty where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "key string, verdict string, summary string")
    return valid_cache(spark.read.schema("key string, verdict string, summary string").parquet(path))


# ---- which files are done ----


def done_rows(units: DataFrame, outputs: DataFrame) -> DataFrame:
    """file_id, output, total_tus of files whose output is written: the state a run leaves. outputs: file_id, output."""
    return units.groupBy("file_id").agg(F.count("*").alias("total_tus")).join(outputs, "file_id")


def to_do(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (file_id, output, total_tus) that no row of the state covers: by input, output and number of units.

    A file is done as a whole or not at all; what a stopped run left of one is computed again.
    """
    return files.join(state.select("file_id", "output", "total_tus").distinct(), ["file_id", "output", "total_tus"], "left_anti")


def missing_total(proposals: DataFrame) -> DataFrame:
    """file_id, total_tus for plans that do not say it: one more than the last unit named."""
    return proposals.groupBy("file_id").agg((F.coalesce(F.max("tu_index"), F.lit(-1)) + 1).alias("total_tus"))
