"""Readers of the formats that workloads, results, logs and counters come in.

Every JSON reader has a fixed schema: unknown keys are dropped, missing ones are null or take their
default, and only the columns that a query asks for are built. Line order, where it means something,
is kept in an explicit `ordinal`.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.functions import text as T
from reprise.operators.ordinals import running_sum, with_ordinal

DONOR = "struct<donor_id:string,text:string,label:string,metadata:map<string,string>>"
WORKLOAD_ITEM = f"item_id string, dataset string, source_id string, transform string, donor_prompts array<{DONOR}>, recipient_prompt string, input string, answers array<string>, negative_control boolean, metadata string, benchmark_version string"
REQUEST_ROW = (
    "item_id string, dataset string, transform string, negative_control boolean, donor_count bigint, prompt_tokens bigint, total_blocks bigint, exact_hit_blocks bigint, exact_hit_tokens bigint, "
    "semantic_candidate_blocks bigint, semantic_candidate_tokens bigint, semantic_eligible_blocks bigint, semantic_eligible_tokens bigint, backend_confirmed_blocks bigint, backend_confirmed_tokens bigint, "
    "external_confirmed_tokens bigint, fuzzy_confirmed_tokens bigint, arm string, traffic_class string, wrapper_rank bigint, stream_position bigint, engine_request_id string, engine_response_id string, "
    "ttft_ms double, latency_ms double, queue_time_ms double, output_text string, error string, output_token_ids array<bigint>, output_top_logprobs array<array<array<double>>>"
)
RUN = "struct<run_id:string,engine:string,arm:string,manifest_sha256:string,baseline_id:string>"
RESULT = f"run {RUN}, requests array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in REQUEST_ROW.split(', ')))}>>"
SNAPSHOT = "url string, captured_at_utc string, counters map<string,double>, sample_count bigint, error string"


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, file, name, value): lines in the order of files and of lines within them."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.monotonically_increasing_id().alias("n"), "value")
    # Ids grow along a file's splits; with the file's name they give a total order.
    return with_ordinal(rows.select(F.struct(F.col("file").alias("f"), "n").alias("o"), "file", "name", "value"), "o").select("ordinal", "file", "name", "value")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value): lines in the order of files and of lines within them."""
    return _file_lines(spark, path).select("ordinal", "value")


def read_manifest(spark: SparkSession, path: str, max_items: int | None = None) -> DataFrame:
    """Workload items of a JSONL manifest, in order. Blank lines are skipped; `max_items` counts items, not lines."""
    lines = _lines(spark, path).where(F.trim("value") != "")
    schema = WORKLOAD_ITEM.replace("metadata string, benchmark", "benchmark")
    item = lines.select("ordinal", F.from_json("value", schema).alias("i"), F.get_json_object("value", "$.metadata").alias("metadata"))
    rows = item.select("ordinal", "i.*", "metadata").withColumns({"input": F.coalesce("input", F.lit("")), "answers": F.coalesce("answers", F.array().cast("array<string>")), "negative_control": F.coalesce("negative_control", F.lit(False))})
    return rows.orderBy("ordinal").limit(max_items) if max_items is not None else rows


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """Request rows of result documents, with the run they belong to and their place in it."""
    doc = spark.read.option("multiLine", True).schema(RESULT).json(path)
    rows = doc.select("run.run_id", F.posexplode("requests").alias("ordinal", "r")).select("run_id", "ordinal", "r.*")
    return with_row_defaults(rows)


def with_row_defaults(rows: DataFrame) -> DataFrame:
    """Defaults of fields that may not be null; all others stay null where they were not measured."""
    top = F.transform("output_top_logprobs", lambda p: F.transform(p, lambda e: F.struct(e[1].cast("bigint").alias("token_id"), e[0].alias("logprob"))))
    return rows.withColumns({"fuzzy_confirmed_tokens": F.coalesce("fuzzy_confirmed_tokens", F.lit(0)), "arm": F.coalesce("arm", F.lit("single")), "output_top_logprobs": top})


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Rows that an interrupted run has written so far; a last line that was cut off is dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "").where(F.get_json_object("value", "$").isNotNull())
    return with_row_defaults(lines.select(F.from_json("value", REQUEST_ROW).alias("r")).select("r.*"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line) of engine logs."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Raw event records of JSONL or csv audits, ready for the quarantining parser, numbered by their first lines.

    A line of JSONL is a record. A csv record ends at a line end outside quotes, as in
    `assemble_csv_records`; one that its file leaves unfinished is kept as it is. Quotes are summed
    up over ranges of lines, so a large file is not one task's work.
    """
    is_csv = F.col("name").endswith(".csv")
    lines = _file_lines(spark, path)
    plain = lines.where(~is_csv).select(F.col("ordinal").alias("line_id"), F.col("value").alias("raw_line"), F.col("name").alias("source_file"), F.lit("jsonl").alias("line_format"))
    csv = lines.where(is_csv)
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("bigint")
    summed = running_sum(csv.select("ordinal", "file", quotes.alias("q")), "ordinal", "q", "upto").select("ordinal", "file", (F.col("upto") - F.col("q")).alias("before"))
    base = summed.groupBy("file").agg(F.min("before").alias("base"))
    begun = summed.join(base, "file").select("ordinal", ((F.col("before") - F.col("base")) % 2 == 0).cast("int").alias("begins"))
    numbered = running_sum(begun, "ordinal", "begins", "record").select("ordinal", "record")
    pieces = F.array_sort(F.collect_list(F.struct("ordinal", "value")))
    whole = F.array_join(F.transform(pieces, lambda x: x["value"]), "\n")
    records = csv.join(numbered, "ordinal").groupBy("record").agg(F.min("ordinal").alias("line_id"), whole.alias("raw_line"), F.first("name").alias("source_file"))
    return plain.unionByName(records.select("line_id", "raw_line", "source_file", F.lit("csv").alias("line_format")))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Counter snapshots of a document {"snapshots": [...]}."""
    inner = ",".join(f"{a}:{b}" for a, b in (x.split(" ", 1) for x in SNAPSHOT.split(", ")))
    return spark.read.option("multiLine", True).schema(f"snapshots array<struct<{inner}>>").json(path).select(F.inline("snapshots"))


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_tokens, traffic_share) of a csv with comments."""
    return spark.read.option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).schema("prompt_tokens bigint, traffic_share double").csv(path).where("prompt_tokens IS NOT NULL")


def parse_histogram(spark: SparkSession, spec: str) -> DataFrame:
    """(prompt_tokens, traffic_share) of a text such as '8192:0.5,16384:0.5'."""
    parts = spark.createDataFrame([(spec,)], "s string").select(F.explode(F.split("s", ",")).alias("p")).where(F.trim("p") != "")
    return parts.select(F.trim(F.split("p", ":")[0]).cast("bigint").alias("prompt_tokens"), F.trim(F.split("p", ":")[1]).cast("double").alias("traffic_share"))


def read_sse(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, payload) of captured event-stream lines, without the end mark and what is no JSON."""
    lines = _lines(spark, path).where(F.col("value").startswith("data:"))
    body = lines.select("ordinal", F.trim(F.substring("value", F.lit(6), F.length("value"))).alias("payload"))
    return body.where((F.col("payload") != "[DONE]") & F.get_json_object("payload", "$").isNotNull())


def fold_sse(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Text, id and token counts of captured streams: pieces in order, the first id, the last usage."""
    get = lambda p: F.get_json_object("payload", p)
    piece = F.coalesce(get("$.choices[0].delta.content"), get("$.choices[0].text"), F.lit(""))
    usage = get("$.usage")
    rows = chunks.select(*keys, "ordinal", piece.alias("piece"), get("$.id").alias("id"), usage.alias("usage"))
    o = F.col("ordinal")
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "piece"))), lambda x: x.piece), "").alias("text"),
        F.min_by(F.when(F.col("id").isNotNull(), F.col("id")), F.when(F.col("id").isNotNull(), o)).alias("response_id"),
        F.max_by(F.when(F.col("usage").isNotNull(), F.col("usage")), F.when(F.col("usage").isNotNull(), o)).alias("usage"),
        F.min(F.when(F.col("piece") != "", o)).alias("first_piece"),
    ).select(*keys, "text", "response_id", "first_piece", F.get_json_object("usage", "$.prompt_tokens").cast("bigint").alias("prompt_tokens"), F.get_json_object("usage", "$.completion_tokens").cast("bigint").alias("completion_tokens"), F.get_json_object("usage", "$.prompt_tokens_details.cached_tokens").cast("bigint").alias("cached_tokens"))


def fold_cumulative(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Text and token counts of streams whose every chunk repeats the text so far: the last text, and of each count the last that isn't 0."""
    get = lambda p: F.get_json_object("payload", p)
    count = lambda *ps: F.coalesce(*(F.nullif(get(p).try_cast("bigint"), F.lit(0)) for p in ps))
    counts = {
        "prompt_tokens": count("$.usage.prompt_tokens", "$.meta_info.prompt_tokens"),
        "cached_tokens": count("$.usage.prompt_tokens_details.cached_tokens", "$.meta_info.cached_tokens"),
        "fuzzy_tokens": count("$.meta_info.cached_tokens_details.fuzzy"),
    }
    rows = chunks.select(*keys, "ordinal", get("$.text").alias("text"), F.when(F.coalesce(get("$.output_ids"), F.lit("[]")) != "[]", F.col("ordinal")).alias("first"), *(x.alias(k) for k, x in counts.items()))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal")))
    return rows.groupBy(*keys).agg(F.coalesce(last("text"), F.lit("")).alias("text"), *(F.coalesce(last(k), F.lit(0)).alias(k) for k in counts), F.min("first").alias("first_output"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def frozen(digests: DataFrame, expected: dict[str, str]) -> bool:
    """Whether files still have the digests that were recorded for their names."""
    have = {Path(r.path).name: r.sha256 for r in digests.where(F.element_at(F.split("path", "/"), -1).isin(*expected)).collect()}
    return have == expected


def read_json_document(path: str) -> dict:
    """A small document, such as recorded digests or a calibration."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def questions(rows: DataFrame, dataset: str) -> DataFrame:
    """Source records of question rows (_id, context, input, answers, ordinal); a missing id is derived."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    made = T.stable_id(F.lit(dataset), F.col("ordinal").cast("string"), F.substring(text("context"), 1, 256))
    return rows.select(F.coalesce(F.nullif("_id", F.lit("")), made).alias("source_id"), F.lit(dataset).alias("dataset"), text("context").alias("context"), text("input").alias("input"), F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), "ordinal")


def choices(rows: DataFrame, dataset: str) -> DataFrame:
    """Source records of multiple-choice rows (_id, context, question, choice_A..D, answer, ordinal)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    asked = F.concat_ws("\n", text("question"), *(F.concat(F.lit(f"{x}. "), text(f"choice_{x}")) for x in "ABCD"))
    made = T.stable_id(F.lit(dataset), F.col("ordinal").cast("string"), text("question"))
    return rows.select(F.coalesce(F.nullif("_id", F.lit("")), made).alias("source_id"), F.lit(dataset).alias("dataset"), text("context").alias("context"), asked.alias("input"), F.array(text("answer")).alias("answers"), "ordinal")


def read_questions(spark: SparkSession, path: str, dataset: str, multiple_choice: bool = False) -> DataFrame:
    """Source records of a downloaded benchmark file, JSON lines in order."""
    rows = _lines(spark, path).where(F.trim("value") != "").select("ordinal", F.from_json("value", _BENCHMARK).alias("r")).select("ordinal", "r.*")
    return choices(rows, dataset) if multiple_choice else questions(rows, dataset)


_BENCHMARK = "_id string, context string, question string, choice_A string, choice_B string, choice_C string, choice_D string, answer string, input string, answers array<string>"


def read_benchmark_document(spark: SparkSession, path: str, dataset: str, multiple_choice: bool = True) -> DataFrame:
    """Source records of a JSON document: a list of rows, or an object that holds one as data, train or rows.

    A document of another shape fails the query.
    """
    row = ", ".join(f"{a}:{b}" for a, b in (x.split(" ", 1) for x in _BENCHMARK.split(", ")))
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^[\s\x{feff}]+", "").alias("v"))
    inner = F.from_json("v", ", ".join(f"{k} array<struct<{row}>>" for k in ("data", "train", "rows")))
    held = F.coalesce(*(F.when(F.size(inner[k]) > 0, inner[k]) for k in ("data", "train", "rows")))
    rows = F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{row}>>")).when(F.col("v").startswith("{"), held)
    known = text.select(F.coalesce(rows, F.raise_error(F.lit("unsupported shape of a benchmark document")).cast(f"array<struct<{row}>>")).alias("rows"))
    each = known.select(F.posexplode("rows").alias("ordinal", "r")).select("ordinal", "r.*")
    return choices(each, dataset) if multiple_choice else questions(each, dataset)


def read_zip_member(spark: SparkSession, path: str, member: str, dataset: str) -> DataFrame:
    """Source records of a JSONL member of zip archives, in order; an archive without it fails the query."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    got = [x for x in (line.decode("utf-8").strip() for line in f) if x]
                yield pd.DataFrame({"ordinal": range(len(got)), "value": got})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "ordinal bigint, value string")
    return questions(rows.select("ordinal", F.from_json("value", _BENCHMARK).alias("r")).select("ordinal", "r.*"), dataset)


def engine_timing(metrics: Column) -> tuple[Column, Column]:
    """(time to first token, queue time) in milliseconds out of a JSON object of engine metrics.

    The first key that is there counts; keys without _ms are in seconds; else the difference of two
    timestamps, null if it is negative.
    """
    number = lambda k: F.get_json_object(metrics, f"$.{k}").try_cast("double")
    first = lambda *ks: F.coalesce(*(number(k) if k.endswith("_ms") else number(k) * 1000 for k in ks))
    elapsed = lambda a, b: F.when(number(b) >= number(a), (number(b) - number(a)) * 1000)
    ttft = F.coalesce(first("time_to_first_token_ms", "ttft_ms", "time_to_first_token", "ttft"), elapsed("first_scheduled_time", "first_token_time"))
    queue = F.coalesce(first("queue_time_ms", "time_in_queue_ms", "queue_time", "time_in_queue"), elapsed("arrival_time", "first_scheduled_time"))
    return ttft, queue


def with_rates(histogram: DataFrame, rates: DataFrame, default: float) -> DataFrame:
    """A histogram with hit rates; sizes without a rate of their own get the default."""
    return histogram.join(rates, "prompt_tokens", "left").withColumn("hit_rate", F.coalesce("hit_rate", F.lit(default)))
