"""Writers: canonical JSONL, result tables, documents."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def _plain(value: object) -> object:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def canonical(record: object) -> str:
    """JSON with sorted keys and characters as they are: equal records give equal bytes."""
    return json.dumps(_plain(record), sort_keys=True, ensure_ascii=False)


def canonical_lines(rows: DataFrame, order: str) -> DataFrame:
    """(order, value): each row as canonical JSON; columns of JSON text named metadata are taken apart."""
    fields = [c for c in rows.columns if c != order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for o, j in zip(batch["o"], batch["j"]):
                record = json.loads(j)
                if isinstance(record.get("metadata"), str):
                    record["metadata"] = json.loads(record["metadata"])
                out.append((o, canonical(record)))
            yield pd.DataFrame(out, columns=["o", "value"])

    made = rows.select(F.col(order).cast("bigint").alias("o"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("j"))
    return made.mapInPandas(run, "o bigint, value string")


def write_canonical(rows: DataFrame, order: str, path: str, files: int = 1) -> None:
    """Canonical JSONL in the order of a column; more than one file parts the order in ranges."""
    canonical_lines(rows, order).repartitionByRange(files, "o").sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def write_result(folder: str, **tables: DataFrame) -> None:
    """The parts of a result (rows, aggregate, paired, by_transform, ...) as tables of one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def append_rows(rows: DataFrame, path: str) -> None:
    """Rows of a checkpoint: appended as JSON lines, whole files at a time."""
    rows.write.mode("append").json(path)


def write_document(path: str, document: dict) -> None:
    """A small document, such as a summary of one row."""
    Path(path).write_text(json.dumps(_plain(document), indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
