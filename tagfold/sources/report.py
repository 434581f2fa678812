"""Statistics as JSON and as a page, for the console and as files. Only the size histogram reaches the driver."""

from __future__ import annotations

import json
import math
from html import escape

from pyspark.sql import DataFrame

from tagfold.operators.stats import duplicate_stats
from tagfold.sources.fastq import open_store


def summary(index: DataFrame, metadata: dict) -> dict:
    row = duplicate_stats(index).first().asDict()
    row["distribution"] = {str(k): v for k, v in sorted(row["distribution"].items())}
    if math.isnan(row["proportion_duplicate"]):
        row["proportion_duplicate"] = None
    return metadata | {"gb": f"{metadata.get('gb') or 0:.3f}", "stats": row}


def _bars(title: str, data: list[tuple[int, int]]) -> str:
    top = max((v for _, v in data), default=0) or 1
    rows = "".join(f"<tr><td>{k}</td><td><div style='width:{300 * v / top:.0f}px'></div></td><td>{v}</td></tr>" for k, v in data)
    return f"<h2>{escape(title)}</h2><table class=bars>{rows}</table>"


def render(report: dict) -> str:
    stats = report["stats"]
    sizes = [(int(k), v) for k, v in stats["distribution"].items()]
    facts = {k: v for k, v in (report | stats).items() if k not in ("stats", "distribution")}
    table = "".join(f"<tr><th>{escape(str(k))}</th><td>{escape(json.dumps(v))}</td></tr>" for k, v in facts.items())
    return (
        "<!doctype html><meta charset=utf-8><title>Duplicate reads</title>"
        "<style>body{font:14px sans-serif;margin:2em}.bars div{background:#468;height:1em}th{text-align:left}</style>"
        f"<h1>Duplicate reads</h1><table>{table}</table>"
        + _bars("Groups by size", sizes)
        + _bars("Reads by group size", [(k, k * v) for k, v in sizes])
    )


def write_report(report: dict, page: str, data: str | None = None) -> None:
    """The page, and the report as JSON if `data` names a file for it."""
    for path, text in ((page, render(report)), (data, json.dumps(report, indent=2) + "\n")):
        if path:
            store, inner = open_store(path)
            with store.open_output_stream(inner) as out:
                out.write(text.encode())
