"""Markdown sinks: the rows are shaped by Spark, a report of some hundred lines is written by the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.dates import MONTHS_LONG


def cadence_report(rows: DataFrame, at: str) -> str:
    """One table row a source (S27, P15, M3). Python's own rounding formats the interval. rows: the probe_cadence_report query."""
    out = [f"# Cadência das fontes\n\n_{at}_\n", "| Fonte | País | Consultas | Mudanças | Erros | Última mudança | Intervalo | Cadência |", "|---|---|---|---|---|---|---|---|"]
    for r in rows.orderBy("source_id").toLocalIterator():  # one row a catalogue entry
        gap = f"{r.interval_days:.1f}d" if r.interval_days is not None else "—"
        out.append(f"| {r.name} | {r.country} | {r.probes} | {r.changes} | {r.errors} | {r.last_change or '—'} | {gap} | **{r.cadence}** |")
    return "\n".join(out) + "\n"


def newsletter(lines: DataFrame, as_of: str, title: str = "Resumo") -> str:
    """Events by start, then news, newest first (S27, P14, D12). lines: views.newsletter_lines()."""
    month = MONTHS_LONG[int(as_of[5:7]) - 1]
    parts = {}
    for section, order in (("events", F.asc_nulls_first("at")), ("news", F.desc_nulls_last("at"))):
        parts[section] = [r.line for r in lines.filter(F.col("section") == section).orderBy(order, "id").toLocalIterator()]
    body = ["## Próximos eventos", "", *(parts["events"] or ["_Nenhum evento futuro registrado._"]), "", "## Notícias do último mês", "", *(parts["news"] or ["_Nenhuma notícia publicada no período._"])]
    return "\n".join([f"# {title} de {month} de {as_of[:4]}", "", f"_{as_of}_", "", *body]) + "\n"


def write(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
