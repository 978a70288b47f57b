"""Scorecards of a run: collected aggregates as JSON, Markdown or self-contained HTML."""

from __future__ import annotations

import html

from tidewright.operators import reports
from tidewright.plans.curator import Result

NO_CLAIM = "No policy was trained or evaluated, so nothing is claimed about the effect of this selection."


def scorecard(result: Result, effect: dict | None = None) -> dict:
    summary = reports.quality_summary(result.decisions).first().asDict()
    signals = [r.asDict() for r in reports.signal_report(result.scores).orderBy("signal").collect()]
    removed = [r.asDict() for r in result.decisions.where("not kept").orderBy("episode_index").toLocalIterator()]
    return {"summary": summary, "signals": signals, "removed": removed, "baseline_n": len(result.baseline or []), "effect": effect or NO_CLAIM, "config": result.spec.to_dict()}


def _number(x) -> str:
    return "–" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)


def markdown(card: dict) -> str:
    s = card["summary"]
    lines = ["# Curation scorecard", "", f"Kept {s['n_kept']} of {s['n']} episodes; removed {_number(s['pct_removed'])} %.", "", "| signal | better | scored | skipped | min | median | max |", "| --- | --- | --- | --- | --- | --- | --- |"]
    lines += [f"| {r['signal']} | {'higher' if r['higher_is_better'] else 'lower'} | {r['scored']} | {r['skipped']} | {_number(r['low'])} | {_number(r['median'])} | {_number(r['high'])} |" for r in card["signals"]]
    lines += ["", "## Removed", ""] + [f"- episode {r['episode_index']}: {r['reason']}" for r in card["removed"]]
    return "\n".join([*lines, "", card["effect"] if isinstance(card["effect"], str) else f"Effect: {card['effect']}", ""])


def html_page(card: dict) -> str:
    rows = "".join(f"<tr><td>{html.escape(r['signal'])}</td><td>{r['scored']}</td><td>{r['skipped']}</td><td>{_number(r['low'])}</td><td>{_number(r['median'])}</td><td>{_number(r['high'])}</td></tr>" for r in card["signals"])
    removed = "".join(f"<li>episode {r['episode_index']}: {html.escape(r['reason'])}</li>" for r in card["removed"])
    s = card["summary"]
    return f"<!DOCTYPE html><meta charset='utf-8'><title>Curation scorecard</title><h1>Curation scorecard</h1><p>Kept {s['n_kept']} of {s['n']} episodes.</p><table><tr><th>signal</th><th>scored</th><th>skipped</th><th>min</th><th>median</th><th>max</th></tr>{rows}</table><h2>Removed</h2><ul>{removed}</ul>"
