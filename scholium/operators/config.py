"""Rubrics and schemas in Markdown or YAML, and what they say of decisions, charted rows and ratings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rubric:
    question: str = ""
    rules: dict[str, list[str]] = field(default_factory=dict)
    themes: dict[str, str] = field(default_factory=dict)


_BULLET = re.compile(r"^\s*[-*]\s+(?P<text>.+)$")
_THEME = re.compile(r"^\s*[-*]\s+\*\*(?:theme\s+)?(?P<id>\w+)\s*[—–:-]+\s*(?P<text>[^*]+)\*\*", re.I)


def screening_rubric(markdown: str) -> Rubric:
    """A rubric of the headings "INCLUDE if", "EXCLUDE if", "MAYBE if" with lists of rules, a question, and themes in bold list items."""
    rules: dict[str, list[str]] = {"include": [], "exclude": [], "maybe": []}
    themes, question, head = {}, "", ""
    for line in markdown.split("\n"):
        if line.startswith("#"):
            head = line.strip("# ").lower()
        elif m := _THEME.match(line):
            themes[m["id"]] = m["text"].strip()
        elif head.startswith("review question") and line.strip() and not question:
            question = line.strip()
        elif m := _BULLET.match(line):
            for k in rules:
                if head.startswith(f"{k} if"):
                    rules[k].append(m["text"].strip())
    return Rubric(question, rules, themes)


def charting_schema(markdown: str) -> list[tuple[str, str, str]]:
    """(field, type, notes) of the table in a schema's text."""
    out = []
    for line in markdown.split("\n"):
        cells = [c.strip().strip("`") for c in line.strip().strip("|").split("|")]
        if line.strip().startswith("|") and len(cells) >= 2 and cells[0].lower() != "field" and not set(cells[0]) <= set("-: "):
            out.append((cells[0], cells[1], cells[2] if len(cells) > 2 else ""))
    return out


def rating_scales(yaml_text: str | None = None) -> dict[str, list[str]]:
    """Scales by dimension of a YAML list `dimensions`; without one, whether one agrees: yes, no or unsure. Bare yes and no stay text."""
    default = {"agree": ["yes", "no", "unsure"]}
    if not yaml_text:
        return default
    try:
        import yaml
    except ImportError as e:  # the only reader of YAML here
        raise RuntimeError("reading YAML needs PyYAML") from e
    dims = (yaml.load(yaml_text, Loader=yaml.BaseLoader) or {}).get("dimensions") or []
    return {str(d["id"]): [str(s) for s in d.get("scale", default["agree"])] for d in dims} or default


def _list(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def decision_warnings(decision: Column, themes: Column, known: list[str]) -> Column:
    """What a rubric has against a decision: an unknown one, unknown themes, none where there should be some, some where there should be none."""
    t = F.coalesce(themes, F.array().cast("array<string>"))
    ok = F.coalesce(decision.isin("include", "exclude", "maybe"), F.lit(False))
    more = F.array_compact(F.array(
        F.when(F.size(F.array_except(t, _list(known))) > 0, "unknown theme"), F.when(decision.isin("include", "maybe") & (F.size(t) == 0), "no themes"), F.when((decision == "exclude") & (F.size(t) > 0), "themes of an excluded record"),
    ))
    return F.when(ok, more).otherwise(F.array(F.lit("bad decision")))


def extraction_warnings(row: Column, fields: list[str]) -> Column:
    """Fields that a charted row (JSON text) has beyond the schema, and those it lacks."""
    keys = F.coalesce(F.json_object_keys(row), F.array().cast("array<string>"))
    extra, lacking = F.array_sort(F.array_except(keys, _list(fields))), F.array_sort(F.array_except(_list(fields), keys))
    return F.array_compact(F.array(F.when(F.size(extra) > 0, F.concat(F.lit("extra: "), F.array_join(extra, ", "))), F.when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))))


def rating_warnings(ratings: Column, scales: dict[str, list[str]]) -> Column:
    """Unknown dimensions of a map of ratings, and values outside their scale; empty ones are none."""
    out = F.filter(F.map_entries(ratings), lambda e: ~e["key"].isin(*scales) | (~_inside(e, scales) & (F.coalesce(e["value"], F.lit("")) != "")))
    return F.array_sort(F.transform(out, lambda e: F.when(e["key"].isin(*scales), F.concat(e["key"], F.lit(": "), e["value"])).otherwise(F.concat(F.lit("unknown: "), e["key"]))))


def _inside(e: Column, scales: dict[str, list[str]]) -> Column:
    ok = F.lit(False)
    for k, values in scales.items():
        ok = ok | ((e["key"] == k) & F.coalesce(e["value"].isin(*values), F.lit(False)))
    return ok


def split_by(df: DataFrame, problems: str) -> tuple[DataFrame, DataFrame]:
    """Rows without problems, and those with."""
    bad = F.size(problems) > 0
    return df.where(~bad), df.where(bad)
