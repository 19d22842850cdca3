"""DuckDB SQL text for the oracle side of rubric-style queries.

Generated from the same constants the Spark expressions use, so a word list
is written once.  This builds SQL strings only; nothing here executes.
"""

from __future__ import annotations

from ..functions.rubric import INDEX_DEMAND_FACTOR, DEFAULT_RUBRIC, Rubric, portable_regex


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(t: str, words) -> str:
    return " + ".join(f"CAST(contains({t}, {lit(w)}) AS INTEGER)" for w in dict.fromkeys(words)) or "0"


def _pats(t: str, pats) -> str:
    return " + ".join(f"CAST(regexp_matches({t}, {lit(portable_regex(p))}) AS INTEGER)" for p in pats) or "0"


def difficulty_sql(prompt: str, language: str, rubric: Rubric = DEFAULT_RUBRIC) -> dict[str, str]:
    p = f"coalesce({prompt}, '')"
    t = f"lower({p})"
    lg = f"lower(coalesce(nullif({language}, ''), {lit(rubric.default_language)}))"
    d, w = rubric.divisors, rubric.weights
    any_q = " OR ".join(f"contains({t}, {lit(x)})" for x in rubric.quality_any) or "false"
    corr = f"least(1.0, ({_words(t, rubric.correctness_words)} + {_pats(t, rubric.correctness_patterns)}) / {d[0]})"
    qual = f"least(1.0, ({_words(t, rubric.quality_words)} + CAST(({any_q}) AS INTEGER)) / {d[1]})"
    eff = f"least(1.0, ({_words(t, rubric.efficiency_words)} + {_pats(t, rubric.efficiency_patterns)}) / {d[2]})"
    doc = f"least(1.0, ({_words(t, rubric.documentation_words)}) / {d[3]})"
    demand = (f"least(1.0, greatest(0.0, ({w[0]} * {corr}) + ({w[1]} * {qual}) + ({w[2]} * {eff})"
              f" + ({w[3]} * {doc})))")
    lw = "CASE " + " ".join(f"WHEN {lg} = {lit(k)} THEN CAST({float(v)} AS DOUBLE)"
                            for k, v in rubric.language_weights.items()) + " ELSE CAST(1.0 AS DOUBLE) END"
    chars = f"CAST(length({p}) AS DOUBLE)"
    index = f"{chars} * ({lw}) * (1.0 + {INDEX_DEMAND_FACTOR} * {demand})"
    return {"token_len": "CAST(0.0 AS DOUBLE)", "char_len": chars, "lang_weight": f"CAST({lw} AS DOUBLE)",
            "rubric_demand": demand,
            "demand_correctness": corr, "demand_code_quality": qual, "demand_efficiency": eff,
            "demand_documentation": doc, "index": index}
