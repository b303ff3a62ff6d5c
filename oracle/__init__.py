"""DuckDB SQL for the correctness check, written apart from the Spark code.

Every table is one named query; :func:`sql_for` collects the ones a result needs into a WITH
clause. Money is summed as DECIMAL and leaves as DOUBLE, like on the Spark side.
"""

import re

from oracle import analysis, edges, layers, quality, reports

BODIES = {**layers.BODIES, **quality.BODIES, **analysis.BODIES, **reports.BODIES}
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _needed(name, seen):
    for word in dict.fromkeys(_WORD.findall(BODIES[name])):
        if word in BODIES and word != name and word not in seen:
            _needed(word, seen)
    if name not in seen:
        seen.append(name)
    return seen


def sql_for(name, rounded=(), places=6, plain=False, fine=()):
    """Query for one table; ``plain`` leaves the result-edge casts out."""
    double, bigint = (c.split() for c in edges.EDGES.get(name, ("", "")))
    swaps = [f"CAST({c} AS DOUBLE) AS {c}" for c in double]
    swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in bigint]
    for columns, n in ((rounded, places), (fine, 6)):
        nudge = f"{2.0 * 10.0 ** -(n + 2)!r}::DOUBLE"  # exact halves fall one way, as on the Spark side
        swaps += [f"ROUND(CAST({c} AS DOUBLE) + {nudge}, {n}) + 0.0::DOUBLE AS {c}" for c in columns]
    star = f"* REPLACE ({', '.join(swaps)})" if swaps and not plain else "*"
    ctes = ",\n".join(f"{n} AS (\n{BODIES[n].strip()}\n)" for n in _needed(name, []))
    return f"WITH {ctes}\nSELECT {star} FROM {name}"
