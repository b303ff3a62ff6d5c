"""Write oracle/edges.py: the result-edge casts every oracle query needs."""

import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402
from panelspark.plans import catalog  # noqa: E402

con = duckdb.connect()
folder = "/root/testdata/sf0.001"
for f in sorted(os.listdir(folder)):
    con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
out = {}
for name, spec in catalog.QUERIES.items():
    if spec.table not in oracle.BODIES or not spec.checked:
        continue
    sql = oracle.sql_for(spec.table, plain=True)
    try:
        types = con.sql(sql)
    except Exception as e:  # noqa: BLE001
        print(name, e, file=sys.stderr)
        continue
    double = [c for c, t in zip(types.columns, types.types) if str(t).startswith("DECIMAL") or str(t) == "FLOAT"]
    whole = [
        c for c, t in zip(types.columns, types.types)
        if str(t) in ("HUGEINT", "INTEGER", "SMALLINT", "TINYINT", "UINTEGER", "UBIGINT")
    ]
    keep = [c for c in double if c not in spec.rounded]
    if keep or whole:
        out[spec.table] = (" ".join(keep), " ".join(whole))
lines = ['"""Result-edge casts: which columns leave as DOUBLE and which as BIGINT."""', "", "EDGES = {"]
for name, (double, whole) in sorted(out.items()):
    lines += [f'    "{name}": (', f'        "{double}",', f'        "{whole}",', "    ),"]
target = os.path.join(os.path.dirname(oracle.__file__), "edges.py")
with open(target, "w") as handle:
    handle.write("\n".join([*lines, "}", ""]))
